"""Hill sessions over a stream of samples: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hill_sessions(samples: DataFrame, gap: str = "20 seconds", late: str = "1 minute", min_grade: float = 0.06) -> DataFrame:
    """Sessions of steep samples (walker, ts, grade, climb_m): those at most ``gap`` apart are one hill.

    Works on streams and tables alike; on streams, samples later than ``late`` are dropped by the watermark.
    """
    steep = samples.withWatermark("ts", late).where(F.col("grade") >= min_grade)
    return steep.groupBy("walker", F.session_window("ts", gap).alias("w")).agg(F.sum("climb_m").alias("climb_m"), F.max("grade").alias("max_grade"), F.count("*").alias("n")).select("walker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "climb_m", "max_grade", "n")
