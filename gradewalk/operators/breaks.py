"""Where to cut segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.operators.series import along


def regular_breakpoints(length: Column, every: float = 15.0) -> Column:
    """0, every, 2 * every and so on below the length, and the exact end; a length of 0 has 0 alone."""
    if every <= 0:
        raise ValueError("the spacing must be positive")
    good = F.when(length < 0, F.raise_error(F.lit("a length can't be negative")).cast("double")).otherwise(length)
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(good / every).cast("int") - 1, F.lit(0))), lambda i: F.round(i * F.lit(float(every)), 6))
    return F.when(good == 0, F.array(F.lit(0.0))).otherwise(F.concat(F.filter(steps, lambda s: s < good), F.array(good)))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sample_grade() -> Column:
    """The grade that segments are cut by: the rolling one over 20 m, else the plain one, else 0."""
    return F.coalesce("rolling_grade_20m", "grade", F.lit(0.0))


def threshold_breakpoints(df: DataFrame, key: str, d: str, g: str | Column, thresholds: tuple[float, ...] = (0.06, 0.10, 0.12)) -> DataFrame:
    """(key, threshold, at): where the absolute grade crosses a threshold, interpolated between samples."""
    w = along(key, d)
    pairs = df.select(key, F.col(d).alias("_d"), F.abs(F.coalesce(_column(g), F.lit(0.0))).alias("_l"), F.lead(d).over(w).alias("_d2"), F.abs(F.coalesce(F.lead(_column(g)).over(w), F.lit(0.0))).alias("_r")).where(F.col("_d2").isNotNull())
    pairs = pairs.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in sorted(map(abs, thresholds))))))
    t, left, right = F.col("threshold"), F.col("_l"), F.col("_r")
    crossed = pairs.where(((left < t) & (t <= right)) | ((right < t) & (t <= left)))
    return crossed.select(key, "threshold", (F.col("_d") + (t - left) / (right - left) * (F.col("_d2") - F.col("_d"))).alias("at"))


def extrema_breakpoints(df: DataFrame, key: str, d: str, g: str | Column, prominence: float = 0.02) -> DataFrame:
    """(key, at): strict peaks and valleys of the grade that stand out from both neighbours."""
    w = along(key, d)
    x = F.coalesce(_column(g), F.lit(0.0))
    rows = df.select(key, F.col(d).alias("at"), x.alias("_x"), F.lag(x).over(w).alias("_b"), F.lead(x).over(w).alias("_a"))
    up, down = F.col("_x") - F.col("_b"), F.col("_x") - F.col("_a")
    return rows.where(((up > 0) & (down > 0) | (up < 0) & (down < 0)) & (F.least(F.abs(up), F.abs(down)) >= prominence)).select(key, "at")


def merge_breakpoints(points: Column, min_gap: float = 3.0) -> Column:
    """Sorted points; one nearer than ``min_gap`` to the last is merged with it at their mean."""
    good = F.transform(points, lambda p: F.when(p < 0, F.raise_error(F.lit("a breakpoint can't be negative")).cast("double")).otherwise(p))
    empty = F.array().cast("array<double>")

    def step(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        apart = (F.size(done) == 0) | (p - last >= min_gap)
        return F.when(apart, F.concat(done, F.array(p))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array((last + p) / 2)))

    return F.aggregate(F.array_sort(good), empty, step)
