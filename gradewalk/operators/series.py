"""Elevation series: one row a sample, keyed by edge, ordered by distance.

All operators share one window by key and distance, so a chain of them sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STEEP = (0.06, 0.08, 0.10, 0.12)


def along(key: str | list[str], d: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(d)


def checked_distances(df: DataFrame, key: str = "edge_id", d: str = "dist_m") -> DataFrame:
    """Fails where distances don't rise strictly; the check rides on the distance column, so it can't be pruned."""
    before = F.lag(d).over(along(key, d))
    return df.withColumn("_before", before).withColumn(d, F.when(F.col("_before") >= F.col(d), F.raise_error(F.lit("distances must rise strictly")).cast("double")).otherwise(F.col(d))).drop("_before")


def grade(key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> Column:
    """Slope from the sample before; null at the first.  Distances that don't rise strictly fail."""
    w = along(key, d)
    return rising(key, d, (F.col(z) - F.lag(z).over(w)) / (F.col(d) - F.lag(d).over(w)))


def rising(key: str, d: str, value: Column) -> Column:
    """``value``, or a failure where the distance isn't above the one before; it needs no window of its own."""
    return checked(F.lag(d).over(along(key, d)) >= F.col(d), value)


def checked(wrong: Column, value: Column) -> Column:
    return F.when(wrong, F.raise_error(F.lit("distances must rise strictly")).cast("double")).otherwise(value)


def rolling_grade(window_m: float, key: str | list[str] = "edge_id", d: str = "dist_m", z: str = "z_smooth_m", carried: Column | None = None) -> Column:
    """Slope over the trailing ``window_m``, its start interpolated between samples; 0 at the first sample.

    ``carried``: the last sample (d, z) before those of the key, null if there is none.
    """
    if window_m <= 0:
        raise ValueError("the window must be positive")
    # frames bounded by a fraction can only be said in SQL
    keys = ", ".join(f"`{k}`" for k in ([key] if isinstance(key, str) else key))
    at, over = f"named_struct('d', `{d}`, 'z', `{z}`)", f"over (partition by {keys} order by `{d}` range between"
    left = F.coalesce(F.expr(f"max({at}) {over} unbounded preceding and {float(window_m)}D preceding)"), *([] if carried is None else [carried]), F.expr(f"min({at}) {over} unbounded preceding and current row)"))
    right = F.expr(f"min({at}) {over} {float(window_m)}D preceding and current row)")
    start = F.greatest(F.col(d) - window_m, left["d"])
    start_z = F.when(right["d"] > left["d"], left["z"] + (start - left["d"]) / (right["d"] - left["d"]) * (right["z"] - left["z"])).otherwise(left["z"])
    return F.when(F.col(d) > start, (F.col(z) - start_z) / (F.col(d) - start)).otherwise(0.0)


def with_grades(df: DataFrame, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    return df.withColumns({"grade": grade(key, d, z), "rolling_grade_20m": rolling_grade(20.0, key, d, z), "rolling_grade_50m": rolling_grade(50.0, key, d, z)})


def gain_loss(df: DataFrame, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    dz = df.withColumn("_dz", rising(key, d, F.col(z) - F.lag(z).over(along(key, d))))
    return dz.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_dz") > 0, F.col("_dz"))), F.lit(0.0)).alias("gain_m"), F.coalesce(F.sum(F.when(F.col("_dz") <= 0, -F.col("_dz"))), F.lit(0.0)).alias("loss_m"))


def edge_grade_metrics(df: DataFrame, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    """Fourteen metrics an edge; all 0 below two samples."""
    w = along(key, d)
    return metrics_of(with_grades(df, key, d, z).withColumns({"_dz": F.col(z) - F.lag(z).over(w), "_dd": F.col(d) - F.lag(d).over(w)}), key, d, z)


def metrics_of(graded: DataFrame, key: str, d: str, z: str) -> DataFrame:
    """The metrics of samples with their grades and the steps ``_dd`` and ``_dz`` from the sample before."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    most = lambda c: zero(F.greatest(F.lit(0.0), F.max(c)))
    up, down = most(F.col("grade")), most(-F.col("grade"))
    first, last = F.min_by(F.col(z), F.col(d)), F.max_by(F.col(z), F.col(d))
    span = F.max(d) - F.min(d)
    out = [
        zero(F.sum(F.when(F.col("_dz") > 0, F.col("_dz")))).alias("gain_m"), zero(F.sum(F.when(F.col("_dz") <= 0, -F.col("_dz")))).alias("loss_m"),
        F.when(span > 0, (last - first) / span).otherwise(0.0).alias("mean_grade"),
        up.alias("max_uphill_grade"), down.alias("max_downhill_grade"), F.greatest(up, down).alias("max_abs_grade"),
    ]
    for m in (20, 50):
        out += [most(F.col(f"rolling_grade_{m}m")).alias(f"sustained_uphill_grade_{m}m"), most(-F.col(f"rolling_grade_{m}m")).alias(f"sustained_downhill_grade_{m}m")]
    out += [zero(F.sum(F.when(F.col("grade") > t, F.col("_dd")))).alias(f"length_above_{round(100 * t)}pct_up_m") for t in STEEP]
    return graded.groupBy(key).agg(*out)


def reversed_samples(df: DataFrame, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    """The series walked the other way, its grades computed anew; it begins at 0."""
    turned = df.withColumn(d, F.max(d).over(Window.partitionBy(key)) - F.col(d))
    return with_grades(turned, key, d, z)
