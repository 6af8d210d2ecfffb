"""Hampel filter and Savitzky-Golay smoothing over row frames of a few samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.operators.series import along, with_grades

#: Quadratic smoothing weights for 5 and 7 samples, a row for each place in the window.
WEIGHTS = {
    5: (35.0, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]),
    7: (42.0, [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4], [-6, 3, 9, 12, 12, 9, 3], [-3, 0, 3, 6, 9, 12, 15], [5, -3, -6, -4, 3, 15, 32]]),
}


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def hampel(value: str, key: str, order: str, window: int = 5, n_sigmas: float = 3.0) -> Column:
    """Values far from the median of their window become it; where the window's deviation is 0, any other value does."""
    half = window // 2
    around = F.collect_list(value).over(along(key, order).rowsBetween(-half, half))
    return hampel_of(F.col(value), around, n_sigmas)


def hampel_of(x: Column, around: Column, n_sigmas: float = 3.0) -> Column:
    m = median(around)
    spread = median(F.transform(around, lambda v: F.abs(v - m)))
    odd = F.when(spread == 0, x != m).otherwise(F.abs(x - m) > n_sigmas * 1.4826 * spread)
    return F.when(odd, m).otherwise(x)


def savgol(df: DataFrame, value: str, key: str, order: str, into: str) -> DataFrame:
    """Quadratic smoothing by rows: 7 samples wide, 5 for series of 5 or 6, none below; ends use the first or last window."""
    w = along(key, order)
    df = df.withColumns({"_n": F.count("*").over(Window.partitionBy(key)), "_at": F.row_number().over(w), "_around": F.collect_list(value).over(w.rowsBetween(-6, 6))})

    def smoothed(width: int) -> Column:
        scale, rows = WEIGHTS[width]
        half = width // 2
        n, at = F.col("_n").cast("int"), F.col("_at")
        row = F.when(at <= half, at - 1).when(at > n - half, width - 1 - (n - at)).otherwise(half)
        begin = F.when(at <= half, 1).when(at > n - half, n - width + 1).otherwise(at - half)  # of the series
        values = F.slice("_around", begin - F.greatest(at - 6, F.lit(1)) + 1, width)
        weights = F.get(F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in rows)), row)
        return F.aggregate(F.zip_with(values, weights, lambda v, k: v * k), F.lit(0.0), lambda s, x: s + x) / scale

    return df.withColumn(into, F.when(F.col("_n") < 5, F.col(value)).when(F.col("_n") < 7, smoothed(5)).otherwise(smoothed(7))).drop("_n", "_at", "_around")


def smooth_profile(df: DataFrame, key: str = "edge_id", d: str = "dist_m", raw: str = "z_raw_m", smooth: str = "z_smooth_m") -> DataFrame:
    """Hampel, then quadratic smoothing, of the raw heights, then grades; series below three samples keep their smooth heights."""
    w = along(key, d)
    df = df.withColumn("_count", F.count("*").over(Window.partitionBy(key)))
    around = F.when(F.col("_count") == 3, F.collect_list(raw).over(w.rowsBetween(-1, 1))).otherwise(F.collect_list(raw).over(w.rowsBetween(-2, 2)))
    df = df.withColumn("_window", around).withColumn("_h", hampel_of(F.col(raw), F.col("_window")))
    df = savgol(df, "_h", key, d, "_s").withColumn(smooth, F.when(F.col("_count") < 3, F.col(smooth)).otherwise(F.col("_s")))
    return with_grades(df.drop("_count", "_window", "_h", "_s"), key, d, smooth)
