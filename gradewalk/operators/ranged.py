"""Series and routes of any length: a key's rows are dealt to ranges, so that no key is one task.

A range takes what it needs of the rows before it from two sides: a halo, which is copies of the rows just before it, and a
state, which the ranges before it hand on.  States combine associatively (sums, latest values), first within blocks of
ranges and then over blocks, so a window holds a block's ranges or a key's blocks, never a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.operators import narrate, series

#: Ranges that one window combines.
BLOCK = 1024
HALO_M = 50.0


def handed_on(states: DataFrame, key: str, sums: tuple[str, ...] = (), latest: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(key, _range, ...): for each row its own and all smaller ranges' states combined.

    ``latest`` are structs that begin with what they're ordered by, so that the latest is the greatest; one that no range has is null.
    """
    names = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(latest, F.max)}
    rows = states.groupBy(key, "_range").agg(*(f(c).alias(c) for c, f in names.items())).withColumn("_block", F.floor(F.col("_range") / block))
    totals = rows.groupBy(key, "_block").agg(*(f(c).alias(f"_{c}") for c, f in names.items()))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), *(f(f"_{c}").over(earlier).alias(f"_{c}") for c, f in names.items()))
    within = Window.partitionBy(key, "_block").orderBy("_range")
    rows = rows.withColumns({c: f(c).over(within) for c, f in names.items()})
    joined = rows.join(totals, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    both = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {c: F.coalesce(c, f"_{c}") for c in latest}
    return joined.select(key, "_range", *(v.alias(c) for c, v in both.items()))


def with_state(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows with the state of their range."""
    named = state.withColumnsRenamed({key: "_key", "_range": "_of"})
    return df.join(named, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")), "left").drop("_key", "_of")


# ---- series ----


def stepped(df: DataFrame, range_m: float = 10_000.0, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m", block: int = BLOCK) -> DataFrame:
    """``series.with_grades`` for series of any length, and the steps ``_dd`` and ``_dz`` from the sample before.

    A range is ``range_m`` of distance, at least the halo of 50 m; what a task holds is a range's samples.  The rest of what
    lies before a range is one sample: the last one before the halo, wherever it is.
    """
    if range_m < HALO_M:
        raise ValueError(f"a range can't be shorter than {HALO_M} m")
    dealt = df.withColumn("_range", F.floor(F.col(d) / range_m))
    halo_from = (F.col("_range") + 1) * range_m - HALO_M
    sample = F.struct(F.col(d).alias("d"), F.col(z).alias("z"))
    ends = dealt.groupBy(key, "_range").agg(F.max(sample).alias("last"), F.max(F.when(F.col(d) < halo_from, sample)).alias("early"))
    # the next range has a halo, so it needs the last sample before that; later ones need the last of all
    told = ends.select(key, F.explode(F.array(F.struct("_range", F.when(F.lit(False), F.col("last")).alias("carried")), F.struct((F.col("_range") + 1).alias("_range"), F.col("early").alias("carried")), F.struct((F.col("_range") + 2).alias("_range"), F.col("last").alias("carried")))).alias("t")).select(key, "t.*")
    copies = F.when(F.col(d) >= halo_from, F.array(F.struct("_range", F.lit(False).alias("_copy")), F.struct((F.col("_range") + 1).alias("_range"), F.lit(True).alias("_copy")))).otherwise(F.array(F.struct("_range", F.lit(False).alias("_copy"))))
    rows = dealt.withColumn("_to", F.explode(copies)).withColumns({"_range": F.col("_to._range"), "_copy": F.col("_to._copy")}).drop("_to")
    rows = with_state(rows, handed_on(told, key, latest=("carried",), block=block), key)
    keys = [key, "_range"]
    before = F.coalesce(F.lag(sample).over(series.along(keys, d)), F.col("carried"))
    rows = rows.withColumn("_before", before)
    right = series.checked(F.col("_before.d") >= F.col(d), F.col(z) - F.col("_before.z"))
    graded = rows.withColumns({
        "_dz": right, "_dd": F.col(d) - F.col("_before.d"),
        "rolling_grade_20m": series.rolling_grade(20.0, keys, d, z, F.col("carried")), "rolling_grade_50m": series.rolling_grade(50.0, keys, d, z, F.col("carried"))})
    return graded.withColumn("grade", F.col("_dz") / F.col("_dd")).where(~F.col("_copy")).select(*df.columns, "grade", "rolling_grade_20m", "rolling_grade_50m", "_dd", "_dz")


def with_grades(df: DataFrame, range_m: float = 10_000.0, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    return stepped(df, range_m, key, d, z).drop("_dd", "_dz")


def edge_grade_metrics(df: DataFrame, range_m: float = 10_000.0, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    """The fourteen metrics; all of them combine from parts before the shuffle."""
    return series.metrics_of(stepped(df, range_m, key, d, z), key, d, z)


def reversed_samples(df: DataFrame, range_m: float = 10_000.0, key: str = "edge_id", d: str = "dist_m", z: str = "z_smooth_m") -> DataFrame:
    """The series walked the other way; each key's end comes from an aggregate, not from a window over its samples."""
    ends = df.groupBy(F.col(key).alias("_key")).agg(F.max(d).alias("_end"))
    turned = df.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn(d, F.col("_end") - F.col(d)).select(*df.columns)
    return with_grades(turned, range_m, key, d, z)


# ---- routes ----


def numbered_runs(df: DataFrame, same: Column, route: str, pos: str, name: str, block: int = BLOCK) -> DataFrame:
    """Runs numbered from 1 over ranges: ``same`` says that a row goes on with the run of the row before it."""
    marked = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    counts = marked.groupBy(route, "_range").agg(F.sum("_new").alias("n"))
    told = counts.select(route, F.explode(F.array(F.struct("_range", F.lit(0).cast("long").alias("runs")), F.struct((F.col("_range") + 1).alias("_range"), F.col("n").alias("runs")))).alias("t")).select(route, "t.*")
    w = Window.partitionBy(route, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return with_state(marked, handed_on(told, route, sums=("runs",), block=block), route).withColumn(name, F.col("runs") + F.sum("_new").over(w)).drop("_new", "runs")


def row_before(df: DataFrame, route: str, pos: str, fields: list[str], block: int = BLOCK) -> DataFrame:
    """Rows with ``_before``: position and ``fields`` of the row before, in this range or any earlier one."""
    row = F.struct(F.col(pos), *fields)
    ends = df.groupBy(route, "_range").agg(F.max_by(row, F.col(pos)).alias("last"))
    told = ends.select(route, F.explode(F.array(F.struct("_range", F.when(F.lit(False), F.col("last")).alias("carried")), F.struct((F.col("_range") + 1).alias("_range"), F.col("last").alias("carried")))).alias("t")).select(route, "t.*")
    carried = with_state(df, handed_on(told, route, latest=("carried",), block=block), route)
    return carried.withColumn("_before", F.coalesce(F.lag(row).over(Window.partitionBy(route, "_range").orderBy(pos)), F.col("carried"))).drop("carried")


def hill_events(df: DataFrame, range_rows: int = 100_000, route: str = "route_id", pos: str = "pos", min_grade: float = 0.06, gap_m: float = 20.0, block: int = BLOCK) -> DataFrame:
    """``narrate.hill_events`` for routes of any length; positions are whole numbers, unique in a route.

    Three states are handed on: the distance walked, the last steep edge (an event may be open across any number of
    ranges) and the number of events.
    """
    dealt = narrate.steepness(df).withColumn("_range", F.floor(F.col(pos) / range_rows))
    told = dealt.groupBy(route, "_range").agg(F.sum("length_m").alias("m")).select(route, F.explode(F.array(F.struct("_range", F.lit(0.0).alias("walked")), F.struct((F.col("_range") + 1).alias("_range"), F.col("m").alias("walked")))).alias("t")).select(route, "t.*")
    w = Window.partitionBy(route, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    placed = with_state(dealt, handed_on(told, route, sums=("walked",), block=block), route).withColumn("_end", F.col("walked") + F.sum("length_m").over(w))
    steep = placed.withColumn("_start", F.col("_end") - F.col("length_m")).where(F.col("_g") >= min_grade)
    steep = row_before(steep, route, pos, ["street_name", "_end"], block)
    same = F.col("_before.street_name").eqNullSafe(F.col("street_name")) & (F.col("_start") - F.col("_before._end") <= gap_m)
    return narrate.summed_events(numbered_runs(steep, same, route, pos, "event", block), route, pos)


def direction_groups(df: DataFrame, range_rows: int = 100_000, route: str = "route_id", pos: str = "pos", key: str = "direction_key", block: int = BLOCK) -> DataFrame:
    """``narrate.direction_groups`` for routes of any length; a run may go on across ranges."""
    rows = row_before(df.withColumn("_range", F.floor(F.col(pos) / range_rows)), route, pos, [key], block)
    same = F.col("_before").isNotNull() & F.col(f"_before.{key}").eqNullSafe(F.col(key))
    return numbered_runs(rows, same, route, pos, "step", block).drop("_range", "_before")
