"""Series and routes dealt to ranges, against the plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from gradewalk.operators import narrate, ranged, series

KIND = "edge_id long, dist_m double, z_raw_m double, z_smooth_m double"


def rows_of(df, *order):
    return [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*order).collect()]


def walks(spark, seed):
    """Dense stretches, gaps over many ranges, samples on borders, one sample alone, a key that is null."""
    rng = random.Random(seed)
    rows = []
    for key in (1, 2, 3, None):
        at = rng.choice([0.0, -130.0, 49.5])
        for _ in range(1 if key == 3 else 220):
            z = rng.uniform(0, 40)
            rows.append((key, at, z, z))
            at = rng.choice([at + rng.uniform(0.1, 9), at + 25.0, (at // 60 + 1) * 60.0, (at // 60 + 1) * 60.0 + 10.0, at + rng.uniform(40, 900) if rng.random() < 0.1 else at + 1.0])
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize(("range_m", "block"), [(50.0, 2), (60.0, 3), (60.0, 1024), (1e9, 1)])
def test_grades_over_ranges(spark, range_m, block):
    df = walks(spark, int(range_m) % 1000 + block).cache()
    got = ranged.stepped(df, range_m, block=block).drop("_dd", "_dz")
    assert got.columns == series.with_grades(df).columns
    assert rows_of(got, "edge_id", "dist_m") == rows_of(series.with_grades(df), "edge_id", "dist_m")


def test_metrics_and_reversal_over_ranges(spark):
    df = walks(spark, 8).cache()
    want = {r["edge_id"]: r.asDict() for r in series.edge_grade_metrics(df).collect()}
    for r in ranged.edge_grade_metrics(df, 60.0).collect():
        assert r.asDict() == pytest.approx(want.pop(r["edge_id"]))
    assert not want
    assert rows_of(ranged.reversed_samples(df.where("edge_id is not null"), 60.0), "edge_id", "dist_m") == rows_of(series.reversed_samples(df.where("edge_id is not null")), "edge_id", "dist_m")


def test_no_samples_and_wrong_ones(spark):
    assert ranged.with_grades(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(Exception, match="rise strictly"):
        ranged.with_grades(spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 70.0, 1.0, 1.0), (1, 70.0, 2.0, 2.0)], KIND), 60.0).collect()
    with pytest.raises(ValueError, match="shorter"):
        ranged.with_grades(spark.createDataFrame([], KIND), 49.0)


def test_tasks_hold_ranges(spark):
    """One key with all rows: no window's group is more than a range and its halo."""
    df = spark.range(40_000).select(F.lit(1).cast("long").alias("edge_id"), (F.col("id") * 2.5).alias("dist_m"), F.sin(F.col("id") / 50).alias("z_raw_m"), F.sin(F.col("id") / 50).alias("z_smooth_m"))
    assert rows_of(ranged.with_grades(df, 1000.0), "dist_m") == rows_of(series.with_grades(df), "dist_m")
    plan = ranged.with_grades(df, 1000.0)._jdf.queryExecution().optimizedPlan().toString()
    # every window over samples is by range too; that over blocks alone is by key
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert windows and sum("_range" not in line and "_block" not in line for line in windows) == 0


def legs(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for route in (1, 2, None):
        pos = 0
        for _ in range(n):
            pos += rng.choice([1, 1, 1, 2, 37])  # ranges without a row
            steep = rng.random() < 0.4
            g = rng.choice([0.06, 0.07, 0.11]) if steep else 0.01
            rows.append((route, pos, rng.choice(["A", "A", "A", "B", None]), rng.choice([2.0, 5.0, 8.5, 30.0]), g, g, g, 1.0, 0.5, 0.25))
    return spark.createDataFrame(rows, "route_id long, pos long, street_name string, length_m double, sustained_uphill_grade_20m double, sustained_uphill_grade_50m double, max_uphill_grade double, gain_m double, length_above_8pct_up_m double, length_above_10pct_up_m double")


@pytest.mark.parametrize(("range_rows", "block"), [(1, 2), (7, 3), (50, 1024), (10**6, 4)])
def test_hills_over_ranges(spark, range_rows, block):
    df = legs(spark, range_rows + block).cache()
    want, got = narrate.hill_events(df), ranged.hill_events(df, range_rows, block=block)
    assert got.columns == want.columns and rows_of(got, "route_id", "event") == rows_of(want, "route_id", "event")
    runs = [f.orderBy("route_id", "pos").select("step") for f in (narrate.direction_groups(df, key="street_name"), ranged.direction_groups(df, range_rows, key="street_name", block=block))]
    assert runs[0].collect() == runs[1].collect()


def test_one_event_over_all_ranges(spark):
    df = legs(spark, 1, 5).limit(1).drop("route_id", "pos").crossJoin(spark.range(100).select(F.lit(1).alias("route_id"), F.col("id").alias("pos"))).withColumns({"street_name": F.lit("A"), "length_m": F.lit(2.0), "max_uphill_grade": F.lit(0.2)})
    (one,) = ranged.hill_events(df, 8, block=2).collect()
    assert (one["start_m"], one["end_m"], one["elevation_gain_m"]) == (0.0, 200.0, 100.0)
