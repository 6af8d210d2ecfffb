"""Results at ties, whole limits and large groups."""

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradewalk.functions import geo
from gradewalk.operators import alternatives, joins, naming, narrate, relaxation, routing
from gradewalk.plans import queries
from gradewalk.plans.fixture import edges_from, hill_graph
from gradewalk.schemas import prefs_for_mode, prefs_struct
from gradewalk.sources import graph

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_lengths_round_as_their_sql_does(spark):
    values = [10.24045, 10.24055, 0.5, 1.00005, -10.24045, 0.0, 123.45675, 450.00015] + [k * 0.00005 for k in range(1, 400)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").orderBy("i").select(queries.rounded(F.col("x"), 4)).collect()]
    assert got == [r[0] for r in duckdb.execute("select round(x, 4) + 0.0 from (select unnest(?::double[]) as x)", [values]).fetchall()]
    assert got[0] == 10.2404


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_connectors_reach_the_whole_limit(spark):
    edges = queries.walk_edges(spark, SF).where("length_m <= 50").groupBy("source", "target").agg(F.min("length_m").alias("s")).collect()
    want: dict[tuple, float] = {}
    starts = [r[0] for r in queries.table(spark, SF, "supplier").select("s_suppkey").collect()]
    for start in starts:
        cost = {start: 0.0}
        for _ in range(40):
            for e in edges:
                if e["source"] in cost and cost[e["source"]] + e["s"] <= min(300, cost.get(e["target"], 301) - 1e-9):
                    cost[e["target"]] = cost[e["source"]] + e["s"]
        want |= {(start, node): c for node, c in cost.items()}
    got = {(r["start"], r["node"]): r["cost"] for r in queries.connector_reach(spark, SF).collect()}
    assert got == pytest.approx(want) and max(got.values()) > 40


def test_frequent_cells_are_dealt_to_blocks(spark):
    """All lines in one cell: blocks of bounded size, more tasks than the session's partitions where pairs call for them."""
    rows = [(i, [(-122.44 + i * 1e-8, 37.77), (-122.44 + i * 1e-8, 37.7701)]) for i in range(90)]
    schema = "k long, geometry array<struct<lon:double,lat:double>>"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[:70], schema).withColumnRenamed("k", "m")
    place = lambda df: df.drop("geometry").withColumn("cell", F.lit(0))
    left, right = joins.blocks_of(place(a), place(b), ["cell"], side=16, task_pairs=100)
    assert left.rdd.getNumPartitions() == 63
    met = left.join(right, ["cell", "_a", "_b"])
    assert met.count() == met.select("k", "m").distinct().count() == 6_300
    assert met.groupBy("_a", "_b").count().agg(F.max("count")).first()[0] < 1_500
    assert joins.lines_within(a, "k", b, "m", 60.0).count() == 6_300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_distance_join_is_dealt_by_its_pairs(spark):
    """As many tasks as partitions at least, also where the customers' file is one split."""
    assert queries.distance_join(spark, SF).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_start_bounds_its_own_search(spark):
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(9)], "source long, target long, cost double")
    starts = spark.createDataFrame([(0, 0, 25.0), (3, 3, 40.0), (5, 5, 0.0)], "start long, node long, most double")
    got = {(r["start"], r["node"]) for r in routing.min_plus(edges, starts, 30.0).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (3, 5), (3, 6), (5, 5)}


def test_reached_names_are_the_best_of_all(spark):
    """Against every street that connectors reach, with equal bearings, both directions of a street and nodes without one; few pairs are scored."""
    rng = random.Random(4)
    at = {n: (-122.4 + rng.randrange(4) * 0.001, 37.7 + rng.randrange(4) * 0.001) for n in range(24)}
    rows = []
    for i in range(160):
        a, b = rng.sample(range(24), 2)
        named = rng.random() < 0.4 and a > 6 and b > 6
        rows.append({"edge_id": i, "source": a, "target": b, "length_m": float(rng.randrange(1, 120)), "edge_type": "residential" if named else "crossing", "street_name": f"Street {rng.randrange(5)}" if named else None, "geometry": [{"lon": x, "lat": y} for x, y in (at[a], at[b])]})
    edges = edges_from(spark, rows)
    bearing = {r["edge_id"]: r["b"] for r in edges.select("edge_id", geo.bearing(F.col("geometry")).alias("b")).collect()}
    far = {(n, n): 0.0 for n in at}
    for _ in range(24):
        for r in rows:
            for a, b in ((r["source"], r["target"]), (r["target"], r["source"])):
                for n in at:
                    if not r["street_name"] and (n, a) in far and far[n, a] + r["length_m"] <= min(300.0, far.get((n, b), 301.0)):
                        far[n, b] = far[n, a] + r["length_m"]
    want = {}
    for c in (r for r in rows if not r["street_name"]):
        turn = lambda s: abs(bearing[c["edge_id"]] - bearing[s["edge_id"]]) % 180.0  # noqa: B023, E731
        scores = [(far[n, m] + 1.5 * min(turn(s), 180.0 - turn(s)), s["street_name"]) for n in (c["source"], c["target"]) for s in rows if s["street_name"] for m in (s["source"], s["target"]) if (n, m) in far]
        if scores:
            want[c["edge_id"]] = min(scores)[1]
    assert {r["edge_id"]: r["reached_name"] for r in naming.reachable_names(edges).collect()} == want and len(want) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_streets_at_nodes_where_nobody_asks_do_not_count():
    asked = pa.table({"edge_id": [7, 8], "own": [10.0, 20.0], "node": [1, 4], "cost": [0.0, 5.0]})
    streets = pa.table({"node": [1, 2, 3, 4, 5], "street_name": ["far", "b", "c", "near", "e"], "bearing": [50.0, 10.0, 11.0, 22.0, 20.0]})
    found = naming._best_streets(asked, streets).to_pylist()
    assert [(r["edge_id"], r["score"], r["street_name"]) for r in found] == [(7, 60.0, "far"), (8, 8.0, "near")]


def test_routes_are_dealt_by_their_lines(spark):
    """The more lines, the more tasks, each with whole orders, up to the steps that the queries give."""
    n = queries.table(spark, SF, "lineitem").count()
    dealt = queries.routes(spark, SF, 500)
    tasks = dealt.rdd.getNumPartitions()
    assert tasks >= n // 500
    steps = narrate.direction_groups(dealt, key="street_name")
    assert steps.groupBy("route_id", "step").count().rdd.getNumPartitions() == tasks
    assert steps.select("route_id", F.spark_partition_id().alias("task")).distinct().groupBy("route_id").count().where("count > 1").count() == 0
    assert queries.routes(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_thinned_graph_bounds_the_whole(spark):
    """Least costs, and of these the fewest hops and the least edge, from two starts over 40 arcs a node with many ties; one goal that no way leads to."""
    rng = random.Random(5)
    arcs = [(k, 1000 * s + i, s, (s + 1 + rng.randrange(30)) % 200, float(rng.randrange(1, 12))) for k in (0, 1) for s in range(200) for i in range(40)]
    starts = [(0, 3), (0, 150), (1, 3)]
    want: dict[tuple, tuple] = {}
    for k, start in starts:
        label = {start: (0.0, 0, None)}
        for _ in range(200):
            better = {}
            for _, e, s, t, c in (a for a in arcs if a[0] == k):
                if s in label and (new := (label[s][0] + c, label[s][1] + 1, e)) < (better.get(t) or label.get(t) or (float("inf"),)) and t != start:
                    better[t] = new
            if not better:
                break
            label |= better
        want |= {(k, start, v): x for v, x in label.items()}
    frame = spark.createDataFrame(arcs, "kind int, edge_id long, source long, target long, step double").withColumn("seen", F.lit(True))
    first = spark.createDataFrame([(k, s, s, 0.0) for k, s in starts], "kind int, start long, node long, cost double")
    goals = [(k, s, (s + d) % 200) for k, s in starts for d in (60, 199)]
    asked = spark.createDataFrame(goals, "kind int, start long, node long")
    labels = lambda a, g: {(r["kind"], r["start"], r["node"]): (r["cost"], r["hops"], r["edge_id"]) for r in relaxation.seeded(first, ["kind", "start"], a, ["kind"], g).collect()}
    got = labels(frame, asked)
    assert {g: got[g] for g in goals} == {g: want[g] for g in goals}
    near = [(k, s, (s + 20) % 200) for k, s in starts]
    assert labels(frame, spark.createDataFrame([*near, (1, 3, 999)], "kind int, start long, node long")).keys() == want.keys()
    thin = relaxation.thinned(frame.where("kind = 0"), ["kind"], 4)
    assert thin.count() <= 4 * 200 and thin.groupBy("source").agg(F.min("step").alias("m")).join(frame.where("kind = 0").groupBy("source").agg(F.min("step").alias("all")), "source").where("m <> `all`").count() == 0


def test_paths_under_many_preferences_shuffle_no_texts(spark, monkeypatch):
    """Labels carry a number for the preferences, and costed arcs no columns of the street."""
    seen = []
    monkeypatch.setattr(routing, "seeded", lambda first, by, arcs, within, goals: seen.append((by, arcs.columns)) or relaxation.seeded(first, by, arcs, within, goals))
    nodes, edges = hill_graph(spark)
    kinds = spark.range(1).select(F.lit("p").alias("profile"), prefs_struct(prefs_for_mode("fastest")).alias("prefs"))
    asked = spark.createDataFrame([("a", "p", 1, 99)], "request_id string, profile string, start long, goal long")
    assert routing.joined_paths(asked, nodes, edges, kinds).first()["edge_ids"] == [101, 102, 103]
    assert seen == [(["kind", "start"], ["kind", "source", "target", "step", "edge_id"])]


def test_options_are_worked_out_once_for_their_features(spark):
    nodes, edges = hill_graph(spark)
    asked = spark.range(1).select(F.lit("r").alias("request_id"), F.lit(1).cast("long").alias("start"), F.lit(99).cast("long").alias("goal"), prefs_struct(prefs_for_mode("balanced")).alias("prefs"))
    options = alternatives.route_candidates(asked, nodes, edges)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ends = asked.select("request_id", "start", "goal")
    features = graph.route_features(options.mapInArrow(counted, options.schema), nodes, edges, ends)
    assert features.count() == 2 + 5 + 4 and seen.value == 2


def test_searches_hold_without_broadcast_labels(spark, monkeypatch):
    assert relaxation.SMALL <= 1 << 19  # 1,048,576 rows took over 200 MB of the driver, and a round hands out two tables
    rng = random.Random(8)
    arcs = spark.createDataFrame([(0, i, i % 40, rng.randrange(40), float(rng.randrange(1, 9))) for i in range(600)], "kind int, edge_id long, source long, target long, step double")
    first = spark.createDataFrame([(0, 3, 3, 0.0)], "kind int, start long, node long, cost double")
    goals = spark.createDataFrame([(0, 3, v) for v in (7, 11, 30)], "kind int, start long, node long")
    found = []
    for small in (relaxation.SMALL, 0):
        monkeypatch.setattr(relaxation, "SMALL", small)
        rows = relaxation.seeded(first, ["kind", "start"], arcs, ["kind"], goals).where(F.col("node").isin(7, 11, 30)).collect()
        found.append(sorted(tuple(r) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 3
