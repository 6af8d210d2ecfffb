"""Databases, caches, boxes and numbering."""

import os
import time

import pytest
from pyspark.sql import functions as F

from gradewalk.functions.cost import edge_cost
from gradewalk.operators import breaks, naming, narrate, routing, series
from gradewalk.plans.fixture import hill_graph
from gradewalk.schemas import prefs_for_mode, prefs_struct
from gradewalk.sources import build, elevation, graph, osm


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_graph_through_a_database(spark, tmp_path):
    nodes, edges = hill_graph(spark)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": ""}
    options.pop("createTableColumnTypes")
    graph.write_jdbc(nodes, edges, url, options)
    back_nodes, back_edges = graph.read_jdbc(spark, url, options, spatial=False)
    assert rows(back_nodes, *nodes.columns) == rows(nodes, *nodes.columns)
    plain = [c for c in edges.columns if c not in ("samples", "geometry", "source_tags")]
    assert rows(back_edges, *plain) == rows(edges, *plain)
    same = lambda df: {r["edge_id"]: (r["geometry"], r["samples"], r["source_tags"]) for r in df.collect()}
    assert same(back_edges) == same(edges)
    # what is there already: nodes are replaced, edges stay
    moved = nodes.where("node_id = 1").withColumn("z_m", F.lit(99.0))
    slower = edges.where("edge_id = 101").withColumn("base_time_s", F.lit(1.0))
    graph.write_jdbc(moved, slower, url, options, truncate=False)
    again_nodes, again_edges = graph.read_jdbc(spark, url, options, spatial=False)
    assert again_nodes.count() == nodes.count() and again_nodes.where("node_id = 1").first()["z_m"] == 99.0
    assert again_edges.count() == edges.count() and again_edges.where("edge_id = 101").first()["base_time_s"] == 200.0


def test_lines_of_a_spatial_database(spark):
    df = spark.createDataFrame([('{"type":"LineString","coordinates":[[-122.5,37.5],[-122.25,37.75]]}', '{"highway": "path"}')], "geometry string, source_tags string")
    r = graph.decoded(df).first()
    assert [tuple(p) for p in r["geometry"]] == [(-122.5, 37.5), (-122.25, 37.75)] and r["source_tags"] == {"highway": "path"}


def test_heights_are_asked_for_once_and_kept(spark, tmp_path):
    log = tmp_path / "asked"

    def ask(keys):
        with open(log, "a") as f:
            f.writelines(k + "\n" for k in keys)
        return [float(k.split(",")[0]) for k in keys]

    points = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "lat double, lon double")
    path = str(tmp_path / "cache")
    assert rows(elevation.heights(points, ask, cache_path=path), "lat", "z_m") == [(1.0, 1.0), (1.0, 1.0), (3.0, 3.0)]
    more = points.union(spark.createDataFrame([(5.0, 6.0)], points.schema))
    assert elevation.heights(more, ask, cache_path=path).where("z_m is null").count() == 0
    assert sorted(log.read_text().split()) == ["1.0000000,2.0000000", "3.0000000,4.0000000", "5.0000000,6.0000000"]
    assert rows(elevation.provided(points, "flat", z_m=7.0), "z_m") == [(7.0,)] * 3
    with pytest.raises(ValueError):
        elevation.provided(points, "nowhere")


def test_boxes_and_their_query():
    assert osm.box("sf", north=37.8, west=None) == {"south": 37.7070, "west": -122.5155, "north": 37.8, "east": -122.3550}
    query = osm.overpass_query(**osm.box("page-duboce"))
    assert query.startswith("[out:json][timeout:120];(way[") and "(37.7678,-122.4412,37.7744,-122.4314)" in query and query.endswith("(._;>;);out body;")
    with pytest.raises(ValueError):
        osm.box("atlantis")


def test_box_segments_from_a_saved_answer(spark, tmp_path, monkeypatch):
    answer = '{"elements": [{"type": "node", "id": 1, "lat": 0.0, "lon": 0.0}, {"type": "node", "id": 2, "lat": 0.0, "lon": 0.1}, {"type": "way", "id": 9, "nodes": [1, 2], "tags": {"highway": "path"}}]}'
    asked = []

    def fetch(url, to, query, timeout_s):
        asked.append((url, query))
        with open(to, "w") as f:
            f.write(answer)

    monkeypatch.setattr(osm, "fetch", fetch)
    got = osm.box_segments(spark, osm.box(), str(tmp_path / "answer.json"), "http://localhost/api")
    assert rows(got, "osm_way_id", "source_osm_node_id", "target_osm_node_id") == [(9, 1, 2)] and "way[" in asked[0][1]


def test_numbers_go_over_ranges_of_ways(spark):
    ways = spark.createDataFrame([(w, p) for w in (0, 3, 4, 9, 10, 30) for p in range(w % 3 + 1)], "way_idx long, pos int").repartition(3)
    got = sorted((r["way_idx"], r["pos"], r["number"]) for r in build.numbered(ways, range_ways=4).collect())
    assert [n for _, _, n in got] == list(range(len(got)))


def test_official_names_are_counted(spark):
    edges = spark.createDataFrame([("datasf_centerline",), ("osm",), (None,)], "name_source string")
    assert tuple(naming.official_count(edges).first()) == (1, 3)


def test_rolling_grade_before_the_plain_one(spark):
    df = spark.createDataFrame([("a", 0.0, None, None), ("a", 10.0, None, 0.2), ("a", 20.0, 0.0, 0.5), ("a", 30.0, 0.3, 0.0)], "k string, d double, rolling_grade_20m double, grade double")
    assert rows(df.select("d", breaks.sample_grade().alias("g")), "d", "g") == [(0.0, 0.0), (10.0, 0.2), (20.0, 0.0), (30.0, 0.3)]
    assert rows(breaks.extrema_breakpoints(df, "k", "d", breaks.sample_grade()), "at") == [(10.0,), (20.0,)]
    assert rows(breaks.threshold_breakpoints(df, "k", "d", breaks.sample_grade(), (0.1,)), "at") == [(5.0,), (15.0,), (pytest.approx(20 + 10 / 3),)]


def test_distances_that_fall_fail_in_every_grade(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 1.0)], "edge_id long, dist_m double, z_smooth_m double")
    for made in (series.with_grades(df), series.gain_loss(df), series.edge_grade_metrics(df), series.reversed_samples(df)):
        with pytest.raises(Exception, match="rise strictly"):
            made.collect()


def test_hill_events_have_an_end_and_the_display_name(spark):
    _, edges = hill_graph(spark)
    df = edges.where("edge_id in (101, 102)").withColumns({"route_id": F.lit("r"), "pos": F.col("edge_id") - 101, "display_name": F.lit("Shown")})
    (r,) = narrate.hill_events(df).collect()
    assert (r["street_name"], r["direction"], r["start_m"]) == ("Shown", "uphill", 350.0) and r["end_m"] == pytest.approx(441.44)


def test_paths_by_joins_cost_edges_as_they_are_reached(spark):
    nodes, edges = hill_graph(spark)
    kinds = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(m).alias("profile"), prefs_struct(prefs_for_mode(m)).alias("prefs")) for m in ("fastest", "avoid_hills")))).alias("k")).select("k.*")
    asked = spark.createDataFrame([("a", "fastest", 1, 99), ("b", "avoid_hills", 1, 99), ("c", "fastest", 99, 1)], "request_id string, profile string, start long, goal long")
    got = {r["request_id"]: r["edge_ids"] for r in routing.joined_paths(asked, nodes, edges, kinds).collect()}
    costs = edges.crossJoin(kinds).select("profile", "edge_id", "source", "target", edge_cost(F.col("prefs")).alias("cost"))
    want = {r["request_id"]: r["edge_ids"] for r in routing.shortest_paths(asked, nodes, costs).collect()}
    assert got == want == {"a": [101, 102, 103], "b": [201, 202], "c": None}


def test_one_rate_and_no_key_twice(spark, tmp_path):
    """Four tasks under one rate; a request that fails once loses no answer that came before it."""
    log = tmp_path / "asked"

    def ask(keys):
        if any(k.startswith("7.") for k in keys):
            try:
                os.mkdir(f"{log}.failed")
            except FileExistsError:
                pass
            else:
                raise OSError("no answer")
        with open(log, "a") as f:
            f.write(f"{time.time()} {' '.join(keys)}\n")
        return [float(k.split(",")[0]) for k in keys]

    points = spark.range(48).select((F.col("id") % 24).cast("double").alias("lat"), F.lit(2.0).alias("lon"))
    path = str(tmp_path / "heights")
    for _ in range(3):  # a session that allows no second attempt fails, and the next call goes on
        try:
            got = elevation.heights(points, ask, cache_path=path, batch=2, rate=8.0).collect()
            break
        except Exception:  # noqa: BLE001
            time.sleep(6)  # until the killed tasks have ended
    assert sorted((r["lat"], r["z_m"]) for r in got) == sorted((float(i % 24), float(i % 24)) for i in range(48))
    lines = [x.split(" ", 1) for x in log.read_text().splitlines()]
    asked = [k for x in lines for k in x[1].split()]
    assert os.path.isdir(f"{log}.failed") and len(asked) == len(set(asked)) == 24
    times = sorted(float(x[0]) for x in lines)
    for i, t in enumerate(times):
        assert sum(t <= u < t + 1 for u in times[i:]) <= 8 + 2  # a request's own time may shift it a little
    assert not os.path.exists(path + ".answers") and elevation.cached(points, path).count() == 24
