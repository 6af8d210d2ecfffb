"""A graph saved to a database and loaded again."""

import pytest
from pyspark.sql import functions as F

from gradewalk.plans.fixture import hill_graph
from gradewalk.sources import database, graph

PLAIN = {"Point": "VARCHAR(200)", "LineString": "VARCHAR(20000)", "text": "VARCHAR(2000)", "json": "VARCHAR(2000)"}
OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def content(spark, url):
    found = {}
    for t in graph.TABLES.values():
        df = spark.read.format("jdbc").options(url=url, dbtable=t, **OPTIONS).load()
        found[t] = sorted(map(str, df.collect()))
    return found


def test_saved_whole_or_not_at_all(spark, tmp_path):
    nodes, edges = hill_graph(spark)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    save = lambda n, e, **k: database.save_graph(n, e, url, OPTIONS, types=PLAIN, **k)
    save(nodes, edges)
    first = content(spark, url)
    assert any("SRID=4326;LINESTRING(" in r and "SRID=26910;LINESTRING(" in r for r in first["walk_edges"]) and any("SRID=26910;POINT(" in r for r in first["walk_nodes"])
    save(nodes, edges)  # again, in place of the old rows
    save(nodes, edges, truncate=False)  # again, beside them
    assert content(spark, url) == first
    # nodes take new values, edges and samples don't; new ones come in
    moved, slower = nodes.where("node_id = 1").withColumn("z_m", F.lit(99.0)), edges.where("edge_id = 101").withColumn("base_time_s", F.lit(1.0))
    fresh = edges.where("edge_id = 101").withColumn("edge_id", F.lit(7_000_000).cast("long"))
    save(moved, slower.unionByName(fresh), truncate=False)
    back_nodes, back_edges = database.load_graph(spark, url, OPTIONS, spatial=False)
    assert {r["node_id"]: r["z_m"] for r in back_nodes.collect()} == {r["node_id"]: 99.0 if r["node_id"] == 1 else r["z_m"] for r in nodes.collect()}
    assert back_edges.where("edge_id = 101").first()["base_time_s"] == edges.where("edge_id = 101").first()["base_time_s"] and back_edges.count() == edges.count() + 1
    kept = content(spark, url)
    # a task that fails, an edge to nowhere, an edge without a line, an id twice
    broken = edges.withColumn("street_name", F.when(F.col("edge_id") == 101, F.raise_error(F.lit("lost")).cast("string")).otherwise("x"))
    nowhere = edges.where("edge_id = 101").withColumns({"edge_id": F.lit(5).cast("long"), "target": F.lit(404).cast("long")})
    no_line = edges.where("edge_id = 101").withColumns({"edge_id": F.lit(6).cast("long"), "geometry": F.lit(None).cast(edges.schema["geometry"].dataType)})
    twice = nowhere.withColumn("target", F.col("source"))
    for n, e, truncate in ((moved, broken, True), (moved, nowhere, False), (moved, no_line, False), (nodes, twice.union(twice), True)):
        with pytest.raises(Exception):  # noqa: B017
            save(n.withColumn("z_m", F.lit(-5.0)), e, truncate=truncate)
        assert content(spark, url) == kept
    with database.transaction(spark, url, OPTIONS) as connection:
        assert not [t for t in database.existing_tables(connection) if t.startswith("walk_") and t not in graph.TABLES.values()]  # no staging is left


def test_loaded_by_ranges_of_ids(spark, tmp_path):
    nodes, edges = hill_graph(spark)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    more = spark.range(1000, 1200).select(F.col("id").alias("node_id"), (-122.5 + F.col("id") / 1e5).alias("lon"), F.lit(37.75).alias("lat"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("z_m"), F.lit("n").alias("node_type"))
    nodes = nodes.unionByName(more)
    database.save_graph(nodes, edges, url, OPTIONS, types=PLAIN)
    got_nodes, got_edges = database.load_graph(spark, url, OPTIONS, parts=8, spatial=False)
    assert got_nodes.rdd.getNumPartitions() == 8
    places = lambda df: sorted(map(tuple, df.select("node_id", "lon", "lat", "z_m", "node_type").collect()))
    assert places(got_nodes) == places(nodes)
    for c in edges.columns:
        ends = [{r["edge_id"]: r["v"] for r in df.select("edge_id", F.col(c).alias("v")).collect()} for df in (edges, got_edges)]
        assert ends[0] == ends[1], c
    read = database.table_in_parts(spark, url, OPTIONS, "walk_nodes", "node_id", "node_id, z_m", 8).where("node_id > 1100").select("node_id")
    assert "NODE_ID" in read._jdf.queryExecution().executedPlan().toString() and "GreaterThan(NODE_ID,1100)" in read._jdf.queryExecution().executedPlan().toString()


def test_every_missing_graph_fails_alike(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/none;create=true"
    empty = tmp_path / "empty.json"
    empty.write_text('{"version": "1", "nodes": [], "edges": []}')
    database.create_tables(spark, f"{tmp_path}/made".join(("jdbc:derby:", ";create=true")), OPTIONS, PLAIN)
    for load in (
        lambda: graph.read_json_graph(spark, str(tmp_path / "missing.json")), lambda: graph.read_json_graph(spark, str(empty)), lambda: graph.read_tables(spark, str(tmp_path / "missing")),
        lambda: database.load_graph(spark, url, OPTIONS, spatial=False), lambda: database.load_graph(spark, f"jdbc:derby:{tmp_path}/made", OPTIONS, spatial=False), lambda: database.load_graph(spark, f"jdbc:derby:{tmp_path}/nowhere", OPTIONS, spatial=False),
    ):
        with pytest.raises(graph.GraphUnavailable):
            load()
