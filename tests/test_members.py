"""Members of large JSON documents, read in blocks that cut through them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gradewalk.sources.graph import GraphUnavailable, read_json_graph
from gradewalk.sources.members import members, pieces, says
from gradewalk.sources.osm import read_centerlines, read_overpass

TRAPS = ["a}b", '{"elements":[{', 'x\\"}', "é]}[{", "\\", '"', "plain", '],"elements":[{']


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def elements(n):
    draw = random.Random(n)
    some = lambda i: draw.choice(TRAPS) * draw.randint(1, 9)
    return [{"type": "way" if i % 3 else "node", "id": i, "nodes": [i, i + 1], "tags": {"name": some(i), "elements": "z"}, "elements": [{"a": 1}, {"b": [{}]}]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_members_as_json_has_them(small_blocks, tmp_path, indent):
    spark, want, path = small_blocks, elements(120), tmp_path / "a.json"
    doc = {"version": 0.6, "bbox": [1, 2], "x": {"y": {"z": 1}, "q": 2}, "generator": '"elements":[{}', "other": [{"k": 1}, {"k": {}}], "elements": want, "more": [{"id": 5}, {"elements": [{}]}], "none": [], "type": "T"}
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)))
    got = members(spark, str(path), "elements").orderBy("nth").collect()
    assert [json.loads(r.json) for r in got] == want and [r.nth for r in got] == list(range(120))
    assert pieces(spark, str(path)).select("block").distinct().count() >= 3
    assert [json.loads(r.json) for r in members(spark, str(path), "more").orderBy("nth").collect()] == doc["more"]
    assert members(spark, str(path), "none").count() == members(spark, str(path), "bbox").count() == members(spark, str(path), "absent").count() == 0
    assert says(spark, str(path), "type", "T").first().said and not says(spark, str(path), "type", "way").first().said
    same = [sorted(read_overpass(spark, str(path), split=s).collect(), key=lambda r: r.way_idx) for s in (False, True)]
    assert same[0] == same[1] and len(same[0]) == 120


def test_files_are_numbered_each_for_itself(small_blocks, tmp_path):
    for k in (3, 60):
        (tmp_path / f"{k}.json").write_text(json.dumps({"elements": elements(k)}))
    got = members(small_blocks, str(tmp_path), "elements").groupBy("file").agg(F.min("nth").alias("a"), F.max("nth").alias("b"), F.count("*").alias("n")).collect()
    assert sorted((r.a, r.b, r.n) for r in got) == [(0, 2, 3), (0, 59, 60)]


def test_centerlines_in_blocks(small_blocks, tmp_path):
    line = lambda i: {"type": "MultiLineString", "coordinates": [[[i, 1.5], [i, 2.5]], [[0.0, i], [1.0, i]]]} if i % 2 else {"type": "LineString", "coordinates": [[i, 1.0], [i, 2.0]]}
    features = [{"type": "Feature", "geometry": line(i), "properties": {"streetname": f"{TRAPS[i % len(TRAPS)]} ST", "cnn": str(i), "active": "true"}} for i in range(150)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"features": features, "type": "FeatureCollection"}))
    whole, cut = (sorted(read_centerlines(small_blocks, str(path), split=s).collect(), key=lambda r: r.line_id) for s in (False, True))
    assert whole == cut and len(cut) == 225
    path.write_text(json.dumps({"type": "Feature", "features": features}))
    with pytest.raises(ValueError, match="FeatureCollection"):
        read_centerlines(small_blocks, str(path), split=True)


def test_graph_in_blocks(small_blocks, tmp_path):
    nodes = [{"node_id": i, "lat": 37.7 + i / 1e4, "lon": -122.4, "x": float(i), "y": 0.0, "z_m": 1.0} for i in range(80)] + [{"node_id": 3, "lat": 1.0, "lon": 2.0}]
    edges = [{"edge_id": i, "source": i, "target": i + 1, "street_name": TRAPS[i % len(TRAPS)], "length_m": 10.0, "geometry": [[-122.4, 37.7], [-122.4, 37.8]]} for i in range(79)]
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"version": "1", "nodes": nodes, "edges": edges}, indent=1))
    for k, key in ((0, "node_id"), (1, "edge_id")):
        whole, cut = (sorted(read_json_graph(small_blocks, str(path), split=s)[k].collect(), key=lambda r: r[key]) for s in (False, True))
        assert whole == cut and len(cut) == (80, 79)[k]
    path.write_text(json.dumps({"version": "1", "nodes": nodes, "edges": []}))
    with pytest.raises(GraphUnavailable):
        read_json_graph(small_blocks, str(path), split=True)
    with pytest.raises(GraphUnavailable):
        read_json_graph(small_blocks, str(tmp_path / "absent.json"), split=True)
