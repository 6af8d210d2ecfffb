"""OpenStreetMap ways and city centerlines, read from saved JSON."""

from __future__ import annotations

import json
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.functions.text import format_street_name
from gradewalk.sources.members import members, says

#: Ways that can be walked, and access tags that close them.
WALKABLE = ["footway", "path", "pedestrian", "steps", "living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary", "crossing"]
CLOSED = ["no", "private", "customers", "permit"]
WITHOUT_SIDEWALK = ["footway", "path", "pedestrian", "steps", "crossing"]
ELEMENT = "struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:map<string,string>>"
FEATURE = "struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
OVERPASS, CENTERLINES = f"elements array<{ELEMENT}>", f"type string, features array<{FEATURE}>"


def is_walkable_way(tags: Column) -> Column:
    value = lambda k: F.lower(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    highway = F.coalesce(F.try_element_at(tags, F.lit("highway")), F.lit(""))
    return highway.isin(WALKABLE) & ~value("access").isin(CLOSED) & ~value("foot").isin(CLOSED) & ~((value("sidewalk") == "no") & ~highway.isin(WITHOUT_SIDEWALK))


#: Named boxes as south, west, north, east.
BOXES = {"page-duboce": (37.7678, -122.4412, 37.7744, -122.4314), "sf": (37.7070, -122.5155, 37.8335, -122.3550)}
SIDES = ("south", "west", "north", "east")


def box(preset: str = "sf", **sides: float | None) -> dict[str, float]:
    """A named box, each side replaced by the one that is given."""
    if preset not in BOXES:
        raise ValueError(f"no box is named {preset}")
    if set(sides) - set(SIDES):
        raise TypeError("a box has the sides south, west, north and east")
    return dict(zip(SIDES, BOXES[preset], strict=True)) | {k: float(v) for k, v in sides.items() if v is not None}


def overpass_query(south: float, west: float, north: float, east: float, timeout_s: int = 120) -> str:
    """Walkable ways in a box and their nodes, as a query of the Overpass service."""
    ways = f'way["highway"~"^({"|".join(sorted(WALKABLE))})$"]({south},{west},{north},{east});'
    settings, members = f"[out:json][timeout:{timeout_s}];", "(._;>;);"
    return f"{settings}({ways});{members}out body;"


def box_segments(spark: SparkSession, within: dict[str, float], to: str, url: str, timeout_s: int = 120) -> DataFrame:
    """Walkable segments in a box: the service's answer is kept in the file ``to``, which all executors must see."""
    fetch(url, to, overpass_query(**within, timeout_s=timeout_s), timeout_s)
    return segments(read_overpass(spark, to))


def fetch(url: str, to: str, query: str | None = None, timeout_s: float = 120) -> None:
    """Download JSON to a file on the driver, for Spark to read; the top level must be an object."""
    data = urlencode({"data": query}).encode() if query else None
    with urlopen(Request(url, data=data), timeout=timeout_s) as answer:
        payload = json.loads(answer.read())
    if not isinstance(payload, dict):
        raise ValueError("the answer isn't a JSON object")
    with open(to, "w") as f:
        json.dump(payload, f)


def read_overpass(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Elements of saved answers, one row each, with ``way_idx``, their place.

    ``split`` reads a large answer in many tasks; without it each file is one task's.
    """
    if split:
        return members(spark, path, "elements").select(F.col("nth").cast("int").alias("way_idx"), F.from_json("json", ELEMENT).alias("e")).select("way_idx", "e.*")
    return spark.read.schema(OVERPASS).json(path, multiLine=True).select(F.posexplode("elements").alias("way_idx", "e")).select("way_idx", "e.*")


def segments(elements: DataFrame, most: int | None = None) -> DataFrame:
    """Consecutive node pairs of walkable ways: way_idx, pos, osm_way_id, ends, geometry, tags.

    Pairs with a missing node or equal ends go.  ``most`` keeps the first so many in order.
    """
    nodes = elements.where("type = 'node'").select("id", "lat", "lon")
    ways = elements.where((F.col("type") == "way") & is_walkable_way(F.col("tags")))
    chain = ways.select("way_idx", F.col("id").alias("osm_way_id"), "tags", F.posexplode("nodes").alias("pos", "source"), "nodes").withColumn("target", F.get("nodes", F.col("pos") + 1)).where(F.col("target").isNotNull()).drop("nodes")
    a, b = nodes.toDF("source", "s_lat", "s_lon"), nodes.toDF("target", "t_lat", "t_lon")
    pairs = chain.join(a, "source").join(b, "target").where((F.col("s_lat") != F.col("t_lat")) | (F.col("s_lon") != F.col("t_lon")))
    point = lambda p: F.struct(F.col(f"{p}_lon").alias("lon"), F.col(f"{p}_lat").alias("lat"))
    out = pairs.select("way_idx", "pos", "osm_way_id", F.col("source").alias("source_osm_node_id"), F.col("target").alias("target_osm_node_id"), F.array(point("s"), point("t")).alias("geometry"), "tags")
    return out.orderBy("way_idx", "pos").limit(most) if most is not None else out


def edge_attributes(tags: Column) -> dict[str, Column]:
    value = lambda k: F.when(F.try_element_at(tags, F.lit(k)) != "", F.try_element_at(tags, F.lit(k)))
    highway = F.coalesce(value("highway"), F.lit("path"))
    return {
        "street_name": value("name"), "edge_type": highway, "access": F.coalesce(value("access"), value("foot"), F.lit("unknown")), "sidewalk_availability": value("sidewalk"),
        "sidewalk_width_m": F.lit(None).cast("double"), "wheelchair_access": value("wheelchair"), "stairs": highway == "steps", "surface": value("surface"),
    }


def read_centerlines(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """One row a line: line_id, display_name, dataset, feature_id, active, geometry, properties.

    Features without a name, or of other shapes than lines, go; parts of a multi-line are numbered, and
    those with fewer than two points go without renumbering.  Another top level than a FeatureCollection fails.
    ``split`` reads a large document in many tasks; without it each file is one task's.
    """
    if split:
        if says(spark, path, "type", "FeatureCollection").where("not said").limit(1).count():
            raise ValueError("not a FeatureCollection")
        return _centerlines(members(spark, path, "features").select(F.col("nth").cast("int").alias("feature"), F.from_json("json", FEATURE).alias("f")))
    doc = spark.read.schema(CENTERLINES).json(path, multiLine=True)
    features = doc.select(F.posexplode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("not a FeatureCollection")).cast(doc.schema["features"].dataType))).alias("feature", "f"))
    return _centerlines(features)


def _centerlines(features: DataFrame) -> DataFrame:
    value = lambda k: F.when(F.try_element_at("f.properties", F.lit(k)) != "", F.try_element_at("f.properties", F.lit(k)))
    parts = F.when(F.col("f.geometry.type") == "LineString", F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))).when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    rows = features.select("feature", F.coalesce(value("streetname"), value("streetname_gc")).alias("name"), value("cnn").alias("cnn"), truthy(F.try_element_at("f.properties", F.lit("active"))).alias("active"), F.col("f.properties").alias("properties"), parts.alias("parts")).where(F.col("name").isNotNull())
    lines = rows.select("*", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "line")).where(F.size("line") >= 2)
    return lines.select(
        (F.col("feature").cast("long") * 1_000_000 + F.col("part")).alias("line_id"),
        format_street_name(F.col("name")).alias("display_name"), F.lit("datasf_streets_active_retired").alias("dataset"),
        F.when(F.col("n_parts") > 1, F.concat_ws(":", "cnn", F.col("part").cast("string"))).otherwise(F.col("cnn")).alias("feature_id"), "active",
        F.transform("line", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("geometry"), "properties")


def truthy(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(v.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))
