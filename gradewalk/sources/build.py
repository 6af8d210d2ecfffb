"""From raw segments to a directed, graded, named graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.functions import geo
from gradewalk.operators.naming import assign_display_names
from gradewalk.operators.series import edge_grade_metrics, reversed_samples
from gradewalk.operators.smoothing import smooth_profile
from gradewalk.schemas import EDGE_DEFAULTS, EDGES
from gradewalk.sources.graph import WALKING_SPEED, graph_schema
from gradewalk.sources.osm import edge_attributes
from gradewalk.storage import stored


def densified(segments: DataFrame, spacing_m: float = 20.0) -> DataFrame:
    """(edge_id, seq, lon, lat, dist_m): k evenly spaced points between each two, k the whole spacings in their distance.

    Points lie on the geodesic.
    """
    if spacing_m <= 0:
        raise ValueError("the spacing must be positive")
    points = segments.select("edge_id", F.posexplode("geometry").alias("i", "p"))
    w = Window.partitionBy("edge_id").orderBy("i")
    pairs = points.withColumn("q", F.lead("p").over(w)).withColumn("line", geo.geodesic(F.col("p"), F.col("q"))).withColumn("length", F.coalesce("line.distance_m", F.lit(0.0)))
    k = F.when(F.col("q").isNull(), 0).otherwise(F.floor(F.col("length") / spacing_m).cast("int"))
    steps = pairs.withColumn("k", k).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k"))))
    share = F.col("j") / (F.col("k") + 1)
    at = F.when(F.col("j") == 0, F.struct("p.lon", "p.lat")).otherwise(geo.geodesic_at(F.col("p"), F.col("line.azimuth"), share * F.col("length")))
    dense = steps.select("edge_id", "i", "j", at.alias("at")).select("edge_id", "i", "j", "at.lon", "at.lat")
    order = Window.partitionBy("edge_id").orderBy("i", "j")
    here, before = F.struct("lon", "lat"), F.lag(F.struct("lon", "lat")).over(order)
    dense = dense.withColumn("step", F.coalesce(geo.geodesic_m(before, here), F.lit(0.0)))
    return dense.select("edge_id", (F.row_number().over(order) - 1).alias("seq"), "lon", "lat", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("dist_m"))


def numbered(segments: DataFrame, range_ways: int = 1 << 16) -> DataFrame:
    """Segments with ``number``, their place from 0 in order of way_idx and pos: sums over ranges of ways, then over the ways of a range."""
    in_way = segments.withColumn("_nth", F.row_number().over(Window.partitionBy("way_idx").orderBy("pos")) - 1)
    ways = segments.groupBy("way_idx").agg(F.count("*").alias("n")).withColumn("_range", F.floor(F.col("way_idx") / range_ways))
    until = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ways.groupBy("_range").agg(F.sum("n").alias("n")).withColumn("_before", until(Window.orderBy("_range"))).drop("n")
    ways = ways.withColumn("_inside", until(Window.partitionBy("_range").orderBy("way_idx"))).join(ranges, "_range")
    return in_way.join(ways.select("way_idx", (F.col("_before") + F.col("_inside")).alias("_first")), "way_idx").withColumn("number", F.col("_first") + F.col("_nth")).drop("_first", "_nth")


def both_ways(segments: DataFrame) -> DataFrame:
    """Directed edges of segments (edge_id, odd, and the ends as ``*_osm_node_id``): the edge back has the next id and the line turned round."""
    rest = ["osm_way_id", "tags"]
    ends = lambda a, b: [F.col(f"{a}_osm_node_id").alias("source"), F.col(f"{b}_osm_node_id").alias("target")]
    forward = segments.select("edge_id", *ends("source", "target"), "geometry", *rest)
    back = segments.select((F.col("edge_id") + 1).alias("edge_id"), *ends("target", "source"), F.reverse("geometry").alias("geometry"), *rest)
    return forward.unionByName(back)


def build_directed_graph(segments: DataFrame, heights: Callable[[DataFrame], DataFrame], spacing_m: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges.  ``segments`` as from ``osm.segments``; ``heights`` adds z_m to points (lat, lon).

    Segment i gives edge 2i + 1 forward and 2i + 2 backward.  A node's height is the smoothed height at
    the last segment that touches it, its target end after its source end.
    """
    base = stored(numbered(segments).withColumn("edge_id", 2 * F.col("number") + 1))
    dense = densified(base, spacing_m)
    places = heights(dense.select("lat", "lon").distinct())
    raw = dense.join(places, ["lat", "lon"]).select("edge_id", "dist_m", F.col("z_m").alias("z_raw_m"), F.col("z_m").alias("z_smooth_m"))
    forward = stored(smooth_profile(raw).select("edge_id", "dist_m", "z_raw_m", "z_smooth_m", "grade", "rolling_grade_20m", "rolling_grade_50m"))
    backward = reversed_samples(forward.withColumn("edge_id", F.col("edge_id") + 1))
    samples = forward.unionByName(backward)
    lists = samples.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("dist_m", "z_raw_m", "z_smooth_m", "grade", "rolling_grade_20m", "rolling_grade_50m"))).alias("samples"))
    length = geo.geometry_length_m(F.col("geometry"))
    both = both_ways(base).withColumns({**edge_attributes(F.col("tags")), "source_tags": F.col("tags"), "length_m": length, "base_time_s": length / WALKING_SPEED}).drop("tags")
    both = both.join(lists, "edge_id", "left").join(edge_grade_metrics(samples), "edge_id", "left")
    fields = graph_schema(EDGES)
    have = set(both.columns)
    edges = both.select(*(F.col(f.name) if f.name in have else F.lit(EDGE_DEFAULTS.get(f.name)).cast(f.dataType).alias(f.name) for f in fields))
    ends = forward.groupBy("edge_id").agg(F.min_by("z_smooth_m", "dist_m").alias("z_first"), F.max_by("z_smooth_m", "dist_m").alias("z_last"))
    touched = base.join(ends, "edge_id").select("edge_id", F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.col("source_osm_node_id").alias("node_id"), F.get("geometry", F.lit(0)).alias("p"), F.col("z_first").alias("z")),
        F.struct(F.lit(1).alias("end"), F.col("target_osm_node_id").alias("node_id"), F.element_at("geometry", -1).alias("p"), F.col("z_last").alias("z")))).alias("t"))
    nodes = touched.groupBy("t.node_id").agg(F.max_by(F.col("t"), F.struct("edge_id", "t.end")).alias("t"))
    x, y = geo.utm10(F.col("t.p.lon"), F.col("t.p.lat"))
    nodes = nodes.select("node_id", F.col("t.p.lon").alias("lon"), F.col("t.p.lat").alias("lat"), x.alias("x"), y.alias("y"), F.col("t.z").alias("z_m"), F.lit("osm_node").alias("node_type"))
    return nodes, assign_display_names(edges)
