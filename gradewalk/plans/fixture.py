"""A small hill graph of five nodes: the short way over a steep street, and the long gentle way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.operators.naming import assign_display_names
from gradewalk.schemas import EDGES, NODES
from gradewalk.sources.graph import complete, graph_schema

#: Nodes (id, lon, lat, x, y, z), and edges (id, source, target, street, length, time, width, wheelchair, samples).
NODE_ROWS = [(1, -122.4194, 37.7749, 0.0, 0.0, 0.0), (10, -122.4154, 37.7750, 350.0, 0.0, 0.0), (11, -122.4144, 37.7750, 441.44, 0.0, 14.6304), (20, -122.4160, 37.7780, 430.0, 120.0, 5.0), (99, -122.4090, 37.7755, 965.606, 0.0, 5.0)]
EDGE_ROWS = [
    (101, 1, 10, "Market Street", 350.0, 200.0, 2.4, "yes", [(0.0, 0.0), (350.0, 0.0)]),
    (102, 10, 11, "Steep Street", 91.44, 100.0, 2.0, "limited", [(0.0, 0.0), (91.44, 14.6304)]),
    (103, 11, 99, "Pine Street", 524.166, 300.0, 2.2, "yes", [(0.0, 14.6304), (524.166, 14.6304)]),
    (201, 1, 20, "Gentle Avenue", 430.0, 270.0, 2.5, "yes", [(0.0, 0.0), (100.0, 6.0), (430.0, 5.0)]),
    (202, 20, 99, "Gentle Avenue", 696.54, 390.0, 2.5, "yes", [(0.0, 5.0), (696.54, 5.0)]),
]


def edges_from(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Edges from dicts with any of their columns; the others take their defaults, metrics come from samples."""
    schema = graph_schema(EDGES)
    full = [tuple(r.get(f.name) for f in schema) for r in rows]
    return complete(spark.createDataFrame(full, schema), fill_time=True)


def hill_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(*n, "intersection") for n in NODE_ROWS], graph_schema(NODES))
    place = {n[0]: (n[1], n[2]) for n in NODE_ROWS}
    rows = [{"edge_id": i, "source": s, "target": t, "street_name": name, "length_m": length, "base_time_s": time, "sidewalk_availability": "both", "sidewalk_width_m": width, "wheelchair_access": chair,
             "geometry": [place[s], place[t]], "samples": [(d, z, z, None, None, None) for d, z in samples]} for i, s, t, name, length, time, width, chair, samples in EDGE_ROWS]
    return nodes, assign_display_names(edges_from(spark, rows)).withColumn("samples", F.col("samples"))
