"""Nearest nodes by descent through a tree of cells, all points a level at a time.

Places are points of the unit sphere, so that no pole and no date line is special: a chord grows with the great circle it
spans.  A cell knows how many places it has and the tightest box around them.  A point goes on only into cells that can
hold something nearer than what its cells so far are sure to hold, so it visits few cells a level, however far away it is
and however large the nodes' extent.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewalk.functions import geo
from gradewalk.storage import stored

#: The finest cells are 2**-BITS of the extent; a level halves a side STEP times.
BITS, STEP = 20, 2
LEVELS = BITS // STEP
#: Cells of a level that every task may hold.
MOST_BROADCAST = 50_000
#: Rounding of chords; a hundredth of a millimetre on the ground.
SLACK = 1e-12
AXES = ("x", "y", "z")


class CellTree(NamedTuple):
    """``cells``: level, parent, cell, leaf and box; ``leaves``: level, cell, node_id, n_lat, n_lon; ``sizes``: cells of each level."""

    cells: DataFrame
    leaves: DataFrame
    sizes: dict[int, int]


def on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return {"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)}


def real(*names: str) -> Column:
    """Neither null nor NaN."""
    found = F.lit(True)
    for c in names:
        found = found & F.col(c).isNotNull() & ~F.isnan(c)
    return found


def build_cell_tree(nodes: DataFrame, most: int = 32) -> CellTree | None:
    """Cells of ``nodes`` (node_id, lat, lon); one with ``most`` places at most isn't divided.  None where no node has a place.

    Of nodes at one place the least id stands for all.  Places nearer to each other than the finest cell share one.
    """
    places = nodes.where(real("lat", "lon")).groupBy(F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon")).agg(F.min("node_id").alias("node_id"))
    places = stored(places.withColumns(on_sphere(F.col("n_lat"), F.col("n_lon"))))
    box = places.agg(*(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("low", F.min), ("high", F.max)))).first()
    if box["low_x"] is None:
        return None
    side = max(box[f"high_{c}"] - box[f"low_{c}"] for c in AXES)
    at = {c: F.least(F.floor((F.col(c) - box[f"low_{c}"]) / side * 2**BITS), F.lit(2**BITS - 1)).cast("long") if side > 0 else F.lit(0).cast("long") for c in AXES}
    key = lambda up: F.expr(" + ".join(f"shiftright(i{c}, {BITS} - {STEP} * (level - {up})) * {2 ** (BITS * k)}L" for k, c in enumerate(AXES)))
    deep = places.withColumns({f"i{c}": v for c, v in at.items()}).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("cell", key(0))
    counted = deep.withColumn("parent", F.when(F.col("level") > 0, key(1)).otherwise(F.lit(-1).cast("long"))).groupBy("level", "parent", "cell").agg(
        F.count("*").alias("n"), *(f(f"n_{c}").alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))), *(f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("low", F.min), ("high", F.max))))
    counted = stored(counted.withColumn("leaf", (F.col("n") <= most) | (F.col("level") == LEVELS)))
    divided = counted.where(~F.col("leaf")).select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    cells = stored(counted.where("level = 0").unionByName(counted.join(divided, ["level", "parent"], "left_semi").select(counted.columns)))
    leaves = stored(deep.join(cells.where("leaf").select("level", "cell"), ["level", "cell"]).select("level", "cell", "node_id", "n_lat", "n_lon"))
    return CellTree(cells, leaves, {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()})


def _bounds() -> tuple[Column, Column]:
    """Squares of the chord to a cell's box: none of its places is nearer than the first, one is as near as the second.

    Every side of a tight box has a place on it, so the second is the least of the three near sides' farthest corners.
    """
    gap, near, far = {}, {}, {}
    for c in AXES:
        p, low, high = F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")
        gap[c] = F.pow(F.greatest(low - p, p - high, F.lit(0.0)), 2)
        near[c] = F.pow(F.least(F.abs(p - low), F.abs(p - high)), 2)
        far[c] = F.pow(F.greatest(F.abs(p - low), F.abs(p - high)), 2)
    # a box in space is loose for a point straight north or south of it, where latitudes say more
    apart = F.radians(F.greatest(F.col("low_lat") - F.col("lat"), F.col("lat") - F.col("high_lat"), F.lit(0.0)))
    low = F.greatest(gap["x"] + gap["y"] + gap["z"], 4 * F.pow(F.sin(apart / 2), 2))
    aside = F.radians(F.least(F.lit(180.0), F.greatest(F.abs(F.col("lon") - F.col("low_lon")), F.abs(F.col("lon") - F.col("high_lon")))))
    half = lambda angle: F.pow(F.sin(angle / 2), 2)
    rims = (4 * (half(F.radians(F.col("lat") - F.col(c))) + F.cos(F.radians("lat")) * F.cos(F.radians(c)) * half(aside)) for c in ("low_lat", "high_lat"))
    return low, F.least(*rims, *(near[c] + sum((far[o] for o in AXES if o != c), F.lit(0.0)) for c in AXES))


def candidate_leaves(asked: DataFrame, tree: CellTree) -> DataFrame:
    """(lat, lon, level, cell): the leaves that may hold the nearest place of each of the distinct places ``asked``."""
    a_point = Window.partitionBy("lat", "lon")
    can_win = F.sqrt("low") <= F.sqrt("sure") + SLACK
    front = asked.select("lat", "lon").withColumns(on_sphere(F.col("lat"), F.col("lon"))).withColumns({"cell": F.lit(-1).cast("long"), "sure": F.lit(8.0)})
    low, high = _bounds()
    met: DataFrame | None = None
    for level in sorted(tree.sizes):
        children = tree.cells.where(F.col("level") == level).withColumnRenamed("cell", "child")
        if tree.sizes[level] <= MOST_BROADCAST:
            children = F.broadcast(children)
        into = front.join(children, F.col("cell") == F.col("parent")).select("lat", "lon", *AXES, "level", F.col("child").alias("cell"), "leaf", low.alias("low"), F.least("sure", high).alias("sure"))
        into = stored(into.withColumn("sure", F.min("sure").over(a_point)).where(can_win))
        ends = into.where("leaf").select("lat", "lon", "level", "cell", "low", "sure")
        met = ends if met is None else met.union(ends)
        front = into.where("not leaf").select("lat", "lon", *AXES, "cell", "sure")
    # a leaf met early may have lost to cells met later
    return met.withColumn("sure", F.min("sure").over(a_point)).where(can_win).select("lat", "lon", "level", "cell")


def nearest(points: DataFrame, tree: CellTree) -> DataFrame:
    """(point_id, node_id, distance_m) of ``points`` (point_id, lat, lon); ties go to the least id; points without a place have no row."""
    placed = points.where(real("lat", "lon")).select("point_id", "lat", "lon")
    near = candidate_leaves(placed.select("lat", "lon").distinct(), tree).join(tree.leaves, ["level", "cell"])
    near = near.withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")))
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("distance_m", "node_id")).alias("b"))
    return placed.join(best, ["lat", "lon"]).select("point_id", "b.node_id", "b.distance_m")
