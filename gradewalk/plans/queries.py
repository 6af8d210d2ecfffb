"""Queries over the driver's tables, each with the SQL that says the same.

The tables hold no streets, so adapters read them as such: an event stream as a height profile for each
user, order lines as directed edges between suppliers, customers and suppliers as points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewalk.functions import cost, geo, text
from gradewalk.operators import alternatives, breaks, joins, narrate, ranged, routing, series, smoothing
from gradewalk.operators.landmarks import landmark_paths
from gradewalk.operators.overlay import build_overlay, overlay_paths
from gradewalk.schemas import EDGE_DEFAULTS, EDGES, PROFILES, prefs_for_mode, prefs_struct, with_profiles
from gradewalk.sources import build, graph
from gradewalk.sources.elevation import parse_batch_answer
from gradewalk.sources.osm import is_walkable_way
from gradewalk.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + 0.0


def rounded(c: Column | str, digits: int) -> Column:
    """The binary value scaled, rounded half away from zero and scaled back, as SQL engines round doubles; ``F.round`` rounds the printed decimals."""
    scaled = F.col(c) * 10.0**digits if isinstance(c, str) else c * 10.0**digits
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**digits + 0.0


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that ``df`` is dealt to: one for every ``rows`` of it, so that a task's memory doesn't grow with the table; the session's partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


# ---- adapters ----


def micros(ts: str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("long")


def profile_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id: user; dist_m: hours since the user's first event; heights: a hundredth of the value."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("edge_id"), micros("ts").alias("us"), (F.col("value") / 100.0).alias("z"))
    first = F.min("us").over(Window.partitionBy("edge_id"))
    return events.select("edge_id", ((F.col("us") - first) / 3.6e9).alias("dist_m"), F.col("z").alias("z_raw_m"), F.col("z").alias("z_smooth_m"))


P = "p as (select user_id as edge_id, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 3.6e9 as dist_m, value / 100.0 as z from events)"
G = """g as (select edge_id, dist_m, z, (z - lag(z) over w) / (dist_m - lag(dist_m) over w) as grade, z - lag(z) over w as dz, dist_m - lag(dist_m) over w as dd from p window w as (partition by edge_id order by dist_m))"""


def rolling_sql(m: int) -> str:
    return f"""b{m} as (select *, min(dist_m) over (partition by edge_id) as d0,
      coalesce(last_value(dist_m) over (partition by edge_id order by dist_m range between unbounded preceding and {m} preceding), first_value(dist_m) over (partition by edge_id order by dist_m)) as ld{m},
      coalesce(last_value(z) over (partition by edge_id order by dist_m range between unbounded preceding and {m} preceding), first_value(z) over (partition by edge_id order by dist_m)) as lz{m},
      first_value(dist_m) over (partition by edge_id order by dist_m range between {m} preceding and current row) as rd{m},
      first_value(z) over (partition by edge_id order by dist_m range between {m} preceding and current row) as rz{m} from g),
    r{m} as (select edge_id, dist_m, z, case when dist_m > greatest(dist_m - {m}, ld{m}) then (z - case when rd{m} > ld{m} then lz{m} + (greatest(dist_m - {m}, ld{m}) - ld{m}) / (rd{m} - ld{m}) * (rz{m} - lz{m}) else lz{m} end) / (dist_m - greatest(dist_m - {m}, ld{m})) else 0 end as roll{m} from b{m})"""


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as directed edges between suppliers, with the columns that costs read."""
    n = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("n"))
    li = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))
    g = F.col("l_discount") * 2
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("source"),
        F.pmod(F.col("l_suppkey") + 1 + F.pmod("l_partkey", F.floor(F.col("n") / 10) + 1), F.col("n")).alias("target"), "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_quantity") * 10).alias("length_m"), (F.col("l_quantity") * 10 / 1.34).alias("base_time_s"), F.lit(0.0).alias("slope_time_s"),
        g.alias("max_uphill_grade"), F.lit(0.0).alias("max_downhill_grade"), g.alias("max_abs_grade"), g.alias("sustained_uphill_grade_20m"), g.alias("sustained_uphill_grade_50m"),
        (F.col("l_quantity") * g).alias("gain_m"), F.lit(0.0).alias("loss_m"), F.when(g > 0.06, F.col("l_quantity") * 10).otherwise(0.0).alias("length_above_6pct_up_m"),
        F.when(g > 0.08, F.col("l_quantity") * 10).otherwise(0.0).alias("length_above_8pct_up_m"), F.when(g > 0.10, F.col("l_quantity") * 10).otherwise(0.0).alias("length_above_10pct_up_m"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("stairs"), F.col("l_tax").alias("barrier_penalty"), F.lit(0.0).alias("traffic_safety_score"), F.lit(0.0).alias("uncertainty_penalty"),
        F.lit(None).cast("string").alias("wheelchair_access"), F.lit(None).cast("string").alias("sidewalk_availability"), F.lit(None).cast("double").alias("sidewalk_width_m"))


E = """e as (select l_orderkey * 8 + l_linenumber as edge_id, l_suppkey as source, (l_suppkey + 1 + l_partkey % (n // 10 + 1)) % n as target, l_orderkey, l_linenumber, l_partkey,
  l_quantity * 10 as length_m, l_quantity * 10 / 1.34 as time_s, l_discount * 2 as g, l_quantity * (l_discount * 2) as gain_m, l_tax as barrier, (l_returnflag = 'R' and l_linestatus = 'F') as stairs
  from lineitem, (select max(s_suppkey) + 1 as n from supplier))"""
CURVE = "case when g <= 0.06 then 0 when g <= 0.10 then ((g - 0.06) / 0.04) ** 2 else 1 + 3 * ((g - 0.10) / 0.06) ** 2 end"
PROFILES_SQL = "profiles(mode, up, mx, bar, soft, hard, no_stairs) as (values " + ", ".join(
    f"('{p[0]}', {p[1]}, {p[3]}, {p[5]}, {p[7]}, {'null::double' if p[8] is None else p[8]}, {str(p[9]).lower()})" for p in PROFILES) + ")"
COST = f"""c as (select e.*, mode, case when (no_stairs and stairs) or coalesce(g > hard, false) or (mode = 'accessibility' and stairs) then null else
  time_s + up * (case when g > 0.06 then length_m else 0 end * {CURVE} * 0.2) + mx * (case when g <= soft then 0 else 90 * ((g - soft) / greatest(coalesce(hard, 0.16) - soft, 1e-9)) ** 2 end) + bar * greatest(0, barrier) end as cost,
  case when g > 0.06 then length_m else 0 end * {CURVE} * 0.2 as discomfort from e, profiles)"""


def points(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), (37.7070 + F.pmod(F.col(key) * 104729, F.lit(1000)) * 0.0001265).alias("lat"), (-122.5155 + F.pmod(F.col(key) * 7919, F.lit(1000)) * 0.0001605).alias("lon"))


def points_sql(t: str, key: str) -> str:
    return f"select {key} as id, 37.7070 + ({key} * 104729 % 1000) * 0.0001265 as lat, -122.5155 + ({key} * 7919 % 1000) * 0.0001605 as lon from {t}"


HAVERSINE = "2 * 6371000.0 * asin(least(1, sqrt(sin((radians(b.lat) - radians(a.lat)) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"

# ---- queries ----


def grade_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.checked_distances(profile_series(spark, sf_dir)).withColumn("g", series.grade()).select("edge_id", r6("dist_m").alias("dist_m"), r6("g").alias("grade"))


def gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gain_loss(profile_series(spark, sf_dir)).select("edge_id", r6("gain_m").alias("gain_m"), r6("loss_m").alias("loss_m"))


def rolling_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_grades(profile_series(spark, sf_dir)).select("edge_id", r6("dist_m").alias("dist_m"), r6("rolling_grade_20m").alias("rolling_grade_20m"), r6("rolling_grade_50m").alias("rolling_grade_50m"))


def edge_grade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series.edge_grade_metrics(profile_series(spark, sf_dir))
    return m.select("edge_id", *(r6(c).alias(c) for c in m.columns if c != "edge_id"))


def reverse_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.reversed_samples(profile_series(spark, sf_dir)).select("edge_id", r6("dist_m").alias("dist_m"), r6("grade").alias("grade"))


def hampel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_series(spark, sf_dir).withColumn("h", smoothing.hampel("z_raw_m", "edge_id", "dist_m")).select("edge_id", r6("dist_m").alias("dist_m"), r6("h").alias("z"))


def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.savgol(profile_series(spark, sf_dir), "z_raw_m", "edge_id", "dist_m", "s").select("edge_id", r6("dist_m").alias("dist_m"), r6("s").alias("z"))


def smooth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.smooth_profile(profile_series(spark, sf_dir)).select("edge_id", r6("dist_m").alias("dist_m"), r6("z_smooth_m").alias("z"), r6("grade").alias("grade"))


def threshold_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = profile_series(spark, sf_dir).withColumn("grade", series.grade())
    return breaks.threshold_breakpoints(graded, "edge_id", "dist_m", "grade").select("edge_id", "threshold", r6("at").alias("at"))


def extrema_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = profile_series(spark, sf_dir).withColumn("grade", series.grade())
    return breaks.extrema_breakpoints(graded, "edge_id", "dist_m", "grade").select("edge_id", r6("at").alias("at"))


def regular_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(breaks.regular_breakpoints(F.col("p_size").cast("double"))).alias("at"))


def merge_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each order, merged at gaps under 3."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("points"))
    return lists.select("l_orderkey", F.posexplode(breaks.merge_breakpoints(F.col("points"))).alias("pos", "at")).select("l_orderkey", F.col("pos").cast("long").alias("pos"), r6("at").alias("at"))


def penalty_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("g")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 2).alias("g")).select(
        "l_orderkey", "l_linenumber", r6(cost.uphill_penalty_curve(g)).alias("uphill"), r6(cost.downhill_penalty_curve(g)).alias("downhill"), r6(cost.max_grade_penalty(g, F.lit(0.10), F.lit(0.16))).alias("max_grade"))


def edge_cost_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of every edge under every profile; null where it isn't allowed."""
    c = with_profiles(walk_edges(spark, sf_dir)).withColumn("cost", cost.edge_cost(F.col("prefs")))
    return c.select("edge_id", F.col("prefs.mode").alias("mode"), r6(F.when(F.col("cost") < float("inf"), F.col("cost"))).alias("cost"))


def route_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes under the balanced profile."""
    e = walk_edges(spark, sf_dir).withColumn("prefs", prefs_struct(prefs_for_mode("balanced")))
    m = e.groupBy("l_orderkey").agg(*cost.route_metrics(F.col("prefs")))
    return m.select("l_orderkey", *(F.round(c, 4).alias(c) for c in ("time_s", "distance_m", "gain_m", "hill_discomfort", "barrier_penalty", "max_uphill_grade", "route_score")))


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier of every customer."""
    found = joins.nearest_node(points(table(spark, sf_dir, "customer"), "c_custkey", "point_id"), points(table(spark, sf_dir, "supplier"), "s_suppkey", "node_id"))
    return found.select(F.col("point_id").alias("c_custkey"), F.col("node_id").alias("s_suppkey"), F.round("distance_m", 3).alias("distance_m"))


def distance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within 250 m of each customer, by grid cells as wide as that, whose pairs are dealt to tasks in blocks."""
    cell = 250 / 78_000.0
    near = lambda df, key: points(df, key, key).withColumnsRenamed({"lat": f"{key}_lat", "lon": f"{key}_lon"})
    c = near(table(spark, sf_dir, "customer"), "c_custkey").withColumns({"cy": F.floor(F.col("c_custkey_lat") / cell), "cx": F.floor(F.col("c_custkey_lon") / cell)})
    s = near(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("cy", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor(F.col("s_suppkey_lat") / cell) + k))).withColumn("cx", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.floor(F.col("s_suppkey_lon") / cell) + k)))
    d = geo.haversine_m(F.col("c_custkey_lat"), F.col("c_custkey_lon"), F.col("s_suppkey_lat"), F.col("s_suppkey_lon"))
    c, s = joins.blocks_of(c, s, ["cy", "cx"])
    return c.join(s, ["cy", "cx", "_a", "_b"]).withColumn("d", d).where(F.col("d") <= 250).select("c_custkey", "s_suppkey", rounded("d", 3).alias("distance_m"))


def geodesic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and first azimuth of a line on the ellipsoid from each customer's place on the earth to one up to 40 degrees away."""
    k = F.col("c_custkey")
    ends = table(spark, sf_dir, "customer").select(k, (F.pmod(k * 104729, F.lit(15001)) * 0.01 - 75).alias("lat"), (F.pmod(k * 7919, F.lit(36001)) * 0.01 - 180).alias("lon"))
    ends = ends.withColumns({"lat2": F.col("lat") + F.pmod(k * 31, F.lit(1001)) * 0.01 - 5, "lon2": F.col("lon") + F.pmod(k * 37, F.lit(8009)) * 0.01 - 40})
    line = geo.geodesic(F.struct("lon", "lat"), F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))
    return ends.withColumn("g", line).select("c_custkey", F.round("g.distance_m", 3).alias("distance_m"), r6("g.azimuth").alias("azimuth"))


def bearing_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compass and turn texts for bearings taken from order lines."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geo.bearing_of(F.col("l_quantity") - 25.3, F.col("l_discount") * 1000 - 41.7).alias("a"), geo.bearing_of(F.col("l_tax") * 1000 - 33.3, F.col("l_quantity") - 20.6).alias("b"))
    return b.select("l_orderkey", "l_linenumber", r6("a").alias("bearing"), geo.compass(F.col("a")).alias("compass"), geo.turn_instruction(F.col("a"), F.col("b")).alias("turn"), r6(geo.parallel_delta(F.col("a"), F.col("b"))).alias("delta"))


def shortest_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least times from supplier 0 to all."""
    edges = walk_edges(spark, sf_dir).select("source", "target", F.col("base_time_s").alias("cost"))
    start = spark.range(1).select(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("node"))
    return routing.min_plus(edges, start).select("node", F.round("cost", 4).alias("cost"))


def connector_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that edges of at most 50 m reach within 300 m from every supplier, as connectors do."""
    edges = walk_edges(spark, sf_dir).where("length_m <= 50").select("source", "target", F.col("length_m").alias("cost"))
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"), F.col("s_suppkey").alias("node"))
    return routing.reach(edges, starts, 300.0).select("start", "node", F.round("cost", 4).alias("cost"))


def dedupe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the part sets of each customer's consecutive orders."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before")).where(F.col("before").isNotNull())
    a, b = li.toDF("o_orderkey", "a"), li.toDF("before", "b")
    return o.join(a, "o_orderkey").join(b, "before").select("o_orderkey", "before", r6(alternatives.overlap(F.col("a"), F.col("b"))).alias("overlap"))


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order that no other line of it dominates in price, tax and quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_tax", "l_quantity")
    return alternatives.pareto_rows(li, "l_orderkey", ["l_extendedprice", "l_tax", "l_quantity"])


def routes(spark: SparkSession, sf_dir: str, task_rows: int = 1 << 19) -> DataFrame:
    """Orders as routes along streets named by part size; whole orders are dealt to tasks, one for every ``task_rows`` lines."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("Street "), F.pmod("p_size", F.lit(4)).cast("string")).alias("street_name"))
    n = tasks_for(table(spark, sf_dir, "lineitem"), task_rows)
    e = walk_edges(spark, sf_dir).repartition(n, "l_partkey").join(parts.repartition(n, "l_partkey"), "l_partkey").repartition(n, "l_orderkey")
    return e.withColumns({"route_id": F.col("l_orderkey"), "pos": F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "source", "length_m", "max_uphill_grade", "barrier_penalty"))})


R = """rt as (select e.*, 'Street ' || (p_size % 4) as street, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, source, length_m, g, barrier) as pos from e join part on p_partkey = l_partkey)"""


def hill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = narrate.hill_events(routes(spark, sf_dir))
    return ev.select("route_id", F.col("event").cast("long").alias("event"), "street_name", *(F.round(c, 10).alias(c) for c in ("start_m", "length_m", "elevation_gain_m", "avg_grade", "max_grade")))


def giant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series: 2.5 m and a bit from one to the next, heights a hundredth of the value."""
    e = F.col("event_id")
    z = (F.col("value") / 100.0).alias("z")
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("edge_id"), (e * 2.5 + F.pmod(e * 7919, F.lit(16)) * 0.125).alias("dist_m"), z.alias("z_raw_m"), z.alias("z_smooth_m"))


PG = "p as (select 0::bigint as edge_id, event_id * 2.5::double + ((event_id * 7919) % 16) * 0.125::double as dist_m, value / 100.0 as z from events)"


def giant_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling grades of one series that holds all rows, dealt to ranges of 5 km."""
    graded = ranged.with_grades(giant_profile(spark, sf_dir), 5_000.0)
    return graded.select("edge_id", r6("dist_m").alias("dist_m"), r6("grade").alias("grade"), r6("rolling_grade_20m").alias("rolling_grade_20m"), r6("rolling_grade_50m").alias("rolling_grade_50m"))


def giant_hills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill events of one route that walks all orders, dealt to ranges of 4,096 positions."""
    cents, key = F.floor(F.col("o_totalprice")).cast("long"), F.col("o_orderkey")
    g = F.pmod(cents, F.lit(13)) / 100.0
    legs = table(spark, sf_dir, "orders").select(
        F.lit(0).cast("long").alias("route_id"), key.alias("pos"), F.concat(F.lit("Street "), F.floor(key / 9).cast("string")).alias("street_name"), (4 + F.pmod(cents, F.lit(64)) * 0.25).alias("length_m"),
        g.alias("max_uphill_grade"), g.alias("sustained_uphill_grade_20m"), g.alias("sustained_uphill_grade_50m"), (F.pmod(cents, F.lit(32)) * 0.125).alias("gain_m"), F.lit(0.0).alias("length_above_8pct_up_m"), F.lit(0.0).alias("length_above_10pct_up_m"))
    ev = ranged.hill_events(legs, 4096)
    return ev.select("route_id", F.col("event").cast("long").alias("event"), "street_name", *(r6(c).alias(c) for c in ("start_m", "length_m", "elevation_gain_m", "avg_grade", "max_grade")))


def direction_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = narrate.direction_groups(routes(spark, sf_dir), key="street_name")
    return runs.groupBy("route_id", "step").agg(F.first("street_name").alias("street_name"), F.sum("length_m").alias("length_m"), F.max("max_uphill_grade").alias("max_uphill"), F.count("*").alias("n_edges")).select(
        "route_id", F.col("step").cast("long").alias("step"), "street_name", F.round("length_m", 4).alias("length_m"), r6("max_uphill").alias("max_uphill"), "n_edges")


def absorb_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each route after short cross streets are absorbed."""
    runs = narrate.direction_groups(routes(spark, sf_dir), key="street_name").groupBy("route_id", "step").agg(F.first("street_name").alias("text"), (F.sum("length_m") / 20).alias("length_m"), F.max("max_uphill_grade").alias("max_uphill"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    entry = F.struct(F.col("text").alias("key"), F.col("text").alias("text"), "length_m", "max_uphill", "first", "last", F.lit(False).alias("connector"))
    lists = runs.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", entry.alias("g")))), lambda x: x["g"]).alias("groups"))
    return lists.select("route_id", F.posexplode(narrate.absorb_short_groups(F.col("groups"))).alias("step", "g")).select("route_id", F.col("step").cast("long").alias("step"), F.col("g.text").alias("street_name"), F.round("g.length_m", 4).alias("length_m"))


def street_name_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.upper("p_name"), F.lit("  "), F.when(F.col("p_size") % 3 == 0, "ST").when(F.col("p_size") % 3 == 1, "AVE.").otherwise("*NO STREET SUFFIX"))
    return table(spark, sf_dir, "part").select("p_partkey", text.format_street_name(raw).alias("name"), text.normalized_name(raw).alias("normalized"))


def walkable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as ways: the type picks the highway, the payload the sidewalk."""
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.create_map(F.lit("highway"), F.when(k % 3 == 0, "residential").when(k % 3 == 1, "footway").otherwise("motorway"), F.lit("access"), F.when(k % 5 == 0, "Private").otherwise("yes"), F.lit("sidewalk"), F.when(k % 2 == 0, "NO").otherwise("both"))
    return table(spark, sf_dir, "events").select("event_id", is_walkable_way(tags).alias("walkable"))


def json_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service answers in their shapes, parsed."""
    v = F.col("value").cast("decimal(20,4)").cast("string")
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"elevation": ['), v, F.lit("]}"))).otherwise(F.concat(F.lit('[{"elevation": "'), v, F.lit('"}]')))
    return table(spark, sf_dir, "events").select("event_id", F.get(parse_batch_answer(payload), F.lit(0)).alias("z_m"))


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that compare each order as a route with the one before it by the same customer."""
    m = route_metrics(spark, sf_dir).select("l_orderkey", F.struct("time_s", (F.col("distance_m") + 0.37).alias("distance_m"), "max_uphill_grade").alias("m"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    j = o.join(m.toDF("o_orderkey", "m"), "o_orderkey").join(m.toDF("before", "f"), "before", "left")
    return j.select("o_orderkey", text.explain_route(F.lit("recommended"), F.col("m"), F.col("f"), F.col("o_orderkey") == F.col("before")).alias("explanation"))


def directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments between customer and clerk's nation, walked both ways: ids 2i + 1 and 2i + 2."""
    line = F.array().cast("array<struct<lon:double,lat:double>>")
    o = table(spark, sf_dir, "orders").select((2 * F.col("o_orderkey") + 1).alias("edge_id"), F.col("o_custkey").alias("source_osm_node_id"), F.pmod("o_orderkey", F.lit(97)).alias("target_osm_node_id"), line.alias("geometry"), F.lit(None).alias("osm_way_id"), F.lit(None).alias("tags"))
    return build.both_ways(o).select("edge_id", "source", "target")


def segment_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as segments of ways, numbered in order of way and place."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    ways = li.select(F.col("l_orderkey").alias("way_idx"), place.alias("pos"))
    return build.numbered(ways, range_ways=1024).select("way_idx", "pos", F.col("number").cast("long").alias("number"))


def street_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as crossings and the shortest order line between two of them as their street, with all columns that routes read.

    A line's id lengthens it by up to a metre, so that no two ways are equally long.  Crossings have a place on the map, but x = y = 0:
    times between suppliers say nothing of their places, so no estimate may be drawn from these.
    """
    at = points(table(spark, sf_dir, "supplier"), "s_suppkey", "node_id")
    nodes = at.select("node_id", "lon", "lat", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z_m"), F.lit("intersection").alias("node_type"))
    g, length = F.col("max_uphill_grade"), F.col("length_m") + F.pmod(F.col("edge_id") * 7919, F.lit(100_003)) * 0.00001
    lines = walk_edges(spark, sf_dir).withColumn("length_m", length).groupBy("source", "target").agg(F.min(F.struct("length_m", "edge_id", "max_uphill_grade", "barrier_penalty", "stairs", "gain_m")).alias("b")).select("source", "target", "b.*")
    place = lambda end: at.select(F.col("node_id").alias(end), F.struct("lon", "lat").alias(f"at_{end}"))
    lines = lines.join(place("source"), "source").join(place("target"), "target")
    above = {f"length_above_{t}pct_up_m": F.when(g > t / 100, F.col("length_m")).otherwise(0.0) for t in (6, 8, 10)}
    known = above | {
        "edge_id": F.col("source") * 1_000_000 + F.col("target"), "geometry": F.array("at_source", "at_target"), "base_time_s": F.col("length_m") / 1.34, "loss_m": F.lit(0.0), "max_downhill_grade": F.lit(0.0),
        "max_abs_grade": g, "sustained_uphill_grade_20m": g, "sustained_uphill_grade_50m": g, "street_name": F.concat(F.lit("Street "), F.pmod("edge_id", F.lit(7)).cast("string"))}
    value = lambda f: known.get(f.name, F.col(f.name) if f.name in lines.columns else F.lit(EDGE_DEFAULTS.get(f.name)).cast(f.dataType)).alias(f.name)
    edges = lines.select(*(value(f) for f in graph.graph_schema(EDGES)))
    return nodes, edges


def street_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From supplier 0 to three others, under each of the four profiles."""
    n = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("n"))
    goals = n.select(F.explode(F.array(*(F.floor(F.col("n") * k / 4).cast("long") for k in (1, 2, 3)))).alias("goal"))
    each = with_profiles(goals)
    return each.select(F.concat_ws("-", "prefs.mode", F.col("goal").cast("string")).alias("request_id"), F.lit(0).cast("long").alias("start"), "goal", "prefs")


def route_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of every profile between suppliers: fastest, recommended or accessible, and flattest, as far as they differ and none is beaten."""
    options = alternatives.route_candidates(street_requests(spark, sf_dir), *street_graph(spark, sf_dir))
    return options.select("request_id", "rank", "label", F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edge_ids"), F.round("metrics.time_s", 4).alias("time_s"), r6("metrics.max_uphill_grade").alias("max_uphill_grade"), F.round("metrics.route_score", 4).alias("route_score"))


def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of those options, as read back from their GeoJSON; edge 0 and length 0 where a feature is no edge."""
    (nodes, edges), requests = street_graph(spark, sf_dir), stored(street_requests(spark, sf_dir))
    nodes, edges = stored(nodes), stored(edges)
    features = graph.route_features(alternatives.route_candidates(requests, nodes, edges), nodes, edges, requests.select("request_id", "start", "goal"))
    of = lambda path, kind: F.get_json_object("feature", f"$.{path}").cast(kind)
    first = F.coalesce(of("geometry.coordinates[0][0]", "double"), of("geometry.coordinates[0]", "double"))
    return features.select("request_id", "rank", F.col("place").cast("long").alias("place"), of("properties.feature_type", "string").alias("feature_type"), F.coalesce(of("properties.edge_id", "long"), F.lit(0)).alias("edge_id"), F.coalesce(rounded(of("properties.length_m", "double"), 4), F.lit(0.0)).alias("length_m"), rounded(first, 6).alias("lon"))


def supplier_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From supplier 0 to every supplier under the balanced profile, over an overlay of cells: cost of the paths' edges."""
    edges = walk_edges(spark, sf_dir).withColumn("prefs", prefs_struct(prefs_for_mode("balanced")))
    edges = edges.select(F.lit("balanced").alias("profile"), "edge_id", "source", "target", cost.edge_cost(F.col("prefs")).alias("cost"))
    edges = edges.groupBy("profile", "source", "target").agg(F.min(F.struct("cost", "edge_id")).alias("b")).select("profile", (F.col("source") * 100_000 + F.col("target")).alias("edge_id"), "source", "target", "b.cost")
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    requests = nodes.select(F.col("node_id").cast("string").alias("request_id"), F.lit("balanced").alias("profile"), F.lit(0).cast("long").alias("start"), F.col("node_id").alias("goal"))
    edges = stored(edges)
    paths = overlay_paths(requests, build_overlay(nodes, edges, most=256))
    steps = paths.select("goal", F.explode("edge_ids").alias("edge_id")).join(edges.select("edge_id", "cost"), "edge_id")
    return steps.groupBy("goal").agg(F.round(F.sum("cost"), 4).alias("cost"))


def landmark_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier to another one by searches that landmarks lead: least time."""
    edges = walk_edges(spark, sf_dir).select("edge_id", "source", "target", F.col("base_time_s").alias("cost"))
    n = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("n"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"))
    requests = nodes.crossJoin(F.broadcast(n)).select(F.col("node_id").alias("start"), F.pmod(F.col("node_id") * 7919 + 3, F.col("n")).alias("goal"))
    return landmark_paths(requests, nodes, edges).select("start", "goal", F.round("cost", 4).alias("cost"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    grade_lag, gain_loss, rolling_grades, edge_grade_metrics, reverse_profile, hampel_filter, savgol_smooth, smooth_profile, threshold_breaks, extrema_breaks, regular_breaks, merge_breaks,
    penalty_curves, edge_cost_profiles, route_metrics, snap_nearest, distance_join, geodesic_lines, bearing_turns, shortest_path_cost, supplier_routes, landmark_routes, connector_reach, dedupe_overlap, pareto_front, hill_events, giant_grades, giant_hills,
    direction_steps, absorb_short, street_name_format, walkable_filter, json_heights, explain_text, directed_edges, segment_numbers, route_candidates, geojson_features)}
