"""Queries that read ways, name streets and match lines, over the driver's tables, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.functions import geo
from gradewalk.operators import joins, naming
from gradewalk.plans.queries import E, R, points, points_sql, r6, rounded, street_graph, table
from gradewalk.sources import osm

# ---- ways ----


def way_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes and orders as ways along the suppliers of their lines, some of which aren't there."""
    nodes = points(table(spark, sf_dir, "supplier"), "s_suppkey", "id").select(F.lit("node").alias("type"), "id", "lat", "lon", F.lit(None).cast("array<long>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"), F.lit(0).cast("long").alias("way_idx"))
    at = F.when(F.pmod("l_partkey", F.lit(23)) == 0, -1).otherwise(F.col("l_suppkey"))
    stops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", at.alias("at")))).alias("stops"))
    k, text = F.col("l_orderkey"), lambda c: c.cast("string")
    pick = lambda n, *names: F.get(F.array(*(F.lit(x) for x in names)), F.pmod(k, F.lit(n)).cast("int"))
    tags = F.create_map(F.lit("highway"), pick(4, "residential", "footway", "steps", "motorway"), F.lit("access"), pick(5, "yes", "Private", "", "yes", "permissive"), F.lit("foot"), pick(3, "designated", "yes", "no"),
                        F.lit("sidewalk"), pick(7, "both", "NO", "left", "", "both", "right", "no"), F.lit("name"), F.when(k % 6 < 4, F.concat(F.lit("Way "), text(k % 50))).otherwise(""))
    ways = stops.select(F.lit("way").alias("type"), k.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("stops.at").alias("nodes"), tags.alias("tags"), k.alias("way_idx"))
    return nodes.unionByName(ways)


def way_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the walkable ways among them, with the attributes of their edges."""
    s = osm.segments(way_elements(spark, sf_dir))
    kept = {name: c for name, c in osm.edge_attributes(F.col("tags")).items() if name in ("street_name", "edge_type", "access", "sidewalk_availability", "stairs")}
    return s.select("way_idx", F.col("pos").cast("long").alias("pos"), "source_osm_node_id", "target_osm_node_id", *(c.alias(n) for n, c in kept.items()), r6(F.col("geometry")[0]["lon"]).alias("from_lon"), r6(F.col("geometry")[1]["lat"]).alias("to_lat"))


WAY_SEGMENTS = f"""with pt as ({points_sql('supplier', 's_suppkey')}),
  tagged as (select distinct l_orderkey as k, ['residential','footway','steps','motorway'][l_orderkey % 4 + 1] as highway, ['yes','Private','','yes','permissive'][l_orderkey % 5 + 1] as access, ['designated','yes','no'][l_orderkey % 3 + 1] as foot,
    ['both','NO','left','','both','right','no'][l_orderkey % 7 + 1] as sidewalk, case when l_orderkey % 6 < 4 then 'Way ' || (l_orderkey % 50) else '' end as name from lineitem),
  walk as (select * from tagged where highway <> 'motorway' and lower(access) <> 'private' and foot <> 'no' and not (lower(sidewalk) = 'no' and highway = 'residential')),
  stop as (select l_orderkey, case when l_partkey % 23 = 0 then -1 else l_suppkey end as here, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, case when l_partkey % 23 = 0 then -1 else l_suppkey end) - 1 as pos from lineitem),
  pair as (select *, lead(here) over (partition by l_orderkey order by pos) as after from stop)
  select k as way_idx, pos, here as source_osm_node_id, after as target_osm_node_id, nullif(name, '') as street_name, highway as edge_type, coalesce(nullif(access, ''), foot) as access, nullif(sidewalk, '') as sidewalk_availability, highway = 'steps' as stairs,
    round(a.lon, 6) + 0.0 as from_lon, round(b.lat, 6) + 0.0 as to_lat
  from pair join walk on k = l_orderkey join pt a on a.id = here join pt b on b.id = after where a.lat <> b.lat or a.lon <> b.lon"""

# ---- names ----


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and labels of streets between suppliers, an eighth of which are connectors: their own, one that connectors reach, or a generic one."""
    k = F.pmod(F.col("source") * 31 + F.col("target") * 17, F.lit(16))
    kinds = ["footway", "crossing", "steps", "service", "path", "residential", "cycle_track"]
    tags = F.when(k == 0, F.create_map(F.lit("footway"), F.lit("Sidewalk"))).when(k == 3, F.create_map(F.lit("service"), F.lit("alley")))
    _, edges = street_graph(spark, sf_dir)
    edges = edges.withColumns({
        "street_name": F.when(k > 6, F.concat(F.lit("Street "), F.pmod(F.col("source") + F.col("target"), F.lit(7)).cast("string"))), "stairs": k == 2, "source_tags": tags,
        "edge_type": F.coalesce(F.get(F.array(*(F.lit(x) for x in kinds)), k.cast("int")), F.lit("residential"))})
    named = naming.with_labels(naming.assign_display_names(edges))
    return named.select("edge_id", "display_name", "name_source", "name_confidence", "name_status", "label_text", "label_key", "label_kind")


def bearing_of_sql(a: str, b: str) -> str:
    return f"fmod(degrees(atan2(({b}.lon - {a}.lon) * cos(radians(({a}.lat + {b}.lat) / 2)), {b}.lat - {a}.lat)) + 720.0, 360.0)"


def delta_sql(a: str, b: str) -> str:
    return f"least(fmod(abs({a} - {b}), 180.0), 180.0 - fmod(abs({a} - {b}), 180.0))"


#: Kind number, name, source, label key and label kind of edges without a street of their own.
GENERIC = ", ".join(f"({k}, '{name}', '{source}', '{key}', '{kind}')" for k, name, source, key, kind in (
    (2, "stairs", "generic_stairs", "stairs", "stairs"), (3, "alley", "generic_alley", "alley", "alley"), (4, "walking path", "generic_path", "walking_path", "path"),
    (5, "unnamed street", "generic_unnamed_street", "road:unnamed street", "unnamed_street"), (6, "cycle track", "generic_edge_type", "kind:cycle_track", "way")))

DISPLAY_NAMES = f"""with recursive pt as ({points_sql('supplier', 's_suppkey')}),
  l as (select l_suppkey as source, (l_suppkey + 1 + l_partkey % (n // 10 + 1)) % n as target, l_quantity * 10 + (((l_orderkey * 8 + l_linenumber) * 7919) % 100003) * 0.00001::double as length_m from lineitem, (select max(s_suppkey) + 1 as n from supplier)),
  e as (select source * 1000000 + target as edge_id, source, target, min(length_m) as length_m, (source * 31 + target * 17) % 16 as k, 'Street ' || ((source + target) % 7) as street from l group by source, target),
  g as (select e.*, {bearing_of_sql('a', 'b')} as turn from e join pt a on a.id = source join pt b on b.id = target),
  two as (select edge_id, k, street, length_m, turn, source as a, target as b from g union all select edge_id, k, street, length_m, turn, target, source from g),
  w as (select a, b, min(length_m) as s from two where k < 2 group by 1, 2),
  p(start, node, cost) using key (start, node) as (select distinct a, a, 0.0::double from w union (select p.start, w.b, min(p.cost + w.s) from p join w on w.a = p.node left join recurring.p as q on q.start = p.start and q.node = w.b where p.cost + w.s <= 300 and (q.cost is null or p.cost + w.s < q.cost) group by 1, 2)),
  sc as (select c.edge_id, s.street, p.cost + 1.5 * {delta_sql('c.turn', 's.turn')} as score from two c join p on p.start = c.a join two s on s.a = p.node and s.k > 6 where c.k < 2),
  reached as (select edge_id, street from (select *, row_number() over (partition by edge_id order by score, street) as rn from sc) where rn = 1),
  generic(k, name, source, label_key, label_kind) as (values {GENERIC})
  select edge_id, street as display_name, 'osm' as name_source, 0.85::double as name_confidence, 'osm_named' as name_status, street as label_text, 'named:' || street as label_key, 'named' as label_kind from e where k > 6
  union all select edge_id, coalesce(r.street, 'walkway'), case when r.street is null then 'generic_connector' else 'inferred_reachable_street' end, case when r.street is null then 0.2 else 0.55 end, case when r.street is null then 'generic_connector' else 'inferred_street_name' end,
    r.street, 'connector:' || coalesce(r.street, 'generic'), 'connector' from e left join reached r using (edge_id) where k < 2
  union all select edge_id, name, x.source, 0.25, x.source, name, label_key, label_kind from e join generic x using (k)"""

# ---- lines ----


def short_lines(spark: SparkSession, sf_dir: str, name: str, key: str, turn: int, scale: float) -> DataFrame:
    """Two-point lines on a flat patch."""
    x, y = F.pmod(F.col(key) * (7919 + turn), F.lit(2003)) * 1e-5, F.pmod(F.col(key) * (104729 + turn), F.lit(1999)) * 1e-5
    at = lambda dx, dy: F.struct((x - 122.44 + dx).alias("lon"), (y + 37.77 + dy).alias("lat"))
    return table(spark, sf_dir, name).select(key, F.array(at(F.lit(0.0), F.lit(0.0)), at(F.pmod(F.col(key), F.lit(11)) * (2e-5 * scale), F.pmod(F.col(key), F.lit(7)) * (3e-5 * scale))).alias("geometry"))


def short_lines_sql(out: str, name: str, key: str, turn: int, scale: float) -> str:
    """CTEs: the ends of the lines in degrees, then each line in metres of the zone."""
    lon, lat = f"({key} * {7919 + turn} % 2003) * 1e-5 - 122.44", f"({key} * {104729 + turn} % 1999) * 1e-5 + 37.77"
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius, e = 0.9996 * geo.SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    east = " + ".join(["eta"] + [f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(alpha, 1)])
    north = " + ".join(["xi"] + [f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(alpha, 1)])
    conformal = f"sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat))))"
    return f"""{out}0 as (select {key} as id, 0 as i, {lon} as lon, {lat} as lat from {name} union all select {key}, 1, {lon} + ({key} % 11) * {2e-5 * scale!r}::double, {lat} + ({key} % 7) * {3e-5 * scale!r}::double from {name}),
  {out}1 as (select *, atan2(t, cos(radians(lon + 123.0))) as xi, atanh(sin(radians(lon + 123.0)) / sqrt(1 + t * t)) as eta from (select *, {conformal} as t from {out}0)),
  {out}2 as (select id, i, lon, lat, {radius!r} * ({east}) as x, {radius!r} * ({north}) as y from {out}1),
  {out} as (select a.id, {bearing_of_sql('a', 'b')} as turn, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from {out}2 a join {out}2 b on a.id = b.id and a.i = 0 and b.i = 1)"""


def far_sql(p: str, end: int, s: str) -> str:
    """Distance of an end of line ``p`` to line ``s``."""
    dx, dy, px, py = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)", f"({p}.x{end} - {s}.x1)", f"({p}.y{end} - {s}.y1)"
    t = f"coalesce(least(1.0, greatest(0.0, ({px} * {dx} + {py} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0.0)"
    return f"sqrt(({px} - {t} * {dx}) ** 2 + ({py} - {t} * {dy}) ** 2)"


def side_sql(s: str, p: str, end: int) -> str:
    return f"(({s}.x2 - {s}.x1) * ({p}.y{end} - {s}.y1) - ({s}.y2 - {s}.y1) * ({p}.x{end} - {s}.x1))"


APART = f"case when {side_sql('a', 'b', 1)} * {side_sql('a', 'b', 2)} < 0 and {side_sql('b', 'a', 1)} * {side_sql('b', 'a', 2)} < 0 then 0.0 else least({far_sql('b', 1, 'a')}, {far_sql('b', 2, 'a')}, {far_sql('a', 1, 'b')}, {far_sql('a', 2, 'b')}) end"


def centerline_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of customers and of suppliers that lie within 60 m of each other."""
    near = joins.lines_within(short_lines(spark, sf_dir, "customer", "c_custkey", 0, 1.0), "c_custkey", short_lines(spark, sf_dir, "supplier", "s_suppkey", 2, 1.0), "s_suppkey", 60.0)
    return near.select("c_custkey", "s_suppkey", rounded("distance_m", 4).alias("distance_m"))


def official_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centerline that fits each customer's line best, suppliers being centerlines."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    kind = lambda *names: F.get(F.array(*(F.lit(x) for x in names)), F.pmod(c, F.lit(3)).cast("int"))
    name = lambda key: F.concat(F.lit("Row "), F.pmod(key, F.lit(5)).cast("string"), F.lit(" Street"))
    edges = short_lines(spark, sf_dir, "customer", "c_custkey", 0, 10.0).select(
        c.alias("edge_id"), "geometry", F.when(F.pmod(c, F.lit(4)) == 0, name(c)).alias("street_name"), kind("residential", "footway", "crossing").alias("edge_type"), F.lit(False).alias("stairs"), F.create_map(F.lit("surface"), F.lit("paved")).alias("source_tags"))
    lines = short_lines(spark, sf_dir, "supplier", "s_suppkey", 2, 10.0).select(s.alias("line_id"), "geometry", name(s).alias("display_name"), F.lit("streets").alias("dataset"), s.cast("string").alias("feature_id"), (F.pmod(s, F.lit(3)) > 0).alias("active"))
    return naming.match_centerlines(edges, lines).select("edge_id", "official_name", "official_feature", r6("official_confidence").alias("official_confidence"), "official_status")


CENTERLINE_DISTANCES = f"""with {short_lines_sql('a', 'customer', 'c_custkey', 0, 1.0)}, {short_lines_sql('b', 'supplier', 's_suppkey', 2, 1.0)},
  d as (select a.id as c_custkey, b.id as s_suppkey, {APART} as m from a, b) select c_custkey, s_suppkey, round(m, 4) as distance_m from d where m <= 60"""

OFFICIAL_NAMES = f"""with {short_lines_sql('a', 'customer', 'c_custkey', 0, 10.0)}, {short_lines_sql('b', 'supplier', 's_suppkey', 2, 10.0)},
  d as (select a.id as edge_id, b.id as line, {APART} as m, {delta_sql('a.turn', 'b.turn')} as delta, a.id % 3 = 2 or (a.id % 3 = 1 and a.id % 4 <> 0) as passage, a.id % 4 = 0 and a.id % 5 = b.id % 5 as same, b.id % 3 > 0 as active from a, b),
  k as (select *, row_number() over (partition by edge_id order by m + least(45, 0.65::double * delta) + case when active then 0 else 30 end - case when same then 18 else 0 end, line) as rn from d where m <= 28 and not (delta > 75 and m > 8 and not (passage and edge_id % 4 <> 0)))
  select edge_id, 'Row ' || (line % 5) || ' Street' as official_name, line::varchar as official_feature, round(greatest(0.35, least(1.0, 1.0 - m / 28.0::double * 0.45)), 6) + 0.0 as official_confidence, case when active then 'official_street_name' else 'retired_street_name' end as official_status from k where rn = 1"""

#: The stack of groups that the fold of ``absorb_short`` keeps.
ABSORB_SHORT = f"""with recursive {E}, {R}, marked as (select *, case when lag(street) over w = street and row_number() over w > 1 then 0 else 1 end as new from rt window w as (partition by l_orderkey order by pos)),
  runs as (select l_orderkey, step, any_value(street) as t, sum(length_m) / 20 as m from (select *, sum(new) over (partition by l_orderkey order by pos rows unbounded preceding)::bigint as step from marked) group by 1, 2),
  f(l_orderkey, step, s) as (select l_orderkey, step, [{{'t': t, 'm': m}}] from runs where step = 1 union all
    select f.l_orderkey, r.step, case when len(s) >= 2 and s[-2].t = r.t and s[-1].t <> r.t and s[-1].m <= 18 then list_append(list_slice(s, 1, len(s) - 2), {{'t': r.t, 'm': s[-2].m + s[-1].m + r.m}}) else list_append(s, {{'t': r.t, 'm': r.m}}) end
    from f join runs r on r.l_orderkey = f.l_orderkey and r.step = f.step + 1),
  whole as (select l_orderkey, arg_max(s, step) as s from f group by 1), each as (select l_orderkey, unnest(s) as g, unnest(range(len(s)::bigint)) as step from whole)
  select l_orderkey as route_id, step, g.t as street_name, round(g.m, 4) as length_m from each"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (way_segments, display_names, centerline_distances, official_names)}
ORACLES = {"way_segments": WAY_SEGMENTS, "display_names": DISPLAY_NAMES, "centerline_distances": CENTERLINE_DISTANCES, "official_names": OFFICIAL_NAMES, "absorb_short": ABSORB_SHORT}
