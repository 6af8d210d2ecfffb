"""DuckDB SQL that says the same as the queries."""

from __future__ import annotations

from gradewalk.functions.text import SUFFIXES
from gradewalk.operators.smoothing import WEIGHTS
from gradewalk.plans.queries import COST, CURVE, HAVERSINE, PG, PROFILES_SQL, E, G, P, R, points_sql, rolling_sql


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


def compass_sql(b: str) -> str:
    return f"['north','northeast','east','southeast','south','southwest','west','northwest'][(round_even({b} / 45.0, 0)::int % 8) + 1]"


def bearing_sql(x: str, y: str) -> str:
    return f"fmod(degrees(atan2({x}, {y})) + 360.0 + 360.0, 360.0)"


STEPS = """marked as (select *, case when lag(street) over w = street and row_number() over w > 1 then 0 else 1 end as new from rt window w as (partition by l_orderkey order by pos)),
  stepped as (select *, sum(new) over (partition by l_orderkey order by pos rows unbounded preceding) as step from marked)"""
METRICS = f"""m as (select l_orderkey, sum(time_s) as time_s, sum(length_m) as distance_m, sum(gain_m) as gain_m, sum(discomfort) as hill, sum(barrier) as barrier, max(g) as max_up, sum(cost) as score from c where mode = 'balanced' group by 1)"""
SMOOTH = """h as (select *, list_sort(list(z) over (partition by edge_id order by dist_m rows between 2 preceding and 2 following)) as a from p),
  h2 as (select *, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) / 2 as med from h),
  h3 as (select *, list_sort(list_transform(a, lambda v: abs(v - med))) as s from h2),
  h4 as (select edge_id, dist_m, z, med, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) / 2 as mad from h3),
  hh as (select edge_id, dist_m, z as raw, case when (mad = 0 and z <> med) or (mad <> 0 and abs(z - med) > 3 * 1.4826 * mad) then med else z end as hz from h4)"""


def savgol_sql(source: str, value: str) -> str:
    scale, rows = WEIGHTS[7]
    case = " ".join([f"when rn = {k + 1} then (" + " + ".join(f"({c}) * h7[{i + 1}]" for i, c in enumerate(rows[k])) + f") / {scale}" for k in range(3)] + [f"when rn = n - {2 - k} then (" + " + ".join(f"({c}) * t7[{i + 1}]" for i, c in enumerate(rows[4 + k])) + f") / {scale}" for k in range(3)])
    mid = " + ".join(f"({c}) * list_extract(a7, {i + 1})" for i, c in enumerate(rows[3]))
    return f"""s1 as (select *, row_number() over w as rn, count(*) over (partition by edge_id) as n, list({value}) over (partition by edge_id order by dist_m rows between 3 preceding and 3 following) as a7 from {source} window w as (partition by edge_id order by dist_m)),
  s2 as (select *, first_value(l7) over (partition by edge_id order by rn) as h7, last_value(f7) over (partition by edge_id order by rn rows between unbounded preceding and unbounded following) as t7 from (select *, list({value}) over (partition by edge_id order by dist_m rows between current row and 6 following) as l7, list({value}) over (partition by edge_id order by dist_m rows between 6 preceding and current row) as f7 from s1)),
  s3 as (select edge_id, dist_m, {value} as before, case {case} else ({mid}) / {scale} end as sz from s2)"""


#: Streets, and options of routes over them: least-cost paths of each profile, then what is left of three tries a request.
STREETS = f"""l as (select l_suppkey as source, (l_suppkey + 1 + l_partkey % (n // 10 + 1)) % n as target, l_orderkey * 8 + l_linenumber as id, l_quantity, l_quantity * 10 + (((l_orderkey * 8 + l_linenumber) * 7919) % 100003) * 0.00001::double as length_m, l_discount * 2 as g, l_tax as barrier, (l_returnflag = 'R' and l_linestatus = 'F') as stairs
    from lineitem, (select max(s_suppkey) + 1 as n from supplier)),
  e as (select source * 1000000 + target as edge_id, source, target, length_m, length_m / 1.34 as time_s, g, l_quantity * g as gain_m, barrier, stairs from (select *, row_number() over (partition by source, target order by length_m, id, g, barrier, stairs) as rn from l) where rn = 1),
  {PROFILES_SQL}, {COST},
  rq as (select mode || '-' || goal as request_id, mode, goal from profiles, (select unnest([n // 4, n // 2, 3 * n // 4])::bigint as goal from (select max(s_suppkey) + 1 as n from supplier))),
  p(mode, node, cost, path) using key (mode, node) as (select mode, 0::bigint, 0.0::double, []::bigint[] from profiles union
    (select p.mode, c.target, min(p.cost + c.cost), arg_min(list_append(p.path, c.edge_id), p.cost + c.cost) from p join c on p.node = c.source and p.mode = c.mode and c.cost is not null left join recurring.p as q on q.mode = p.mode and q.node = c.target where q.cost is null or p.cost + c.cost < q.cost group by 1, 2)),
  t as (select r.request_id, r.goal, place, case place when 0 then 'fastest' when 2 then 'flattest' when 1 then case when r.mode = 'accessibility' then 'accessible' else 'recommended' end end as label, p.mode, p.path
    from rq r, range(3) as k(place) join p on p.node = r.goal and p.mode = case place when 0 then 'fastest' when 1 then r.mode else 'avoid_hills' end),
  o as (select t.request_id, t.place, any_value(t.goal) as goal, any_value(t.label) as label, any_value(t.path) as path, sum(c.time_s) as time_s, sum(c.length_m) as distance_m, max(c.g) as grade, sum(c.discomfort) as hill, sum(c.barrier) as barrier, sum(c.cost) as score
    from (select *, unnest(path) as edge_id from t) t join c on c.edge_id = t.edge_id and c.mode = t.mode group by 1, 2),
  it as (select o.* from o left join o f on f.request_id = o.request_id and f.place = 0 where o.label <> 'flattest' or f.place is null or o.time_s <= f.time_s + 300),
  d1 as (select a.* from it a where a.place < 2 and not exists (select 1 from it b where b.request_id = a.request_id and b.place < a.place and len(list_intersect(a.path, b.path)) / least(len(a.path), len(b.path))::double > 0.95)),
  d2 as (select * from d1 union all select a.* from it a where a.place = 2 and not exists (select 1 from d1 b where b.request_id = a.request_id and len(list_intersect(a.path, b.path)) / least(len(a.path), len(b.path))::double > 0.95)),
  kept as (select a.* from d2 a where not exists (select 1 from d2 b where b.request_id = a.request_id
    and b.time_s <= a.time_s + 1e-9 and b.distance_m <= a.distance_m + 1e-9 and b.grade <= a.grade + 1e-9 and b.hill <= a.hill + 1e-9 and b.barrier <= a.barrier + 1e-9 and b.score <= a.score + 1e-9
    and (b.time_s < a.time_s - 1e-9 or b.distance_m < a.distance_m - 1e-9 or b.grade < a.grade - 1e-9 or b.hill < a.hill - 1e-9 or b.barrier < a.barrier - 1e-9 or b.score < a.score - 1e-9))),
  ranked as (select *, (row_number() over (partition by request_id order by case when label in ('recommended', 'accessible') then 0 when label = 'fastest' then 1 else 2 end, score, place) - 1)::int as rank from kept)"""

ORACLES = {
    "grade_lag": f"with {P}, {G} select edge_id, {r6('dist_m', 'dist_m')}, {r6('grade', 'grade')} from g",
    "gain_loss": f"with {P}, {G} select edge_id, {r6('coalesce(sum(case when dz > 0 then dz end), 0)', 'gain_m')}, {r6('coalesce(sum(case when dz <= 0 then -dz end), 0)', 'loss_m')} from g group by 1",
    "rolling_grades": f"with {P}, {G}, {rolling_sql(20)}, {rolling_sql(50)} select r20.edge_id, {r6('r20.dist_m', 'dist_m')}, {r6('roll20', 'rolling_grade_20m')}, {r6('roll50', 'rolling_grade_50m')} from r20 join r50 on r20.edge_id = r50.edge_id and r20.dist_m = r50.dist_m",
    "edge_grade_metrics": f"""with {P}, {G}, {rolling_sql(20)}, {rolling_sql(50)}, j as (select g.*, roll20, roll50 from g join r20 using (edge_id, dist_m) join r50 using (edge_id, dist_m))
      select edge_id, {r6('coalesce(sum(case when dz > 0 then dz end), 0)', 'gain_m')}, {r6('coalesce(sum(case when dz <= 0 then -dz end), 0)', 'loss_m')},
      {r6('coalesce((arg_max(z, dist_m) - arg_min(z, dist_m)) / nullif(max(dist_m) - min(dist_m), 0), 0)', 'mean_grade')},
      {r6('greatest(0, coalesce(max(grade), 0))', 'max_uphill_grade')}, {r6('greatest(0, coalesce(max(-grade), 0))', 'max_downhill_grade')}, {r6('coalesce(max(abs(grade)), 0)', 'max_abs_grade')},
      {r6('greatest(0, max(roll20))', 'sustained_uphill_grade_20m')}, {r6('greatest(0, max(-roll20))', 'sustained_downhill_grade_20m')}, {r6('greatest(0, max(roll50))', 'sustained_uphill_grade_50m')}, {r6('greatest(0, max(-roll50))', 'sustained_downhill_grade_50m')},
      {', '.join(r6(f'coalesce(sum(case when grade > {t / 100} then dd end), 0)', f'length_above_{t}pct_up_m') for t in (6, 8, 10, 12))} from j group by 1""",
    "reverse_profile": f"with {P}, t as (select edge_id, max(dist_m) over (partition by edge_id) - dist_m as dist_m, z from p) select edge_id, {r6('dist_m', 'dist_m')}, {r6('(z - lag(z) over w) / (dist_m - lag(dist_m) over w)', 'grade')} from t window w as (partition by edge_id order by dist_m)",
    "hampel_filter": f"with {P}, {SMOOTH} select edge_id, {r6('dist_m', 'dist_m')}, {r6('hz', 'z')} from hh",
    "savgol_smooth": f"with {P}, {savgol_sql('p', 'z')} select edge_id, {r6('dist_m', 'dist_m')}, {r6('sz', 'z')} from s3",
    "smooth_profile": f"with {P}, {SMOOTH}, {savgol_sql('hh', 'hz')} select edge_id, {r6('dist_m', 'dist_m')}, {r6('sz', 'z')}, {r6('(sz - lag(sz) over w) / (dist_m - lag(dist_m) over w)', 'grade')} from s3 window w as (partition by edge_id order by dist_m)",
    "threshold_breaks": f"""with {P}, {G}, q as (select edge_id, dist_m as d, abs(coalesce(grade, 0)) as l, lead(dist_m) over w as d2, abs(coalesce(lead(grade) over w, 0)) as r from g window w as (partition by edge_id order by dist_m))
      select edge_id, t as threshold, {r6('d + (t - l) / (r - l) * (d2 - d)', 'at')} from q, (values (0.06::double), (0.10::double), (0.12::double)) v(t) where d2 is not null and ((l < t and t <= r) or (r < t and t <= l))""",
    "extrema_breaks": f"""with {P}, {G}, q as (select edge_id, dist_m, coalesce(grade, 0) as x, lag(coalesce(grade, 0)) over w as b, lead(coalesce(grade, 0)) over w as a from g window w as (partition by edge_id order by dist_m))
      select edge_id, {r6('dist_m', 'at')} from q where ((x > b and x > a) or (x < b and x < a)) and least(abs(x - b), abs(x - a)) >= 0.02""",
    "regular_breaks": "select p_partkey, unnest(case when p_size = 0 then [0.0::double] else list_append(list_transform(range(0, ceil(p_size / 15.0)::bigint), lambda i: round(i * 15.0::double, 6)), p_size::double) end) as at from part",
    "merge_breaks": """with recursive q as (select l_orderkey, l_quantity::double as x, row_number() over (partition by l_orderkey order by l_quantity) as rn from lineitem),
      f(l_orderkey, rn, pts) as (select l_orderkey, rn, [x] from q where rn = 1 union all
        select f.l_orderkey, q.rn, case when q.x - f.pts[-1] >= 3 then list_append(f.pts, q.x) else list_append(f.pts[:-2], (f.pts[-1] + q.x) / 2) end from f join q on q.l_orderkey = f.l_orderkey and q.rn = f.rn + 1),
      b as (select l_orderkey, arg_max(pts, rn) as pts from f group by 1), u as (select l_orderkey, unnest(range(len(pts)::bigint)) as pos, pts from b)
      select l_orderkey, pos, round(pts[pos + 1], 6) + 0.0 as at from u""",
    "penalty_curves": f"""with v as (select l_orderkey, l_linenumber, l_discount * 2 as g from lineitem) select l_orderkey, l_linenumber, {r6(CURVE, 'uphill')},
      {r6('case when g <= 0.08 then 0 when g <= 0.12 then ((g - 0.08) / 0.04) ** 2 else 1 + 2 * ((g - 0.12) / 0.08) ** 2 end', 'downhill')}, {r6('case when g <= 0.10 then 0 else 90 * ((g - 0.10) / greatest(0.16::double - 0.10::double, 1e-9)) ** 2 end', 'max_grade')} from v""",
    "edge_cost_profiles": f"with {E}, {PROFILES_SQL}, {COST} select edge_id, mode, {r6('cost', 'cost')} from c",
    "route_metrics": f"with {E}, {PROFILES_SQL}, {COST}, {METRICS} select l_orderkey, round(time_s, 4) as time_s, round(distance_m, 4) as distance_m, round(gain_m, 4) as gain_m, round(hill, 4) as hill_discomfort, round(barrier, 4) as barrier_penalty, round(max_up, 4) as max_uphill_grade, round(score, 4) as route_score from m",
    "snap_nearest": f"""with a as ({points_sql('customer', 'c_custkey')}), b as ({points_sql('supplier', 's_suppkey')}), d as (select a.id as c, b.id as s, {HAVERSINE} as m from a, b),
      k as (select *, row_number() over (partition by c order by m, s) as n from d) select c as c_custkey, s as s_suppkey, round(m, 3) as distance_m from k where n = 1""",
    "distance_join": f"with a as ({points_sql('customer', 'c_custkey')}), b as ({points_sql('supplier', 's_suppkey')}), d as (select a.id as c_custkey, b.id as s_suppkey, {HAVERSINE} as m from a, b) select c_custkey, s_suppkey, round(m, 3) as distance_m from d where m <= 250",
    "geodesic_lines": f"""with recursive f as (select 1 / 298.257223563::double as f, 6378137.0::double as a), k as (select c_custkey, (c_custkey * 104729 % 15001) * 0.01::double - 75 as lat, (c_custkey * 7919 % 36001) * 0.01::double - 180 as lon from customer),
      u as (select c_custkey, f, a, atan((1 - f) * tan(radians(lat))) as u1, atan((1 - f) * tan(radians(lat + (c_custkey * 31 % 1001) * 0.01::double - 5))) as u2, radians(lon + (c_custkey * 37 % 8009) * 0.01::double - 40 - lon) as wide from k, f),
      i(n, c_custkey, f, a, u1, u2, wide, lam) as (select 0, *, wide from u union all select n + 1, c_custkey, f, a, u1, u2, wide, wide + (1 - c) * f * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1)))
        from (select *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) as c, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) as m from (select *, atan2(ss, cs) as s, coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) as sa from
          (select *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs from i where n < 8)))),
      e as (select *, atan2(ss, cs) as s, coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) as sa from (select *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) as cs from i where n = 8)),
      w as (select *, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) as m, (1 - sa * sa) * (1 / (1 - f) ** 2 - 1) as q from e), v as (select *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) as aa, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) as bb from w)
      select c_custkey, round(a * (1 - f) * aa * (s - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))), 3) as distance_m,
        {r6(bearing_sql('cos(u2) * sin(lam)', 'cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)'), 'azimuth')} from v""",
    "bearing_turns": f"""with v as (select l_orderkey, l_linenumber, {bearing_sql('l_quantity - 25.3', 'l_discount * 1000 - 41.7')} as a, {bearing_sql('l_tax * 1000 - 33.3', 'l_quantity - 20.6')} as b from lineitem),
      t as (select *, fmod(b - a + 540.0, 360.0) - 180.0 as d, fmod(abs(a - b), 180.0) as p from v)
      select l_orderkey, l_linenumber, {r6('a', 'bearing')}, {compass_sql('a')} as compass, case when abs(d) < 30 then 'Continue' when abs(d) > 150 then 'Turn around' when d > 0 then 'Turn right' else 'Turn left' end as turn, {r6('least(p, 180 - p)', 'delta')} from t""",
    "shortest_path_cost": f"""with recursive {E}, w as (select source, target, min(time_s) as s from e group by 1, 2),
      p(node, cost) using key (node) as (select 0::bigint, 0.0::double union (select w.target, min(p.cost + w.s) from p join w on p.node = w.source left join recurring.p as q on q.node = w.target where q.cost is null or p.cost + w.s < q.cost group by 1))
      select node, round(cost, 4) as cost from p""",
    "supplier_routes": f"""with recursive {E}, {PROFILES_SQL}, {COST}, w as (select source, target, min(cost) as s from c where mode = 'balanced' and cost is not null group by 1, 2),
      p(node, cost) using key (node) as (select 0::bigint, 0.0::double union (select w.target, min(p.cost + w.s) from p join w on p.node = w.source left join recurring.p as q on q.node = w.target where q.cost is null or p.cost + w.s < q.cost group by 1))
      select node as goal, round(cost, 4) as cost from p where node <> 0""",
    "landmark_routes": f"""with recursive {E}, w as (select source, target, min(time_s) as s from e group by 1, 2), r as (select s_suppkey as start, (s_suppkey * 7919 + 3) % n as goal from supplier, (select max(s_suppkey) + 1 as n from supplier)),
      p(start, node, cost) using key (start, node) as (select start, start, 0.0::double from r union (select p.start, w.target, min(p.cost + w.s) from p join w on p.node = w.source left join recurring.p as q on q.start = p.start and q.node = w.target where q.cost is null or p.cost + w.s < q.cost group by 1, 2))
      select r.start, r.goal, round(cost, 4) as cost from r join p on p.start = r.start and p.node = r.goal""",
    "route_candidates": f"with recursive {STREETS} select request_id, rank, label, array_to_string(path, ',') as edge_ids, round(time_s, 4) as time_s, {r6('grade', 'max_uphill_grade')}, round(score, 4) as route_score from ranked",
    "geojson_features": f"""with recursive {STREETS}, pt as ({points_sql('supplier', 's_suppkey')}), w as (select request_id, rank, unnest(path) as edge_id, unnest(range(1, len(path) + 1)) as place from ranked)
      select request_id, rank, 0::bigint as place, 'route' as feature_type, 0::bigint as edge_id, 0.0::double as length_m, {r6('lon', 'lon')} from ranked, pt where id = 0
      union all select request_id, rank, place, 'edge', w.edge_id, round(e.length_m, 4), {r6('lon', 'lon')} from w join e on e.edge_id = w.edge_id join pt on pt.id = e.source
      union all select request_id, rank, 1000000 + k, ['origin', 'destination'][k + 1], 0, 0.0, {r6('lon', 'lon')} from ranked, range(2) as x(k) join pt on pt.id = case k when 0 then 0 else goal end""",
    "connector_reach": f"""with recursive {E}, w as (select source, target, min(length_m) as s from e where length_m <= 50 group by 1, 2),
      p(start, node, cost) using key (start, node) as (select s_suppkey, s_suppkey, 0.0::double from supplier union (select p.start, w.target, min(p.cost + w.s) from p join w on p.node = w.source left join recurring.p as q on q.start = p.start and q.node = w.target where p.cost + w.s <= 300 and (q.cost is null or p.cost + w.s < q.cost) group by 1, 2))
      select start, node, round(cost, 4) as cost from p""",
    "dedupe_overlap": """with s as (select l_orderkey, list_distinct(list(l_partkey)) as parts from lineitem group by 1), o as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders)
      select o.o_orderkey, o.before, round(len(list_intersect(a.parts, b.parts)) / least(len(a.parts), len(b.parts))::double, 6) + 0.0 as overlap from o join s a on a.l_orderkey = o.o_orderkey join s b on b.l_orderkey = o.before""",
    "pareto_front": """select l_orderkey, l_partkey, l_extendedprice, l_tax, l_quantity from lineitem a where not exists (select 1 from lineitem b where a.l_orderkey = b.l_orderkey
      and b.l_extendedprice <= a.l_extendedprice + 1e-9 and b.l_tax <= a.l_tax + 1e-9 and b.l_quantity <= a.l_quantity + 1e-9
      and (b.l_extendedprice < a.l_extendedprice - 1e-9 or b.l_tax < a.l_tax - 1e-9 or b.l_quantity < a.l_quantity - 1e-9))""",
    "hill_events": f"""with {E}, {R}, x as (select *, sum(length_m) over (partition by l_orderkey order by pos rows unbounded preceding) as till from rt), y as (select *, till - length_m as since from x where g >= 0.06),
      i as (select *, case when street is not distinct from lag(street) over w and since - lag(till) over w <= 20 then 0 else 1 end as new from y window w as (partition by l_orderkey order by pos)),
      k as (select *, sum(new) over (partition by l_orderkey order by pos rows unbounded preceding) as event from i)
      select l_orderkey as route_id, event::bigint as event, arg_min(street, pos) as street_name, round(min(since), 10) as start_m, round(max(till) - min(since), 10) as length_m, round(sum(gain_m), 10) as elevation_gain_m, round(sum(gain_m) / (max(till) - min(since)), 10) as avg_grade, round(max(g), 10) as max_grade from k group by 1, 2""",
    "giant_grades": f"with {PG}, {G}, {rolling_sql(20)}, {rolling_sql(50)} select r20.edge_id, {r6('r20.dist_m', 'dist_m')}, {r6('grade', 'grade')}, {r6('roll20', 'rolling_grade_20m')}, {r6('roll50', 'rolling_grade_50m')} from r20 join r50 on r20.dist_m = r50.dist_m join g on g.dist_m = r20.dist_m",
    "giant_hills": f"""with o as (select o_orderkey as pos, 'Street ' || (o_orderkey // 9) as street, floor(o_totalprice)::bigint as c from orders), x as (select *, 4 + (c % 64) * 0.25::double as length_m, (c % 13) / 100.0 as g, (c % 32) * 0.125::double as gain_m from o),
      y as (select *, sum(length_m) over (order by pos rows unbounded preceding) as till from x), s as (select *, till - length_m as since from y where g >= 0.06),
      i as (select *, case when street = lag(street) over w and since - lag(till) over w <= 20 then 0 else 1 end as new from s window w as (order by pos)), k as (select *, sum(new) over (order by pos rows unbounded preceding) as event from i)
      select 0::bigint as route_id, event::bigint as event, arg_min(street, pos) as street_name, {r6('min(since)', 'start_m')}, {r6('max(till) - min(since)', 'length_m')}, {r6('sum(gain_m)', 'elevation_gain_m')}, {r6('sum(gain_m) / (max(till) - min(since))', 'avg_grade')}, {r6('max(g)', 'max_grade')} from k group by event""",
    "direction_steps": f"with {E}, {R}, {STEPS} select l_orderkey as route_id, step::bigint as step, any_value(street) as street_name, round(sum(length_m), 4) as length_m, {r6('max(g)', 'max_uphill')}, count(*) as n_edges from stepped group by 1, 2",
    "street_name_format": f"""with v as (select p_partkey, upper(p_name) as base, case when p_size % 3 = 0 then 'ST' when p_size % 3 = 1 then 'AVE.' else '' end as last from part),
      t as (select p_partkey, string_split(trim(regexp_replace(base || ' ' || last, '\\s+', ' ', 'g')), ' ') as w from v), m as (select map {{{', '.join(f"'{k}': '{x}'" for k, x in SUFFIXES.items())}}} as suffixes),
      f as (select p_partkey, array_to_string(list_transform(w, lambda x, i: case when i = len(w) and suffixes[upper(trim(x, '.'))] is not null then suffixes[upper(trim(x, '.'))] when regexp_full_match(trim(x, '.'), '\\d+(ST|ND|RD|TH)?') then trim(x, '.') else array_to_string(list_transform(string_split(lower(x), ''), lambda ch, j: case when j = 1 or not regexp_matches(string_split(lower(x), '')[j - 1], '[a-z]') then upper(ch) else ch end), '') end), ' ') as name from t, m)
      select p_partkey, name, replace(lower(name), '.', '') as normalized from f""",
    "walkable_filter": """with v as (select event_id, (props ->> '$.k')::int as k from events), t as (select event_id, case when k % 3 = 0 then 'residential' when k % 3 = 1 then 'footway' else 'motorway' end as highway, k % 5 = 0 as closed, k % 2 = 0 as no_sidewalk from v)
      select event_id, highway <> 'motorway' and not closed and not (no_sidewalk and highway = 'residential') as walkable from t""",
    "json_heights": "select event_id, cast(cast(value as decimal(20, 4)) as varchar)::double as z_m from events",
    "directed_edges": "select 2 * o_orderkey + 1 as edge_id, o_custkey as source, o_orderkey % 97 as target from orders union all select 2 * o_orderkey + 2, o_orderkey % 97, o_custkey from orders",
    "segment_numbers": """with w as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos from lineitem)
      select l_orderkey as way_idx, pos, row_number() over (order by l_orderkey, pos) - 1 as number from w""",
    "explain_text": f"""with {E}, {PROFILES_SQL}, {COST}, {METRICS}, r as (select l_orderkey, round(time_s, 4) as t, round(distance_m, 4) + 0.37 as d, round(max_up, 4) as g from m),
      o as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders),
      j as (select o_orderkey, a.*, b.t as ft, b.g as fg from o join r a on a.l_orderkey = o_orderkey left join r b on b.l_orderkey = before),
      k as (select o_orderkey, t, g, ft, fg, 'Recommended: ' || greatest(0, round_even(t / 60.0, 0)::bigint) || ' min, ' || printf('%.1f', d / 1609.344) || ' mi.' as base, round_even(g * 100, 0)::bigint || '%' as own, round_even(fg * 100, 0)::bigint || '%' as other, t - ft as delta, round_even((t - ft) / 60.0, 0)::bigint as n from j),
      l as (select *, ' This is ' || case when delta <= 0 then 'no slower' when delta < 60 then 'less than 1 minute slower' else 'about ' || n || case when n = 1 then ' minute' else ' minutes' end || ' slower' end || ' than the fastest route' as slower, 'Max uphill grade is ' || own || ', versus ' || other || ' on the fastest route.' as versus from k)
      select o_orderkey, case when ft is null and g > 0 then base || ' Max uphill grade is ' || own || '.' when ft is null then base when g < fg then base || slower || ', but avoids the steepest climb. ' || versus || ' Distance above 10% uphill is near zero.' else base || slower || '. ' || versus end as explanation from l""",
}
