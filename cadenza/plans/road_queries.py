"""Queries over road graphs and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import geo
from cadenza.operators import roads as g
from cadenza.operators import tracks as t
from cadenza.plans import duck
from cadenza.plans.registry import register

BOX = (50.62, 50.75, 5.93, 6.02)
NG = "map_edges map_nodes"
ENDS = f"""SELECT DISTINCT e.* FROM map_edges e JOIN map_nodes a ON a.id = e.from_node JOIN map_nodes b ON b.id = e.to_node WHERE {g.in_box('a.lat', 'a.lon', BOX)} OR {g.in_box('b.lat', 'b.lon', BOX)}"""
register("edges_in_bbox", lambda e, n: g.edges_in_box(e, n, BOX).select("from_node", "to_node", "length_m", "is_traversed"), NG, f"SELECT from_node, to_node, length_m, is_traversed FROM ({ENDS}) q")
REWARD = g.routing_reward("pedal_flow_count", "gravity_flow_count", "is_traversed", "(coalesce(predicted_gravity_flow_probability, 0e0) + coalesce(predicted_pedal_flow_probability, 0e0))", "flow_confidence")
J = lambda field: f"CASE WHEN json_valid(metadata) THEN CAST(json_extract_string(metadata, '$.{field}') AS DOUBLE) ELSE NULL END"
register("routing_reward", lambda e, n, m: g.with_metadata(g.edges_in_box(e, n, BOX).select("from_node", "to_node").join(m, ["from_node", "to_node"])).select("from_node", "to_node", F.round(F.expr(REWARD), 6).alias("reward")), f"{NG} edge_metadata",
  f"""SELECT from_node, to_node, round(coalesce({J('pedal_flow_count')}, 0) + coalesce({J('gravity_flow_count')}, 0) + CASE WHEN is_traversed THEN 0 ELSE 3e-1 * (coalesce({J('predicted_pedal_flow_probability')}, 0) + coalesce({J('predicted_gravity_flow_probability')}, 0)) * coalesce({J('flow_confidence')}, 0) END, 6) AS reward
  FROM edge_metadata WHERE (from_node, to_node) IN (SELECT (from_node, to_node) FROM ({ENDS}) q)""")
register("edge_metadata_fields", lambda m: g.with_metadata(m).select("from_node", "to_node", "pedal_flow_count", "flow_confidence"), "edge_metadata", f"SELECT from_node, to_node, CAST({J('pedal_flow_count')} AS INT) AS pedal_flow_count, {J('flow_confidence')} AS flow_confidence FROM edge_metadata")
register("flow_segments", lambda e, n: g.flow_segments(g.edges_in_box(e, n, BOX)).select("from_node", "to_node", "pedal_count", "gravity_count"), NG, f"SELECT from_node, to_node, pedal_count, gravity_count FROM ({ENDS}) q WHERE CASE WHEN pedal_count IS NULL THEN 0 ELSE pedal_count END + CASE WHEN gravity_count IS NULL THEN 0 ELSE gravity_count END > 2")
TURNS = "SELECT a.from_node AS a_from, a.to_node AS junction, b.to_node AS b_to FROM map_edges a JOIN map_edges b ON b.from_node = a.to_node WHERE NOT (a.from_node = a.to_node AND a.to_node = b.to_node)"
register("turns_in_bbox", lambda e, n: g.turns_in_box(g.successors(e).withColumnRenamed("via", "junction"), n, BOX).select("a_from", "junction", "b_to"), NG, f"SELECT a_from, junction, b_to FROM ({TURNS}) q JOIN map_nodes n ON n.id = junction WHERE {g.in_box('lat', 'lon', BOX)}")
register("edge_adjacency", lambda e: g.successors(e).select("a_from", F.col("via").alias("junction"), "b_to"), "map_edges", TURNS)
register("edge_pair_lookup", lambda e, p: g.pair_lookup(e, p.selectExpr("p_partkey as from_node", "p_partkey + 20 as to_node").where("from_node % 7 = 0")).select("from_node", "to_node", "length_m"), "map_edges part", "SELECT from_node, to_node, length_m FROM map_edges WHERE from_node % 7 = 0 AND to_node = from_node + 20")
register("connector_lookup", lambda e: g.either_end(e, 42).select("from_node", "to_node"), "map_edges", "SELECT from_node, to_node FROM map_edges WHERE from_node = 42 OR to_node = 42")
register("hazard_filter", lambda e: g.safe_roads(e).select("from_node", "to_node", "highway"), "map_edges", "SELECT from_node, to_node, highway FROM map_edges WHERE highway IS NULL OR NOT (highway LIKE 'motorway%' OR highway LIKE 'trunk%')")
register("traversed_edges", lambda e: e.where("is_traversed").select("from_node", "to_node"), "map_edges", "SELECT from_node, to_node FROM map_edges WHERE from_node % 3 > 0")
register("array_member_join", lambda n, l: g.members(l.groupBy(F.col("l_orderkey").alias("group_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("ids")), n.select(F.col("id").alias("node")).where("node % 3 <> 0"), "ids", "node").selectExpr("group_id", "n", "array_join(members, ',') as members"), "map_nodes lineitem",
  "SELECT l_orderkey AS group_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM (SELECT DISTINCT l_orderkey, id FROM lineitem JOIN map_nodes ON id = l_partkey WHERE id % 3 <> 0) q GROUP BY 1")
HOME = (50.68, 5.98)
DIST = geo.haversine("lat", "lon", geo.number(HOME[0]), geo.number(HOME[1]))
register("nearest_node", lambda n: n.select("id", F.round(F.expr(DIST), 4).alias("metres")).orderBy("metres", "id").limit(1), "map_nodes", f"SELECT id, round({DIST}, 4) AS metres FROM map_nodes ORDER BY 2, 1 LIMIT 1")
register("nodes_in_radius", lambda n: n.where(F.expr(f"{DIST} <= 3e3")).select("id", F.round(F.expr(DIST), 4).alias("metres")), "map_nodes", f"SELECT id, round({DIST}, 4) AS metres FROM map_nodes WHERE {DIST} <= 3e3")
BR = geo.bearing(geo.number(HOME[0]), geo.number(HOME[1]), "lat", "lon")
register("exit_candidates", lambda n: n.select("id", F.round(F.expr(DIST), 4).alias("metres"), F.expr(geo.bearing_difference(BR, "90e0")).alias("off")).where("metres between 3e3 and 8e3 and off <= 45e0").orderBy("metres", "id").limit(5).select("id", "metres"), "map_nodes",
  f"SELECT id, metres FROM (SELECT id, round({DIST}, 4) AS metres, {geo.bearing_difference(BR, '90e0')} AS off FROM map_nodes) q WHERE metres BETWEEN 3e3 AND 8e3 AND off <= 45e0 ORDER BY metres, id LIMIT 5")
register("nearest_corridor", lambda c: c.select("id", F.round(F.expr(DIST), 4).alias("metres")).orderBy("metres", "id").limit(1), "corridors", f"SELECT id, round({duck.hav('lat', 'lon', str(HOME[0]), str(HOME[1]))}, 4) AS metres FROM corridors ORDER BY 2, 1 LIMIT 1")
RIDE = 75.0


def _anchors(c, clockwise):
    scored = g.anchor_scores(c.withColumn("reward", F.col("pedal_reward") + F.col("gravity_reward")), *HOME, RIDE, 2900.0, clockwise)
    return g.top_per_group(scored.withColumn("score", F.round("score", 6)), "quadrant", "score", "id", 2).select("quadrant", "id", "score", "place")


def _anchor_sql(sign):
    e, n = f"((lon - {HOME[1]}) * 111320 * cos(radians({HOME[0]})))", f"((lat - {HOME[0]}) * 111320)"
    along, side = f"({e} * sin(radians({RIDE})) + {n} * cos(radians({RIDE})))", f"({e} * cos(radians({RIDE})) - {n} * sin(radians({RIDE})))"
    return f"""WITH q AS (SELECT c.id, {along.replace('lat', 'c.lat').replace('lon', 'c.lon')} AS al, {sign} * {side.replace('lat', 'c.lat').replace('lon', 'c.lon')} AS si, pedal_reward + gravity_reward AS reward, {duck.course(str(HOME[0]), str(HOME[1]), 'c.lat', 'c.lon')} AS head FROM corridors c),
  r AS (SELECT *, CASE WHEN al >= 0 THEN CASE WHEN si >= 0 THEN 0 ELSE 1 END WHEN si < 0 THEN 2 ELSE 3 END AS quadrant, min(reward) OVER () AS low, max(reward) OVER () AS high FROM q),
  z AS (SELECT CAST(quadrant AS INT) AS quadrant, id, round(al / 2900e0 + 5e-1 * cos(radians(head - ({RIDE} + {sign} * (CASE quadrant WHEN 0 THEN 45 WHEN 1 THEN -45 WHEN 2 THEN -135 ELSE 135 END)))) + CASE WHEN high > low THEN 1e-1 * (reward - low) / (high - low) ELSE 0 END, 6) AS score FROM r)
  SELECT quadrant, id, score, CAST(row_number() OVER (PARTITION BY quadrant ORDER BY score DESC, id) AS INT) AS place FROM z QUALIFY place <= 2"""


register("anchor_topk", lambda c: _anchors(c, True), "corridors", _anchor_sql(1))
register("anchor_topk_left", lambda c: _anchors(c, False), "corridors", _anchor_sql(-1))
register("fills_between", lambda c, n: g.fills_between(g.with_headings(c, n), (50.62, 5.93), (50.72, 6.02), 0.4).select("id", F.round("t", 6).alias("t")), "corridors map_nodes",
  f"""SELECT id, round(t, 6) AS t FROM (SELECT c.id, ((c.lon - 5.93) * (6.02 - 5.93) * power(cos(radians(50.62)), 2) + (c.lat - 50.62) * (50.72 - 50.62)) / (power((6.02 - 5.93) * cos(radians(50.62)), 2) + power(50.72 - 50.62, 2)) AS t, cos(radians({duck.course('a.lat', 'a.lon', 'b.lat', 'b.lon')} - {duck.course('50.62', '5.93', '50.72', '6.02')})) AS align
  FROM corridors c JOIN map_nodes a ON a.id = entry_node JOIN map_nodes b ON b.id = exit_node) q WHERE t BETWEEN 0 AND 1 AND align >= 4e-1""")
CANDIDATES = "select session_id as id, distance_km * 1e3 as distance_m, cast(rider_id as double) as reward, (session_id % 40) / 1e2 as compactness, (session_id % 23) / 1e2 as repeat_fraction from sessions"
BAND = "distance_m BETWEEN 15e4 * 85e-2 AND 15e4 * 115e-2"
GATE = "compactness >= 26e-2 AND repeat_fraction <= 15e-2"
register("rank_candidates", lambda s: g.ranked_candidates(s.sparkSession.sql(CANDIDATES.replace("sessions", "{s}"), s=s), 150000.0, 0.15).select("id", "in_band", "in_shape", "reward").limit(25), "sessions",
  f"SELECT id, {BAND} AS in_band, {GATE} AS in_shape, reward FROM ({CANDIDATES}) q ORDER BY {BAND} DESC, {GATE} DESC, reward DESC, id LIMIT 25")
register("winner", lambda s: g.winner(s.sparkSession.sql(CANDIDATES.replace("sessions", "{s}"), s=s), 150000.0, 0.15).select("id"), "sessions",
  f"SELECT id FROM ({CANDIDATES}) q WHERE {BAND} ORDER BY {GATE} DESC, CASE WHEN {GATE} THEN reward ELSE compactness - repeat_fraction END DESC, id LIMIT 1")
register("winner_without_gate", lambda s: g.winner(s.sparkSession.sql(CANDIDATES.replace("sessions", "{s}"), s=s), 150000.0, 0.15, least_compactness=0.9).select("id"), "sessions", f"SELECT id FROM ({CANDIDATES}) q WHERE {BAND} ORDER BY round(compactness - repeat_fraction, 9) DESC, id LIMIT 1")
register("deviations", lambda s: g.deviations(s.sparkSession.sql(CANDIDATES.replace("sessions", "{s}"), s=s), 150000.0).select("id", F.round("percent", 6).alias("percent")), "sessions", f"SELECT id, round(100 * (distance_m / 150000e0 - 1), 6) AS percent FROM ({CANDIDATES}) q")
TURN = g.turn_cost("angle", "measured", "hazard", "stop", "CAST(NULL AS DOUBLE)", "energy")
TURN_IN = "CAST(l_partkey % 181 AS DOUBLE) AS angle, l_suppkey % 2 = 0 AS measured, l_discount * 2e1 AS hazard, l_tax AS stop, l_quantity - 2e1 AS energy"
register("turn_cost", lambda l: l.selectExpr("l_orderkey", "l_linenumber", *[x.strip() for x in TURN_IN.split(",")]).select("l_orderkey", "l_linenumber", F.round(F.expr(TURN), 6).alias("cost")), "lineitem", f"SELECT l_orderkey, l_linenumber, round({TURN}, 6) AS cost FROM (SELECT l_orderkey, l_linenumber, {TURN_IN} FROM lineitem) q")
EDGE = g.composed_reward("(coalesce(pedal_count, 0) + coalesce(gravity_count, 0))", "is_traversed", "(coalesce(gravity_probability, 0e0) + coalesce(pedal_probability, 0e0))", "confidence")
register("edge_reward", lambda e: e.select("from_node", "to_node", F.round(F.expr(EDGE), 6).alias("reward")), "map_edges",
  """SELECT from_node, to_node, round(flow + CASE WHEN is_traversed OR confidence IS NULL OR confidence < 2e-1 THEN 0 ELSE 3e-1 * hope * confidence END, 6) AS reward
  FROM (SELECT *, CAST(ifnull(pedal_count, 0) + ifnull(gravity_count, 0) AS DOUBLE) AS flow, ifnull(pedal_probability, 0) + ifnull(gravity_probability, 0) AS hope FROM map_edges) q""")
register("corridor_reward", lambda c: g.corridor_rewards(c, 2.0).select("id", F.round("length_m", 6).alias("length_m"), "reward"), "corridors",
  "SELECT from_node // 5 AS id, round(sum(length_m), 6) AS length_m, 2e0 * (coalesce(sum(pedal_count), 0) + coalesce(sum(gravity_count), 0)) AS reward FROM map_edges WHERE to_node = from_node + 1 AND from_node % 5 < 4 GROUP BY 1")
register("max_reachable", lambda c, e: g.max_reachable(c, e.selectExpr("length_m as distance_m")), "corridors map_edges", "SELECT round((SELECT sum(length_m) FROM corridors) + (SELECT avg(length_m) FROM map_edges) * (SELECT count(*) FROM corridors), 4) AS max_m")


def _lent(e):
    """Roads that borrow from the same road the other way, if that one is ridden and measured."""
    back = e.where("is_traversed and speed_mean is not null and power_mean is not null").selectExpr("to_node as from_node", "from_node as to_node", "speed_mean as speed", "power_mean as power")
    return e.where("not (is_traversed and speed_mean is not null and power_mean is not null)").select("from_node", "to_node").join(back, ["from_node", "to_node"])


def _totals(p):
    return p.groupBy("route").agg((F.sum("length_m") * 1.25).alias("total_m"))


LENT = "lent AS (SELECT a.from_node, a.to_node, b.speed_mean AS speed, b.power_mean AS power FROM map_edges a JOIN map_edges b ON b.from_node = a.to_node AND b.to_node = a.from_node WHERE NOT (a.is_traversed AND a.speed_mean IS NOT NULL AND a.power_mean IS NOT NULL) AND b.is_traversed AND b.speed_mean IS NOT NULL AND b.power_mean IS NOT NULL)"
register("discovery_score", lambda p, e: g.discovery_scores(p, _lent(e)), "paths map_edges", f"WITH {LENT} SELECT route, CAST(floor(100 * coalesce(sum(length_m) FILTER (NOT is_traversed AND speed IS NULL), 0) / sum(length_m) + 0.5e0) AS INT) AS score FROM paths LEFT JOIN lent USING (from_node, to_node) GROUP BY route")
register("speed_power_estimate", lambda p, e: g.speed_power_estimates(p, _totals(p), _lent(e)), "paths map_edges", f"""WITH {LENT}, u AS (SELECT route, length_m, is_traversed AND speed_mean IS NOT NULL AND power_mean IS NOT NULL AS own, speed_mean, power_mean, speed, power FROM paths LEFT JOIN lent USING (from_node, to_node)),
  v AS (SELECT route, sum(length_m) * 1.25 AS total, coalesce(sum(length_m) FILTER (own), 0) AS direct, coalesce(sum(length_m) FILTER (own OR speed IS NOT NULL), 0) AS known, sum(length_m * CASE WHEN own THEN speed_mean ELSE speed END) AS vs, sum(length_m * CASE WHEN own THEN power_mean ELSE power END) AS ps FROM u GROUP BY route)
  SELECT route, coalesce(CAST(floor(vs / nullif(known, 0) + 0.5e0) AS INT), 0) AS speed_kmh, coalesce(CAST(floor(ps / nullif(known, 0) + 0.5e0) AS INT), 0) AS power_w, CAST(floor(100 * direct / total + 0.5e0) AS INT) AS coverage, CAST(floor(100 * known / total + 0.5e0) AS INT) AS total_coverage, CASE WHEN floor(100 * known / total + 0.5e0) > 0 THEN 'Estimate' ELSE 'NoRideHistory' END AS outcome FROM v""")
ESTIMATE = "SELECT route, '{k}' AS kind, round(sum(length_m) / 1000 / (sum(speed_{q} * length_m) / sum(length_m) FILTER (speed_{q} IS NOT NULL)) * 3600, 4) AS sec, round(coalesce(sum(length_m / speed_{q} * power_{q}) / sum(length_m / speed_{q}) FILTER (power_{q} IS NOT NULL), 0e0), 4) AS power_w FROM paths GROUP BY route HAVING count(speed_{q}) > 0"
register("ride_estimate", g.ride_estimates, "paths", " UNION ALL ".join(ESTIMATE.format(k=k, q=q) for k, q in (("slow", "p25"), ("average", "p50"), ("fast", "p75"))))
register("percentile_coverage", g.percentile_coverage, "paths", "SELECT route, round(100 * coalesce(sum(length_m) FILTER (speed_p25 + speed_p50 + speed_p75 IS NOT NULL), 0) / sum(length_m), 6) AS percent FROM paths GROUP BY route")
register("new_road_share", g.new_road_shares, "paths", "SELECT route, round(100 * coalesce(sum(length_m) FILTER (from_node % 3 = 0), 0) / sum(length_m), 6) AS percent FROM paths GROUP BY route")
register("route_shape", lambda p, n: g.shape_report(p, n, 3000.0), "paths map_nodes", """WITH q AS (SELECT *, sum(length_m) OVER (PARTITION BY route ORDER BY seq) AS upto, sum(length_m) OVER (PARTITION BY route) AS total, least(from_node, to_node) || '-' || greatest(from_node, to_node) AS road, row_number() OVER (PARTITION BY route, least(from_node, to_node), greatest(from_node, to_node) ORDER BY seq) AS nth FROM paths),
  z AS (SELECT route, road, coalesce(sum(length_m) FILTER (nth > 1), 0) AS extra, bool_and(upto <= 3000 OR upto - length_m >= total - 3000) AS exempt, count(*) AS n FROM q GROUP BY 1, 2),
  c AS (SELECT route, sum(extra) AS raw, coalesce(sum(extra) FILTER (NOT exempt), 0) AS rep, count(*) FILTER (n > 1 AND NOT exempt) AS roads FROM z GROUP BY 1),
  l AS (SELECT route, seq, from_node AS node FROM paths UNION ALL SELECT route, max(seq) + 1, arg_max(to_node, seq) FROM paths GROUP BY route),
  x AS (SELECT route, seq, (lon - first(lon) OVER w) * 111320 * cos(radians(first(lat) OVER w)) AS x, (lat - first(lat) OVER w) * 111320 AS y FROM l JOIN map_nodes ON id = node WINDOW w AS (PARTITION BY route ORDER BY seq)),
  a AS (SELECT route, abs(sum(x * ny - nx * y)) / 2 AS area, count(*) AS pts FROM (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM x WINDOW w AS (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) v GROUP BY route)
  SELECT route, round(total, 6) AS length_m, round(rep, 6) AS repeated_m, round(rep / total, 6) AS repeat_fraction, round(raw / total, 6) AS raw_repeat_fraction, round(CASE WHEN pts < 3 THEN 0 ELSE 4 * pi() * area / (total * total) END, 6) AS compactness, roads AS repeated_roads FROM c JOIN a USING (route) JOIN (SELECT DISTINCT route, total FROM q) t USING (route)""")

ALONG = f"""SELECT *, lag(s) OVER (PARTITION BY session_id ORDER BY idx) AS s0 FROM (SELECT *, sum(coalesce({geo.haversine('a', 'b', 'lat', 'lon')}, 0e0)) OVER (PARTITION BY session_id ORDER BY idx) AS s FROM (SELECT *, lag(lat) OVER (PARTITION BY session_id ORDER BY idx) AS a, lag(lon) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM ride_points) l) m"""
SAMPLED = f"""SELECT session_id, k, round(CASE WHEN k = n - 1 THEN lat_end ELSE a + (lat - a) * f END, 6) AS lat, round(CASE WHEN k = n - 1 THEN lon_end ELSE b + (lon - b) * f END, 6) AS lon FROM (
  SELECT q.*, (q.k * q.gap - r.s0) / (r.s - r.s0) AS f, r.a, r.b, r.lat, r.lon, row_number() OVER (PARTITION BY q.session_id, q.k ORDER BY r.idx) AS pick FROM
  (SELECT session_id, n, gap, lat_end, lon_end, unnest(generate_series(0, n - 1)) AS k FROM (SELECT session_id, CAST(greatest(2, floor(max(s) / 50)) AS BIGINT) AS n, max(s) / (greatest(2, floor(max(s) / 50)) - 1) AS gap, arg_max(lat, idx) AS lat_end, arg_max(lon, idx) AS lon_end FROM along_ GROUP BY 1) t) q
  JOIN along_ r ON r.session_id = q.session_id AND r.s0 IS NOT NULL AND r.s > r.s0 AND (q.k * q.gap BETWEEN r.s0 - 1e-6 AND r.s + 1e-6)) z WHERE pick = 1"""
P = "ride_points"
register("track_resample", lambda p: t.resample(p, 50.0).select("session_id", F.col("k").cast("long").alias("k"), "lat", "lon"), P, f"WITH along_ AS ({ALONG}) {SAMPLED}")
register("headings", t.headings, P, f"SELECT session_id, idx, CASE WHEN a <> c OR b <> d THEN round({geo.bearing('a', 'b', 'c', 'd')}, 5) END AS heading FROM (SELECT session_id, idx, first(lat) OVER w AS a, first(lon) OVER w AS b, last(lat) OVER w AS c, last(lon) OVER w AS d FROM ride_points WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) q")
register("run_length", lambda p: t.runs(p.withColumn("snap", F.expr("case when power % 11 = 0 then null else heart_rate div 40 end")), "snap"), P, """WITH v AS (SELECT session_id, idx, heart_rate // 40 AS snap FROM ride_points WHERE NOT coalesce(power % 11 = 0, FALSE) AND heart_rate IS NOT NULL), r AS (SELECT *, sum(CASE WHEN snap IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, lag(snap) OVER (PARTITION BY session_id ORDER BY idx) AS was FROM v) l),
  g AS (SELECT session_id, run, any_value(snap) AS value, count(*) AS n, min(idx) AS start_idx FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT session_id, start_idx, value, n FROM (SELECT *, lag(value) OVER (PARTITION BY session_id ORDER BY start_idx) AS was FROM g) h WHERE was IS NULL OR was <> value""")
CHUNKS = f"""WITH RECURSIVE o AS (SELECT session_id, idx, s, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM ({ALONG}) q), k AS (SELECT session_id, n, idx, 0e0 AS at_, 0 AS nxt, 0 AS chunk FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.idx, CASE WHEN o.s - k.at_ >= 5e3 THEN o.s ELSE k.at_ END, CASE WHEN o.s - k.at_ >= 5e3 THEN k.nxt + 1 ELSE k.nxt END, k.nxt FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n + 1) """
register("track_chunks", lambda p: t.chunks(p, 5000.0), P, CHUNKS + "SELECT session_id, idx, chunk FROM k UNION ALL SELECT session_id, max(idx), chunk + 1 FROM k WHERE (session_id, chunk + 1) IN (SELECT (session_id, chunk) FROM k) GROUP BY session_id, chunk")
NEAR = duck.hav("x.lat", "x.lon", "y.lat", "y.lon")
CHAIN = f"""WITH along_ AS ({ALONG}), sampled AS ({SAMPLED}), tr AS (SELECT session_id, avg(lat) AS lat, avg(lon) AS lon, max(s) AS m FROM along_ GROUP BY 1 HAVING count(*) >= 4 AND max(s) >= 100),
  cand AS (SELECT x.session_id AS a, y.session_id AS b FROM tr x JOIN tr y ON x.session_id <> y.session_id AND {NEAR} < 3000 AND abs(x.m - y.m) <= least(7000, 0.15 * least(x.m, y.m))),
  cov AS (SELECT a, b, round(count(*) FILTER (hit) / count(*), 6) AS share FROM (SELECT c.a, c.b, x.k, EXISTS (SELECT 1 FROM ride_points y WHERE y.session_id = c.b AND abs(y.lat - x.lat) < 1e-3 AND {NEAR} <= 25) AS hit FROM cand c JOIN sampled x ON x.session_id = c.a) h GROUP BY 1, 2 HAVING count(*) FILTER (hit) > 0)"""
PAIRS = "SELECT least(a, b) AS a, greatest(a, b) AS b, max(share) AS share FROM cov GROUP BY 1, 2 HAVING max(share) >= 85e-2"


register("coverage_similarity", t.route_coverage, P, f"{CHAIN} SELECT * FROM cov")
register("route_pairs", t.route_pairs, P, f"{CHAIN} {PAIRS}")
register("route_clusters", lambda p: t.clusters(t.route_links(p), 3), P, f"""WITH RECURSIVE {CHAIN[5:]}, pairs AS ({PAIRS}), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y)
  SELECT root, x AS member FROM (SELECT x, min(y) AS root FROM reach GROUP BY 1) q QUALIFY count(*) OVER (PARTITION BY root) >= 3""")
IV = f"""iv AS (SELECT interval_id, sum({duck.hav('a', 'b', 'lat', 'lon')}) AS m, count(*) AS n, min(lat) AS s, min(lon) AS w, max(lat) AS t, max(lon) AS e FROM (SELECT *, lag(lat) OVER (PARTITION BY interval_id ORDER BY idx) AS a, lag(lon) OVER (PARTITION BY interval_id ORDER BY idx) AS b FROM interval_points) q GROUP BY 1 HAVING count(*) >= 2),
  near AS (SELECT x.interval_id AS a, y.interval_id AS b, x.idx AS ka, y.idx AS kb, p.n AS na, q.n AS nb FROM iv p JOIN iv q ON p.interval_id <> q.interval_id AND abs(p.m - q.m) <= 100 AND p.s <= q.t + 1e-3 AND q.s <= p.t + 1e-3 JOIN interval_points x ON x.interval_id = p.interval_id JOIN interval_points y ON y.interval_id = q.interval_id AND abs(x.lat - y.lat) < 1e-3 AND {NEAR} <= 20),
  qual AS (SELECT a, b FROM near GROUP BY 1, 2 HAVING greatest(count(DISTINCT ka) / any_value(na), count(DISTINCT kb) / any_value(nb)) >= 8e-1)"""
register("interval_pairs", t.interval_pairs, "interval_points", f"WITH {IV} SELECT a, b FROM qual WHERE a < b")
register("interval_clusters", lambda p: t.interval_clusters(p, t.interval_links(p)).selectExpr("root", "member", "representative", "round(south, 6) as south", "round(west, 6) as west", "round(north, 6) as north", "round(east, 6) as east", "cell_row", "cell_col"), "interval_points",
  f"""WITH RECURSIVE {IV}, reach(x, y) AS (SELECT interval_id, interval_id FROM iv UNION SELECT r.x, qual.b FROM reach r JOIN qual ON qual.a = r.y), c AS (SELECT x AS member, min(y) AS root FROM reach GROUP BY 1),
  d AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY m, member) - 1 AS k, count(*) OVER (PARTITION BY root) AS size FROM c JOIN iv ON interval_id = member),
  g AS (SELECT root, max(member) FILTER (k = size // 2) AS representative, min(s) AS s, min(w) AS w, max(t) AS t, max(e) AS e FROM d GROUP BY root)
  SELECT c.root, member, representative, round(s, 6) AS south, round(w, 6) AS west, round(t, 6) AS north, round(e, 6) AS east, CAST(floor((s + t) / 2 / (5000 / 111320e0)) AS BIGINT) AS cell_row, CAST(floor((w + e) / 2 / (5000 / (111320e0 * cos(radians((SELECT avg(s) FROM iv)))))) AS BIGINT) AS cell_col FROM c JOIN g USING (root)""")
register("interval_assign", lambda p: t.assigned_intervals(p, p.where("session_id = 0").withColumn("interval_id", -1 - F.col("interval_id"))), "interval_points",
  f"WITH {IV} SELECT i.interval_id, arg_max(q.arch, (q.m, -q.arch)) AS archetype_id FROM (SELECT DISTINCT interval_id FROM interval_points) i LEFT JOIN (SELECT a, -1 - b AS arch, m FROM (SELECT a, b FROM qual UNION ALL SELECT interval_id, interval_id FROM iv) z JOIN iv ON iv.interval_id = b WHERE b < 100000) q ON q.a = i.interval_id GROUP BY 1")
ARCH = "SELECT CAST(floor(from_node / 2e1) AS BIGINT) * 4 + v AS archetype_id, from_node, to_node, length_m FROM {e} CROSS JOIN (VALUES (0), (1), (2), (3)) t(v) WHERE to_node = from_node + 1 AND (v = 0 AND from_node % 20 < 15 OR v = 1 AND from_node % 20 >= 8 OR v = 2 AND from_node % 20 BETWEEN 3 AND 8 OR v = 3 AND from_node % 20 BETWEEN 4 AND 9)"
register("interval_subsets", lambda e: t.without_subsets(e.sparkSession.sql(ARCH, e=e)), "map_edges", f"""WITH RECURSIVE arch AS ({ARCH.format(e='map_edges')}), z AS (SELECT archetype_id, sum(length_m) AS m FROM arch GROUP BY 1), o AS (SELECT *, archetype_id // 4 AS line, row_number() OVER (PARTITION BY archetype_id // 4 ORDER BY m DESC, archetype_id) AS k FROM z),
  c AS (SELECT x.archetype_id AS a, list(y.archetype_id) AS over FROM (SELECT x.archetype_id, y.archetype_id AS other FROM arch x JOIN arch y USING (from_node, to_node) JOIN o ON o.archetype_id = x.archetype_id JOIN o p ON p.archetype_id = y.archetype_id AND p.k < o.k GROUP BY 1, 2 HAVING sum(x.length_m) / any_value(o.m) >= 8e-1) x JOIN (SELECT archetype_id FROM z) y ON y.archetype_id = x.other GROUP BY 1),
  r AS (SELECT line, k, [archetype_id] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.line, o.k, CASE WHEN list_has_any(r.kept, coalesce(c.over, [])) THEN r.kept ELSE list_append(r.kept, o.archetype_id) END FROM r JOIN o ON o.line = r.line AND o.k = r.k + 1 LEFT JOIN c ON c.a = o.archetype_id)
  SELECT unnest(kept) AS archetype_id FROM (SELECT arg_max(kept, k) AS kept FROM r GROUP BY line) f""")


def _segments(e, n):
    a, b = n.selectExpr("id as from_node", "lat as ay", "lon as ax"), n.selectExpr("id as to_node", "lat as by", "lon as bx")
    return e.where("to_node > from_node").join(a, "from_node").join(b, "to_node").selectExpr("struct(from_node, to_node) as seg", "ax", "ay", "bx", "by")


register("nearest_edge", lambda e, n, p: t.nearest_segment(p.selectExpr("id", "lat + 9e-1 * (id % 2) as lat", "lon"), _segments(e, n), 400.0).select("id", "seg.*", "distance_m"), "map_edges map_nodes pois",
  f"""SELECT id, from_node, to_node, round(round(d, 6), 4) AS distance_m FROM (SELECT p.id, from_node, to_node, {duck.to_segment('p.lat', 'p.lon', 'a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM (SELECT id, lat + 9e-1 * (id % 2) AS lat, lon FROM pois) p CROSS JOIN map_edges JOIN map_nodes a ON a.id = from_node JOIN map_nodes b ON b.id = to_node WHERE to_node > from_node) q
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 6), from_node, to_node) = 1""")
register("elevation_profile", t.smoothed_profile, P, f"SELECT session_id, idx, round(s, 4) AS at_m, round(avg(altitude) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS altitude FROM ({ALONG}) q WHERE altitude IS NOT NULL")
register("elevation_gain_loss", t.gain_loss, P, "SELECT session_id, round(sum(greatest(d, 0e0)), 6) AS gain_m, round(sum(greatest(-d, 0e0)), 6) AS loss_m FROM (SELECT session_id, z - lag(z) OVER (PARTITION BY session_id ORDER BY idx) AS d FROM (SELECT session_id, idx, avg(altitude) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS z FROM ride_points WHERE altitude IS NOT NULL) m) n WHERE d IS NOT NULL GROUP BY 1")
register("poi_density", lambda p: t.density(p.withColumn("at", F.expr(DIST)), "at", 10000.0, 500.0), "pois", f"SELECT g.bucket, count(p.id) AS cnt FROM (SELECT unnest(generate_series(0, 19)) AS bucket) g LEFT JOIN (SELECT id, CAST(least(19, greatest(0, floor({DIST} / 5e2))) AS BIGINT) AS bucket FROM pois) p ON p.bucket = g.bucket GROUP BY 1")
register("poi_in_box", lambda p: p.where(g.in_box("lat", "lon", BOX)).select("id", "category"), "pois", f"SELECT id, category FROM pois WHERE {g.in_box('lat', 'lon', BOX)}")
register("poi_categories", lambda p: p.select("category").distinct(), "pois", "SELECT DISTINCT category FROM pois")
register("track_boxes", t.boxes, P, "SELECT session_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east FROM ride_points GROUP BY 1")
