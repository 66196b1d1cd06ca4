"""Queries of paths, files, surrogates and points along tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import geo
from cadenza.operators import history, loops, paths, roads, tracks
from cadenza.plans import duck
from cadenza.plans.lineage import store
from cadenza.plans.registry import register
from cadenza.sources import files

NG = "map_edges map_nodes"


def _trips(nodes):
    """A trip for every node: from near it to the node 43 ids on, three columns and two rows away or across the grid."""
    a = nodes.selectExpr("id as trip_id", "id + 43 as h", "lat + 1e-4 as lat", "lon + 1e-4 as lon")
    return a.join(nodes.selectExpr("id as h", "lat as home_lat", "lon as home_lon"), "h").select("trip_id", "lat", "lon", "home_lat", "home_lon")


def _ride(points):
    """Whole rides moved onto the grid: they run along a meridian of it."""
    return points.withColumn("lat", F.expr("lat - 15e-2")).withColumn("lon", F.expr("607e-2 + idx * 0"))


def _match(points, edges, nodes):
    ride = _ride(points)
    return paths.map_match(ride, tracks.chunks(ride, 5000.0), edges, nodes)


register("way_home", lambda e, n: paths.way_home(_trips(n), e, n), NG)
# Shortest lengths by relaxation until nothing gets shorter, on the same boxes of roads.
WAYS = f"""WITH RECURSIVE trip AS (SELECT a.id AS trip_id, a.lat + 1e-4 AS lat, a.lon + 1e-4 AS lon, b.id AS goal, least(a.lat + 1e-4, b.lat) - 2000 / 111320e0 AS s, greatest(a.lat + 1e-4, b.lat) + 2000 / 111320e0 AS n, least(a.lon + 1e-4, b.lon) - 2000 / 111320e0 / cos(radians(a.lat + 1e-4)) AS w, greatest(a.lon + 1e-4, b.lon) + 2000 / 111320e0 / cos(radians(a.lat + 1e-4)) AS e FROM map_nodes a JOIN map_nodes b ON b.id = a.id + 43),
  road AS (SELECT from_node AS f, to_node AS t, length_m, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM map_edges JOIN map_nodes a ON a.id = from_node JOIN map_nodes b ON b.id = to_node),
  box AS (SELECT trip_id, goal, road.*, round({duck.to_segment('lat', 'lon', 'alat', 'alon', 'blat', 'blon')}, 3) AS off FROM trip JOIN road ON alat BETWEEN s AND n AND alon BETWEEN w AND e OR blat BETWEEN s AND n AND blon BETWEEN w AND e),
  begin AS (SELECT trip_id, goal, t FROM box QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY off, f, t) = 1 AND off <= 50),
  best(trip_id, node, d) USING KEY (trip_id, node) AS (SELECT trip_id, t, 0e0 FROM begin UNION SELECT x.trip_id, b.t, min(x.d + b.length_m) FROM best x JOIN box b ON b.trip_id = x.trip_id AND b.f = x.node LEFT JOIN recurring.best r ON r.trip_id = x.trip_id AND r.node = b.t WHERE r.d IS NULL OR x.d + b.length_m < r.d GROUP BY 1, 2)
  SELECT trip_id, round(d, 4) AS length_m FROM best JOIN begin USING (trip_id) WHERE node = goal AND d > 0"""
register("way_home_length", lambda e, n: paths.way_home(_trips(n), e, n).groupBy("trip_id").agg(F.round(F.sum("length_m"), 4).alias("length_m")), NG, WAYS)


def _fast_way_home(e, n):
    """The estimates of three paces for each way home, and the share of it that has them."""
    way = paths.way_home(_trips(n), e, n).select("trip_id", "seq", "from_node", "to_node").withColumnRenamed("trip_id", "route")
    path = store(way.join(e.drop("is_traversed"), ["from_node", "to_node"]))  # read twice
    return roads.ride_estimates(path).join(roads.percentile_coverage(path), "route")


register("fast_way_home", _fast_way_home, NG)
register("map_match", _match, f"ride_points {NG}")
register("plan_loop", lambda e, n: paths.loops(n.selectExpr("id as plan_id", "lat", "lon", "14e3 as target_m"), e, n, e.selectExpr("from_node", "to_node", "cast(traversal_count as double) as reward"))
         .selectExpr("plan_id", "place", "round(length_m, 4) as length_m", "round(reward, 4) as reward", "round(repeat_fraction, 6) as repeat_fraction", "round(compactness, 6) as compactness", "array_join(nodes, ',') as nodes"), NG)


def _planned(nations, corridors, edges, nodes):
    """A loop from the grid's node of each nation, in one of four directions or none."""
    homes = nations.selectExpr("n_nationkey as plan_id", "n_nationkey * 3 + 110 as id", "CASE WHEN n_nationkey % 5 < 4 THEN n_nationkey % 5 * 9e1 END as bearing").join(nodes, "id").selectExpr("plan_id", "lat + 1e-4 as lat", "lon", "20e3 + plan_id % 3 * 5e3 as target_m", "bearing")
    chains = corridors.selectExpr("id", "entry_node", "exit_node", "length_m", "pedal_reward + gravity_reward as reward", "lat", "lon", "group_id", "sequence(entry_node, exit_node) as nodes")
    graph = edges.selectExpr("from_node", "to_node", "length_m", "coalesce(pedal_count, 0) + coalesce(gravity_count, 0) as reward", "traversal_count as count")
    turns = roads.successors(edges).selectExpr("a_from as from_node", "via as junction", "b_to as to_node", "(a_from % 10) / 1e1 as hazard", "(b_to % 4) / 1e1 as stop", "cast(null as double) as braking", "1e0 as energy").where("via % 2 = 0")
    return loops.planned_loops(homes, chains, graph, nodes, turns)


register("planned_loops", lambda n, c, e, m: _planned(n, c, e, m).selectExpr("plan_id", "tier", "round(length_m, 4) as length_m", "round(reward, 4) as reward", "round(repeat_fraction, 6) as repeat_fraction", "round(compactness, 6) as compactness", "round(deviation_percent, 6) as deviation_percent", "array_join(nodes, ',') as nodes", "reason"), "nation corridors map_edges map_nodes")


def _round_trip(points):
    docs = files.gpx_documents(points.withColumn("_name", F.expr("'ride ' || session_id")), "session_id", "_name", "idx", "2026-01-01T00:00:00Z")
    back = files.read_gpx(docs.selectExpr("cast(session_id as string) as path", "cast(gpx as binary) as content"))
    return back.selectExpr("cast(path as bigint) as session_id", "name", "idx", "lat", "lon")


register("gpx_round_trip", _round_trip, "ride_points", "SELECT session_id, 'ride ' || session_id AS name, idx, lat, lon FROM ride_points")

BEARING = geo.bearing("alat", "alon", "blat", "blon")


def _edges(e, n):
    a, b = n.selectExpr("id as from_node", "lat as alat", "lon as alon"), n.selectExpr("id as to_node", "lat as blat", "lon as blon")
    return e.join(a, "from_node").join(b, "to_node").selectExpr("struct(from_node, to_node) as edge", "length_m", "is_traversed and speed_mean is not null and power_mean is not null as known", "from_node", "to_node", "alat", "alon", "blat", "blon", f"{BEARING} as bearing")


def _surrogates(e, n):
    roads = _edges(e, n)
    middles = roads.where("not known").selectExpr("edge", "(alat + blat) / 2 as lat", "(alon + blon) / 2 as lon", "bearing")
    return tracks.surrogates(middles, roads.where("known"), 900.0, 45.0).selectExpr("edge.*", "surrogate.from_node as near_from", "surrogate.to_node as near_to", "distance_m")


register("surrogates", _surrogates, NG, f"""WITH r AS (SELECT from_node AS f, to_node AS t, is_traversed AND speed_mean IS NOT NULL AND power_mean IS NOT NULL AS known, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, {duck.course('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS head FROM map_edges JOIN map_nodes a ON a.id = from_node JOIN map_nodes b ON b.id = to_node),
  m AS (SELECT f, t, (alat + blat) / 2 AS lat, (alon + blon) / 2 AS lon, head FROM r WHERE NOT known),
  c AS (SELECT m.f, m.t, r.f AS nf, r.t AS nt, round({duck.to_segment('m.lat', 'm.lon', 'r.alat', 'r.alon', 'r.blat', 'r.blon')}, 4) AS d FROM m JOIN r ON r.known AND abs(r.alat - m.lat) < 2e-2 AND {duck.apart('m.head', 'r.head')} <= 45)
  SELECT f AS from_node, t AS to_node, nf AS near_from, nt AS near_to, d AS distance_m FROM c WHERE d <= 900 QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY d, nf, nt) = 1""")

register("poi_on_track", lambda e, n, p: tracks.points_on_track(p.select("id", "lat", "lon"), _edges(e, n).where("to_node = from_node + 1").selectExpr("from_node div 20 as route", "from_node % 20 as seq", "length_m", "alat", "alon", "blat", "blon"), 200.0), f"{NG} pois",
  f"""WITH t AS (SELECT from_node // 20 AS route, from_node % 20 AS seq, length_m, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, sum(length_m) OVER (PARTITION BY from_node // 20 ORDER BY from_node % 20) - length_m AS before FROM map_edges JOIN map_nodes a ON a.id = from_node JOIN map_nodes b ON b.id = to_node WHERE to_node = from_node + 1),
  c AS (SELECT *, CASE WHEN l = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((lon - alon) * (blon - alon) + (lat - alat) * (blat - alat)) / l)) END AS f FROM (SELECT p.id, p.lat, p.lon, t.*, (blon - alon) * (blon - alon) + (blat - alat) * (blat - alat) AS l FROM pois p JOIN t ON abs(p.lat - t.alat) < 1e-2) q),
  d AS (SELECT *, {geo.haversine('lat', 'lon', '(alat + f * (blat - alat))', '(alon + f * (blon - alon))')} AS off FROM c WHERE seq IS NOT NULL)
  SELECT route, id, round(before + f * length_m, 3) AS along_m, round(off, 3) AS off_m FROM d WHERE off <= 200e0 QUALIFY row_number() OVER (PARTITION BY route, id ORDER BY round(off, 3), seq) = 1""")

TRACK = "SELECT CAST(floor(from_node / 2e1) AS BIGINT) AS route, from_node % 20 AS seq, length_m, alat, alon, blat, blon FROM"
ON_TRACK = """t AS (SELECT from_node // 20 AS route, from_node % 20 AS seq, length_m, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, sum(length_m) OVER (PARTITION BY from_node // 20 ORDER BY from_node % 20) - length_m AS before FROM map_edges JOIN map_nodes a ON a.id = from_node JOIN map_nodes b ON b.id = to_node WHERE to_node = from_node + 1)"""


def _place(lat, lon, more, limit):
    """SQL for the nearest place of points {more} on each route within a limit: route, along_m, off_m."""
    f = f"greatest(0e0, least(1e0, (({lon} - alon) * (blon - alon) + ({lat} - alat) * (blat - alat)) / (power(blon - alon, 2) + power(blat - alat, 2))))"
    off = duck.hav(lat, lon, f"(alat + {f} * (blat - alat))", f"(alon + {f} * (blon - alon))")
    return f"SELECT route, {more}, round(before + {f} * length_m, 3) AS along_m, round({off}, 3) AS off_m, seq FROM t, {{source}} WHERE {off} <= {limit}"


def _segments(e, n):
    return _edges(e, n).where("to_node = from_node + 1").selectExpr("from_node div 20 as route", "from_node % 20 as seq", "length_m", "alat", "alon", "blat", "blon")


RIDERS = "SELECT id AS route, lat - 1e-4 AS lat, lon + 33e-3 AS lon FROM (SELECT CAST(floor(id / 2e1) AS BIGINT) AS id, min(lat) AS lat, min(lon) AS lon FROM {n} GROUP BY 1) q WHERE id % 2 = 0"


def _rider_pois(e, n, p):
    seg = _segments(e, n)
    riders = tracks.points_on_track(n.sparkSession.sql(RIDERS, n=n).selectExpr("route as id", "lat", "lon"), seg, 500.0).where("id = route").select("route", "along_m", "off_m")
    return tracks.rider_pois(tracks.points_on_track(p.select("id", "lat", "lon"), seg, 200.0), riders, 2500.0)


register("rider_pois", _rider_pois, f"{NG} pois", f"""WITH {ON_TRACK}, i AS (SELECT * FROM ({_place('p.lat', 'p.lon', 'p.id', 200).format(source='pois p')}) q QUALIFY row_number() OVER (PARTITION BY route, id ORDER BY off_m, seq) = 1),
  u AS (SELECT * FROM ({_place('r.lat', 'r.lon', 'r.route AS own', 500).format(source=f"({RIDERS.format(n='map_nodes')}) r").replace('SELECT route,', 'SELECT t.route,')}) q WHERE route = own QUALIFY row_number() OVER (PARTITION BY route ORDER BY off_m, seq) = 1),
  d AS (SELECT i.route, id, round(coalesce(u.off_m, 0) + abs(i.along_m - coalesce(u.along_m, 0)) + i.off_m, 3) AS distance_m, i.along_m >= coalesce(u.along_m, 0) AS ahead FROM i LEFT JOIN u ON u.route = i.route)
  SELECT route, id, distance_m, ahead, CAST(row_number() OVER (PARTITION BY route, ahead ORDER BY distance_m, id) AS INT) AS place FROM d WHERE ahead OR distance_m <= 2500""")
register("track_between", lambda p: tracks.between(p.selectExpr("session_id as route", "idx as seq", "lat", "lon"), p.groupBy(F.col("session_id").alias("route")).agg(F.max(F.expr("idx div 2")).alias("a_seq"), F.max(F.expr("idx div 3")).alias("b_seq"))), "ride_points",
  "SELECT session_id AS route, idx AS seq, lat, lon FROM ride_points JOIN (SELECT session_id, max(idx) AS top FROM ride_points GROUP BY 1) USING (session_id) WHERE idx BETWEEN top // 3 AND top // 2")


def _spots(p):
    return p.where("idx = 30").selectExpr("session_id as route", "idx as seq", "round(lat + 3e-5, 7) as lat", "lon")


D = duck.hav("lat", "lon", "plat", "plon")
register("sub_tracks", lambda p: tracks.sub_tracks(p.selectExpr("session_id as route", "idx as seq", "lat", "lon"), _spots(p), 400.0, 250.0), "ride_points", f"""WITH s AS (SELECT session_id AS r, round(lat + 3e-5, 7) AS plat, lon AS plon FROM ride_points WHERE idx = 30),
  a AS (SELECT p.session_id, idx, lat, lon, plat, plon, CASE WHEN idx IN (30, 31) THEN {D} WHEN idx > 31 THEN {duck.hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} ELSE {duck.hav('lead(lat) OVER w', 'lead(lon) OVER w', 'lat', 'lon')} END AS step FROM ride_points p JOIN s ON r = p.session_id WINDOW w AS (PARTITION BY p.session_id ORDER BY idx)),
  b AS (SELECT *, CASE WHEN idx <= 30 THEN sum(step) FILTER (idx <= 30) OVER (PARTITION BY session_id ORDER BY idx DESC) ELSE coalesce(sum(step) FILTER (idx > 30) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS far FROM a)
  SELECT session_id AS route, CAST(idx AS DOUBLE) AS seq, lat, lon FROM b WHERE idx <= 30 AND far < 250 OR idx > 30 AND far < 400 UNION ALL SELECT r, 305e-1, plat, plon FROM s""")
register("polyline_round_trip", lambda p: tracks.decode_polylines(tracks.encode_polylines(p.selectExpr("session_id as id", "idx as seq", "lat", "lon"))).selectExpr("id", "cast(seq as bigint) as seq", "round(lat, 5) as lat", "round(lon, 5) as lon"), "ride_points",
  "SELECT session_id AS id, idx AS seq, round(floor(lat * 1e5 + 0.5e0) / 1e5, 5) AS lat, round(floor(lon * 1e5 + 0.5e0) / 1e5, 5) AS lon FROM ride_points")
LINES = {"_p~iF~ps|U_ulLnnqC_mqNvxq`@": [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], "": [], "??": [(0.0, 0.0)], "_ibE_ibE": [(1.0, 1.0)]}
register("polyline_decode", lambda p: tracks.decode_polylines(p.selectExpr("id", "element_at(array(" + ", ".join(f"'{x}'" for x in LINES) + "), cast(id % 4 as int) + 1) as encoded")), "pois",
  "SELECT id, CAST(seq AS INT) AS seq, v.lat, v.lon FROM pois JOIN (VALUES " + ", ".join(f"({k}, {i}, {a}e0, {b}e0)" for k, x in enumerate(LINES.values()) for i, (a, b) in enumerate(x)) + ") v(k, seq, lat, lon) ON k = id % 4")
TEXTS = ["[[1.5, 2.5], [3, 4, 5], [6]]", "no json", "[]", "[[7.25, 8.125]]"]
register("track_json", lambda p: tracks.parse_tracks(p.selectExpr("id", "element_at(array(" + ", ".join(f"'{x}'" for x in TEXTS) + "), cast(id % 4 as int) + 1) as track")).selectExpr("id", "lat", "lon"), "pois",
  "SELECT id, v.lat, v.lon FROM pois JOIN (VALUES (0, 1.5e0, 2.5e0), (0, 3e0, 4e0), (3, 7.25e0, 8.125e0)) v(k, lat, lon) ON k = id % 4")
register("track_json_round_trip", lambda p: tracks.parse_tracks(tracks.tracks_as_json(p.selectExpr("session_id as id", "idx as seq", "lat", "lon"))).selectExpr("id", "cast(seq as bigint) as seq", "lat", "lon"), "ride_points", "SELECT session_id AS id, idx AS seq, lat, lon FROM ride_points")
GPX = "<gpx><metadata><name>m</name></metadata><trk><name> A </name><trkseg><trkpt lat=\"1.5\" lon=\"2\"><ele>7</ele></trkpt><trkpt lat=\"x\" lon=\"2\"/></trkseg><trkseg><trkpt lat=\"3\" lon=\"4\"/></trkseg></trk></gpx>"
register("gpx_read", lambda p: files.read_gpx(p.selectExpr("cast(id as string) as path", f"cast(CASE WHEN id % 3 = 0 THEN '<gpx/>' WHEN id % 3 = 1 THEN '<gpx' ELSE '{GPX}' END as binary) as content")).selectExpr("cast(path as bigint) as id", "name", "idx", "lat", "lon", "altitude", "error is not null as failed"), "pois",
  "SELECT id, name, CAST(idx AS BIGINT) AS idx, v.lat, v.lon, altitude, failed FROM pois JOIN (VALUES (0, NULL, NULL, NULL, NULL, NULL, TRUE), (1, NULL, NULL, NULL, NULL, NULL, TRUE), (2, 'A', 0, 1.5e0, 2e0, 7e0, FALSE), (2, 'A', 1, 3e0, 4e0, NULL, FALSE)) v(k, name, idx, lat, lon, altitude, failed) ON k = id % 3")


def _edge_lines(paths_, nodes):
    a, b = nodes.selectExpr("id as from_node", "lat as alat", "lon as alon"), nodes.selectExpr("id as to_node", "lat as blat", "lon as blon")
    ends = paths_.join(a, "from_node").join(b, "to_node")
    points = ends.selectExpr("struct(route, seq) as edge", "explode(array(struct(0 as k, alat as lat, alon as lon), struct(1 as k, blat as lat, blon as lon))) as p").select("edge", "p.*")
    lines = tracks.encode_polylines(points.selectExpr("edge.route * 1000 + edge.seq as id", "k as seq", "lat", "lon"))
    return lines.selectExpr("id div 1000 as route", "id % 1000 as seq", "encoded")


def _edges_out_and_back(p, n):
    docs = files.gpx_of_edges(_edge_lines(p, n), "2026-01-01T00:00:00Z")
    back = files.read_gpx(docs.selectExpr("cast(route as string) as path", "cast(gpx as binary) as content"))
    return back.selectExpr("cast(path as bigint) as route", "name", "idx", "round(lat, 5) as lat", "round(lon, 5) as lon")


register("gpx_write", _edges_out_and_back, "paths map_nodes", """WITH s AS (SELECT route, seq, k, round(lat, 5) AS lat, round(lon, 5) AS lon FROM paths, (VALUES (0), (1)) v(k) JOIN map_nodes ON id = CASE k WHEN 0 THEN from_node ELSE to_node END)
  SELECT route, 'route ' || route AS name, row_number() OVER (PARTITION BY route ORDER BY seq, k) - 1 AS idx, lat, lon FROM s""")
FIT = "SELECT session_id, idx, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) - 631065600 AS s, CAST(floor(lat / 180 * 2147483648e0) AS INT) AS y, CAST(floor(lon / 180 * 2147483648e0) AS INT) AS x, power, heart_rate, CAST(floor(speed_kmh / 36e-1 * 1000 + 0.5e0) AS INT) AS v, CAST(floor((altitude + 500) * 5 + 0.5e0) AS INT) AS h FROM ride_points"


def _fit(points):
    coded = points.selectExpr("session_id", "idx", "cast(floor(unix_micros(cast(ts as timestamp)) / 1e6) as bigint) - 631065600 as s", "cast(floor(lat / 180 * 2147483648e0) as int) as y", "cast(floor(lon / 180 * 2147483648e0) as int) as x", "power", "heart_rate", "cast(floor(speed_kmh / 36e-1 * 1000 + 5e-1) as int) as v", "cast(floor((altitude + 500) * 5 + 5e-1) as int) as h")
    found = files.read_fit(files.fit_documents(coded, "session_id"))
    return found.selectExpr("cast(path as bigint) as session_id", "kind", "idx", "unix_seconds(ts) as sec", "round(lat, 6) as lat", "round(lon, 6) as lon", "round(speed_kmh, 4) as speed_kmh", "power", "heart_rate", "round(altitude, 4) as altitude")


register("fit_read", _fit, "ride_points", f"""WITH f AS ({FIT}) SELECT session_id, 'record' AS kind, idx, s + 631065600 AS sec, round(y * (180e0 / 2147483648e0), 6) AS lat, round(x * (180e0 / 2147483648e0), 6) AS lon, round(v / 1000e0 * 3.6e0, 4) AS speed_kmh, power, heart_rate, round(h / 5e0 - 500, 4) AS altitude FROM f
  UNION ALL SELECT session_id, 'total', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY 1""")


def _first_matches(points, edges, nodes):
    """Each road that a ride was matched to, once, with the chunk that found it first."""
    return history.first_wins(_match(points, edges, nodes).select("session_id", "from_node", "to_node", "chunk"), ["session_id", "from_node", "to_node"], "chunk")


register("matched_roads", _first_matches, f"ride_points {NG}")


def _coverage(points, edges, nodes):
    ride = _ride(points)
    cut = tracks.chunks(ride, 5000.0)
    return paths.match_coverage(ride, cut, paths.map_match(ride, cut, edges, nodes), "1e0").select("session_id", "distance_m", "matched_m", F.round("percent", 6).alias("percent"))


register("match_coverage", _coverage, f"ride_points {NG}")
register("joined_legs", lambda p: history.joined_legs(p.where("seq < 5").select("route", "seq", "from_node"), p.where("seq >= 19").select("route", "seq", "from_node"), p.where("seq between 5 and 9").select("route", "seq", "from_node")).selectExpr("route", "cast(seq as bigint) as seq", "from_node"), "paths",
  "SELECT route, row_number() OVER (PARTITION BY route ORDER BY CASE WHEN seq < 5 THEN 0 WHEN seq >= 19 THEN 1 ELSE 2 END, seq) - 1 AS seq, from_node FROM paths WHERE seq < 10 OR seq >= 19")
