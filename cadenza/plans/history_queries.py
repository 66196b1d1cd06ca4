"""Queries over ride histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import geo
from cadenza.operators import history as h
from cadenza.operators import metrics as m
from cadenza.plans import ride_queries as r
from cadenza.plans.registry import ORACLES, register

S = "sessions"
EIGHT = {"Zone 1": "easy", "Zone 2": "easy", "Zone 3": "middle", "Zone 4": "hard", "Zone 5": "hard", "0 W": "none"}

register("records", h.records, S, """SELECT record, session_id, value FROM (
  SELECT 'longest_ride' AS record, session_id, distance_km AS value FROM sessions UNION ALL SELECT 'biggest_climb', session_id, elevation_gain_m FROM sessions UNION ALL SELECT 'longest_duration', session_id, CAST(net_duration_sec AS DOUBLE) FROM sessions) u
  WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record ORDER BY value DESC, session_id) = 1""")
register("split_records", lambda p: h.best_per_label(m.best_splits(p, r.SPLITS), "metres", "best_sec", True), "ride_points",
  f"WITH cum AS ({r.CUM}), b AS ({' UNION ALL '.join(map(r._split, r.SPLITS))}) SELECT metres AS label, session_id, best_sec AS value FROM b WHERE best_sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY metres ORDER BY best_sec, session_id) = 1")
register("power_records", lambda p: h.best_per_label(m.best_powers(p), "seconds", "watts", False), "ride_points",
  f"WITH cum AS ({r.CUM}), b AS ({' UNION ALL '.join(map(r._power, m.DURATIONS_S))}) SELECT seconds AS label, session_id, watts AS value FROM b WHERE watts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seconds ORDER BY watts DESC, session_id) = 1")
register("yearly_rollup", lambda s: h.yearly_rollup(s, 2026), S, """SELECT CAST(y.year AS INT) AS year, count(s.session_id) AS rides, round(coalesce(sum(distance_km), 0e0), 6) AS distance_km, CAST(coalesce(sum(net_duration_sec), 0) AS BIGINT) AS net_duration_sec, round(coalesce(sum(elevation_gain_m), 0e0), 6) AS elevation_gain_m
  FROM (SELECT unnest(generate_series((SELECT min(year(session_start)) FROM sessions), 2026)) AS year) y LEFT JOIN sessions s ON year(s.session_start) = y.year GROUP BY 1""")
register("monthly_rollup", lambda s: h.monthly_rollup(s, "2000-08-15"), S, """SELECT strftime(g.m, '%Y-%m') AS month, count(s.session_id) AS rides, round(coalesce(sum(distance_km), 0e0), 6) AS distance_km
  FROM (SELECT unnest(generate_series(TIMESTAMP '1999-09-01', TIMESTAMP '2000-08-01', INTERVAL 1 MONTH)) AS m) g LEFT JOIN sessions s ON date_trunc('month', s.session_start) = g.m GROUP BY 1""")
register("power_speed_cloud", h.power_speed_cloud, S, """WITH v AS (SELECT session_id, CAST(average_power AS FLOAT) AS power, CAST(distance_km / net_duration_sec * 3600e0 AS FLOAT) AS speed, elevation_gain_m / distance_km * 100e0 AS climb
    FROM sessions WHERE has_power AND average_power IS NOT NULL AND elevation_gain_m IS NOT NULL AND net_duration_sec > 0 AND distance_km > 0),
  n AS (SELECT count(*) - 1 AS top FROM v),
  o AS (SELECT row_number() OVER (ORDER BY power) - 1 AS kp, power, row_number() OVER (ORDER BY speed) - 1 AS ks, speed FROM v),
  q AS (SELECT p, top * p - floor(top * p) AS f, (SELECT power FROM o WHERE kp = floor(top * p)) AS pa, (SELECT power FROM o WHERE kp = ceil(top * p)) AS pb, (SELECT speed FROM o WHERE ks = floor(top * p)) AS sa, (SELECT speed FROM o WHERE ks = ceil(top * p)) AS sb FROM n, (VALUES (25e-3), (975e-3)) t(p)),
  e AS (SELECT p, pa + (pb - pa) * CAST(f AS FLOAT) AS power, sa + (sb - sa) * CAST(f AS FLOAT) AS speed FROM q)
  SELECT session_id, round(CAST(power AS DOUBLE), 4) AS power, round(CAST(speed AS DOUBLE), 4) AS speed, CASE WHEN climb < 200 THEN 'flat' WHEN climb < 800 THEN 'rolling' WHEN climb < 1400 THEN 'hilly' WHEN climb < 2000 THEN 'mountain' ELSE 'alpine' END AS climb_class
  FROM v WHERE power BETWEEN (SELECT power FROM e WHERE p < 5e-1) AND (SELECT power FROM e WHERE p > 5e-1) AND speed BETWEEN (SELECT speed FROM e WHERE p < 5e-1) AND (SELECT speed FROM e WHERE p > 5e-1)""")
register("zone_averages", lambda p: h.equal_weight_average(m.power_zones(p)), "ride_points")
ORACLES["zone_averages"] = f"WITH hh AS ({ORACLES['power_zones']}), t AS (SELECT session_id, greatest(sum(cnt), 1) AS total FROM hh GROUP BY 1) SELECT label, round(sum(cnt * 100e0 / total) / (SELECT count(*) FROM t), 6) AS percent FROM hh JOIN t USING (session_id) GROUP BY label"
register("merged_zones", lambda p: h.merged_speed_bins(m.power_zones(p), EIGHT), "ride_points")
MAP = ", ".join(f"('{a}', '{b}')" for a, b in EIGHT.items())
ORACLES["merged_zones"] = f"WITH hh AS ({ORACLES['power_zones']}), mp(label, merged) AS (VALUES {MAP}) SELECT session_id, merged AS label, CAST(sum(cnt) AS BIGINT) AS cnt FROM hh JOIN mp USING (label) GROUP BY 1, 2"
METRICS = {
    "duration": "net_duration_sec", "distance": "distance_km", "speed": "CASE WHEN net_duration_sec > 0 THEN distance_km / net_duration_sec * 3600 ELSE 0 END", "power": "average_power", "normalized": "normalized_power", "fat": "CASE WHEN has_power THEN fat_score END",
    "cardiac": "average_power / CAST(nullif(avg_heart_rate, 0) AS DOUBLE)", "kcal": "floor(93e-1 * fat_g + 41e-1 * carb_g + 0.5e0)", "climb": "elevation_gain_m", "climb_rate": "100 * (elevation_gain_m / distance_km)",
}
MEDIANS = ", ".join(f"CASE WHEN count({n}) FILTER ({f}) >= 2 THEN {'CAST(trunc(' if n in ('duration', 'power', 'normalized') else 'round('}quantile_cont(CAST({n} AS DOUBLE), 5e-1) FILTER ({f}){') AS INT)' if n in ('duration', 'power', 'normalized') else ', 6)'} END AS {n}_{pool}" for n in METRICS for pool, f in (("recent", "k <= 5"), ("all", "k IS NOT NULL")))
register("previous_n_comparison", h.previous_comparison, S, f"""WITH v AS (SELECT session_id, rider_id, session_start, {", ".join(f"{x} AS {n}" for n, x in METRICS.items())} FROM sessions),
  p AS (SELECT a.session_id AS s, b.*, row_number() OVER (PARTITION BY a.session_id ORDER BY b.session_start DESC, b.session_id DESC) AS k FROM sessions a JOIN v b ON a.rider_id = b.rider_id AND b.session_start < a.session_start)
  SELECT c.session_id, count(k) FILTER (k <= 5) AS n_recent, count(k) AS n_all, {MEDIANS} FROM sessions c LEFT JOIN p ON p.s = c.session_id GROUP BY c.session_id""")
AVERAGES = """SELECT group_id, rides, avg_duration_sec, avg_power, avg_normalized_power, round(km, 6) AS avg_distance_km, round(CASE WHEN avg_duration_sec > 0 THEN km / avg_duration_sec * 3600 ELSE 0e0 END, 6) AS avg_speed_kmh, round(climb / nullif(km, 0) * 100, 6) AS climb_per_100km
  FROM (SELECT {key} AS group_id, count(*) AS rides, CAST(floor(sum(net_duration_sec) / count(*)) AS BIGINT) AS avg_duration_sec, CAST(floor(avg(average_power)) AS BIGINT) AS avg_power, CAST(floor(avg(normalized_power)) AS BIGINT) AS avg_normalized_power, avg(distance_km) AS km, avg(elevation_gain_m) AS climb FROM sessions GROUP BY 1) q"""
register("route_averages", lambda s: h.group_averages(s, "rider_id"), S, AVERAGES.format(key="rider_id"))
register("group_averages", lambda s: h.group_averages(s.withColumn("g", s.session_id % 7), "g"), S, AVERAGES.format(key="session_id % 7"))
MODEL = """SELECT rider_id AS group_id, count(*) FILTER (has_power) AS n, round(covar_pop(net_duration_sec, average_power) / var_pop(average_power) FILTER (has_power), 5) AS slope,
  round(avg(net_duration_sec) FILTER (has_power) - covar_pop(net_duration_sec, average_power) / var_pop(average_power) FILTER (has_power) * avg(average_power), 5) AS intercept,
  CAST(trunc((min(average_power) - 10) / 10e0) * 10 AS INT) AS slider_min, CAST(ceil((max(average_power) + 10) / 10e0) * 10 AS INT) AS slider_max, round(median(distance_km), 6) AS median_km
  FROM sessions GROUP BY rider_id HAVING count(*) FILTER (has_power) >= 2 AND min(average_power) < max(average_power)"""
register("power_duration_regression", lambda s: h.power_duration_model(s, "rider_id"), S, MODEL)
register("estimated_seconds", lambda s: h.estimated_seconds(h.power_duration_model(s, "rider_id"), "slider_min + 10"), S, f"SELECT group_id, CASE WHEN slope * (slider_min + 10) + intercept > 0 THEN CAST(trunc(slope * (slider_min + 10) + intercept) AS INT) END AS sec FROM ({MODEL}) q")
register("recent_sessions", lambda s: h.newest(s, 20), S, "SELECT session_id, session_start, distance_km FROM sessions ORDER BY session_start DESC, session_id DESC LIMIT 20")
register("median_representative", lambda s: h.middle_member(s, "rider_id", "distance_km"), S, "SELECT rider_id AS group_id, session_id, distance_km AS value FROM (SELECT *, row_number() OVER (PARTITION BY rider_id ORDER BY distance_km, session_id) AS r, count(*) OVER (PARTITION BY rider_id) AS n FROM sessions) w WHERE r = n // 2 + 1")
GROUPS = "SELECT rider_id AS group_id, concat(CASE WHEN rider_id % 2 = 0 THEN 'Loop ' ELSE 'loop ' END, CAST(rider_id % 50 AS STRING)) AS name, avg(distance_km) AS distance, count(*) AS frequency FROM {t} GROUP BY rider_id"
# The same groups with exact sums and quotients, so that groups of equal rides tie in whatever order these are read, and means on half a digit do not tip.
EXACT = "try_cast(distance_km as decimal(38, 18))"
FAIR = GROUPS.replace("avg(distance_km)", f"CASE WHEN count({EXACT}) < count(distance_km) THEN avg(distance_km) WHEN count(distance_km) > 0 THEN cast(sum({EXACT}) / cast(count(distance_km) as decimal(19, 0)) as double) END")
for _o, _sql in (("distance_asc", "distance"), ("distance_desc", "distance DESC"), ("frequency_asc", "frequency"), ("frequency_desc", "frequency DESC"), ("name_asc", "lower(name)"), ("name_desc", "lower(name) DESC")):
    register(f"groups_by_{_o}", lambda s, o=_o: h.sorted_groups(s.sparkSession.sql(FAIR.format(t="{s}"), s=s), o).selectExpr("group_id", "name", "round(distance, 6) as distance", "frequency", "cast(place as bigint) as place"), S,
      f"SELECT group_id, name, round(distance, 6) AS distance, frequency, row_number() OVER (ORDER BY {_sql}, group_id) AS place FROM ({GROUPS.format(t='sessions')}) q")
LABELS = [b[0] for b in m.POWER_ZONES]
register("group_histogram_average", lambda p: h.histogram_average(m.power_zones(p), p.selectExpr("session_id % 3 as group_id", "session_id").distinct(), ("0 W", *LABELS)), "ride_points")
ORACLES["group_histogram_average"] = f"WITH hh AS ({ORACLES['power_zones']}), t AS (SELECT session_id, sum(cnt) AS total FROM hh GROUP BY 1) SELECT session_id % 3 AS group_id, label, round(avg(cnt * 100e0 / total), 6) AS percent FROM hh JOIN t USING (session_id) GROUP BY 1, 2"


def _named(s):
    old = s.selectExpr("rider_id * 2 + session_id % 2 as group_id", "session_id").unionByName(s.selectExpr("1000000000 + session_id % 1000 as group_id", "session_id")).groupBy("group_id").agg(F.collect_list("session_id").alias("members"))
    old = old.selectExpr("group_id", "members", "concat('Loop ', group_id) as name", "group_id % 5 as created_at")
    return s.groupBy(F.col("rider_id").alias("group_id")).agg(F.collect_list("session_id").alias("members")), old


OLD = """old AS (SELECT rider_id * 2 + session_id % 2 AS o, session_id FROM sessions UNION ALL SELECT 1000000000 + session_id % 1000, session_id FROM sessions),
  best AS (SELECT g.rider_id, g.o FROM (SELECT rider_id, o, count(*) AS hits FROM old JOIN sessions USING (session_id) GROUP BY 1, 2) g JOIN (SELECT o, count(*) AS n FROM old GROUP BY 1) z ON z.o = g.o AND hits = n QUALIFY row_number() OVER (PARTITION BY rider_id ORDER BY g.o % 5, g.o) = 1)"""
register("kept_names", lambda s: h.kept_names(*_named(s)), S, f"WITH {OLD} SELECT DISTINCT rider_id AS group_id, o AS old_id, 'Loop ' || o AS name FROM sessions LEFT JOIN best USING (rider_id)")
register("stale_groups", lambda s: h.stale_groups(_named(s)[1], h.kept_names(*_named(s))), S, f"WITH {OLD} SELECT DISTINCT o AS group_id FROM old WHERE o NOT IN (SELECT o FROM best)")
register("trends", lambda s: s.selectExpr("session_id", f"{h.trend('average_power', '180', True)} as power", f"{h.trend('net_duration_sec', 'normalized_power', False)} as duration"), S,
  "SELECT session_id, CASE WHEN average_power > 180 THEN 'up better' WHEN average_power < 180 THEN 'down worse' END AS power, CASE WHEN normalized_power = 0 THEN NULL WHEN net_duration_sec > normalized_power THEN 'up worse' WHEN net_duration_sec < normalized_power THEN 'down better' END AS duration FROM sessions")
register("import_summary", lambda e: h.import_summary(e.selectExpr("event_id as idx", "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'small' ELSE 'success' END as kind", "concat('bad file ', event_id) as message")), "events",
  "SELECT concat('Imported ', count(*) FILTER (event_type NOT IN ('error', 'signup')), ' new rides, ', count(*) FILTER (event_type = 'error'), ' failed: bad file ', min(event_id) FILTER (event_type = 'error'), ', ', count(*) FILTER (event_type = 'signup'), ' skipped (too short)') AS message FROM events")
register("session_exists", lambda s: s.selectExpr("count(1) as n", "count_if(session_id = 7) > 0 as has_seven", "count_if(session_id = -1) > 0 as has_none"), S, "SELECT count(*) AS n, EXISTS (SELECT 1 FROM sessions WHERE session_id = 7) AS has_seven, EXISTS (SELECT 1 FROM sessions WHERE session_id = -1) AS has_none FROM sessions")
register("ride_energy", lambda p: h.energy_kcal(m.fat_carb_grams(p)), "ride_points")
ORACLES["ride_energy"] = f"SELECT session_id, {geo.half_up('9.3e0 * fat_g + 4.1e0 * carb_g')} AS kcal FROM ({ORACLES['fat_carb_grams']}) g"
register("cascade_delete", lambda s, o: h.cascade_delete(s, o.where("o_totalprice > 300000").selectExpr("o_orderkey as session_id"), "session_id").select("session_id", "rider_id"), "sessions orders", "SELECT session_id, rider_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.session_id AND o_totalprice > 300000)")
register("upsert", lambda s: h.upsert(s.select("session_id", "distance_km"), s.where("session_id % 3 = 0").selectExpr("session_id", "distance_km * 2 as distance_km"), "session_id"), S, "SELECT session_id, CASE WHEN session_id % 3 = 0 THEN distance_km * 2 ELSE distance_km END AS distance_km FROM sessions")
register("point_lookup", lambda s: s.where("session_id in (3, 1, 4, 15, 92, 65)").select("session_id", "distance_km", "average_power"), S, "SELECT session_id, distance_km, average_power FROM sessions WHERE session_id IN (3, 1, 4, 15, 92, 65)")
register("best_effort_join", lambda p, s: m.best_split(p, 100).join(s.selectExpr("session_id", "session_start"), "session_id"), "ride_points sessions", f"WITH cum AS ({r.CUM}), b AS ({r._split(100)}) SELECT b.session_id, metres, best_sec, session_start FROM b JOIN sessions s ON s.session_id = b.session_id")

EIGHT_SPEEDS = "CASE WHEN v < 5 THEN '0-5 km/h' WHEN v < 10 THEN '5-10 km/h' WHEN v < 20 THEN '10-20 km/h' WHEN v < 25 THEN '20-25 km/h' WHEN v < 30 THEN '25-30 km/h' WHEN v < 35 THEN '30-35 km/h' WHEN v < 40 THEN '35-40 km/h' WHEN v < 70 THEN '>40 km/h' ELSE 'odd' END"
register("migrated_speeds", lambda p: h.merged_speed_bins(p.selectExpr("session_id", "coalesce(speed_kmh, 0e0) as v").selectExpr("session_id", f"{EIGHT_SPEEDS} as label").groupBy("session_id", "label").count().withColumnRenamed("count", "cnt"), h.SPEED_LABELS), "ride_points",
  """SELECT session_id, label, count(*) FILTER (v >= low AND v < high) AS cnt FROM (SELECT session_id, coalesce(speed_kmh, 0) AS v FROM ride_points) p, (VALUES ('0-10 km/h', 0, 10), ('10-20 km/h', 10, 20), ('20-30 km/h', 20, 30), ('30-40 km/h', 30, 40), ('>40 km/h', 40, 70)) l(label, low, high) GROUP BY 1, 2""")
register("cluster_rows", lambda s: s.selectExpr("session_id", "rider_id", "distance_km", "average_power", "net_duration_sec", "session_start"), S, "SELECT o_orderkey AS session_id, o_custkey AS rider_id, o_totalprice / 1e3 AS distance_km, CASE o_orderstatus WHEN 'F' THEN CAST(100 + o_orderkey % 200 AS INT) END AS average_power, net_duration_sec, o_orderdate AS session_start FROM orders JOIN sessions ON session_id = o_orderkey")
register("groups_by_creation", lambda s: h.placed(s.groupBy(F.col("rider_id").alias("group_id")).agg(F.min("session_start").alias("created_at")), [F.col("created_at").asc(), F.col("group_id").asc()]).selectExpr("group_id", "cast(place as bigint) as place"), S, "SELECT rider_id AS group_id, row_number() OVER (ORDER BY min(session_start), rider_id) AS place FROM sessions GROUP BY rider_id")
