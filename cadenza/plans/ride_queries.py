"""Queries over single rides."""

from __future__ import annotations

from cadenza.functions import geo
from cadenza.operators import metrics as m
from cadenza.plans import duck
from cadenza.plans.registry import ORACLES, register

P = "ride_points"
W = "OVER (PARTITION BY session_id ORDER BY idx)"
LAGGED = f"SELECT *, lag(lat) {W} AS a, lag(lon) {W} AS b FROM ride_points"
US = "epoch_us(ts)"


def _hist(rows: str, label: str, labels: list[str]) -> str:
    values = ", ".join(f"('{x}')" for x in labels)
    return f"""WITH g AS (SELECT s.session_id, v.label FROM (SELECT DISTINCT session_id FROM {rows}) s CROSS JOIN (VALUES {values}) v(label)),
      c AS (SELECT session_id, {label} AS label, count(*) AS cnt FROM {rows} GROUP BY 1, 2)
      SELECT g.session_id, g.label, coalesce(c.cnt, 0) AS cnt FROM g LEFT JOIN c ON g.session_id = c.session_id AND g.label = c.label"""


# Positive values are numbered, and each zero looks at the 20 before it.
EFF = """SELECT r.session_id, r.idx, CASE WHEN any_value(r.power) > 0 THEN CAST(any_value(r.power) AS DOUBLE) ELSE coalesce(median(q.power), 0e0) END AS effective_power
    FROM (SELECT *, sum(CASE WHEN power > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS k FROM ride_points) r
    LEFT JOIN (SELECT session_id, power, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS j FROM ride_points WHERE power > 0) q
    ON q.session_id = r.session_id AND coalesce(r.power, 0) <= 0 AND q.j BETWEEN r.k - 19 AND r.k GROUP BY r.session_id, r.idx"""
CUM = f"""SELECT *, lag(c) {W} AS pc, lag(e) {W} AS pe, lag(w) {W} AS pw FROM (SELECT session_id, idx, e, sum(step) {W} AS c, sum(joule) {W} AS w FROM (
    SELECT session_id, idx, elapsed_sec AS e, coalesce({geo.haversine('a', 'b', 'lat', 'lon')}, 0e0) AS step,
    coalesce(lag(CAST(coalesce(power, 0) AS DOUBLE)) {W} * (elapsed_sec - lag(elapsed_sec) {W}), 0e0) AS joule FROM ({LAGGED}) l) s) t"""
ROLL = f"SELECT session_id, idx, CASE WHEN idx < 14 THEN 0e0 ELSE avg(CAST(coalesce(power, 0) AS DOUBLE)) OVER (PARTITION BY session_id ORDER BY idx ROWS 14 PRECEDING) END AS rolling FROM ride_points"


def _split(metres: float) -> str:
    # Each sample's end: the first later sample far enough, found by a nearest-match join on running distance.
    return f"""SELECT session_id, {metres:.1f}e0 AS metres, round(min(CASE WHEN xc > xpc THEN xpe + (target - xpc) / (xc - xpc) * (xe - xpe) ELSE xe END - e), 6) AS best_sec FROM (
      SELECT s.session_id, s.e, s.target, f.c AS xc, f.pc AS xpc, f.e AS xe, f.pe AS xpe FROM (SELECT *, c + {metres:.1f}e0 AS target FROM cum) s
      ASOF JOIN (SELECT session_id, c, min(idx) AS idx, arg_min(pc, idx) AS pc, arg_min(e, idx) AS e, arg_min(pe, idx) AS pe FROM cum GROUP BY session_id, c) f
      ON s.session_id = f.session_id AND s.target <= f.c) z GROUP BY session_id"""


def _power(seconds: float) -> str:
    return f"""SELECT session_id, {seconds:.1f}e0 AS seconds, CASE WHEN max(v) > 0 THEN CAST(floor(round(max(v), 6) + 0.5e0) AS INT) END AS watts FROM (
      SELECT s.session_id, (CASE WHEN f.e > f.pe THEN f.pw + (f.w - f.pw) * ((s.target - f.pe) / (f.e - f.pe)) ELSE f.w END - s.w) / {seconds:.1f}e0 AS v
      FROM (SELECT *, e + {seconds:.1f}e0 AS target FROM cum) s ASOF JOIN cum f ON s.session_id = f.session_id AND s.target <= f.e) z GROUP BY session_id"""


register("ride_distance", m.ride_distance, P, f"SELECT session_id, round(coalesce(sum({geo.haversine('a', 'b', 'lat', 'lon')}), 0e0) / 1000, 6) AS distance_km, count(*) AS n_points FROM ({LAGGED}) l GROUP BY session_id")
register("ride_duration", m.ride_duration, P, f"SELECT session_id, CAST(floor((max({US}) - min({US})) / 1e6) AS BIGINT) AS total_sec FROM ride_points GROUP BY session_id")
register("ride_heading_vectors", m.heading_vectors, P, f"""SELECT session_id, idx, CASE WHEN ok THEN round(dx, 6) END AS dx, CASE WHEN ok THEN round(dy, 6) END AS dy, CASE WHEN ok THEN round({geo.positive_mod('degrees(atan2(dx, dy))', '360e0')}, 6) END AS heading
  FROM (SELECT *, sqrt(dx * dx + dy * dy) >= 5e-1 AS ok FROM (SELECT session_id, idx, (lon - b) * {geo.metres_per_degree_lon('lat')} AS dx, (lat - a) * 111320e0 AS dy FROM ({LAGGED}) l) v) o""")
GAPS = "SELECT * REPLACE (CASE WHEN idx % 5 IN (1, 2) THEN NULL ELSE power END AS power) FROM ride_points"
register("power_interpolated", lambda p: m.interpolated_power(p.selectExpr("session_id", "idx", "case when idx % 5 in (1, 2) then null else power end as power")), P, f"""SELECT session_id, idx, CAST(coalesce(power, CASE WHEN ai IS NULL THEN bp WHEN bi IS NULL THEN ap ELSE trunc(ap + (bp - ap) * (CAST(idx - ai AS DOUBLE) / (bi - ai))) END) AS INT) AS power FROM (
  SELECT *, last_value(CASE WHEN power IS NOT NULL THEN idx END IGNORE NULLS) {W} AS ai, last_value(power IGNORE NULLS) {W} AS ap,
  first_value(CASE WHEN power IS NOT NULL THEN idx END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi,
  first_value(power IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp FROM ({GAPS}) g) h""")
D = geo.haversine("k.lat", "k.lon", "p.lat", "p.lon")
register("gps_quality_filter", m.gps_quality_filter, P, f"""WITH RECURSIVE ok AS (SELECT session_id, idx, lat, lon, {US} / 1e6 AS s, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM ride_points
  WHERE lat <> 0 AND lon <> 0 AND coalesce(speed_kmh, 0) <= 110 AND coalesce(power, 0) <= 1500),
  k AS (SELECT session_id, n, idx, lat, lon, s, TRUE AS kept FROM ok WHERE n = 1
    UNION ALL SELECT p.session_id, p.n, p.idx, CASE WHEN bad THEN klat ELSE p.lat END, CASE WHEN bad THEN klon ELSE p.lon END, CASE WHEN bad THEN ks ELSE p.s END, NOT bad
    FROM (SELECT p.*, k.lat AS klat, k.lon AS klon, k.s AS ks, ({D} > 500 AND p.s - k.s < 5) OR (p.s > k.s AND {D} / (p.s - k.s) * 3.6e0 > 120) AS bad FROM k JOIN ok p ON p.session_id = k.session_id AND p.n = k.n + 1) p)
  SELECT session_id, idx FROM k WHERE kept""")
register("elevation_gain_hysteresis", m.elevation_gain, P, """WITH RECURSIVE o AS (SELECT session_id, altitude AS alt, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM ride_points WHERE altitude IS NOT NULL),
  k AS (SELECT session_id, n, alt AS low, 0e0 AS gain FROM o WHERE n = 1 UNION ALL
    SELECT o.session_id, o.n, CASE WHEN o.alt < k.low OR o.alt - k.low >= 3e0 THEN o.alt ELSE k.low END, k.gain + CASE WHEN o.alt - k.low >= 3e0 THEN o.alt - k.low ELSE 0e0 END FROM k JOIN o ON o.session_id = k.session_id AND o.n = k.n + 1)
  SELECT session_id, CASE WHEN max(n) >= 2 THEN round(arg_max(gain, n), 6) END AS elevation_gain_m FROM k GROUP BY session_id""")
# Stops close at the next start; of several stops before one start the first counts.
PAUSES = """SELECT session_id, CAST(coalesce(sum(floor((epoch_us(until) - epoch_us(since)) / 1e6)), 0) AS BIGINT) AS pause_sec FROM (SELECT session_id, starts, min(ts) FILTER (kind <> 'start') AS since, any_value(next_start) AS until FROM (
  SELECT *, count(*) FILTER (kind = 'start') OVER (PARTITION BY session_id ORDER BY ts, event_id) AS starts, min(ts) FILTER (kind = 'start') OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM timer_events) e GROUP BY 1, 2) g GROUP BY session_id"""
register("pause_duration", m.pause_duration, "timer_events", PAUSES)
register("net_duration", m.net_duration, f"{P} timer_events", f"SELECT session_id, total_sec, greatest(0, total_sec - coalesce(pause_sec, 0)) AS net_sec FROM (SELECT session_id, CAST(floor((max({US}) - min({US})) / 1e6) AS BIGINT) AS total_sec FROM ride_points GROUP BY session_id) t LEFT JOIN ({PAUSES}) q USING (session_id)")
register("power_presence", lambda p: m.has_power(p.selectExpr("session_id", "idx", "case when idx % 10 < session_id % 4 - 1 or idx % 13 = 1 and session_id % 4 = 2 then power end as power")), P, "SELECT session_id, count(*) FILTER (power IS NOT NULL AND (idx % 10 < session_id % 4 - 1 OR idx % 13 = 1 AND session_id % 4 = 2)) >= 1e-1 * count(*) AS has_power FROM ride_points GROUP BY session_id")
register("speed_histogram", m.speed_histogram, P, _hist(P, m.speed_label(), [b[0] for b in m.SPEED_BINS]))
register("power_zones", m.power_zones, P, _hist(P, m.power_label(150), ["0 W", *[b[0] for b in m.POWER_ZONES]]))
register("hr_zones", m.hr_zones, P, _hist(P, m.hr_label(190), [b[0] for b in m.HR_ZONES]))
register("avg_power", m.average_power, P, f"SELECT session_id, {geo.half_up('avg(power)')} AS avg_power FROM ride_points GROUP BY session_id")
register("avg_hr", m.average_hr, P, f"SELECT session_id, CASE WHEN count(*) FILTER (heart_rate > 0) >= 1e-1 * count(*) THEN {geo.half_up('avg(heart_rate) FILTER (heart_rate > 0)')} END AS avg_hr FROM ride_points GROUP BY session_id")
register("normalized_power", m.normalized_power, P, """SELECT session_id, round(CASE WHEN count(*) > 29 THEN pow(avg(CASE WHEN idx >= 29 THEN pow(r, 4e0) END), 25e-2) ELSE avg(p) END, 6) AS normalized_power FROM (
  SELECT *, avg(p) OVER (PARTITION BY session_id ORDER BY idx ROWS 29 PRECEDING) AS r FROM (SELECT session_id, idx, CAST(coalesce(power, 0) AS DOUBLE) AS p FROM ride_points) b) c GROUP BY session_id""")
register("effective_power", m.effective_power, P, EFF)
register("fat_carb_grams", m.fat_carb_grams, P, f"SELECT session_id, round(sum({geo.fat_rate('effective_power')}) / 9.3e0, 6) AS fat_g, round(sum({geo.carb_rate('effective_power')}) / 4.1e0, 6) AS carb_g FROM ({EFF}) e GROUP BY session_id")
register("fat_score", m.fat_score, P, f"SELECT session_id, {m.fat_score_text('effective_power')} AS fat_score FROM ({EFF}) e WHERE effective_power > 0 GROUP BY session_id")
register("fat_histogram", m.fat_histogram, P, f"WITH eff AS ({EFF}), {_hist('eff', m.fat_label('effective_power'), [b[0] for b in m.FAT_BINS])[5:]}")
register("cardiac_drift", lambda p: m.cardiac_drift(p, 150, 10, 60), P, """WITH t AS (SELECT session_id, CAST(max(elapsed_sec) AS BIGINT) AS total, CAST(max(elapsed_sec) AS BIGINT) // 10 AS n FROM ride_points GROUP BY session_id),
  b AS (SELECT p.session_id, t.n, least(floor(elapsed_sec / 10), t.n - 1) AS b, coalesce(power, 0) >= 37.5e0 AS used, power, heart_rate FROM ride_points p JOIN t ON t.session_id = p.session_id AND t.total >= 60 WHERE heart_rate > 0),
  e AS (SELECT session_id, n, b, avg(CASE WHEN used THEN power END) / avg(CASE WHEN used THEN heart_rate END) AS ef FROM b GROUP BY 1, 2, 3 HAVING count(*) FILTER (used) >= 5e-1 * count(*)),
  h AS (SELECT session_id, avg(CASE WHEN b < n // 2 THEN ef END) AS one, avg(CASE WHEN b >= n // 2 THEN ef END) AS two FROM e GROUP BY 1)
  SELECT session_id, round((one - two) / one * 100e0, 6) AS drift_percent FROM h WHERE one > 0 AND two IS NOT NULL""")
register("quality_pct", lambda p: m.quality_percent(p, m.gps_quality_filter(p)), P)
ORACLES["quality_pct"] = ORACLES["gps_quality_filter"].replace("SELECT session_id, idx FROM k WHERE kept", "SELECT p.session_id, round(n_kept * 100e0 / count(*), 6) AS gps_quality, round(count(power) * 100e0 / count(*), 6) AS power_quality FROM ride_points p LEFT JOIN (SELECT session_id, count(*) FILTER (kept) AS n_kept FROM k GROUP BY 1) q ON q.session_id = p.session_id GROUP BY p.session_id, n_kept")
register("rolling_power", m.rolling_power, P, f"SELECT session_id, idx, round(rolling, 6) AS rolling FROM ({ROLL}) r")
ISLAND = "sum(CASE WHEN was IS NULL OR idx - was > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS island"
SPANS = f"""WITH hot AS (SELECT session_id, idx FROM ({ROLL}) r WHERE rolling > 142.5e0), i AS (SELECT *, {ISLAND.format(gap=16)} FROM (SELECT *, lag(idx) {W} AS was FROM hot) l),
  s AS (SELECT session_id, island, min(idx) AS a, least(max(idx) + 14, (SELECT max(idx) FROM ride_points p WHERE p.session_id = i.session_id)) AS z FROM i GROUP BY session_id, island),
  w AS (SELECT session_id, idx, ts, power, speed_kmh, lat, lon, lag(lat) {W} AS pl, lag(lon) {W} AS po FROM ride_points),
  v AS (SELECT s.session_id, s.a, s.z, count(*) AS n, avg(coalesce(power, 0)) AS mean, CAST(greatest(count(*), floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)) AS INT) AS sec, coalesce(avg(speed_kmh), 0e0) AS speed,
    coalesce(sum({duck.hav('pl', 'po', 'lat', 'lon')}) FILTER (idx > s.a), 0e0) AS m, arg_min(lat, idx) AS la, arg_min(lon, idx) AS lo, arg_max(lat, idx) AS lz, arg_max(lon, idx) AS oz FROM s JOIN w p ON p.session_id = s.session_id AND p.idx BETWEEN s.a AND s.z GROUP BY 1, 2, 3),
  found AS (SELECT session_id, a AS start_idx, z AS end_idx, sec AS duration_sec, {duck.rounded('mean')} AS avg_power, CAST(trunc(sec * {duck.rounded('mean')} / 150e0) AS INT) AS normalized_sec, round(m, 4) AS distance_m, floor(speed * 10 + 0.5e0) / 10 AS speed_kmh,
    CASE WHEN {duck.rounded('mean')} > 0 THEN floor(speed / {duck.rounded('mean')} * 150e0 * 10 + 0.5e0) / 10 ELSE 0e0 END AS normalized_kmh, CASE WHEN m < 10 THEN 'unknown' ELSE ['north', 'east', 'south', 'west', 'north'][1 + CAST(floor(({duck.course('la', 'lo', 'lz', 'oz')} + 45) / 90) AS INT)] END AS direction FROM v WHERE n * (mean / 150e0) >= 20)"""
FOUND = lambda p: m.intervals(p, least=20)
register("intervals", FOUND, P, f"{SPANS} SELECT * FROM found")
register("interval_tracks", lambda p: m.interval_tracks(p, FOUND(p)), P, f"{SPANS} SELECT f.session_id, start_idx, idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM found f JOIN ride_points p ON p.session_id = f.session_id AND idx BETWEEN start_idx AND end_idx")
register("interval_pauses", lambda p: m.pauses_between(FOUND(p).selectExpr("session_id", "start_idx", "start_idx as start_sec", "(end_idx - start_idx) div 3 as duration_sec")), P, f"{SPANS} SELECT session_id, start_idx, pause_sec FROM (SELECT session_id, start_idx, start_idx - lag(start_idx + (end_idx - start_idx) // 3) OVER (PARTITION BY session_id ORDER BY start_idx) AS pause_sec FROM found) q WHERE pause_sec > 0")
register("interval_totals", lambda p: m.interval_totals(FOUND(p)), P, f"{SPANS} SELECT session_id, count(*) AS n, CAST(sum(duration_sec) AS BIGINT) AS total_sec, CAST(trunc(avg(avg_power)) AS INT) AS avg_power FROM found GROUP BY session_id")
SPRINTS = f"""SELECT session_id, min(idx) AS start_idx, max(idx) - min(idx) + 1 AS duration, max(power) AS peak_power FROM (
  SELECT *, {ISLAND.format(gap=2)} FROM (SELECT session_id, idx, power, lag(idx) {W} AS was FROM ride_points WHERE power > 199.5e0) h) i GROUP BY session_id, island HAVING max(idx) - min(idx) + 1 BETWEEN 3 AND 30"""
register("sprints", m.sprints, P, SPRINTS)
register("sprint_histogram", m.sprint_histogram, P, f"WITH sp AS ({SPRINTS}), {_hist('sp', geo.bin_label('duration', m.SPRINT_BINS), [b[0] for b in m.SPRINT_BINS])[5:]}")
SPLITS = (100, 500, *m.SPLITS_M)
register("best_split_time", lambda p: m.best_splits(p, SPLITS), P, f"WITH cum AS ({CUM}) SELECT * FROM ({' UNION ALL '.join(map(_split, SPLITS))}) q WHERE best_sec IS NOT NULL")
register("best_power_curve", m.best_powers, P, f"WITH cum AS ({CUM}) " + " UNION ALL ".join(map(_power, m.DURATIONS_S)))
