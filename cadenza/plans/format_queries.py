"""Queries that format values: texts, colours, axes and opening hours."""

from __future__ import annotations

from cadenza.functions import geo
from cadenza.functions import text as x
from cadenza.plans.registry import register

# Upper bounds of speeds with their colours, colours of interval lengths, nice sizes of axes and buckets.
SPEED_COLOURS = [(1e-12, "#000000"), (20, "#FFEDA0"), (25, "#FEB24C"), (30, "#FD8D3C"), (40, "#F03B20"), (50, "#BD0026"), (60, "#6BAED6"), (70, "#2171B5")]
FASTEST = "#08306B"
LENGTH_COLOURS = ["#FFFFB2", "#FECC5C", "#FD8D3C", "#F03B20", "#BD0026"]
AXIS_STEPS_M = [50.0, 100.0, 200.0]
BUCKETS_M = [5000.0, 10000.0, 20000.0, 25000.0, 50000.0, 100000.0]


def formats(query: str, table: str, key: str, **columns: str) -> None:
    """One query of texts that both engines compute from the same declarations."""
    shown = ", ".join([key, *[f"{sql} AS {c}" for c, sql in columns.items()]])
    register(query, lambda df: df.selectExpr(*key.split(", "), *[f"{sql} AS {c}" for c, sql in columns.items()]), table, x.duck(f"SELECT {shown} FROM {table}"))


S, KM, SEC = "sessions", "distance_km", "CAST(net_duration_sec AS INT)"
formats("format_durations", S, "session_id", duration=x.duration(SEC), hours=x.duration_hours(SEC), long_form=x.duration_long(SEC), clock=x.minutes_seconds(SEC))
formats("format_measures", S, "session_id", distance=f"{x.fixed(KM, 1)} || ' km'", rounded=f"{x.thousands(f'CAST({x.fixed(KM, 0)} AS INT)')} || ' km'",
        climb=f"{x.fixed('elevation_gain_m', 0)} || ' m'", climb_rate=x.climb_per_100km("elevation_gain_m", KM), power=f"{x.whole('average_power')} || ' W'")
formats("format_comparison", S, "session_id", power=x.comparison("average_power", "180", "W"), distance=x.comparison(KM, "150e0", "km"), nothing=x.comparison(KM, "CAST(NULL AS DOUBLE)", "km"), duration=x.duration_comparison(SEC, "3600"))
formats("format_poi_distance", S, "session_id", near=x.poi_distance(f"({KM} * 7e0)"), on_track=x.track_poi_distance(f"({KM} * 7e0)"))
formats("format_categories", "events", "event_id", name=x.category_name("event_type"))
formats("cardiac_bands", S, "session_id", band=x.drift_band(f"({KM} / 3e1)"))
formats("speed_colors", "ride_points", "session_id, idx", colour=x.class_of("coalesce(speed_kmh, 0e0)", SPEED_COLOURS, FASTEST))
formats("interval_colors", S, "session_id", colour=x.ramp("net_duration_sec % 600", 120, 480, LENGTH_COLOURS))
formats("scale_bar", S, "session_id", metres=f"round({x.nice_distance(f'({KM} * 37e0)')}, 6)", label=x.scale_label(x.nice_distance(f"({KM} * 37e0)")))
formats("axis_steps", S, "session_id", step=x.axis_step("1e2", "(1e2 + coalesce(elevation_gain_m, 0e0))", AXIS_STEPS_M, 6), bucket=x.axis_step("0e0", f"({KM} * 1e3)", BUCKETS_M, 11))
formats("file_names", "part", "p_partkey", shown=x.short_file_name("(p_name || '-' || p_type || '.fit')"), escaped=x.escape_xml("(p_name || ' & <' || p_type || '>')"))
formats("decimal_comma", "orders", "o_orderkey", value=x.decimal_comma("(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE replace(CAST(o_orderkey AS STRING) || '.5', '.', ',') END)"))

# Opening hours, with what holds on a Wednesday at 13:30, worked out by hand.
HOURS = [
    ("24/7", "TRUE"), ("off", "FALSE"), ("Mo-Fr 08:00-18:00", "TRUE"), ("Sa,Su 10:00-16:00", "CAST(NULL AS BOOLEAN)"), ("Fr-We 12:00-14:00", "TRUE"), ("22:00-02:00", "FALSE"),
    ("Mo-Su 09:00-12:00; We 13:00-17:00", "TRUE"), ("08:00-18:00; We 08:00-12:00", "FALSE"), ("by appointment", "CAST(NULL AS BOOLEAN)"), ("18:00-14:00", "TRUE"), ("08:00-25:00", "CAST(NULL AS BOOLEAN)"), ("Mo-Fr 08:00-18:00; off", "FALSE"),
]
PICK = f"CAST(id % {len(HOURS)} AS INT)"
register("opening_hours", lambda p: p.selectExpr("id", f"array({', '.join(f'{chr(39)}{h}{chr(39)}' for h, _ in HOURS)})[{PICK}] AS hours").selectExpr("id", "hours", f"{x.is_open('hours', 3, 13 * 60 + 30)} AS is_open"), "pois",
  f"SELECT id, CASE {PICK} {' '.join(f'WHEN {i} THEN {chr(39)}{h}{chr(39)}' for i, (h, _) in enumerate(HOURS))} END AS hours, CASE {PICK} {' '.join(f'WHEN {i} THEN {v}' for i, (_, v) in enumerate(HOURS))} END AS is_open FROM pois")

# Written out by hand for the other engine.
register("format_dates", lambda s: s.selectExpr("session_id", f"{x.ride_date('session_start')} AS shown"), S, "SELECT session_id, strftime(session_start, '%a, %d %b %Y') AS shown FROM sessions")
register("gpx_names", lambda p: p.selectExpr("p_partkey", x.file_base("p_name || '/' || p_type || ' '", "'260105'") + " AS file"), "part", "SELECT p_partkey, '260105_' || trim(regexp_replace(p_name || '/' || p_type || ' ', '[^-A-Za-z0-9 _]', '_', 'g')) AS file FROM part")
register("ride_summaries", lambda s: s.selectExpr("session_id", f"{x.ride_summary(KM, SEC, 'average_power', 'session_id % 3')} AS summary"), S, """SELECT session_id, CAST(CAST(CAST(distance_km AS VARCHAR) AS DECIMAL(30, 1)) AS VARCHAR) || ' km | ' || CASE WHEN net_duration_sec >= 3600 THEN concat(net_duration_sec // 3600, 'h ', net_duration_sec // 60 % 60, 'm') WHEN net_duration_sec >= 60 THEN concat(net_duration_sec // 60, 'm ', net_duration_sec % 60, 's') ELSE concat(greatest(net_duration_sec, 0), 's') END
  || CASE WHEN average_power IS NULL THEN '' ELSE concat(' | ', average_power, ' W') END || CASE session_id % 3 WHEN 0 THEN '' ELSE concat(' | ', session_id % 3, ' intervals') END AS summary FROM sessions""")
register("poi_icons", lambda e: e.selectExpr("event_id", x.icon_key("replace(event_type, 'click', 'friture')") + " AS icon"), "events", "SELECT event_id, CASE event_type WHEN 'click' THEN 'fast_food' ELSE event_type END AS icon FROM events")
LOW, HIGH = "(distance_km / 3e0 - 20e0)", "(distance_km / 3e0 - 20e0 + session_id % 97 / 4e0)"
register("axis_ticks", lambda s: s.selectExpr("session_id", f"array_join(transform({x.integer_ticks(LOW, HIGH)}, v -> cast(round(v, 6) as string)), ' ') AS ticks", f"{x.rounded_bounds(LOW, HIGH)[0]} AS low", f"{x.rounded_bounds(LOW, HIGH)[1]} AS high", f"cast({x.count_axis('session_id % 23')} as int) AS top"), S,
  f"""WITH r AS (SELECT session_id, {LOW} AS a, {HIGH} AS b FROM sessions), s AS (SELECT *, coalesce(list_filter([1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000], lambda v: (b - a) / v <= 4)[1], 1000) AS st FROM r)
  SELECT session_id, CASE WHEN ceil(a / st) * st <= b + st * 1e-4 THEN array_to_string(list_transform(generate_series(CAST(ceil(a / st) AS BIGINT), CAST(floor((b + st * 1e-4) / st) AS BIGINT)), lambda k: CAST(CAST(k * st AS DOUBLE) AS VARCHAR)), ' ') ELSE CAST(round((a + b) / 2, 6) AS VARCHAR) END AS ticks,
  floor(a / 10) * 10 AS low, ceil(b / 10) * 10 AS high, greatest(5, CAST(ceil(session_id % 23 / 5e0) * 5 AS INT)) AS top FROM s""")
register("direction_compass", lambda n: n.selectExpr("id", f"{geo.compass('(id % 20 * 1e0)', '((id * 7 % 360) * 1e0)')} AS direction"), "map_nodes", "SELECT id, CASE WHEN id % 20 < 10 THEN 'unknown' ELSE ['north', 'east', 'south', 'west'][1 + (id * 7 % 360 + 45) // 90 % 4] END AS direction FROM map_nodes")
register("format_speeds", lambda s: s.selectExpr("session_id", f"{x.speed(f'({KM} / 7e0)')} AS speed", f"{x.cardiac(f'({KM} / 111e0)')} AS cardiac"), S, "SELECT session_id, CAST(CAST(CAST(distance_km / 7e0 AS VARCHAR) AS DECIMAL(30, 1)) AS VARCHAR) || ' km/h' AS speed, CAST(CAST(CAST(distance_km / 111e0 AS VARCHAR) AS DECIMAL(30, 2)) AS VARCHAR) || ' W/bpm' AS cardiac FROM sessions")
