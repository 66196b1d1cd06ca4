"""Ride and road tables derived from the driver's star schema. The texts run on Spark and on DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROXIES = {
    # About a thousand points a ride, so that the number of rides grows with the data.
    "ride_events": "SELECT e.*, user_id % n AS session_id FROM {events} e CROSS JOIN (SELECT CAST(greatest(10, floor(count(*) / 1e3)) AS BIGINT) AS n FROM {events}) k",
    "ride_points": """SELECT session_id, idx, ts, CAST(idx AS DOUBLE) AS elapsed_sec, 50.78e0 + idx * 1e-4 + (event_id % 7) * 1e-5 AS lat,
      6.07e0 + (event_id % 13) * 1e-5 AS lon, CASE WHEN event_type = 'signup' THEN NULL ELSE value / 4e0 END AS speed_kmh,
      CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 4e0) AS INT) END AS power,
      60 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS heart_rate, 100e0 + ((event_id * 37) % 200) / 1e1 AS altitude
      FROM (SELECT r.*, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS idx FROM {ride_events} r) s""",
    "timer_events": """SELECT session_id, event_id, ts, CASE WHEN event_type = 'click' THEN 'start' WHEN event_type = 'error' THEN 'stop' ELSE 'stop_all' END AS kind
      FROM {ride_events} WHERE event_type IN ('click', 'error', 'signup')""",
    "sessions": """SELECT o.o_orderkey AS session_id, o.o_custkey AS rider_id, o.o_orderdate AS session_start, o.o_totalprice / 1e3 AS distance_km,
      CAST(coalesce(l.q, 0e0) * 60e0 AS BIGINT) AS net_duration_sec, CASE WHEN o.o_orderstatus = 'F' THEN CAST(100 + o.o_orderkey % 200 AS INT) END AS average_power,
      CASE WHEN o.o_orderpriority LIKE '1%' THEN NULL ELSE o.o_totalprice / 2e2 END AS elevation_gain_m, o.o_orderstatus = 'F' AS has_power,
      CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 <> 0 THEN CAST(110 + o.o_orderkey % 190 AS INT) END AS normalized_power, CASE WHEN o.o_orderkey % 3 <> 0 THEN CAST(o.o_orderkey % 90 + 70 AS INT) ELSE 0 END AS avg_heart_rate,
      CASE WHEN o.o_orderkey % 4 <> 0 THEN (o.o_orderkey % 400) / 1e1 END AS fat_g, (o.o_orderkey % 900) / 1e1 AS carb_g, CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST(o.o_orderkey % 101 AS INT) END AS fat_score
      FROM {orders} o LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "map_nodes": "SELECT p_partkey AS id, 50.6e0 + floor(p_partkey / 2e1) * 1e-2 AS lat, 5.9e0 + (p_partkey % 20) * 1e-2 AS lon FROM {part}",
    "map_edges": """SELECT e.from_node, e.to_node, 700e0 + (e.from_node * 31 + e.to_node * 17) % 400 AS length_m, e.from_node % 3 <> 0 AS is_traversed,
      coalesce(l.n, 0) AS traversal_count, l.s AS speed_mean, CASE WHEN (e.from_node + e.to_node) % 4 <> 0 THEN 9e1 + e.from_node % 160 END AS power_mean,
      CASE WHEN e.to_node % 5 <> 0 THEN l.s * 8e-1 END AS speed_p25, CASE WHEN e.to_node % 7 <> 0 THEN l.s END AS speed_p50, l.s * 12e-1 AS speed_p75,
      CASE WHEN e.from_node % 5 <> 0 THEN 8e1 + e.from_node % 90 END AS power_p25, 12e1 + e.to_node % 90 AS power_p50, CASE WHEN e.from_node % 9 <> 0 THEN 16e1 + e.to_node % 90 END AS power_p75,
      CASE WHEN e.from_node % 3 <> 1 THEN CAST(e.to_node % 5 AS INT) END AS pedal_count, CASE WHEN e.to_node % 4 <> 2 THEN CAST(e.from_node % 4 AS INT) END AS gravity_count,
      CASE WHEN e.from_node % 6 <> 0 THEN (e.to_node % 11) / 1e1 END AS pedal_probability, (e.from_node % 9) / 1e1 AS gravity_probability, CASE WHEN e.to_node % 8 <> 0 THEN (e.from_node % 10) / 1e1 END AS confidence,
      CASE e.from_node % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'motorway_link' WHEN 3 THEN 'trunk_link' WHEN 4 THEN 'residential' WHEN 5 THEN 'cycleway' END AS highway
      FROM (SELECT a.p_partkey AS from_node, b.p_partkey AS to_node FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 20
            UNION ALL SELECT a.p_partkey, b.p_partkey FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey - 20
            UNION ALL SELECT a.p_partkey, b.p_partkey FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 20 <> 19
            UNION ALL SELECT a.p_partkey, b.p_partkey FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey - 1 AND a.p_partkey % 20 <> 0) e
      LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS s FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = e.from_node""",
    "pois": "SELECT s_suppkey AS id, s_nationkey % 8 AS category, 50.6e0 + (s_suppkey % 50) * 2e-3 AS lat, 5.9e0 + (s_suppkey % 97) * 2e-3 AS lon FROM {supplier}",
    # Counts and probabilities of a road as the text of one JSON object; some are not valid JSON.
    "edge_metadata": """SELECT from_node, to_node, is_traversed, CASE WHEN from_node % 17 = 3 THEN chr(123) || 'oops' ELSE chr(123) || coalesce('"pedal_flow_count":' || CAST(pedal_count AS STRING) || ',', '') || coalesce('"gravity_flow_count":' || CAST(gravity_count AS STRING) || ',', '')
      || coalesce('"predicted_pedal_flow_probability":0.' || CAST(to_node % 10 AS STRING) || ',', '') || '"predicted_gravity_flow_probability":0.' || CAST(from_node % 9 AS STRING) || CASE WHEN to_node % 8 <> 0 THEN ',"flow_confidence":0.' || CAST(from_node % 10 AS STRING) ELSE '' END || chr(125) END AS metadata FROM {map_edges}""",
    # Chains of up to four roads along a row of the grid; two chains make a group of twins.
    "corridors": """SELECT CAST(floor(from_node / 5e0) AS BIGINT) AS id, min(from_node) AS entry_node, max(to_node) AS exit_node, sum(length_m) AS length_m, CAST(sum(coalesce(pedal_count, 0)) AS DOUBLE) AS pedal_reward,
      CAST(sum(coalesce(gravity_count, 0)) AS DOUBLE) AS gravity_reward, avg(lat) AS lat, avg(lon) AS lon, CAST(sum(traversal_count) AS BIGINT) AS popularity, CAST(floor(min(from_node) / 1e1) AS BIGINT) AS group_id
      FROM {map_edges} JOIN {map_nodes} ON id = from_node WHERE to_node = from_node + 1 AND from_node % 5 <> 4 GROUP BY floor(from_node / 5e0)""",
    # Rides along a row of the grid and half of it back.
    "paths": """SELECT CAST(floor(from_node / 2e1) AS BIGINT) AS route, CASE WHEN to_node > from_node THEN from_node % 20 ELSE 38 - from_node % 20 END AS seq, from_node, to_node, length_m, is_traversed, speed_mean, power_mean,
      speed_p25, speed_p50, speed_p75, power_p25, power_p50, power_p75 FROM {map_edges} WHERE to_node = from_node + 1 OR (to_node = from_node - 1 AND from_node % 20 >= 10)""",
    # Stretches of forty points of the rides.
    "interval_points": """SELECT session_id * 100000 + CAST(floor(idx / 4e1) AS BIGINT) AS interval_id, session_id, idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {ride_points} WHERE CAST(floor(idx / 4e1) AS BIGINT) % 3 = 0""",
}
_BASE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A proxy view, or one of the driver's tables, as a DataFrame."""
    if name not in PROXIES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PROXIES[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in sorted(set(_BASE.findall(text)))})


def with_proxies(sql: str) -> str:
    """DuckDB text: ``sql`` with the proxies that it names, and those that they name, defined in front."""
    used: set[str] = set()
    fresh = {n for n in PROXIES if re.search(rf"\b{n}\b", sql)}
    while fresh:
        used |= fresh
        fresh = {t for n in fresh for t in _BASE.findall(PROXIES[n]) if t in PROXIES} - used
    order = sorted(used, key=_depth)
    ctes = ", ".join(f"{n} AS ({_BASE.sub(lambda m: m[1], PROXIES[n])})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {ctes} {body}"


def _depth(name: str) -> int:
    """How many proxies stand below one another until those that read base tables only."""
    return 1 + max((_depth(t) for t in _BASE.findall(PROXIES[name]) if t in PROXIES), default=0)
