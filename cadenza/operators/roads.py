"""Road graph tables: bounding boxes, rewards, lookups, turn costs and rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import geo


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> str:
    """SQL for a point within (south, north, west, east), edges included."""
    return f"({lat} BETWEEN {geo.number(box[0])} AND {geo.number(box[1])} AND {lon} BETWEEN {geo.number(box[2])} AND {geo.number(box[3])})"


def edges_in_box(edges: DataFrame, nodes: DataFrame, box) -> DataFrame:
    """Edges with either end in the box: two semi-joins with the few nodes there, each edge once."""
    near = nodes.where(in_box("lat", "lon", box)).select("id")
    one = edges.join(near, edges.from_node == near.id, "left_semi")
    two = edges.join(near, edges.to_node == near.id, "left_semi")
    return one.unionByName(two).distinct()


def routing_reward(pedal: str, gravity: str, traversed: str, predicted: str, confidence: str) -> str:
    """Reward of a routing edge: measured flow, and for roads not yet ridden a discounted prediction."""
    return f"(coalesce({pedal}, 0) + coalesce({gravity}, 0) + CASE WHEN NOT {traversed} THEN 3e-1 * coalesce({predicted}, 0e0) * coalesce({confidence}, 0e0) ELSE 0e0 END)"


def composed_reward(flow: str, traversed: str, predicted: str, confidence: str, floor: float = 0.2, explore: float = 0.3) -> str:
    """Reward by weights: flow, and exploration of new roads, which counts for nothing below a floor of confidence."""
    new = f"NOT {traversed} AND coalesce({confidence}, 0e0) >= {geo.number(floor)}"
    return f"({flow} + CASE WHEN {new} THEN {geo.number(explore)} * coalesce({predicted}, 0e0) * {confidence} ELSE 0e0 END)"


#: Road classes that no ride may take.
HAZARDS = ("motorway", "motorway_link", "trunk", "trunk_link")


def safe_roads(edges: DataFrame) -> DataFrame:
    """Roads of other classes than the hazardous ones; a road without a class stays."""
    return edges.where(~F.coalesce(F.col("highway").isin(*HAZARDS), F.lit(False)))


def flow_segments(edges: DataFrame, least: int = 3) -> DataFrame:
    """Roads ridden in flow at least so often, by pedal or gravity; an unknown count is 0."""
    return edges.where(F.coalesce("pedal_count", F.lit(0)) + F.coalesce("gravity_count", F.lit(0)) >= least)


#: Fields of a road's JSON metadata that rewards take.
METADATA = "pedal_flow_count int, gravity_flow_count int, predicted_pedal_flow_probability double, predicted_gravity_flow_probability double, flow_confidence double"


def with_metadata(edges: DataFrame) -> DataFrame:
    """Edges with the fields of their JSON ``metadata``; text that is no JSON object gives nulls."""
    return edges.withColumn("_m", F.from_json("metadata", METADATA)).select("*", "_m.*").drop("_m")


def corridor_rewards(corridors: DataFrame, flow_weight: float = 1.0) -> DataFrame:
    return corridors.select("id", "length_m", (F.lit(flow_weight) * (F.col("pedal_reward") + F.col("gravity_reward"))).alias("reward"))


def turn_cost(angle: str, measured: str, hazard: str, stop: str, braking: str, energy: str) -> str:
    """Metres that a turn costs by its angle and, where measured, its hazards; an unmeasured real turn costs 10 more."""
    known = f"greatest(0e0, least(1e0, {hazard})) * 60e0 + greatest(0e0, {stop}) * 15e0 + greatest(0e0, least(1e0, coalesce({braking}, 0e0))) * 30e0 + greatest(0e0, coalesce({energy}, 0e0)) * 5e-1"
    return f"(CASE WHEN {measured} THEN {angle} / 180e0 * 20e0 + {known} WHEN {angle} < 5e0 THEN 0e0 ELSE {angle} / 180e0 * 20e0 + 10e0 END)"


def turns_in_box(turns: DataFrame, nodes: DataFrame, box) -> DataFrame:
    near = nodes.where(in_box("lat", "lon", box)).select(F.col("id").alias("junction"))
    return turns.join(near, "junction", "left_semi")


def pair_lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges by (from_node, to_node) pairs."""
    return edges.join(pairs, ["from_node", "to_node"], "left_semi")


def either_end(edges: DataFrame, node: int) -> DataFrame:
    return edges.where((F.col("from_node") == node) | (F.col("to_node") == node))


def successors(edges: DataFrame) -> DataFrame:
    """Pairs of edges of which one ends where the other begins; not an edge with itself."""
    a = edges.select(F.col("from_node").alias("a_from"), F.col("to_node").alias("via"))
    b = edges.select(F.col("from_node").alias("via"), F.col("to_node").alias("b_to"))
    return a.join(b, "via").where("not (a_from = via and via = b_to)")


def members(groups: DataFrame, items: DataFrame, ids: str, key: str) -> DataFrame:
    """Groups with their members looked up by id and kept in order; unknown ids drop out, and empty groups with them."""
    flat = groups.select("group_id", F.posexplode(ids).alias("place", key)).join(items, key)
    rows = flat.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("place", key))).alias("m"), F.count(F.lit(1)).alias("n"))
    return rows.select("group_id", F.transform("m", lambda x: x[key]).alias("members"), "n")


def top_per_group(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def to_local(lat: str, lon: str, lat0: float, lon0: float) -> tuple[str, str]:
    """Metres east and north of a point, as SQL."""
    return f"(({lon}) - {geo.number(lon0)}) * {geo.metres_per_degree_lon(geo.number(lat0))}", f"(({lat}) - {geo.number(lat0)}) * 111320e0"


def with_headings(corridors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Corridors with the places of their ends (elat, elon, xlat, xlon); nulls where a node is unknown."""
    a, b = nodes.selectExpr("id as entry_node", "lat as elat", "lon as elon"), nodes.selectExpr("id as exit_node", "lat as xlat", "lon as xlon")
    return corridors.join(a, "entry_node", "left").join(b, "exit_node", "left")


def aligned(bearing: str, other: str) -> str:
    """SQL: the cosine of the angle between two bearings."""
    return f"cos(radians(({bearing}) - ({other})))"


def anchor_scores(corridors: DataFrame, lat0: float, lon0: float, ride_bearing: float, reach_m: float, clockwise: bool = True) -> DataFrame:
    """Corridors (lat, lon of the centroid, reward) with along and lateral metres in the frame of the ride, quadrant and score.

    The frame's axes are the ride's direction and its right (clockwise) or left. Quadrants: 0 ahead on the near side,
    1 ahead on the far side, 2 and 3 behind. The score is the way along over the reach, half of how well the way
    to it runs along the bisector of its quadrant, and a tenth of its reward between the least and the greatest.
    """
    east, north = to_local("lat", "lon", lat0, lon0)
    turn, side = geo.number(math.radians(ride_bearing)), "1e0" if clockwise else "-1e0"
    df = corridors.withColumn("along", F.expr(f"{east} * sin({turn}) + {north} * cos({turn})")).withColumn("lateral", F.expr(f"{side} * ({east} * cos({turn}) - {north} * sin({turn}))"))
    df = df.withColumn("quadrant", F.expr("CASE WHEN along >= 0 AND lateral >= 0 THEN 0 WHEN along >= 0 THEN 1 WHEN lateral < 0 THEN 2 ELSE 3 END"))
    bounds = corridors.agg(F.min("reward").alias("low"), F.max("reward").alias("high"))
    tangent = f"({geo.number(ride_bearing)} + {side} * element_at(array(45e0, -45e0, -135e0, 135e0), quadrant + 1))"
    norm = "CASE WHEN high > low THEN (reward - low) / (high - low) ELSE 0e0 END"
    score = f"along / {geo.number(reach_m)} + 5e-1 * {aligned(geo.bearing(geo.number(lat0), geo.number(lon0), 'lat', 'lon'), tangent)} + 1e-1 * {norm}"
    return df.crossJoin(F.broadcast(bounds)).withColumn("score", F.expr(score)).drop("low", "high")


def fills_between(corridors: DataFrame, before: tuple[float, float], after: tuple[float, float], cone: float = 0.0) -> DataFrame:
    """Corridors whose centroid projects between two places (t from 0 to 1) and that do not run against the way from one to the other.

    ``cone`` is the least cosine of heading and way; a corridor with an unknown end passes it. Nothing lies between equal places.
    """
    east, north = to_local("lat", "lon", *before)
    ex, ny = (after[1] - before[1]) * 111320.0 * math.cos(math.radians(before[0])), (after[0] - before[0]) * 111320.0
    size = ex * ex + ny * ny
    way = geo.bearing(*(geo.number(x) for x in (*before, *after)))
    fits = f"coalesce({aligned(geo.bearing('elat', 'elon', 'xlat', 'xlon'), way)} >= {geo.number(cone)}, true)"
    t = f"({east} * {geo.number(ex)} + {north} * {geo.number(ny)}) / {geo.number(size)}" if size else "cast(null as double)"
    return corridors.withColumn("t", F.expr(t)).where("t between 0e0 and 1e0").where(F.expr(fits))


def _judged(candidates: DataFrame, target_m: float, band: float, least_compactness: float, most_repeat: float) -> DataFrame:
    df = candidates.withColumn("in_band", F.col("distance_m").between(target_m * (1 - band), target_m * (1 + band)))
    return df.withColumn("in_shape", (F.col("compactness") >= least_compactness) & (F.col("repeat_fraction") <= most_repeat))


def ranked_candidates(candidates: DataFrame, target_m: float, band: float, least_compactness: float = 0.26, most_repeat: float = 0.15) -> DataFrame:
    """Loops (id, distance_m, reward, compactness, repeat_fraction): those in the distance band first, then good shapes, then reward."""
    return _judged(candidates, target_m, band, least_compactness, most_repeat).orderBy(F.desc("in_band"), F.desc("in_shape"), F.desc("reward"), "id")


def winner(candidates: DataFrame, target_m: float, band: float, least_compactness: float = 0.26, most_repeat: float = 0.15) -> DataFrame:
    """The loop in the band of good shape and highest reward; if none is of good shape, the one of best shape; no row if none is in the band."""
    df = _judged(candidates, target_m, band, least_compactness, most_repeat).where("in_band")
    key = F.when(F.col("in_shape"), F.col("reward")).otherwise(F.round(F.col("compactness") - F.col("repeat_fraction"), 9))
    return df.orderBy(F.desc("in_shape"), key.desc(), "id").limit(1)


def deviations(candidates: DataFrame, requested_m: float) -> DataFrame:
    """Candidates with their distance's deviation in percent of the request; 0 for a request of nothing."""
    return candidates.withColumn("percent", (F.col("distance_m") - requested_m) / requested_m * 100.0 if requested_m > 0 else F.lit(0.0))


def length_share(value: str, length: str) -> Column:
    """Percent of length where ``value`` holds."""
    return F.expr(f"least(100e0, greatest(0e0, coalesce(sum(CASE WHEN {value} THEN {length} ELSE 0e0 END) / sum({length}) * 100e0, 0e0)))")


def discovery_scores(path: DataFrame, surrogates: DataFrame) -> DataFrame:
    """(route, score): whole percent of each route's length on roads neither ridden nor near a ridden one (``surrogates``: from_node, to_node)."""
    known = surrogates.select("from_node", "to_node").distinct().withColumn("near", F.lit(True))
    df = path.join(known, ["from_node", "to_node"], "left")
    new = "NOT is_traversed AND near IS NULL"
    score = geo.half_up(f"least(1e2, greatest(0e0, sum(CASE WHEN {new} THEN length_m ELSE 0e0 END) * 1e2 / sum(length_m)))")
    return df.groupBy("route").agg(F.expr(f"CASE WHEN sum(length_m) > 0 THEN {score} END").alias("score")).where("score is not null")


def speed_power_estimates(path: DataFrame, totals: DataFrame, surrogates: DataFrame) -> DataFrame:
    """(route, speed_kmh, power_w, coverage, total_coverage, outcome) of matched roads, in whole numbers.

    Ridden roads with speed and power count by length; others borrow those of their surrogate (from_node, to_node,
    speed, power). Coverage is the share of the whole route's length (``totals``: route, total_m), directly and with
    surrogates; without any of it the outcome is NoRideHistory.
    """
    own = F.expr("is_traversed and speed_mean is not null and power_mean is not null")
    df = path.join(surrogates.select("from_node", "to_node", "speed", "power"), ["from_node", "to_node"], "left")
    df = df.withColumn("own", own).withColumn("lent", ~F.col("own") & F.col("speed").isNotNull())
    df = df.withColumn("v", F.expr("CASE WHEN own THEN speed_mean WHEN lent THEN speed END")).withColumn("p", F.expr("CASE WHEN own THEN power_mean WHEN lent THEN power END"))
    per = df.groupBy("route").agg(F.sum("length_m").alias("all_m"), F.expr("coalesce(sum(CASE WHEN own THEN length_m END), 0e0)").alias("own_m"), F.expr("coalesce(sum(CASE WHEN own OR lent THEN length_m END), 0e0)").alias("known_m"), F.expr("sum(v * length_m)").alias("vs"), F.expr("sum(p * length_m)").alias("ps"))
    per = per.where("all_m > 0").join(totals, "route")

    def share(x: str) -> str:
        return f"CASE WHEN total_m > 0 THEN {geo.half_up(f'least(1e2, greatest(0e0, {x} * 1e2 / total_m))')} ELSE 0 END"

    out = per.selectExpr("route", f"CASE WHEN known_m > 0 THEN {geo.half_up('vs / known_m')} ELSE 0 END AS speed_kmh", f"CASE WHEN known_m > 0 THEN {geo.half_up('ps / known_m')} ELSE 0 END AS power_w", f"{share('own_m')} AS coverage", f"{share('known_m')} AS total_coverage")
    return out.selectExpr("*", "CASE WHEN coverage <= 0 AND total_coverage <= 0 THEN 'NoRideHistory' ELSE 'Estimate' END AS outcome")


def ride_estimates(path: DataFrame) -> DataFrame:
    """(route, kind, sec, power_w): slow, average and fast rides, by the quartiles of each road's speed and power.

    The speed is the length-weighted mean of roads that have one, ridden over the whole length; power is weighted by
    time. Kinds without any speed are left out.
    """
    kinds = "stack(3, 'slow', speed_p25, power_p25, 'average', speed_p50, power_p50, 'fast', speed_p75, power_p75) as (kind, v, p)"
    df = path.selectExpr("route", "length_m", kinds).withColumn("t", F.expr("CASE WHEN v > 0 AND p IS NOT NULL THEN length_m / 1e3 / v * 36e2 END"))
    per = df.groupBy("route", "kind").agg(F.sum("length_m").alias("all_m"), F.expr("sum(v * length_m) / sum(CASE WHEN v IS NOT NULL THEN length_m END)").alias("v"), F.expr("sum(p * t)").alias("work"), F.sum("t").alias("t"))
    return per.where("v is not null").selectExpr("route", "kind", "round(CASE WHEN v > 0 THEN all_m / 1e3 / v * 36e2 ELSE 0e0 END, 4) AS sec", "round(CASE WHEN t > 0 THEN work / t ELSE 0e0 END, 4) AS power_w")


def percentile_coverage(path: DataFrame) -> DataFrame:
    """(route, percent) of length on roads with all three quartiles of speed."""
    return path.groupBy("route").agg(F.round(length_share("speed_p25 IS NOT NULL AND speed_p50 IS NOT NULL AND speed_p75 IS NOT NULL", "length_m"), 6).alias("percent"))


def new_road_shares(path: DataFrame) -> DataFrame:
    """(route, percent): the share of a plan's length on roads not yet ridden."""
    return path.groupBy("route").agg(F.round(F.expr("CASE WHEN sum(length_m) > 0 THEN sum(CASE WHEN NOT is_traversed THEN length_m ELSE 0e0 END) / sum(length_m) * 1e2 ELSE 0e0 END"), 6).alias("percent"))


def max_reachable(corridors: DataFrame, connectors: DataFrame) -> DataFrame:
    """One row: the length of all corridors with a mean connector each; null if there are no corridors or no connectors."""
    a = corridors.agg(F.sum("length_m").alias("m"), F.count(F.lit(1)).alias("n"))
    return a.crossJoin(connectors.agg(F.avg("distance_m").alias("d"))).selectExpr("round(m + d * n, 4) AS max_m")


def shape_report(path: DataFrame, nodes: DataFrame, stem_m: float = 8000.0) -> DataFrame:
    """(route, length_m, repeated_m, repeat_fraction, raw_repeat_fraction, compactness, repeated_roads) of edge paths (route, seq, from_node, to_node, length_m).

    A road, either way, repeats by the length of all its passages but the first. It is exempt only if all of them lie
    within the first or last ``stem_m`` metres. Compactness is 4 pi area over length squared, the area by the shoelace
    formula in local metres around the first node, through the last edge's end.
    """
    w = Window.partitionBy("route").orderBy("seq")
    whole = Window.partitionBy("route")
    df = path.withColumn("a", F.least("from_node", "to_node")).withColumn("b", F.greatest("from_node", "to_node"))
    df = df.withColumn("done", F.sum("length_m").over(w)).withColumn("total", F.sum("length_m").over(whole))
    df = df.withColumn("stem", (F.col("done") <= stem_m) | (F.col("done") - F.col("length_m") >= F.col("total") - stem_m))
    per = df.groupBy("route", "a", "b").agg((F.sum("length_m") - F.min_by("length_m", "seq")).alias("extra"), F.min("stem").alias("exempt"), F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    counts = per.groupBy("route").agg(F.first("total").alias("length_m"), F.sum(F.expr("CASE WHEN n > 1 AND NOT exempt THEN extra ELSE 0e0 END")).alias("repeated_m"), F.sum(F.expr("CASE WHEN n > 1 THEN extra ELSE 0e0 END")).alias("raw_m"), F.count_if(F.expr("n > 1 AND NOT exempt")).alias("repeated_roads"))
    end = path.groupBy("route").agg((F.max("seq") + 1).alias("seq"), F.max_by("to_node", "seq").alias("node"))
    line = path.select("route", "seq", F.col("from_node").alias("node")).unionByName(end.select("route", "seq", "node")).join(nodes.selectExpr("id as node", "lat", "lon"), "node")
    line = line.withColumn("lat0", F.first("lat").over(w)).withColumn("lon0", F.first("lon").over(w))
    line = line.withColumn("x", F.expr(f"(lon - lon0) * {geo.metres_per_degree_lon('lat0')}")).withColumn("y", F.expr("(lat - lat0) * 111320e0"))
    line = line.withColumn("cross", F.col("x") * F.coalesce(F.lead("y").over(w), F.lit(0.0)) - F.coalesce(F.lead("x").over(w), F.lit(0.0)) * F.col("y"))
    area = line.groupBy("route").agg(F.abs(F.sum("cross")).alias("twice"), F.count(F.lit(1)).alias("points"))
    out = counts.join(area, "route", "left")
    some = "length_m > 0"
    return out.selectExpr("route", "round(length_m, 6) AS length_m", "round(repeated_m, 6) AS repeated_m", f"round(CASE WHEN {some} THEN repeated_m / length_m ELSE 0e0 END, 6) AS repeat_fraction", f"round(CASE WHEN {some} THEN raw_m / length_m ELSE 0e0 END, 6) AS raw_repeat_fraction",
                          f"round(CASE WHEN {some} AND points >= 3 THEN 2e0 * pi() * twice / (length_m * length_m) ELSE 0e0 END, 6) AS compactness", "repeated_roads")
