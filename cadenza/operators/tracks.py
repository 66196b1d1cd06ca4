"""Tracks: resampling, headings, chunks, coverage, clusters, and points of interest along them."""

from __future__ import annotations

import math
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import geo
from cadenza.operators import likeness
from cadenza.operators.components import connected_components
from cadenza.operators.folds import folded
from cadenza.plans.lineage import discard, store


def along(points: DataFrame, key: str = "session_id") -> DataFrame:
    """Points with running distance s in metres and the point before (a, b, s0)."""
    w = Window.partitionBy(key).orderBy("idx")
    df = points.withColumn("a", F.lag("lat").over(w)).withColumn("b", F.lag("lon").over(w))
    df = df.withColumn("s", F.sum(F.coalesce(F.expr(geo.haversine("a", "b", "lat", "lon")), F.lit(0.0))).over(w))
    return df.withColumn("s0", F.lag("s").over(w))


def resample(points: DataFrame, step_m: float) -> DataFrame:
    """Equally spaced points: max(2, length / step) of them, each on the segment that holds its distance."""
    df = along(points).select("session_id", "idx", "lat", "lon", "a", "b", "s", "s0")
    total = df.groupBy("session_id").agg(F.max("s").alias("total")).withColumn("n", F.greatest(F.lit(2), F.floor(F.col("total") / step_m).cast("int")))
    seg = df.join(total, "session_id").where("s0 is not null and s > s0").withColumn("gap", F.expr("total / (n - 1)"))
    k = F.expr("sequence(cast(ceil(s0 / gap - 1e-9) as int), least(cast(floor(s / gap - 1e-9) as int), n - 1))")
    last = F.expr("cast(floor(s / gap - 1e-9) as int) >= cast(ceil(s0 / gap - 1e-9) as int)")
    out = seg.where(last).withColumn("k", F.explode(k)).withColumn("f", F.expr("(k * gap - s0) / (s - s0)"))
    inner = out.where("k < n - 1").select("session_id", "k", F.round(F.expr("a + (lat - a) * f"), 6).alias("lat"), F.round(F.expr("b + (lon - b) * f"), 6).alias("lon"))
    end = seg.groupBy("session_id", "n").agg(F.max(F.struct("idx", "lat", "lon")).alias("e")).select("session_id", (F.col("n") - 1).alias("k"), F.round("e.lat", 6).alias("lat"), F.round("e.lon", 6).alias("lon"))
    return inner.unionByName(end)


def headings(points: DataFrame, span: int = 2) -> DataFrame:
    """Bearing from ``span`` points before to ``span`` after, cut at the ends; null if both are one place."""
    w = Window.partitionBy("session_id").orderBy("idx").rowsBetween(-span, span)
    df = points.select("session_id", "idx", *[f(c).over(w).alias(n) for f, c, n in ((F.first, "lat", "a"), (F.first, "lon", "b"), (F.last, "lat", "c"), (F.last, "lon", "d"))])
    return df.select("session_id", "idx", F.round(F.expr(f"CASE WHEN a <> c OR b <> d THEN {geo.bearing('a', 'b', 'c', 'd')} END"), 5).alias("heading"))


def runs(points: DataFrame, value: str, least: int = 2) -> DataFrame:
    """Runs of equal values, nulls left out, of at least ``least`` rows; equal neighbours among those that remain are one."""
    w = Window.partitionBy("session_id").orderBy("idx")
    df = points.where(F.col(value).isNotNull()).withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("run", F.sum("new").over(w)).groupBy("session_id", "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("n"), F.min("idx").alias("start_idx")).where(F.col("n") >= least)
    v = Window.partitionBy("session_id").orderBy("start_idx")
    return df.withColumn("was", F.lag("value").over(v)).where("was is null or was <> value").select("session_id", "start_idx", "value", "n")


def chunks(points: DataFrame, metres: float) -> DataFrame:
    """(session_id, idx, chunk): splits tracks where the distance since the last split reaches ``metres``.

    The point of a split ends one chunk and begins the next: it has two rows. An accumulator with resets, folded in a
    stream.
    """
    def step(state, row):
        _, s = row
        at, k = state or (0.0, 0)
        return ((s, k + 1), k) if s - at >= metres else ((at, k), k)

    ends = folded(along(points).select("session_id", "idx", "s"), "session_id", "idx", step, "chunk int")
    after = F.lead("chunk").over(Window.partitionBy("session_id").orderBy("idx"))
    both = F.when(after > F.col("chunk"), F.array("chunk", after)).otherwise(F.array("chunk"))
    return ends.withColumn("both", both).select("session_id", "idx", F.explode("both").alias("chunk"))


def _cells(df: DataFrame, size_m: float, top_lat: float) -> DataFrame:
    """Grid cells at least ``size_m`` on a side up to ``top_lat`` degrees."""
    lon = f"{geo.number(size_m)} / {geo.metres_per_degree_lon(geo.number(top_lat))}"
    return df.withColumn("cy", F.expr(f"cast(floor(lat / ({geo.number(size_m)} / 111000e0)) as bigint)")).withColumn("cx", F.expr(f"cast(floor(lon / ({lon} * 1.01e0)) as bigint)"))


def _reached(df: DataFrame, radius_m: float, size_m: float, top_lat: float) -> DataFrame:
    """Each row once for each of the cells of ``_cells`` that its radius reaches."""
    lat, lon = f"({geo.number(size_m)} / 111000e0)", f"({geo.number(size_m)} / {geo.metres_per_degree_lon(geo.number(top_lat))} * 1.01e0)"
    up, wide = geo.number(radius_m / 111000.0), f"({geo.number(radius_m * 1.01)} / {geo.metres_per_degree_lon('lat')})"
    rows = f"sequence(cast(floor((lat - {up}) / {lat}) as bigint), cast(floor((lat + {up}) / {lat}) as bigint))"
    columns = f"sequence(cast(floor((lon - {wide}) / {lon}) as bigint), cast(floor((lon + {wide}) / {lon}) as bigint))"
    return df.withColumn("cy", F.explode(F.expr(rows))).withColumn("cx", F.explode(F.expr(columns)))


def _around(df: DataFrame) -> DataFrame:
    """Each row once for its own and each neighbouring cell."""
    return df.withColumn("_c", F.explode(F.expr("transform(sequence(0, 8), i -> struct(cy + i div 3 - 1 as cy, cx + i % 3 - 1 as cx))"))).withColumn("cy", F.col("_c.cy")).withColumn("cx", F.col("_c.cx")).drop("_c")


def coverage(samples: DataFrame, points: DataFrame, pairs: DataFrame, radius_m: float, key: str = "session_id", top_lat: float = 80.0) -> DataFrame:
    """(a, b, share): for each of ``pairs`` (a, b), the share of a's samples (key, k, lat, lon) with a point of b (key, lat, lon) within the radius.

    Samples go to the tracks they are compared with and to their own and neighbouring cells; points are joined by track
    and cell, so a place that many tracks pass is no hot key. Pairs without any such sample have no row.
    """
    wanted = pairs.select("a", "b").where("a <> b").distinct()
    cell_m = 8 * radius_m  # few samples are near a second cell
    left = _reached(samples.select(F.col(key).alias("a"), "k", "lat", "lon"), radius_m, cell_m, top_lat).join(wanted, "a").selectExpr("a", "b", "k", "lat as la", "lon as lo", "cy", "cx")
    right = _cells(points.select(F.col(key).alias("other"), "lat", "lon"), cell_m, top_lat).withColumnsRenamed({"cy": "ry", "cx": "rx"})
    # A sample needs one point that is near: a semi-join stops there, and does not list the others.
    close = F.expr(f"b = other AND cy = ry AND cx = rx AND {geo.haversine('la', 'lo', 'lat', 'lon')} <= {geo.number(radius_m)}")
    hits = left.join(right, close, "left_semi").select("a", "b", "k").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"))
    n = samples.groupBy(F.col(key).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(n, "a").select("a", "b", F.round(F.col("hits") / F.col("n"), 6).alias("share"))


def candidate_pairs(tracks: DataFrame, apart_m: float = 3000.0, max_gap_m: float = 7000.0, max_ratio: float = 0.15, top_lat: float = 80.0) -> DataFrame:
    """(a, b), a < b: tracks (session_id, lat, lon of the centroid, length_m) close in place and alike in length, by neighbouring cells."""
    t = _cells(tracks.select("session_id", "lat", "lon", "length_m"), apart_m, top_lat)
    left = _around(t).selectExpr("session_id as a", "lat as la", "lon as lo", "length_m as ma", "cy", "cx")
    right = t.selectExpr("session_id as b", "lat", "lon", "length_m as mb", "cy", "cx")
    alike = F.abs(F.col("ma") - F.col("mb")) <= F.least(F.lit(max_gap_m), F.lit(max_ratio) * F.least("ma", "mb"))
    return left.join(right, ["cy", "cx"]).where("a < b").where(alike).where(F.expr(f"{geo.haversine('la', 'lo', 'lat', 'lon')} < {geo.number(apart_m)}")).select("a", "b")


def track_summaries(points: DataFrame, least_points: int = 4, least_m: float = 100.0) -> DataFrame:
    """(session_id, lat, lon, length_m): centroid and length of tracks that are long enough to compare."""
    per = along(points).groupBy("session_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max("s").alias("length_m"), F.count(F.lit(1)).alias("n"))
    return per.where((F.col("n") >= least_points) & (F.col("length_m") >= least_m)).drop("n")


def route_pairs(points: DataFrame, step_m: float = 50.0, radius_m: float = 25.0, least: float = 0.85, apart_m: float = 3000.0) -> DataFrame:
    """(a, b, share), a < b: rides on the same route: close in place and length, and one's samples covered by the other's points."""
    found = likeness.mutual_coverage(track_summaries(points), resample(points, step_m), points, radius_m, apart_m)
    return found.select("a", "b", F.greatest(F.round(F.expr("hits_a / n_a"), 6), F.round(F.expr("hits_b / n_b"), 6)).alias("share")).where(F.col("share") >= least)


def route_links(points: DataFrame, step_m: float = 50.0, radius_m: float = 25.0, least: float = 0.85, apart_m: float = 3000.0) -> DataFrame:
    """(a, b): enough of ``route_pairs`` to join the same rides into groups."""
    return likeness.mutual_coverage(track_summaries(points), resample(points, step_m), points, radius_m, apart_m, least=least).select("a", "b")


def route_coverage(points: DataFrame, step_m: float = 50.0, radius_m: float = 25.0, apart_m: float = 3000.0) -> DataFrame:
    """(a, b, share): the share of a's samples near b, for rides close in place and length; pairs without any have no row."""
    found = likeness.mutual_coverage(track_summaries(points), resample(points, step_m), points, radius_m, apart_m)
    both = found.selectExpr("inline(array(struct(a, b, hits_a as h, n_a as n), struct(b as a, a as b, hits_b as h, n_b as n)))")
    return both.where("h > 0").select("a", "b", F.round(F.expr("h / n"), 6).alias("share"))


def interval_tracks_summary(points: DataFrame) -> DataFrame:
    """(interval_id, distance_m, n) of interval points (interval_id, idx, lat, lon); single points are no track."""
    w = Window.partitionBy("interval_id").orderBy("idx")
    df = points.withColumn("a", F.lag("lat").over(w)).withColumn("b", F.lag("lon").over(w))
    per = df.groupBy("interval_id").agg(F.sum(F.coalesce(F.expr(geo.haversine("a", "b", "lat", "lon")), F.lit(0.0))).alias("distance_m"), F.count(F.lit(1)).alias("n"))
    return per.where("n >= 2")


def interval_matches(left: DataFrame, right: DataFrame, radius_m: float = 20.0, tolerance_m: float = 100.0, least: float = 0.8, top_lat: float = 80.0) -> DataFrame:
    """(a, b): tracks of ``left`` and ``right`` (interval_id, idx, lat, lon) alike in length of which one covers the other by points.

    Points meet by cell and by bins of their tracks' lengths, so only tracks of like lengths meet anywhere.
    """
    cell_m = 8 * radius_m

    def placed(points: DataFrame, name: str, reach: bool) -> DataFrame:
        sized = points.join(interval_tracks_summary(points), "interval_id").withColumn("bin", F.floor(F.col("distance_m") / tolerance_m).cast("long"))
        cells = _reached(sized, radius_m, cell_m, top_lat) if reach else _cells(sized, cell_m, top_lat)
        return cells.selectExpr(f"interval_id as {name}", f"idx as {name}_idx", f"lat as {name}_lat", f"lon as {name}_lon", f"distance_m as {name}_m", f"n as {name}_n", "bin", "cy", "cx")

    a = placed(left, "a", True).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    b = placed(right, "b", False)
    near = a.join(b, ["cy", "cx", "bin"]).where("a <> b").where(F.abs(F.col("a_m") - F.col("b_m")) <= tolerance_m).where(F.expr(f"{geo.haversine('a_lat', 'a_lon', 'b_lat', 'b_lon')} <= {geo.number(radius_m)}"))
    hit_a = near.select("a", "b", "a_idx", "a_n").distinct().groupBy("a", "b").agg((F.count(F.lit(1)) / F.first("a_n")).alias("share_a"))
    hit_b = near.select("a", "b", "b_idx", "b_n").distinct().groupBy("a", "b").agg((F.count(F.lit(1)) / F.first("b_n")).alias("share_b"))
    return hit_a.join(hit_b, ["a", "b"]).where(F.greatest("share_a", "share_b") >= least).select("a", "b")


def interval_pairs(points: DataFrame, radius_m: float = 20.0, tolerance_m: float = 100.0, least: float = 0.8) -> DataFrame:
    """(a, b), a < b: pairs of intervals on the same stretch of road."""
    found = likeness.interval_hits(points, interval_tracks_summary(points), radius_m, tolerance_m)
    return found.where(F.expr("greatest(hits_a / n_a, hits_b / n_b)") >= least).select("a", "b")


def interval_links(points: DataFrame, radius_m: float = 20.0, tolerance_m: float = 100.0, least: float = 0.8) -> DataFrame:
    """(a, b): enough of ``interval_pairs`` to join the same intervals into groups."""
    return likeness.interval_hits(points, interval_tracks_summary(points), radius_m, tolerance_m, least).select("a", "b")


def interval_clusters(points: DataFrame, pairs: DataFrame, cell_m: float = 5000.0) -> DataFrame:
    """(root, member, representative, south, west, north, east, cell_row, cell_col): groups of intervals on the same stretch, single ones included.

    The representative is the middle member by length (place n div 2). The box holds all members' tracks; its middle
    lies in a cell of ``cell_m`` at the mean of the tracks' southern ends, by which groups share a part of the road graph.
    """
    sized = interval_tracks_summary(points).select("interval_id", "distance_m")
    found = connected_components(pairs.select("a", "b")).select(F.col("node").alias("interval_id"), "root")
    named = store(sized.join(found, "interval_id", "left").withColumn("root", F.coalesce("root", "interval_id")))
    w = Window.partitionBy("root")
    middle = named.withColumn("r", F.row_number().over(w.orderBy("distance_m", "interval_id"))).withColumn("n", F.count(F.lit(1)).over(w)).where("r = n div 2 + 1").select("root", F.col("interval_id").alias("representative"))
    box = points.join(named, "interval_id").groupBy("root").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    ref = points.join(sized, "interval_id").groupBy("interval_id").agg(F.min("lat").alias("s")).agg(F.avg("s").alias("ref"))
    size = geo.number(cell_m)
    box = box.crossJoin(F.broadcast(ref)).withColumn("cell_row", F.expr(f"cast(floor((south + north) / 2e0 / ({size} / 111320e0)) as bigint)")).withColumn("cell_col", F.expr(f"cast(floor((west + east) / 2e0 / ({size} / (111320e0 * cos(radians(ref))))) as bigint)"))
    return named.join(middle, "root").join(box, "root").select("root", F.col("interval_id").alias("member"), "representative", "south", "west", "north", "east", "cell_row", "cell_col")


def assigned_intervals(intervals: DataFrame, archetypes: DataFrame, **limits) -> DataFrame:
    """(interval_id, archetype_id): the longest archetype on the same stretch, ties to the smallest id; null without one."""
    long = interval_tracks_summary(archetypes).selectExpr("interval_id as b", "distance_m")
    best = interval_matches(intervals, archetypes, **limits).join(long, "b").groupBy("a").agg(F.max(F.struct("distance_m", (-F.col("b")).alias("k"))).alias("m"))
    return intervals.select("interval_id").distinct().join(best.selectExpr("a as interval_id", "-m.k as archetype_id"), "interval_id", "left")


def without_subsets(edges: DataFrame, least: float = 0.8) -> DataFrame:
    """Ids of archetypes (archetype_id, from_node, to_node, length_m) that are not mostly part of a longer one that stays.

    Longest first, ties to smaller ids. An archetype goes if a kept longer one shares at least ``least`` of its length.
    Decided in rounds: what no undecided or kept one covers stays, and what a kept one covers goes.
    """
    sizes = edges.groupBy("archetype_id").agg(F.sum("length_m").alias("m")).where("m > 0")
    mine = edges.join(sizes, "archetype_id").selectExpr("archetype_id as a", "m as am", "from_node", "to_node", "length_m")
    other = edges.select("archetype_id", "from_node", "to_node").distinct().join(sizes, "archetype_id").selectExpr("archetype_id as b", "m as bm", "from_node", "to_node")
    longer = (F.col("bm") > F.col("am")) | ((F.col("bm") == F.col("am")) & (F.col("b") < F.col("a")))
    covers = store(mine.join(other, ["from_node", "to_node"]).where(longer).groupBy("a", "b").agg((F.sum("length_m") / F.first("am")).alias("share")).where(F.col("share") >= least).select("a", "b"))
    open_ = store(sizes.select(F.col("archetype_id").alias("a")))
    kept, first = None, True
    while first or not open_.isEmpty():
        first = False
        live = covers.join(open_.withColumnRenamed("a", "b"), "b", "left_semi")
        stay = store(open_.join(live, "a", "left_anti"))
        gone = covers.join(stay.withColumnRenamed("a", "b"), "b", "left_semi").select("a").distinct()
        kept = stay if kept is None else kept.unionByName(stay)
        left = store(open_.join(stay, "a", "left_anti").join(gone, "a", "left_anti"))
        discard(open_)
        open_ = left
    return kept.select(F.col("a").alias("archetype_id"))


def clusters(pairs: DataFrame, least: int) -> DataFrame:
    """(root, member) of the connected groups of at least ``least`` tracks."""
    found = connected_components(pairs.select("a", "b"))
    big = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("root")
    return found.join(big, "root").select("root", F.col("node").alias("member"))


def nearest_segment(points: DataFrame, segments: DataFrame, cell_m: float) -> DataFrame:
    """(id, seg, distance_m): each point's nearest segment (seg, ax, ay, bx, by in lon/lat), ties to the smallest seg.

    A segment lies in all cells that its box meets; a point looks into its own and the neighbouring cells, which hold
    all segments up to one cell away. What is found there counts only if it is that near; the other points look again
    with cells eight times as large, until one cell holds the globe.
    """
    rest, found = points.select("id", "lat", "lon"), []
    while True:
        last = cell_m >= 2e7
        step = 360.0 if last else cell_m / 111000.0
        best = store(_nearest_in_cells(rest, segments, step))
        # A degree of longitude shrinks with the latitude, and so does what the neighbouring cells are sure to hold.
        sure = F.lit(True) if last else F.expr(f"d <= least({geo.number(cell_m)}, {geo.number(step * 0.99)} * 111320e0 * cos(radians(lat)))")
        near = best.where(sure)
        found.append(near.select("id", "seg", F.round("d", 4).alias("distance_m")))
        rest = store(rest.join(near.select("id"), "id", "left_anti"))
        if last or rest.isEmpty():
            break
        cell_m *= 8
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _nearest_in_cells(points: DataFrame, segments: DataFrame, step: float) -> DataFrame:
    """(id, lat, d, seg): the nearest segment in the cells, ``step`` degrees on a side, around each point."""
    cell = lambda x: f"cast(floor(({x}) / {geo.number(step)}) as bigint)"
    seg = segments.withColumn("cy", F.explode(F.expr(f"sequence({cell('least(ay, by)')}, {cell('greatest(ay, by)')})"))).withColumn("cx", F.explode(F.expr(f"sequence({cell('least(ax, bx)')}, {cell('greatest(ax, bx)')})")))
    near = _around(points.withColumn("cy", F.expr(cell("lat"))).withColumn("cx", F.expr(cell("lon")))).join(seg, ["cy", "cx"])
    k = "cos(radians(lat)) * 111320e0"
    ax, ay, bx, by = f"(ax - lon) * {k}", "(ay - lat) * 111320e0", f"(bx - lon) * {k}", "(by - lat) * 111320e0"
    d = geo.point_to_segment("0e0", "0e0", f"({ax})", f"({ay})", f"({bx})", f"({by})")
    return near.withColumn("d", F.expr(d)).groupBy("id", "lat").agg(F.min(F.struct(F.round("d", 6).alias("d"), "seg")).alias("m")).select("id", "lat", "m.d", "m.seg")


def smoothed_profile(points: DataFrame) -> DataFrame:
    """Altitude along the track, smoothed over five points, shorter at the ends; points without altitude are left out."""
    w = Window.partitionBy("session_id").orderBy("idx")
    df = along(points).where("altitude is not null").withColumn("z", F.avg("altitude").over(w.rowsBetween(-2, 2)))
    return df.select("session_id", "idx", F.round("s", 4).alias("at_m"), F.round("z", 6).alias("altitude"))


def gain_loss(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("idx")
    df = points.where("altitude is not null").withColumn("z", F.avg("altitude").over(w.rowsBetween(-2, 2))).withColumn("d", F.col("z") - F.lag("z").over(w))
    return df.groupBy("session_id").agg(F.round(F.sum(F.greatest("d", F.lit(0.0))), 6).alias("gain_m"), F.round(F.sum(F.greatest(-F.col("d"), F.lit(0.0))), 6).alias("loss_m"))


def density(rows: DataFrame, at: str, total_m: float, bucket_m: float) -> DataFrame:
    """Counts of places by distance bucket, clamped to the track, zero-filled."""
    n = max(1, int(-(-total_m // bucket_m)))
    counts = rows.withColumn("bucket", F.expr(f"cast(least({n - 1}, greatest(0, floor({at} / {geo.number(bucket_m)}))) as bigint)")).groupBy("bucket").agg(F.count(F.lit(1)).alias("cnt"))
    return rows.sparkSession.range(n).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("session_id").agg(*[F.round(f(c), 6).alias(n) for f, c, n in ((F.avg, "lat", "lat"), (F.avg, "lon", "lon"), (F.min, "lat", "south"), (F.max, "lat", "north"), (F.min, "lon", "west"), (F.max, "lon", "east"))])


def decode_polyline(text: str) -> list[tuple[float, float]]:
    """Points of an encoded polyline with five decimals: zigzag numbers of five-bit groups, low groups first."""
    numbers, value, shift = [], 0, 0
    for c in text:
        group = ord(c) - 63
        value |= (group & 31) << shift
        shift += 5
        if group < 32:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return [(a / 1e5, b / 1e5) for a, b in zip(accumulate(numbers[0::2]), accumulate(numbers[1::2]))]


def encode_polyline(points: list[tuple[float, float]]) -> str:
    out, was = [], (0, 0)
    for p in points:
        now = tuple(math.floor(x * 1e5 + 0.5) for x in p)
        for a, b in zip(was, now):
            n = (b - a) << 1 if b >= a else ~((b - a) << 1)
            while n >= 32:
                out.append(chr((n & 31 | 32) + 63))
                n >>= 5
            out.append(chr(n + 63))
        was = now
    return "".join(out)


def decode_polylines(lines: DataFrame) -> DataFrame:
    """(id, seq, lat, lon) of (id, encoded) rows; null or empty texts have no points."""

    def run(batches):
        for batch in batches:
            ids, seq, lat, lon = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = decode_polyline(t or "")
                ids += [i] * len(points)
                seq += range(len(points))
                lat += [p[0] for p in points]
                lon += [p[1] for p in points]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(lat, pa.float64()), pa.array(lon, pa.float64())], names=["id", "seq", "lat", "lon"])

    return lines.selectExpr("cast(id as bigint) id", "encoded").mapInArrow(run, "id bigint, seq int, lat double, lon double")


def encode_polylines(points: DataFrame) -> DataFrame:
    """(id, encoded) of the points (id, seq, lat, lon); one row holds one line."""
    rows = points.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).selectExpr("cast(id as bigint) id", "transform(p, x -> x.lat) as lat", "transform(p, x -> x.lon) as lon")

    def run(batches):
        for batch in batches:
            texts = [encode_polyline(list(zip(a, b))) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "encoded"])

    return rows.mapInArrow(run, "id bigint, encoded string")


def parse_tracks(rows: DataFrame, text: str = "track") -> DataFrame:
    """(id, seq, lat, lon) of JSON tracks [[lat, lon], ...]; pairs that are too short are skipped, and text that is no such JSON has no points."""
    parsed = rows.select("id", F.filter(F.from_json(text, "array<array<double>>"), lambda p: F.size(p) >= 2).alias("p"))
    return parsed.select("id", F.posexplode("p").alias("seq", "p")).select("id", "seq", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))


def tracks_as_json(points: DataFrame) -> DataFrame:
    """(id, track): the points (id, seq, lat, lon) as JSON."""
    rows = points.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    return rows.select("id", F.to_json(F.transform("p", lambda x: F.array(x["lat"], x["lon"]))).alias("track"))


def surrogates(unknown: DataFrame, known: DataFrame, radius_m: float, angle: float) -> DataFrame:
    """(edge, surrogate, distance_m): for roads (edge, lat, lon of the middle, bearing) the nearest known road within the radius that runs alike.

    Known roads are ridden and have speed and power, which the caller sees to; they (edge, alat, alon, blat, blon, bearing) lie in all cells that their box, widened by the radius, meets.
    Cells lie in bands of latitude and are as wide as a band's least circle asks for, so no latitude is too high for them.
    """
    size = max(radius_m, 2000.0)
    lat_size, pad_lat = size / 111000.0, radius_m / 111000.0
    low, high = f"cos(radians(cy * {geo.number(lat_size)}))", f"cos(radians((cy + 1) * {geo.number(lat_size)}))"
    # A band that holds a pole is one cell: the cosines of its ends differ in sign.
    narrow = f"(CASE WHEN {low} * {high} <= 0e0 THEN 1e-9 ELSE greatest(1e-9, least(abs({low}), abs({high}))) END)"
    per_lon = lambda m: f"({geo.number(m / 111000.0)} / {narrow})"

    roads = known.select(F.col("edge").alias("surrogate"), "alat", "alon", "blat", "blon", F.col("bearing").alias("other"))
    band = lambda x: f"cast(floor(({x}) / {geo.number(lat_size)}) as bigint)"
    roads = roads.withColumn("cy", F.explode(F.expr(f"sequence({band(f'least(alat, blat) - {geo.number(pad_lat)}')}, {band(f'greatest(alat, blat) + {geo.number(pad_lat)}')})")))
    column = lambda x: f"cast(floor(({x}) / {per_lon(size)}) as bigint)"
    roads = roads.withColumn("cx", F.explode(F.expr(f"sequence({column(f'least(alon, blon) - {per_lon(radius_m)}')}, {column(f'greatest(alon, blon) + {per_lon(radius_m)}')})")))
    asked = unknown.withColumn("cy", F.expr(band("lat"))).withColumn("cx", F.expr(column("lon")))
    k = "cos(radians(lat)) * 111320e0"
    d = geo.point_to_segment("0e0", "0e0", f"((alon - lon) * {k})", "((alat - lat) * 111320e0)", f"((blon - lon) * {k})", "((blat - lat) * 111320e0)")
    pairs = asked.join(roads, ["cy", "cx"]).where("edge <> surrogate").where(F.expr(geo.bearing_difference("bearing", "other")) <= angle).withColumn("d", F.expr(d)).where(F.col("d") <= radius_m)
    return pairs.groupBy("edge").agg(F.min(F.struct(F.round("d", 4).alias("d"), "surrogate")).alias("m")).select("edge", "m.surrogate", F.col("m.d").alias("distance_m"))


def points_on_track(points: DataFrame, segments: DataFrame, radius_m: float, top_lat: float = 60.0) -> DataFrame:
    """(route, id, along_m, off_m): points within the radius of a route, at the length of their nearest place on it.

    Segments (route, seq, length_m, alat, alon, blat, blon); the place on a segment is found in degrees.
    """
    w = Window.partitionBy("route").orderBy("seq")
    size = max(radius_m, 2000.0)
    lat_size, lon_size = size / 111000.0, size / (111320.0 * math.cos(math.radians(top_lat)))
    pad_lat, pad_lon = radius_m / 111000.0, radius_m / (111320.0 * math.cos(math.radians(top_lat)))
    seg = segments.withColumn("before", F.sum("length_m").over(w) - F.col("length_m"))
    for name, a, b, pad, step in (("cy", "alat", "blat", pad_lat, lat_size), ("cx", "alon", "blon", pad_lon, lon_size)):
        low, high = f"floor((least({a}, {b}) - {geo.number(pad)}) / {geo.number(step)})", f"floor((greatest({a}, {b}) + {geo.number(pad)}) / {geo.number(step)})"
        seg = seg.withColumn(name, F.explode(F.expr(f"sequence(cast({low} as bigint), cast({high} as bigint))")))
    pts = points.withColumn("cy", F.expr(f"cast(floor(lat / {geo.number(lat_size)}) as bigint)")).withColumn("cx", F.expr(f"cast(floor(lon / {geo.number(lon_size)}) as bigint)"))
    size2 = "((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat))"
    f = f"CASE WHEN {size2} = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((lon - alon) * (blon - alon) + (lat - alat) * (blat - alat)) / {size2})) END"
    near = pts.join(seg, ["cy", "cx"]).withColumn("f", F.expr(f)).withColumn("off", F.expr(geo.haversine("lat", "lon", "(alat + f * (blat - alat))", "(alon + f * (blon - alon))"))).where(F.col("off") <= radius_m)
    best = near.groupBy("route", "id").agg(F.min(F.struct(F.round("off", 3).alias("off_m"), "seq", F.round(F.expr("before + f * length_m"), 3).alias("along_m"))).alias("m"))
    return best.select("route", "id", "m.along_m", "m.off_m")


def rider_pois(items: DataFrame, riders: DataFrame, look_back_m: float | None = 5000.0) -> DataFrame:
    """(route, id, distance_m, ahead, place): points along routes as seen by a rider, nearest first, those ahead and those behind apart.

    The distance is the rider's way to the route, along it, and off it to the point. items: (route, id, along_m, off_m);
    riders: (route, along_m, off_m), a route without a rider is seen from its start. Points behind are shown up to
    ``look_back_m``.
    """
    at = riders.selectExpr("route", "along_m as rider_m", "off_m as rider_off")
    df = items.join(at, "route", "left").withColumn("rider_m", F.coalesce("rider_m", F.lit(0.0)))
    df = df.withColumn("distance_m", F.round(F.coalesce("rider_off", F.lit(0.0)) + F.abs(F.col("along_m") - F.col("rider_m")) + F.col("off_m"), 3)).withColumn("ahead", F.col("along_m") >= F.col("rider_m"))
    if look_back_m is not None:
        df = df.where(F.col("ahead") | (F.col("distance_m") <= look_back_m))
    w = Window.partitionBy("route", "ahead").orderBy("distance_m", "id")
    return df.withColumn("place", F.row_number().over(w)).select("route", "id", "distance_m", "ahead", "place")


def between(points: DataFrame, spots: DataFrame) -> DataFrame:
    """(route, seq, lat, lon): the points of a track from the one place to the other (spots: route, a_seq, b_seq: segments nearest to rider and goal), ends included."""
    return points.join(spots, "route").where("seq between least(a_seq, b_seq) and greatest(a_seq, b_seq)").select("route", "seq", "lat", "lon")


def sub_tracks(points: DataFrame, spots: DataFrame, ahead_m: float, back_m: float) -> DataFrame:
    """(route, seq, lat, lon): the stretch of a track around a place on it (spots: route, seq of its segment, lat, lon), the place itself at seq + 0.5.

    Backwards up to, not including, the first point at ``back_m`` or more; forwards up to and including the first at
    ``ahead_m`` or more. points: (route, seq, lat, lon).
    """
    w = Window.partitionBy("route").orderBy("seq")
    df = points.join(spots.selectExpr("route", "seq as at", "lat as plat", "lon as plon"), "route")
    df = df.withColumn("a", F.lag("lat").over(w)).withColumn("b", F.lag("lon").over(w)).withColumn("step", F.coalesce(F.expr(geo.haversine("a", "b", "lat", "lon")), F.lit(0.0)))
    df = df.withColumn("run", F.sum("step").over(w)).withColumn("direct", F.expr(geo.haversine("plat", "plon", "lat", "lon")))
    edge = df.groupBy("route").agg(F.max(F.expr("CASE WHEN seq = at THEN run END")).alias("run0"), F.max(F.expr("CASE WHEN seq = at THEN direct END")).alias("back0"), F.max(F.expr("CASE WHEN seq = at + 1 THEN run END")).alias("run1"), F.max(F.expr("CASE WHEN seq = at + 1 THEN direct END")).alias("ahead0"))
    df = df.join(edge, "route").withColumn("back", F.expr("back0 + run0 - run")).withColumn("ahead", F.expr("ahead0 + run - run1"))
    shown = df.where((F.expr("seq <= at") & (F.col("back") < back_m)) | (F.expr("seq > at") & (F.col("ahead") - F.col("step") * F.expr("cast(seq > at + 1 as int)") < ahead_m) | F.expr("seq = at + 1")))
    return shown.selectExpr("route", "cast(seq as double) as seq", "lat", "lon").unionByName(spots.selectExpr("route", "seq + 5e-1 as seq", "lat", "lon"))
