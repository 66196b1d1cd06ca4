"""Paths on road graphs: the way home, map matching and loops.

Each trip, chunk of a track or plan takes the roads of its own box, found by grid cells; a kernel then searches that
small graph. The work spreads over trips, and a group is as large as its box, not as the road table. Kernels order their
input first and break ties by edge, so that reruns agree.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from itertools import chain, combinations, groupby, permutations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.plans.lineage import store

CELL_DEG = 0.05
METRES_PER_DEGREE = 111320.0


def located(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the places of both ends (alat, alon, blat, blon)."""
    a = nodes.selectExpr("id as from_node", "lat as alat", "lon as alon")
    b = nodes.selectExpr("id as to_node", "lat as blat", "lon as blon")
    # All nodes are no table to broadcast, however few bytes their file takes.
    return edges.join(a.hint("merge"), "from_node").join(b.hint("merge"), "to_node").select("from_node", "to_node", "length_m", "alat", "alon", "blat", "blon")


def clamped(boxes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Boxes (south, north, west, east) cut to the extent of all nodes, which changes nothing in them; those left empty go.

    Near a pole a margin in metres is any number of degrees, and a box of so many cells would fit no task.
    """
    extent = nodes.agg(F.min("lat").alias("_s"), F.max("lat").alias("_n"), F.min("lon").alias("_w"), F.max("lon").alias("_e"))
    cut = boxes.crossJoin(F.broadcast(extent))
    for name, way, limit in (("south", F.greatest, "_s"), ("north", F.least, "_n"), ("west", F.greatest, "_w"), ("east", F.least, "_e")):
        cut = cut.withColumn(name, way(name, limit))
    return cut.where("south <= north and west <= east").select(*boxes.columns)


def roads_in_boxes(boxes: DataFrame, roads: DataFrame, key: str) -> DataFrame:
    """Roads (``located``) with either end in each box (key, south, north, west, east), by cells of ``CELL_DEG``."""
    def cells(low: str, high: str) -> str:
        return f"sequence(cast(floor({low} / {CELL_DEG}) as int), cast(floor({high} / {CELL_DEG}) as int))"

    wide = boxes.withColumn("_r", F.explode(F.expr(cells("south", "north")))).withColumn("_c", F.explode(F.expr(cells("west", "east"))))
    ends = ", ".join(f"struct(cast(floor({e}lat / {CELL_DEG}) as int) as r, cast(floor({e}lon / {CELL_DEG}) as int) as c)" for e in "ab")
    spread = roads.withColumn("_cell", F.explode(F.expr(f"array_distinct(array({ends}))"))).withColumn("_r", F.col("_cell.r")).withColumn("_c", F.col("_cell.c")).drop("_cell")
    inside = " or ".join(f"({e}lat between south and north and {e}lon between west and east)" for e in "ab")
    return wide.hint("merge").join(spread, ["_r", "_c"]).where(inside).select(key, *roads.columns).dropDuplicates([key, "from_node", "to_node"])


def box_around(df: DataFrame, lats: list[str], lons: list[str], margin_m: float) -> DataFrame:
    """Adds the box around some points of each row, widened by ``margin_m``."""
    many = lambda way, x: f"{way}({', '.join(x)})" if len(x) > 1 else x[0]
    south, north, west, east = many("least", lats), many("greatest", lats), many("least", lons), many("greatest", lons)
    lat, lon = margin_m / METRES_PER_DEGREE, f"{margin_m / METRES_PER_DEGREE} / cos(radians({lats[0]}))"
    return df.selectExpr("*", f"{south} - {lat} as south", f"{north} + {lat} as north", f"{west} - {lon} as west", f"{east} + {lon} as east")


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


class Graph:
    """A directed road graph in memory."""

    def __init__(self, roads: pd.DataFrame):
        roads = roads.sort_values(["from_node", "to_node"]).reset_index(drop=True)
        self.roads = roads
        self.a, self.b, self.length = roads["from_node"].to_numpy(), roads["to_node"].to_numpy(), roads["length_m"].to_numpy(float)
        self.ends = roads[["alat", "alon", "blat", "blon"]].to_numpy(float)
        # Plain numbers for the searches: single elements of arrays are slow to read.
        self.froms, self.tos, ends = self.a.tolist(), self.b.tolist(), self.ends.tolist()
        self.out = defaultdict(list)
        for i, n in enumerate(self.froms):
            self.out[n].append(i)
        self.at = {}
        for a, b, (alat, alon, blat, blon) in zip(self.froms, self.tos, ends):
            self.at[a], self.at[b] = (alat, alon), (blat, blon)
        self.back = {(a, b): i for i, (a, b) in enumerate(zip(self.froms, self.tos))}
        # Lengths below the distance of the ends would make that distance too high an estimate; the least ratio mends it.
        direct, self.lengths = [metres(*e) for e in ends], self.length.tolist()
        self.ratios = np.array([n / d if d > 0 else 1.0 for n, d in zip(self.lengths, direct)])
        self.ratio = min([1.0, *self.ratios.tolist()])
        self.estimates: dict[frozenset, dict] = {}

    def distances(self, lat: float, lon: float, own: np.ndarray | None = None) -> np.ndarray:
        """Metres from a point to every road, or to some, in a plane around the point."""
        k, ends = METRES_PER_DEGREE * np.array([1.0, math.cos(math.radians(lat))]), self.ends if own is None else self.ends[own]
        a, b = (ends[:, :2] - (lat, lon)) * k, (ends[:, 2:] - (lat, lon)) * k
        d = b - a
        size = (d * d).sum(1)
        t = np.clip(-(a * d).sum(1) / np.where(size > 0, size, 1), 0, 1)
        return np.sqrt(((a + t[:, None] * d) ** 2).sum(1))

    def way(self, trip, own: np.ndarray, allowed: bytes, start_m: float, goal_m: float) -> list[int]:
        """Roads of a shortest way on some roads (their places, and a flag for each road) from near a trip's start to near its home."""
        near = np.round(self.distances(trip.lat, trip.lon, own), 3)
        first = int(near.argmin())
        if not near[first] <= start_m:
            return []
        reach = goal_m / 111000.0  # no node is nearer than its way north or south
        ends = self.ends[own]
        close = {*self.a[own[np.abs(ends[:, 0] - trip.home_lat) <= reach]].tolist(), *self.b[own[np.abs(ends[:, 2] - trip.home_lat) <= reach]].tolist()}
        goals = {n for n in close if metres(*self.at[n], trip.home_lat, trip.home_lon) <= goal_m}
        return self.path(self.tos[own[first]], goals, allowed=allowed, ratio=min(1.0, float(self.ratios[own].min()))) or []

    def path(self, start, goals: set, weight=None, allowed: bytes | None = None, ratio: float | None = None) -> list[int] | None:
        """Roads of a least-cost path from a node to the nearest of some nodes; None if there is none. Estimates never exceed the cost.

        Roads may be ``allowed`` by a flag for each; ``ratio`` is then the least of theirs.
        """
        weight = self.lengths if weight is None else np.asarray(weight).tolist()
        aims = [self.at[g] for g in goals if g in self.at]
        if not aims:
            return None
        known = self.estimates.setdefault(frozenset(goals), {}) if ratio is None else {}
        ratio = self.ratio if ratio is None else ratio

        def ahead(n) -> float:
            if n not in known:
                known[n] = ratio * min(metres(*self.at[n], *g) for g in aims) if n in self.at else 0.0
            return known[n]

        best, via, done, heap = {start: 0.0}, {}, set(), [(ahead(start), start)]
        while heap:
            _, n = heapq.heappop(heap)
            if n in done:
                continue
            if n in goals:
                found = []
                while n != start:
                    found.append(via[n])
                    n = self.froms[via[n]]
                return found[::-1]
            done.add(n)
            for i in self.out.get(n, ()):
                if allowed is not None and not allowed[i]:
                    continue
                m, cost = self.tos[i], best[n] + weight[i]
                if cost < best.get(m, math.inf):
                    best[m], via[m] = cost, i
                    heapq.heappush(heap, (cost + ahead(m), m))
        return None


#: A block of trips is so many degrees on a side, or as many doublings of that as its trips' boxes take, and has so many trips.
BLOCK_DEG = 0.25
BLOCK_TRIPS = 1000


def in_blocks(boxes: DataFrame) -> DataFrame:
    """Adds ``block``, at most twice as large as the boxes in it, to boxes (trip_id, south, north, west, east); blocks of many boxes are dealt out."""
    size = f"{BLOCK_DEG}d * pow(2, _level)"
    level = f"cast(greatest(0, ceil(log2(greatest(north - south, east - west, {BLOCK_DEG}d) / {BLOCK_DEG}d))) as int)"
    placed = boxes.withColumn("_level", F.expr(level)).selectExpr("*", f"struct(_level, cast(floor(south / ({size})) as long) as row, cast(floor(west / ({size})) as long) as col) as _place").drop("_level")
    parts = placed.groupBy("_place").agg(F.expr(f"cast(ceil(count(1) / {BLOCK_TRIPS}) as long)").alias("_parts"))
    return placed.join(parts, "_place").withColumn("block", F.expr("struct(_place._level as level, _place.row as row, _place.col as col, pmod(xxhash64(trip_id), _parts) as part)")).drop("_place", "_parts")


def block_boxes(boxed: DataFrame) -> DataFrame:
    """The box (of_block, south, north, west, east) around all boxes of each block (``in_blocks``)."""
    blocks = boxed.groupBy("block").agg(F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))
    return blocks.withColumnRenamed("block", "of_block").selectExpr("struct(of_block.*) as of_block", "south", "north", "west", "east")


def way_home(trips: DataFrame, edges: DataFrame, nodes: DataFrame, margin_m: float = 2000.0, start_m: float = 50.0, goal_m: float = 50.0) -> DataFrame:
    """(trip_id, seq, from_node, to_node, length_m): a shortest way for each trip (trip_id, lat, lon, home_lat, home_lon).

    It begins at the end of the road nearest to the start (to the millimetre; then the first by its nodes), which must be within ``start_m``, and ends at the first node
    within ``goal_m`` of home. Trips without such a way, or already at home, have no rows. A trip searches the roads with an
    end in its own box; trips whose boxes lie together take them from one block of roads, which is sent once.
    """
    full = box_around(trips, ["lat", "home_lat"], ["lon", "home_lon"], margin_m)
    boxed = store(in_blocks(clamped(full.dropDuplicates(["trip_id"]), nodes)))
    roads = roads_in_boxes(block_boxes(boxed), located(edges, nodes), "of_block")

    def search(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        columns: list[list] = [[], [], [], [], []]
        if len(near):
            g = Graph(near)
            alat, alon, blat, blon = np.ascontiguousarray(g.ends.T)
            for t in asked.sort_values("trip_id").itertuples(index=False):
                inside = (alat >= t.south) & (alat <= t.north) & (alon >= t.west) & (alon <= t.east) | (blat >= t.south) & (blat <= t.north) & (blon >= t.west) & (blon <= t.east)
                own = np.flatnonzero(inside)
                found = g.way(t, own, inside.tobytes(), start_m, goal_m) if len(own) else []
                for column, values in zip(columns, ([t.trip_id] * len(found), range(len(found)), [g.froms[i] for i in found], [g.tos[i] for i in found], [g.lengths[i] for i in found])):
                    column.extend(values)
        return pd.DataFrame(dict(zip(("trip_id", "seq", "from_node", "to_node", "length_m"), columns)))

    return boxed.groupBy("block").cogroup(roads.groupBy("of_block")).applyInPandas(search, "trip_id long, seq int, from_node long, to_node long, length_m double")


def _bearings(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    y = np.sin(lon2 - lon1) * np.cos(lat2)
    return np.degrees(np.arctan2(y, np.cos(lat1) * np.sin(lat2) - np.sin(lat1) * np.cos(lat2) * np.cos(lon2 - lon1))) % 360


def snapped(g: Graph, lat: np.ndarray, lon: np.ndarray, radius_m: float, angle: float) -> list[int | None]:
    """Each point's road among those whose box meets the point's: the nearest within ``angle`` of the heading, else the nearest."""
    n, roads = len(lat), _bearings(*g.ends.T) if len(g.a) else np.array([])
    low, high = np.maximum(np.arange(n) - 2, 0), np.minimum(np.arange(n) + 2, n - 1)
    heading, still = _bearings(lat[low], lon[low], lat[high], lon[high]), (lat[low] == lat[high]) & (lon[low] == lon[high])
    boxes = np.minimum(g.ends[:, :2], g.ends[:, 2:]), np.maximum(g.ends[:, :2], g.ends[:, 2:])
    found: list[int | None] = []
    for i in range(n):
        reach = radius_m / METRES_PER_DEGREE * np.array([1.0, 1.0 / math.cos(math.radians(lat[i]))])
        p = np.array([lat[i], lon[i]])
        hits = np.flatnonzero(((boxes[0] <= p + reach) & (boxes[1] >= p - reach)).all(1))
        if not len(hits):
            found.append(None)
            continue
        d = g.distances(lat[i], lon[i])[hits]
        off = np.abs((roads[hits] - heading[i] + 180) % 360 - 180) > angle
        order = np.lexsort((hits, d, off & (not still[i])))
        found.append(int(hits[order[0]]))
    return found


def connectors(g: Graph, a: int, b: int, depth: int) -> list[int] | None:
    """Fewest roads between the end of road ``a`` and road ``b``, found level by level; None beyond ``depth`` levels."""
    level, via = [a], {a: a}
    for _ in range(depth):
        following = []
        for i in level:
            for j in g.out[g.b[i]]:
                if j not in via:
                    via[j] = i
                    following.append(j)
                    if j == b:
                        steps = []
                        while via[j] != a:
                            j = via[j]
                            steps.append(j)
                        return steps[::-1]
        level = following
    return None


def _distinct_runs(seq) -> list:
    return [k for k, _ in groupby(seq)]


def joined(g: Graph, anchors: list[int], depth: int) -> list[int] | None:
    """Anchors with the roads between them. Where the way on turns back at once, the road before was a side street and goes; None if a gap stays."""
    path = anchors[:1]
    for road in anchors[1:]:
        for attempt in range(2):
            if not path:
                return None
            if path[-1] == road:
                steps = []
            else:
                steps = [] if g.a[road] == g.b[path[-1]] else connectors(g, path[-1], road, depth)
            if steps is None:
                return None
            if attempt == 0 and steps and g.b[steps[0]] == g.a[path[-1]]:
                path.pop()
                continue
            path += [*steps, road]
            break
    return _distinct_runs(path)


def pruned(g: Graph, path: list[int], first: tuple[float, float], last: tuple[float, float]) -> list[int]:
    """The path without dead ends, apart from those nearest to the track's own ends."""
    nodes = sorted({n for i in path for n in (g.a[i], g.b[i])})
    safe = {min(nodes, key=lambda n: metres(*p, *g.at[n])) for p in (first, last)} if nodes else set()
    while len(path) > 1:
        degree = defaultdict(int)
        for x, y in {(min(g.a[i], g.b[i]), max(g.a[i], g.b[i])) for i in path}:
            degree[x] += 1
            degree[y] += 1
        kept = [i for i in path if not any(degree[n] == 1 and n not in safe for n in (g.a[i], g.b[i]))]
        if len(kept) == len(path):
            break
        path = kept
    return path


def map_match(points: DataFrame, chunks: DataFrame, edges: DataFrame, nodes: DataFrame, radius_m: float = 20.0, angle: float = 45.0, least_points: int = 2, depth: int = 6) -> DataFrame:
    """(session_id, chunk, seq, from_node, to_node): roads ridden, chunk by chunk of a track (``tracks.chunks``).

    A chunk without a match of two roads or more has no rows. Points (session_id, idx, lat, lon).
    """
    rows = points.join(chunks, ["session_id", "idx"]).select("session_id", "chunk", "idx", "lat", "lon")
    pad = radius_m / METRES_PER_DEGREE
    boxes = rows.groupBy("session_id", "chunk").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    # An end of a road may lie a road's length away from the points beside it.
    boxes = boxes.selectExpr("struct(session_id, chunk) as part", f"s - {pad} - 2e-2 as south", f"n + {pad} + 2e-2 as north", f"w - {pad} - 3e-2 as west", f"e + {pad} + 3e-2 as east")
    roads = roads_in_boxes(boxes, located(edges, nodes), "part").selectExpr("part.session_id", "part.chunk", "from_node", "to_node", "length_m", "alat", "alon", "blat", "blon")
    names = ["session_id", "chunk", "seq", "from_node", "to_node"]

    def match(key: tuple, track: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        if len(track) < 2 or len(near) < 2:
            return empty
        track, g = track.sort_values("idx"), Graph(near)
        lat, lon = track["lat"].to_numpy(float), track["lon"].to_numpy(float)
        runs = [(k, len(list(v))) for k, v in groupby(s for s in snapped(g, lat, lon, radius_m, angle) if s is not None)]
        path = joined(g, _distinct_runs(k for k, n in runs if n >= least_points), depth)
        path = pruned(g, path, (lat[0], lon[0]), (lat[-1], lon[-1])) if path else []
        if len(path) < 2:
            return empty
        return pd.DataFrame({"session_id": key[0], "chunk": key[1], "seq": range(len(path)), "from_node": g.a[path], "to_node": g.b[path]})

    return rows.groupBy("session_id", "chunk").cogroup(roads.groupBy("session_id", "chunk")).applyInPandas(match, "session_id long, chunk int, seq int, from_node long, to_node long")


def match_coverage(points: DataFrame, chunks: DataFrame, matched: DataFrame, step_m: str) -> DataFrame:
    """(session_id, distance_m, matched_m, percent): the share of each track's length in chunks with a match; ``step_m`` is the length up to a point."""
    own = chunks.groupBy("session_id", "idx").agg(F.min("chunk").alias("chunk"))  # the point where chunks meet ends the earlier one
    size = points.withColumn("_m", F.expr(step_m)).join(own, ["session_id", "idx"]).groupBy("session_id", "chunk").agg(F.sum("_m").alias("m"))
    hit = matched.select("session_id", "chunk").distinct().withColumn("hit", F.lit(1))
    rows = size.join(hit, ["session_id", "chunk"], "left").groupBy("session_id").agg(F.sum("m").alias("distance_m"), F.sum(F.when(F.col("hit") == 1, F.col("m")).otherwise(0.0)).alias("matched_m"))
    return rows.withColumn("percent", F.expr("coalesce(least(1e2, greatest(0e0, matched_m / distance_m * 1e2)), 0e0)"))


#: What is known of ways to stops is dropped beyond so many nodes, to bound a task's memory.
KNOWN_NODES = 2_000_000
MOST_TASKS = 2000
AROUND = ((True, True), (True, False), (False, False), (False, True))


class RoundTrips:
    """Round trips of plans that lie together, on the roads of one block; each plan keeps to the roads with an end in its own box.

    The length that is left to a stop on all roads of the block bounds that on any of them from below, so plans share it: a
    search then follows little more than the way that it finds. A way that meets no dear road is the same as if none were.
    """

    def __init__(self, near: pd.DataFrame, reuse: float):
        g = Graph(near)
        self.g, self.reuse = g, reuse
        self.gain = g.roads["reward"].fillna(0.0).to_numpy(float)
        self.ids, ends = np.unique(np.concatenate([g.a, g.b]), return_inverse=True)
        self.a, self.b = ends[:len(g.a)], ends[len(g.a):]
        self.froms, self.tos, self.gains = self.a.tolist(), self.b.tolist(), self.gain.tolist()
        self.at = [g.at[n] for n in self.ids.tolist()]
        self.places = np.array(self.at)
        self.out, self.into = [[] for _ in self.at], [[] for _ in self.at]
        for i, (a, b, n) in enumerate(zip(self.froms, self.tos, g.lengths)):
            self.out[a].append((b, i, n))
            self.into[b].append((a, i, n))
        twins = [g.back.get((b, a)) for a, b in zip(g.froms, g.tos)]
        self.both = [(i,) if j is None else (i, j) for i, j in enumerate(twins)]
        self.street = [min(x) for x in self.both]
        self.leaving = [frozenset(i for _, i, _ in roads) for roads in self.out]
        self.known, self.n_known = {}, 0

    def to_go(self, goal: int, start: int) -> tuple[dict[int, float], float]:
        """Least metres to ``goal`` from ``start``, if it is reached, and from all nodes nearer; no other has less than the second number."""
        if goal not in self.known:
            if self.n_known > KNOWN_NODES:
                self.known, self.n_known = {}, 0
            self.known[goal] = {goal: 0.0}, {}, [(0.0, goal)]
        best, done, heap = self.known[goal]
        while heap and start not in done:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done[n] = d
            self.n_known += 1
            for m, _, size in self.into[n]:
                if d + size < best.get(m, math.inf):
                    best[m] = d + size
                    heapq.heappush(heap, (d + size, m))
        return done, heap[0][0] if heap else math.inf

    def straight(self, start: int, goal: int, own: bytes) -> tuple[int, ...] | None:
        """Roads of the shortest way in the block, if no other is as short and all are own; None tells nothing."""
        (left, _), n, found = self.to_go(goal, start), start, []
        if start not in left:
            return None
        while n != goal:
            first = second = math.inf
            for m, i, size in self.out[n]:
                all_of_it = size + left.get(m, math.inf)
                if all_of_it < first:
                    first, second, road, following = all_of_it, first, i, m
                elif all_of_it < second:
                    second = all_of_it
            if second <= first * (1 + 1e-9) or not own[road]:
                return None
            found.append(road)
            n = following
        return tuple(found)

    def way(self, start: int, goal: int, own: bytes, ratio: float, taken: frozenset, looked: list | None = None) -> tuple[int, ...] | None:
        """Roads of a least-cost way on own roads, where those taken are dear; ``looked`` gets the nodes whose roads count.

        Of ways alike, each node takes the one before it that lies best by air.
        """
        (left, far), reuse = self.to_go(goal, start), self.reuse
        if start not in left:
            return None
        ahead = left.get
        best, via, ties, heap, limit = {start: 0.0}, {}, {}, [(left[start], 0.0, start)], math.inf
        looked = [] if looked is None else looked
        while heap:
            f, d, n = heapq.heappop(heap)
            if f > limit:
                break
            if n == goal:
                limit = min(limit, d * (1 + 1e-12))  # all ways as short are looked at
                continue
            if d > best[n]:
                continue
            looked.append(n)
            for m, i, size in self.out[n]:
                if own[i]:
                    cost = d + (reuse * size if i in taken else size)
                    old = best.get(m, math.inf)
                    if cost < old:
                        best[m], via[m] = cost, i
                        if ties:
                            ties.pop(m, None)
                        heapq.heappush(heap, (cost + ahead(m, far), cost, m))
                    elif cost == old and cost > d:
                        ties.setdefault(m, [via[m]] if m in via else []).append(i)
        if goal not in best:
            return None
        found, n = [], goal
        while n != start:
            i = via[n]
            if n in ties:
                i = min(ties[n], key=lambda j: (best[self.froms[j]] + ratio * metres(*self.at[self.froms[j]], *self.at[goal]), self.froms[j]))
            found.append(i)
            n = self.froms[i]
        return tuple(found[::-1])

    def stops(self, p, own: np.ndarray, per_quadrant: int) -> tuple[int, list[list[int]]]:
        """A plan's home node and the anchors of each quadrant."""
        nodes = np.unique(np.concatenate([self.a[own], self.b[own]])).tolist()
        off = {n: metres(*self.at[n], p.lat, p.lon) for n in nodes}
        home = min(nodes, key=lambda n: (off[n], n))
        worth = np.bincount(self.b[own], weights=self.gain[own], minlength=len(self.at)).tolist()
        top, reach, quadrants = max(max(worth), 1e-9), 0.1442 * p.target_m, defaultdict(list)
        for n in nodes:
            if n != home and 0.5 * reach <= off[n] <= 2 * reach:
                lat, lon = self.at[n]
                quadrants[(lon >= p.lon, lat >= p.lat)].append((-(1 - abs(off[n] - reach) / reach) - 0.1 * worth[n] / top, n))
        return home, [[n for _, n in heapq.nsmallest(per_quadrant, quadrants[q])] for q in AROUND]

    def trips(self, p, per_quadrant: int, apart_m: float) -> tuple[int, list[tuple[int, ...]]]:
        """A plan's home node and its different round trips, as roads."""
        alat, alon, blat, blon = self.g.ends.T
        inside = (alat >= p.south) & (alat <= p.north) & (alon >= p.west) & (alon <= p.east) | (blat >= p.south) & (blat <= p.north) & (blon >= p.west) & (blon <= p.east)
        places = np.flatnonzero(inside)
        if not len(places):
            return -1, []
        own, ratio = inside.tobytes(), min(1.0, float(self.g.ratios[places].min()))
        home, anchors = self.stops(p, places, per_quadrant)
        flat = [n for ns in anchors for n in ns]
        close = {(x, y) for x, y in permutations(flat, 2) if metres(*self.at[x], *self.at[y]) < apart_m}
        plain: dict[tuple, tuple | None] = {}
        searched: dict[tuple, list] = {}  # roads that a search looked at, those dear among them, and what it found
        ridden: dict[tuple, tuple | None] = {(home,): (frozenset(), ())}

        def ride(stops: tuple) -> tuple | None:
            """Roads that are dear now, and the trip so far; what trips that begin alike share is kept."""
            if stops not in ridden:
                before, (a, b), leg = ride(stops[:-1]), stops[-2:], None
                if before is not None:
                    if (a, b) not in plain:
                        plain[a, b] = self.straight(a, b, own) or self.way(a, b, own, ratio, frozenset())
                        searched[a, b] = []
                    leg, taken = plain[a, b], before[0]
                    if leg is not None and not taken.isdisjoint(leg):
                        leg = next((x for seen, met, x in searched[a, b] if taken & seen == met), None)
                        if leg is None:
                            looked: list[int] = []
                            leg = self.way(a, b, own, ratio, taken, looked)
                            seen = self.leaving[looked[0]].union(*[self.leaving[n] for n in looked[1:]])
                            searched[a, b].append((seen, taken & seen, leg))
                last = b == home  # nothing follows that would ask what is dear
                ridden[stops] = None if leg is None else (taken if last else taken.union(*[self.both[i] for i in leg]), before[1] + leg)
            return ridden[stops]

        found: dict[tuple, None] = {}
        for combo in product(*[[None, *ns] for ns in anchors]):
            stops = tuple(n for n in combo if n is not None)
            if len(stops) < 2 or any(x in close for x in combinations(stops, 2)):
                continue
            for order in (stops, stops[::-1]):
                trip = ride((home, *order, home))
                if trip and trip[1]:
                    found[trip[1]] = None
        return home, list(found)

    def ranked(self, p, home: int, trips: list[tuple[int, ...]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Numbers of a plan's trips (place, length, reward, share ridden again, compactness), how many nodes each has, and these, best trip first."""
        sizes = np.array([len(t) for t in trips])
        starts, flat = np.cumsum(sizes) - sizes, np.fromiter(chain.from_iterable(trips), np.int64, int(sizes.sum()))
        length = np.add.reduceat(self.g.length[flat], starts)
        reward = np.array([sum(map(self.gains.__getitem__, set(t))) for t in trips])
        again = np.array([self.repeated(t) for t in trips]) / length
        y, x = ((self.places - (p.lat, p.lon)) * METRES_PER_DEGREE).T
        x = x * math.cos(math.radians(p.lat))
        a, b = self.a[flat], self.b[flat]
        area = np.abs(np.add.reduceat(x[a] * y[b] - x[b] * y[a], starts)) / 2
        shape, off = 4 * math.pi * area / length**2, np.abs(length - p.target_m) / p.target_m
        tier = np.where(off <= 0.15, 0, np.where(off <= 0.3, 1, 2))
        keys = list(zip(tier.tolist(), (-reward).tolist(), np.round(again - shape, 12).tolist(), trips))  # the same roads begun elsewhere tie
        order = np.array(sorted(range(len(trips)), key=keys.__getitem__))
        nodes = np.fromiter(chain.from_iterable(trips[k] for k in order.tolist()), np.int64, len(flat))
        begun = np.cumsum(sizes[order]) - sizes[order]
        nodes = np.insert(self.ids[self.b[nodes]], begun, self.ids[home])
        return [np.arange(1, len(trips) + 1), *[v[order] for v in (length, reward, again, shape)]], sizes[order] + 1, nodes

    def repeated(self, trip: tuple[int, ...]) -> float:
        """Metres on roads already ridden, either way."""
        streets = [self.street[i] for i in trip]
        if len(set(streets)) == len(streets):
            return 0.0
        first, again = set(), 0.0
        for i, k in zip(trip, streets):
            again += self.g.lengths[i] if k in first else 0.0
            first.add(k)
        return again


def loops(plans: DataFrame, edges: DataFrame, nodes: DataFrame, rewards: DataFrame, per_quadrant: int = 2, reuse: float = 5.0, apart_m: float = 1000.0) -> DataFrame:
    """(plan_id, place, length_m, reward, repeat_fraction, compactness, nodes): round trips ranked for each plan (plan_id, lat, lon, target_m).

    Every quadrant around home offers its best anchors (distance against a reach of 0.1442 of the target, then reward) or
    none; combinations of two or more, at least ``apart_m`` from one another, are ridden in turn around home both ways.
    Legs are least-cost paths on which roads already taken, either way, cost ``reuse`` times their length. Trips within 15 % of the target
    come first (else 30 %, else all), then higher reward, then a rounder shape. Rewards: (from_node, to_node, reward).
    A plan searches the roads with an end in its own box; plans whose boxes lie together take them from one block of roads.
    """
    boxed = plans.withColumn("_pad", F.col("target_m") / (4 * METRES_PER_DEGREE)).selectExpr("plan_id as trip_id", "lat", "lon", "target_m", "lat - _pad as south", "lat + _pad as north", "lon - _pad / cos(radians(lat)) as west", "lon + _pad / cos(radians(lat)) as east")
    boxed = store(in_blocks(clamped(boxed.dropDuplicates(["trip_id"]), nodes)))
    roads = roads_in_boxes(block_boxes(boxed), located(edges, nodes), "of_block").join(rewards.select("from_node", "to_node", "reward"), ["from_node", "to_node"], "left")
    columns = {"place": pa.int32(), **dict.fromkeys(("length_m", "reward", "repeat_fraction", "compactness"), pa.float64())}

    def plan(asked: pa.Table, near: pa.Table) -> pa.Table:
        keys, found, sizes, visited = [], [[np.array([])] for _ in columns], [np.array([0], np.int64)], [np.array([], np.int64)]
        if near.num_rows:
            plans_here = asked.drop_columns(["block"]).to_pandas().sort_values("trip_id")
            block = RoundTrips(near.drop_columns(["of_block"]).to_pandas(), reuse)
            for p in plans_here.itertuples(index=False):
                home, trips = block.trips(p, per_quadrant, apart_m)
                if trips:
                    values, counts, ids = block.ranked(p, home, trips)
                    keys.append(np.full(len(trips), p.trip_id))
                    sizes.append(counts)
                    visited.append(ids)
                    for column, v in zip(found, values):
                        column.append(v)
        data = {"plan_id": pa.array(np.concatenate(keys) if keys else [], pa.int64())}
        data |= {name: pa.array(np.concatenate(v), kind, safe=False) for (name, kind), v in zip(columns.items(), found)}
        return pa.table(data | {"nodes": pa.ListArray.from_arrays(np.cumsum(np.concatenate(sizes)).astype(np.int32), pa.array(np.concatenate(visited)))})

    # A block is seconds of work on few bytes, by which Spark would put many into one task.
    tasks = min(MOST_TASKS, max(1, boxed.select("block").distinct().count()))
    return boxed.repartition(tasks, "block").groupBy("block").cogroup(roads.repartition(tasks, "of_block").groupBy("of_block")).applyInArrow(plan, "plan_id long, place int, length_m double, reward double, repeat_fraction double, compactness double, nodes array<long>")
