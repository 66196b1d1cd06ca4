"""Round trips over corridors: anchors by quadrant, fills, refinement on roads, legs from and to home, shape and relaxation.

Each plan is a group of its own: the corridors and roads of its box go to one kernel, so the work spreads over plans and a
group is as large as its box. Kernels order their input and break ties by id, so that reruns agree.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.folds import metres
from cadenza.operators.paths import METRES_PER_DEGREE, Graph, box_around, located, roads_in_boxes


@dataclass(frozen=True)
class LoopRules:
    """Limits of loop planning. Pairs hold the strict value and the one that a relaxed tier takes."""

    reach: tuple[float, float] = (0.1442, 0.2163)
    cone: tuple[float, float] = (0.0, -0.5)
    apart_m: tuple[float, float] = (2000.0, 1000.0)
    band: tuple[float, float] = (0.15, 0.30)
    per_quadrant: int = 2
    refined: int = 5
    kept: int = 2
    detour: float = 1.3
    fill: float = 0.9
    reuse: float = 5.0
    reward_budget: float = 1.5
    calibration: float = 0.15
    least_compactness: float = 0.26
    most_repeat: float = 0.15
    stem_m: float = 8000.0
    exit_m: tuple[float, float] = (3000.0, 8000.0)
    exit_half_m: float = 2500.0
    exit_candidates: int = 5
    exit_cap: float = 0.15
    walk_share: float = 1 / 6
    least_budget: float = 0.3
    popularity: tuple[float, ...] = (0.25, 0.10, 0.05, 0.0)
    steps: int = 50_000


TIERS = ("none", "wide cone", "long reach", "small separation", "wide band")


@dataclass
class Chain:
    """A corridor, or a road that stands in for one (negative id)."""

    id: int
    entry: int
    exit: int
    length: float
    reward: float
    lat: float
    lon: float
    group: int
    nodes: list[int] = field(default_factory=list)


def course(a: tuple[float, float], b: tuple[float, float]) -> float:
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    y = math.sin(lon2 - lon1) * math.cos(lat2)
    return math.degrees(math.atan2(y, math.cos(lat1) * math.sin(lat2) - math.sin(lat1) * math.cos(lat2) * math.cos(lon2 - lon1))) % 360


def alike(a: float, b: float) -> float:
    return math.cos(math.radians(a - b))


def local(origin: tuple[float, float], lat, lon):
    """Metres east and north of a place, for numbers or arrays."""
    return (lon - origin[1]) * METRES_PER_DEGREE * math.cos(math.radians(origin[0])), (lat - origin[0]) * METRES_PER_DEGREE


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counterclockwise; collinear points are no corners."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


class Hull:
    """The ring that a loop should keep to; ``build`` gives None where the places span less than a square kilometre."""

    def __init__(self, origin: tuple[float, float], corners: np.ndarray):
        self.origin, self.corners = origin, corners
        self.band = float(np.clip(0.15 * np.hypot(*(corners - corners.mean(0)).T).mean(), 500.0, 2000.0))

    @staticmethod
    def build(places: list[tuple[float, float]]) -> Hull | None:
        if len(places) < 3:
            return None
        corners = np.array(convex_hull([local(places[0], *p) for p in places]))
        if len(corners) < 3:
            return None
        x, y = corners.T
        area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
        return Hull(places[0], corners) if area >= 1e6 else None

    def distances(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Metres from places to the nearest side."""
        p = np.stack(local(self.origin, lat, lon), -1)[:, None, :]
        a = self.corners[None]
        d = np.roll(self.corners, -1, 0)[None] - a
        size = (d * d).sum(-1)
        t = np.clip(((p - a) * d).sum(-1) / np.where(size > 0, size, 1), 0, 1)
        return np.sqrt(((a + t[..., None] * d - p) ** 2).sum(-1)).min(1)

    def factors(self, lat: np.ndarray, lon: np.ndarray, weight: float = 0.4) -> np.ndarray:
        """What a road's length counts for, by how many bands its middle lies off the ring; three at most."""
        return 1.0 + weight * np.minimum(self.distances(lat, lon) / self.band, 3.0) ** 2


def turn_costs(angle: float, hazards: tuple | None) -> float:
    """Metres that a turn costs; hazards: (score, stops, braking, energy) where the junction is measured."""
    plain = angle / 180.0 * 20.0
    if hazards is None:
        return 0.0 if angle < 5.0 else plain + 10.0
    score, stop, braking, energy = (0.0 if x is None or x != x else x for x in hazards)
    return plain + min(max(score, 0.0), 1.0) * 60.0 + max(stop, 0.0) * 15.0 + min(max(braking, 0.0), 1.0) * 30.0 + max(energy, 0.0) * 0.5


class LoopPlanner:
    """Plans on one box of roads. Roads: from_node, to_node, length_m, ends' places, reward and count (of passages)."""

    def __init__(self, roads: pd.DataFrame, chains: list[Chain], turns: dict | None = None, rules: LoopRules = LoopRules()):
        self.g, self.rules, self.turns = Graph(roads), rules, turns or {}
        g = self.g
        self.reward, self.count = (g.roads[c].fillna(0.0).to_numpy(float).tolist() for c in ("reward", "count"))
        self.middle = (g.ends[:, 0] + g.ends[:, 2]) / 2, (g.ends[:, 1] + g.ends[:, 3]) / 2
        self.heading = [course((a, b), (c, d)) for a, b, c, d in g.ends.tolist()]
        self.chains = {c.id: c for c in sorted(chains, key=lambda c: c.id)}
        self.lengths = g.length.tolist()

    # Searches over roads.

    def _back(self, via: dict[int, int], road: int) -> list[int]:
        path = [road]
        while path[-1] in via:
            path.append(via[path[-1]])
        return path[::-1]

    def shortest(self, start: int, goal: int, weight: list[float], turning: bool = False, allowed=None) -> list[int] | None:
        """Least-cost roads between two nodes, road by road, so that turns can cost something; None if there is no way."""
        g = self.g
        if goal not in g.at:
            return None
        ahead = lambda i: metres(*g.at[g.tos[i]], *g.at[goal])
        best, via, done, heap = {}, {}, set(), []
        for i in g.out.get(start, ()):
            if allowed is None or allowed[i]:
                best[i] = weight[i]
                heapq.heappush(heap, (weight[i] + ahead(i), i))
        for _ in range(self.rules.steps):
            if not heap:
                return None
            _, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            if g.tos[i] == goal:
                return self._back(via, i)
            for j in g.out.get(g.tos[i], ()):
                if j in done or allowed is not None and not allowed[j]:
                    continue
                cost = best[i] + weight[j]
                if turning:
                    gap = abs(self.heading[i] - self.heading[j]) % 360
                    cost += turn_costs(min(gap, 360 - gap), self.turns.get((g.froms[i], g.tos[i], g.tos[j])))
                if cost < best.get(j, math.inf):
                    best[j], via[j] = cost, i
                    heapq.heappush(heap, (cost + ahead(j), j))
        return None

    def richest(self, start: int, goal: int, factor: np.ndarray, budget: float, taken: set[int]) -> list[int] | None:
        """Roads of high reward within a budget of weighted length, none taken before; best first by reward, each road settled once, so not always the best."""
        g, size = self.g, (self.g.length * factor).tolist()
        heap = [(-self.reward[i], i, size[i]) for i in g.out.get(start, ()) if i not in taken and size[i] <= budget]
        gain, via, done, goals = {i: -r for r, i, _ in heap}, {}, set(), []
        heapq.heapify(heap)
        for _ in range(self.rules.steps):
            if not heap:
                break
            r, i, used = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            if g.tos[i] == goal:
                goals.append((r, i))
                continue
            for j in g.out.get(g.tos[i], ()):
                if j in done or j in taken or used + size[j] > budget:
                    continue
                if -r + self.reward[j] > gain.get(j, -math.inf):
                    gain[j], via[j] = -r + self.reward[j], i
                    heapq.heappush(heap, (r - self.reward[j], j, used + size[j]))
        return self._back(via, min(goals)[1]) if goals else None

    def with_reverse(self, roads: list[int]) -> set[int]:
        both = set(roads)
        for i in roads:
            j = self.g.back.get((self.g.tos[i], self.g.froms[i]))
            if j is not None:
                both.add(j)
        return both

    # Coarse loops over corridors.

    def places(self, c: Chain) -> list[tuple[float, float]]:
        return [self.g.at[n] for n in {c.entry, c.exit, *c.nodes} if n in self.g.at]

    def separated(self, a: Chain, b: Chain, apart: float) -> bool:
        """Whether no two of their nodes are closer; unknown places count as far."""
        if metres(a.lat, a.lon, b.lat, b.lon) > apart + (a.length + b.length) / 2:
            return True
        return not any(metres(*p, *q) < apart for p in self.places(a) for q in self.places(b))

    def heading_of(self, c: Chain) -> float | None:
        return course(self.g.at[c.entry], self.g.at[c.exit]) if c.entry in self.g.at and c.exit in self.g.at else None

    def gap(self, a: Chain, b: Chain) -> float:
        p, q = self.g.at.get(a.exit, (a.lat, a.lon)), self.g.at.get(b.entry, (b.lat, b.lon))
        return metres(*p, *q) * self.rules.detour

    def fits(self, c: Chain, before: Chain, after: Chain, chosen: list[Chain], apart: float, cone: float) -> bool:
        """Whether a corridor can fill a gap: between its neighbours, no twin of a chosen one, far from all, and not against the way."""
        way, there = local((before.lat, before.lon), after.lat, after.lon), local((before.lat, before.lon), c.lat, c.lon)
        size = way[0] ** 2 + way[1] ** 2
        if size == 0 or not 0 <= (there[0] * way[0] + there[1] * way[1]) / size <= 1:
            return False
        if any(x.group == c.group and x.id != c.id for x in chosen) or any(not self.separated(c, x, apart) for x in chosen):
            return False
        own = self.heading_of(c)
        return own is None or alike(own, course((before.lat, before.lon), (after.lat, after.lon))) >= cone

    def coarse(self, home: tuple[float, float], target: float, reach_share: float, apart_m: float, cone: float, bearing: float | None, start: int | None) -> list[tuple[list[Chain], float, float]]:
        """(corridors in order, estimated length, reward) of distinct loops, most rewarding first."""
        rules, reach = self.rules, target * reach_share
        far = {c.id: metres(*home, c.lat, c.lon) for c in self.chains.values()}
        near = [c for c in self.chains.values() if far[c.id] <= reach]
        if not near:
            return []
        origin = self.chains.get(start) or min(near, key=lambda c: far[c.id])
        at_home = min(near, key=lambda c: far[c.id]) if start is None else origin
        pool = [c for c in near if c.id not in (origin.id, at_home.id)]
        if bearing is None:
            others = [c for c in near if c.id != at_home.id]
            bearing = course(home, (lambda c: (c.lat, c.lon))(max(others, key=lambda c: far[c.id]))) if others else 0.0
        apart = min(apart_m, reach / 2)
        low, high = min(c.reward for c in near), max(c.reward for c in near)
        u = math.sin(math.radians(bearing)), math.cos(math.radians(bearing))
        roads = [i for i in range(len(self.lengths)) if self.count[i] > 0 and metres(*home, self.middle[0][i], self.middle[1][i]) <= reach]
        found: dict[tuple, tuple[list[Chain], float, float]] = {}
        for side in (1.0, -1.0):
            def frame(lat: float, lon: float) -> tuple[int, float]:
                e, n = local(home, lat, lon)
                along, lateral = e * u[0] + n * u[1], side * (e * u[1] - n * u[0])
                return (0 if lateral >= 0 else 1) if along >= 0 else (2 if lateral < 0 else 3), along

            tangent = [(bearing + side * x) % 360 for x in (45.0, -45.0, -135.0, 135.0)]
            quadrants: list[list[Chain]] = [[], [], [], []]
            score = {}
            for c in pool:
                q, along = frame(c.lat, c.lon)
                quadrants[q].append(c)
                score[c.id] = along / reach + 0.5 * alike(course(home, (c.lat, c.lon)), tangent[q]) + 0.1 * ((c.reward - low) / (high - low) if high > low else 0.0)
            options = [[*sorted(quadrants[q], key=lambda c: (-score[c.id], c.id))[: rules.per_quadrant], None] for q in range(4)]
            by_quadrant = defaultdict(list)
            for i in sorted(roads, key=lambda i: (-self.count[i], i)):
                by_quadrant[frame(self.middle[0][i], self.middle[1][i])[0]].append(i)
            for combo in product(*options):
                picked = [c for c in combo if c is not None]
                if not picked or any(not self.separated(a, b, apart) for k, a in enumerate(picked) for b in picked[:k]):
                    continue
                anchors: list[Chain | None] = [None if c is None else self.twin(c, tangent[q], quadrants[q]) for q, c in enumerate(combo)]
                chosen = [a for a in anchors if a is not None]
                for q in range(4):
                    if anchors[q] is None:
                        stand_in = next((c for c in map(self.road_chain, [-q - 1] * len(by_quadrant[q]), by_quadrant[q]) if alike(self.heading_of(c), tangent[q]) >= cone and all(self.separated(c, x, apart) for x in chosen)), None)
                        if stand_in:
                            anchors[q] = stand_in
                            chosen.append(stand_in)
                loop = [origin, *[a for a in anchors if a is not None and a.id not in (origin.id, at_home.id)]]
                self.fill(loop, [c for c in pool if c.id not in {x.id for x in loop}], chosen, target, apart, cone)
                key = tuple(sorted({c.id for c in loop}))
                if len(key) > 1 and key not in found:
                    line = sum(metres(a.lat, a.lon, b.lat, b.lon) for a, b in zip(loop, loop[1:] + loop[:1]))
                    distinct = {c.id: c for c in loop}.values()
                    found[key] = loop, line * rules.detour + sum(c.length for c in distinct), sum(c.reward for c in distinct)
        return sorted(found.values(), key=lambda x: (-x[2], [c.id for c in x[0]]))

    def twin(self, c: Chain, bearing: float, pool: list[Chain]) -> Chain:
        """The corridor's twin of the same group in the quadrant if it runs better along the arc."""
        other = next((x for x in pool if x.id != c.id and x.group == c.group), None)
        own, its = self.heading_of(c), self.heading_of(other) if other else None
        return other if own is not None and its is not None and alike(its, bearing) > alike(own, bearing) else c

    def road_chain(self, key: int, i: int) -> Chain:
        g = self.g
        return Chain(key, g.froms[i], g.tos[i], self.lengths[i], self.reward[i], float(self.middle[0][i]), float(self.middle[1][i]), key)

    def fill(self, loop: list[Chain], pool: list[Chain], chosen: list[Chain], target: float, apart: float, cone: float) -> None:
        """Put the most rewarding fitting corridor into the largest gap until the loop is long enough."""
        while len(loop) > 1 and pool:
            gaps = [self.gap(a, b) for a, b in zip(loop, loop[1:] + loop[:1])]
            if sum(c.length for c in loop) + sum(gaps) >= self.rules.fill * target:
                return
            k = gaps.index(max(gaps))
            good = [c for c in pool if self.fits(c, loop[k], loop[(k + 1) % len(loop)], chosen, apart, cone)]
            if not good:
                return
            best = max(good, key=lambda c: (c.reward, -c.id))
            loop.insert(k + 1, best)
            pool.remove(best)
            chosen.append(best)

    # From corridors to roads.

    def refine(self, loop: list[Chain], close: bool) -> list[int] | None:
        """Roads from corridor to corridor: shortest ones, dear where taken before and off the ring; then a richer way within the budget."""
        stops = [n for c in loop for n in (c.entry, c.exit)] + ([loop[0].entry] if close else [])
        hull = Hull.build([self.g.at[n] for n in stops if n in self.g.at] + [(c.lat, c.lon) for c in loop])
        factor = hull.factors(*self.middle) if hull else np.ones(len(self.lengths))
        weight, taken, path = (self.g.length * factor).tolist(), set(), []
        plain = weight[:]
        for k, (a, b) in enumerate(zip(stops, stops[1:])):
            if a == b:
                continue
            way = self.shortest(a, b, weight, turning=k % 2 == 1)
            if way is None:
                return None
            rich = self.richest(a, b, factor, sum(self.lengths[i] for i in way) * self.rules.reward_budget, taken)
            if rich and sum(self.reward[i] for i in rich) > sum(self.reward[i] for i in way):
                way = rich
            path += way
            fresh = self.with_reverse(way) - taken
            for i in fresh:
                weight[i] = plain[i] * self.rules.reuse
            taken |= fresh
        return path or None

    def popular(self, start: int, goals: list[int], weight: list[float], inside: np.ndarray | None = None) -> list[list[int]]:
        """Ways to some nodes on the most popular roads that give any, by falling shares of the highest count."""
        ok = np.ones(len(self.lengths), bool) if inside is None else inside
        top = max((c for c, x in zip(self.count, ok) if x), default=0.0)
        for share in self.rules.popularity:
            least = int(top * share)
            allowed = [bool(x) and c >= least for c, x in zip(self.count, ok)]
            ways = [w for w in (self.shortest(start, n, weight, allowed=allowed) for n in goals) if w]
            if ways:
                return ways
        return []

    def inside(self, south: float, north: float, west: float, east: float) -> np.ndarray:
        e = self.g.ends
        return ((e[:, 0] >= south) & (e[:, 0] <= north) & (e[:, 1] >= west) & (e[:, 1] <= east)) | ((e[:, 2] >= south) & (e[:, 2] <= north) & (e[:, 3] >= west) & (e[:, 3] <= east))

    def around(self, places: list[tuple[float, float]]) -> np.ndarray:
        lats, lons, pad = [p[0] for p in places], [p[1] for p in places], self.rules.exit_half_m / METRES_PER_DEGREE
        wide = pad / math.cos(math.radians(places[0][0]))
        return self.inside(min(lats) - pad, max(lats) + pad, min(lons) - wide, max(lons) + wide)

    def exit_leg(self, home: tuple[float, float], target: float, bearing: float | None) -> tuple[list[int], Chain, float] | None:
        """(roads from home, corridor they lead to, what is left of the target), or None to begin at home."""
        rules, node = self.rules, min(self.g.at, key=lambda n: (metres(*self.g.at[n], *home), n))
        far = {c.id: metres(*home, c.lat, c.lon) for c in self.chains.values()}
        ready = [c for c in self.chains.values() if rules.exit_m[0] <= far[c.id] <= rules.exit_m[1] and (bearing is None or alike(course(home, (c.lat, c.lon)), bearing) >= math.cos(math.radians(45)) - 1e-12)]
        ready = sorted(ready, key=lambda c: (far[c.id], c.id))[: rules.exit_candidates]
        if not ready:
            way, entry = self.walk(node, home, target * rules.walk_share, bearing)
        else:
            if far[ready[0].id] > target * rules.exit_cap:
                return None
            ways = self.popular(node, [c.entry for c in ready], self.lengths, self.around([home]))
            if not ways:
                return None
            way = max(ways, key=lambda w: (sum(self.count[i] for i in w) / max(sum(self.lengths[i] for i in w), 1e-9), [-i for i in w]))
            entry = self.g.tos[way[-1]]
        goal = next((c for c in self.chains.values() if c.entry == entry), None) if way else None
        if goal is None or goal.id == min(self.chains.values(), key=lambda c: (far[c.id], c.id)).id:
            return None
        left = target - sum(self.lengths[i] for i in way) - far[goal.id] * rules.detour
        return (way, goal, left) if left >= rules.least_budget * target else None

    def walk(self, node: int, home: tuple[float, float], budget: float, bearing: float | None) -> tuple[list[int], int | None]:
        """The most ridden roads from home, never to a node twice, within a budget; and the entry of the corridor nearest to their end."""
        way, seen, used = [], {node}, 0.0
        while used < budget:
            out = [i for i in self.g.out.get(node, ()) if self.count[i] > 0 and self.g.tos[i] not in seen]
            if bearing is not None and len(out) > 1:
                out = [i for i in out if alike(course(home, self.g.at[self.g.tos[i]]), bearing) >= -1e-12] or out
            if not out:
                break
            best = max(out, key=lambda i: (self.count[i], -i))
            if used + self.lengths[best] > budget:
                break
            way.append(best)
            node, used = self.g.tos[best], used + self.lengths[best]
            seen.add(node)
        if not way or not self.chains:
            return way, None
        return way, min(self.chains.values(), key=lambda c: (metres(*self.g.at[node], c.lat, c.lon), c.id)).entry

    def return_leg(self, last: Chain, home: tuple[float, float], exit_way: list[int]) -> list[int]:
        node, weight = min(self.g.at, key=lambda n: (metres(*self.g.at[n], *home), n)), self.lengths[:]
        for i in self.with_reverse(exit_way):
            weight[i] *= self.rules.reuse
        ways = self.popular(last.exit, [node], weight, self.around([(last.lat, last.lon), home]))
        return ways[0] if ways else []

    # Judging.

    def shape(self, path: list[int]) -> tuple[float, float, float]:
        """(length, repeat fraction, compactness) of a route of roads."""
        g, total = self.g, sum(self.lengths[i] for i in path)
        passages, at = defaultdict(list), 0.0
        for i in path:
            n = self.lengths[i]
            passages[tuple(sorted((g.froms[i], g.tos[i])))].append((at + n <= self.rules.stem_m or at >= total - self.rules.stem_m, n))
            at += n
        again = sum(sum(n for _, n in p[1:]) for p in passages.values() if len(p) > 1 and not all(x for x, _ in p))
        places = np.array([g.at[g.froms[i]] for i in path] + [g.at[g.tos[path[-1]]]])
        x, y = local(tuple(places[0]), places[:, 0], places[:, 1])
        area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 if len(places) > 2 else 0.0
        return total, again / total if total else 0.0, 4 * math.pi * area / total**2 if total else 0.0

    def plan(self, home: tuple[float, float], target: float, bearing: float | None = None, max_m: float | None = None) -> dict:
        """The best loop of the strictest tier that has one in its band, or the reason why there is none."""
        rules = self.rules
        out = self.exit_leg(home, target, bearing) if self.chains and self.g.at else None
        goal, start = (out[2], out[1].id) if out else (target, None)
        refined: dict[tuple, tuple] = {}
        calibrated = False
        for tier, name in enumerate(TIERS if self.chains and self.g.at else ()):
            cone, reach, apart, band = (pair[tier >= k] for k, pair in enumerate((rules.cone, rules.reach, rules.apart_m, rules.band), 1))
            search = lambda: self.coarse(home, goal, reach, apart, cone, bearing, start)[: rules.refined]  # noqa: E731, B023
            loops = search()
            if not calibrated:
                for loop, estimate, _ in loops:
                    way = self.refine(loop, out is None) if estimate > 0 else None
                    if way:
                        calibrated, ratio = True, sum(self.lengths[i] for i in way) / estimate
                        if abs(ratio - 1) > rules.calibration:
                            goal /= ratio
                            loops = search()
                        break
            for loop, _, reward in loops:
                key = tuple(c.id for c in loop)
                if key in refined:
                    continue
                way = self.refine(loop, out is None)
                if way:
                    if out:
                        way = out[0] + way + self.return_leg(loop[-1], home, out[0])
                    length, repeat, compact = self.shape(way)
                    refined[key] = length, reward, repeat, compact, way
            in_band = lambda r: target * (1 - band) <= r[0] <= target * (1 + band)  # noqa: E731, B023
            good = lambda r: r[3] >= rules.least_compactness and r[2] <= rules.most_repeat
            order = sorted(refined.items(), key=lambda x: (not in_band(x[1]), not good(x[1]), -x[1][1], x[0]))
            refined = dict(order[: rules.kept])
            fit = [r for r in refined.values() if in_band(r)]
            if fit:
                best = max([r for r in fit if good(r)], key=lambda r: r[1], default=None) or max(fit, key=lambda r: r[3] - r[2])
                nodes = [self.g.froms[i] for i in best[4]] + [self.g.tos[best[4][-1]]]
                return {"tier": name, "length_m": best[0], "reward": best[1], "repeat_fraction": best[2], "compactness": best[3], "deviation_percent": (best[0] - target) / target * 100, "nodes": nodes, "reason": None}
        reason = f"{target / 1000:.0f} km are more than the {max_m / 1000:.0f} km within reach" if max_m is not None and target > max_m else "no loop of this length starts here"
        return {"tier": None, "length_m": None, "reward": None, "repeat_fraction": None, "compactness": None, "deviation_percent": None, "nodes": None, "reason": reason}


PLANNED = "plan_id long, tier string, length_m double, reward double, repeat_fraction double, compactness double, deviation_percent double, nodes array<long>, reason string"


def planned_loops(plans: DataFrame, corridors: DataFrame, edges: DataFrame, nodes: DataFrame, turns: DataFrame | None = None, rules: LoopRules = LoopRules(), max_m: float | None = None) -> DataFrame:
    """One row a plan (plan_id, lat, lon, target_m, bearing or null): the loop, or the reason why there is none.

    Corridors: (id, entry_node, exit_node, length_m, reward, lat, lon, group_id, nodes). Edges: (from_node, to_node,
    length_m, reward, count). Turns, where measured: (from_node, junction, to_node, hazard, stop, braking, energy); they
    reach a plan with the road that they begin on. A plan without roads in its box has no row.
    """
    boxed = box_around(plans.withColumn("_pad", F.greatest(F.col("target_m") * rules.reach[1] + 1500.0, F.lit(rules.exit_m[1] + rules.exit_half_m))), ["lat"], ["lon"], 0.0)
    boxed = boxed.selectExpr("plan_id", f"south - _pad / {METRES_PER_DEGREE} as south", f"north + _pad / {METRES_PER_DEGREE} as north", f"west - _pad / {METRES_PER_DEGREE} / cos(radians(lat)) as west", f"east + _pad / {METRES_PER_DEGREE} / cos(radians(lat)) as east")
    rewards = edges.selectExpr("from_node", "to_node", "cast(reward as double) as reward", "cast(count as double) as count")
    if turns is not None:
        by_road = turns.groupBy("from_node", F.col("junction").alias("to_node")).agg(F.collect_list(F.struct(F.col("to_node").alias("onto"), "hazard", "stop", "braking", "energy")).alias("turns"))
        rewards = rewards.join(by_road, ["from_node", "to_node"], "left")
    roads = roads_in_boxes(boxed, located(edges, nodes), "plan_id").join(rewards, ["from_node", "to_node"]).join(plans.selectExpr("plan_id", "lat", "lon", "target_m", "cast(bearing as double) as bearing"), "plan_id")
    spots = corridors.selectExpr("id as from_node", "id as to_node", "length_m", "lat as alat", "lon as alon", "lat as blat", "lon as blon", "entry_node", "exit_node", "reward", "group_id", "nodes")
    near = roads_in_boxes(boxed, spots, "plan_id").withColumnRenamed("plan_id", "of_plan")
    names = [c.split(" ")[0] for c in PLANNED.split(", ")]

    def run(key: tuple, group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame(columns=names)
        p = group.iloc[0]
        chains = [Chain(int(c.from_node), int(c.entry_node), int(c.exit_node), float(c.length_m), float(c.reward), float(c.alat), float(c.alon), int(c.group_id), [int(n) for n in c.nodes]) for c in found.itertuples()]
        known = {}
        if "turns" in group:
            for r in group.itertuples():
                for t in r.turns if isinstance(r.turns, (list, np.ndarray)) else ():
                    known[(r.from_node, r.to_node, t["onto"])] = (t["hazard"], t["stop"], t["braking"], t["energy"])
        bearing = None if p.bearing is None or p.bearing != p.bearing else float(p.bearing)
        planner = LoopPlanner(group.drop(columns=["turns"], errors="ignore"), chains, known, rules)
        return pd.DataFrame([{"plan_id": key[0], **planner.plan((float(p.lat), float(p.lon)), float(p.target_m), bearing, max_m)}], columns=names)

    return roads.groupBy("plan_id").cogroup(near.groupBy("of_plan")).applyInPandas(run, PLANNED)
