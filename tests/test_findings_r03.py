"""One small test for each finding of the round's report that changed code."""

import heapq
import itertools
import math
import random

import pandas as pd
import pytest


def _near(seed, n=7):
    """Roads of a bent grid with lengths that often tie, both ways, some missing; with rewards."""
    r = random.Random(seed)
    at = {i: (50 + i // n * 1e-2 + r.random() * 2e-3, 6 + i % n * 1.5e-2 + r.random() * 2e-3) for i in range(n * n)}
    rows = [(a, b, float(r.choice((1100, 1200, 1300))), *at[a], *at[b], float(r.randrange(9))) for a in at for b in (a + n, a - n, *([a + 1] if a % n < n - 1 else []), *([a - 1] if a % n else [])) if b in at and r.random() < 0.93]
    return pd.DataFrame(rows, columns="from_node to_node length_m alat alon blat blon reward".split())


def _cost(roads, start, goal, own, dear):
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        for a, b, i, size in roads.get(n, ()):
            if own[i] and d + size * (5 if i in dear else 1) < best.get(b, math.inf):
                best[b] = d + size * (5 if i in dear else 1)
                heapq.heappush(heap, (best[b], b))
    return best.get(goal)


def test_f1_ways_on_some_roads_with_some_dear_are_shortest():
    from cadenza.operators import paths

    for seed in range(6):
        r, block = random.Random(seed), paths.RoundTrips(_near(seed), 5.0)
        roads = {}
        for i, (a, b, size) in enumerate(zip(block.froms, block.tos, block.g.lengths)):
            roads.setdefault(a, []).append((a, b, i, size))
        for _ in range(150):
            own, dear = bytes(int(r.random() < 0.9) for _ in block.froms), frozenset(i for i in range(len(block.froms)) if r.random() < r.choice((0, 0.2)))
            a, b = r.sample(range(len(block.at)), 2)
            found, straight = block.way(a, b, own, 0.5, dear), block.straight(a, b, own)
            want = _cost(roads, a, b, own, dear)
            assert (found is None) == (want is None)
            if found:
                assert block.froms[found[0]] == a and block.tos[found[-1]] == b and all(own[i] for i in found) and all(block.tos[i] == block.froms[j] for i, j in itertools.pairwise(found))
                assert math.isclose(sum(block.g.lengths[i] * (5 if i in dear else 1) for i in found), want)
            if straight:
                assert straight == block.way(a, b, own, 0.5, frozenset())


def test_f1_plans_of_a_block_get_the_loops_that_each_gets_alone(spark):
    from cadenza.operators import paths

    near = _near(9, 12)
    ends = pd.concat([near[[f"{e}_node", f"{x}lat", f"{x}lon"]].set_axis(["id", "lat", "lon"], axis=1) for e, x in (("from", "a"), ("to", "b"))]).drop_duplicates("id")
    nodes, edges = spark.createDataFrame(ends), spark.createDataFrame(near[["from_node", "to_node", "length_m", "reward"]])
    plans = nodes.selectExpr("id as plan_id", "lat", "lon", "14e3 as target_m")
    ask = lambda p: [tuple(r) for r in paths.loops(p, edges.drop("reward"), nodes, edges).orderBy("plan_id", "place").collect()]
    together, alone = ask(plans), [r for k in (0, 65, 143) for r in ask(plans.where(f"plan_id = {k}"))]
    assert len({r[0] for r in together}) > 100 and [r for r in together if r[0] in (0, 65, 143)] == alone and alone
    lengths = near.set_index(["from_node", "to_node"])["length_m"].to_dict()
    for r in alone:
        assert r[6][0] == r[6][-1] == r[0] and r[2] == sum(lengths[x] for x in itertools.pairwise(r[6]))


def test_f4_means_of_an_interval_on_half_a_tenth(spark):
    import datetime
    from fractions import Fraction

    from cadenza.operators import metrics

    at = datetime.datetime(2026, 1, 1)
    # An interval begins with the power, at 14, and has 21 speeds; 265.65 / 21 is below 12.65 in doubles.
    means = [f"{k // 100}.{k % 100:02}" for k in range(1205, 5005, 50)] + ["12.65", "9.231", "9.333"]
    rows = [(s, i, at + datetime.timedelta(seconds=i), 50 + i * 1e-4, 6.0, float(v), 0 if i < 14 else 2400 + s % 7) for s, v in enumerate(means) for i in range(35)]
    points = spark.createDataFrame(rows, "session_id long, idx int, ts timestamp, lat double, lon double, speed_kmh double, power int")
    got = metrics.intervals(points, least=20).collect()
    assert len(got) == len(means) and {(g["start_idx"], g["end_idx"]) for g in got} == {(14, 34)}
    up = lambda x: float(Fraction((x * 20 + 1) // 2, 10))
    for g in got:
        mean = Fraction(means[g["session_id"]])
        assert (g["speed_kmh"], g["normalized_kmh"]) == (up(mean), up(mean * 150 / g["avg_power"]))


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_f2_f3_means_of_a_group_on_half_a_digit(spark, way):
    from cadenza.operators import history
    from cadenza.plans import history_queries as q

    # 2338.00161 / 12 and 5455.44867 / 28 lie on half of the sixth digit; the quotients of doubles lie below it.
    rides = [(1, 2338.00161), *[(1, 0.0)] * 11, (2, 5455.44867), *[(2, 0.0)] * 27, (3, 0.3), *[(3, 0.0)] * 2, (4, 0.1)]
    df = spark.createDataFrame(rides, "rider_id long, distance_km double")
    got = history.sorted_groups(spark.sql(q.FAIR.format(t="{s}"), s=df), f"distance_{way}").selectExpr("group_id", "round(distance, 6) as distance", "place").collect()
    by = {r["group_id"]: (r["distance"], r["place"]) for r in got}
    assert by[1][0] == 194.833468 and by[2][0] == 194.837453
    assert by[3][0] == by[4][0] == 0.1 and by[3][1] < by[4][1]
