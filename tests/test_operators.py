"""Golden cases, and set-based forms against sequential models on random data."""

import random

import pytest

from cadenza.operators import metrics as m
from cadenza.operators import tracks as t
from cadenza.operators.components import connected_components


def points(spark, rows):
    """rows: (power, altitude, heart_rate) at 1 Hz on one meridian."""
    data = [(1, i, float(i), 50.0 + i * 1e-4, 6.0, 20.0, p, h, a) for i, (p, a, h) in enumerate(rows)]
    df = spark.createDataFrame(data, "session_id long, idx long, elapsed_sec double, lat double, lon double, speed_kmh double, power int, heart_rate int, altitude double")
    return df.selectExpr("*", "timestamp_seconds(1700000000 + idx) as ts")


def test_average_heart_rate_rounds_half_up(spark):
    got = m.average_hr(points(spark, [(0, None, 120 + i) for i in range(10)])).first()
    assert got.avg_hr == 125


def test_best_power_window(spark):
    rows = [(100, None, None)] * 20 + [(400, None, None)] * 10 + [(100, None, None)] * 20
    assert m.best_power(points(spark, rows), 10).first().watts == 400.0


def test_all_zero_power_has_no_best(spark):
    assert m.best_power(points(spark, [(0, None, None)] * 30), 5).first().watts is None


def test_one_interval(spark):
    rows = [(100, None, None)] * 50 + [(310, None, None)] * 200 + [(100, None, None)] * 50
    found = m.intervals(points(spark, rows), ftp=300, least=120).collect()
    assert len(found) == 1 and 290 <= found[0].avg_power <= 330 and 180 <= found[0].end_idx - found[0].start_idx + 1 <= 220


@pytest.mark.parametrize("seed", range(3))
def test_elevation_gain_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    alts = [None if rng.random() < 0.1 else 100 + rng.uniform(-8, 8) for _ in range(200)]
    known = [a for a in alts if a is not None]
    low, gain = known[0], 0.0
    for a in known[1:]:
        if a < low:
            low = a
        elif a - low >= 3:
            gain, low = gain + a - low, a
    assert m.elevation_gain(points(spark, [(1, a, None) for a in alts])).first().elevation_gain_m == pytest.approx(gain, abs=1e-5)


@pytest.mark.parametrize("seed", range(3))
def test_sprints_match_a_loop(spark, seed):
    rng = random.Random(seed)
    power = [rng.choice([50, 500]) if rng.random() < 0.7 else 500 for _ in range(300)]
    want, start, last, below = [], None, -1, 0
    for i, p in enumerate([*power, 0, 0]):
        if p > 200:
            start, last, below = (i if start is None else start), i, 0
        elif start is not None:
            below += 1
            if below == 2:
                want.append((start, last - start + 1))
                start = None
    want = [w for w in want if 3 <= w[1] <= 30]
    got = sorted((r.start_idx, r.duration) for r in m.sprints(points(spark, [(p, None, None) for p in power]), 150, 200 / 150).collect())
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_polyline_of_the_format_description():
    assert [(round(a, 5), round(b, 5)) for a, b in t.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@")] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert t.decode_polyline("") == []
