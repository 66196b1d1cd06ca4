"""Path search against plain searches on random graphs, map matching and loops on a grid."""

import math
import random

import pandas as pd
import pytest

from cadenza.operators import paths as p
from cadenza.operators import tracks as t
from cadenza.plans import path_queries as q
from cadenza.plans.registry import QUERIES


def random_roads(seed, n=40):
    r = random.Random(seed)
    at = {i: (50 + r.random() / 10, 6 + r.random() / 10) for i in range(n)}
    rows = [(a, b, p.metres(*at[a], *at[b]) * r.uniform(0.7, 2), *at[a], *at[b]) for a in at for b in r.sample(sorted(at), 3) if a != b]
    return pd.DataFrame(rows, columns="from_node to_node length_m alat alon blat blon".split())


def all_distances(roads, start):
    d = {start: 0.0}
    for _ in range(60):
        for a, b, n in roads[["from_node", "to_node", "length_m"]].itertuples(index=False):
            if a in d and d[a] + n < d.get(b, math.inf):
                d[b] = d[a] + n
    return d


@pytest.mark.parametrize("seed", range(8))
def test_path_is_a_shortest(seed):
    roads = random_roads(seed)
    g, want = p.Graph(roads), all_distances(roads, 0)
    for goals in ({5}, {7, 9, 11}, {39}):
        found = g.path(0, goals)
        least = min(want.get(x, math.inf) for x in goals)
        if found is None:
            assert least == math.inf
        else:
            assert g.a[found[0]] == 0 and g.b[found[-1]] in goals and all(g.b[i] == g.a[j] for i, j in zip(found, found[1:]))
            assert math.isclose(g.length[found].sum(), least)


def grid(spark, n=8):
    nodes = [(r * n + c, 50.6 + r * 0.01, 5.9 + c * 0.01) for r in range(n) for c in range(n)]
    edges = [(a, b, float(700 + (a * 31 + b * 17) % 400)) for a, _, _ in nodes for b in (a + n, a - n, *([a + 1] if a % n < n - 1 else []), *([a - 1] if a % n else [])) if 0 <= b < n * n]
    return spark.createDataFrame(edges, "from_node long, to_node long, length_m double"), spark.createDataFrame(nodes, "id long, lat double, lon double")


def test_way_home(spark):
    edges, nodes = grid(spark)
    trips = spark.createDataFrame([(1, 50.6, 5.9001, 50.65, 5.95), (2, 50.6, 5.9001, 40.0, 5.95), (3, 50.605, 5.905, 50.65, 5.95)], "trip_id long, lat double, lon double, home_lat double, home_lon double")
    rows = p.way_home(trips, edges, nodes).orderBy("seq").collect()
    assert {r.trip_id for r in rows} == {1} and rows[-1].to_node == 45
    frame = edges.toPandas()
    start = rows[0].from_node
    assert math.isclose(sum(r.length_m for r in rows), all_distances(frame, start)[45])


def test_map_match_follows_the_roads(spark):
    edges, nodes = grid(spark)
    track = [(1, i, 50.6 + min(i, 30) * 1e-3, 5.92 + max(0, i - 30) * 1e-3) for i in range(61)] + [(2, i, 40.0 + i * 1e-3, 5.92) for i in range(9)]
    pts = spark.createDataFrame(track, "session_id long, idx long, lat double, lon double")
    whole = pts.selectExpr("session_id", "idx", "0 as chunk")
    found = p.map_match(pts, whole, edges, nodes).orderBy("seq").collect()
    assert [(r.session_id, r.from_node, r.to_node) for r in found] == [(1, a, b) for a, b in [(2, 10), (10, 18), (18, 26), (26, 27), (27, 28), (28, 29)]]
    share = {r.session_id: r.percent for r in p.match_coverage(pts, whole, p.map_match(pts, whole, edges, nodes), "1e0").collect()}
    assert share == {1: 100.0, 2: 0.0}


def test_loops_return_home(spark):
    edges, nodes = grid(spark)
    plans = spark.createDataFrame([(7, 50.63, 5.93, 14000.0)], "plan_id long, lat double, lon double, target_m double")
    rewards = edges.selectExpr("from_node", "to_node", "cast(from_node % 5 as double) as reward")
    rows = p.loops(plans, edges, nodes, rewards).orderBy("place").collect()
    known = {(r.from_node, r.to_node) for r in edges.collect()}
    assert rows and [r.place for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:
        assert r.nodes[0] == r.nodes[-1] == 27 and set(zip(r.nodes, r.nodes[1:])) <= known and 0 <= r.repeat_fraction < 1 and 0 <= r.compactness <= 1
    off = [abs(r.length_m / 14000 - 1) for r in rows]
    tiers = [0 if o <= 0.15 else 1 if o <= 0.3 else 2 for o in off]
    assert tiers == sorted(tiers)
    assert [tuple(r) for r in p.loops(plans, edges.repartition(7), nodes, rewards).orderBy("place").collect()] == [tuple(r) for r in rows]


def test_map_match_query_takes_whole_rides(spark):
    edges, nodes = grid(spark, 20)
    pts = spark.range(1600).selectExpr("1L as session_id", "id as idx", "5078e-2 + id * 1e-4 as lat", "607e-2 as lon")
    found = q._match(pts, edges, nodes).collect()
    assert max(r.to_node // 20 for r in found) >= 18 and {r.chunk for r in found} == {0, 1, 2, 3}


def test_way_home_query_plans_a_trip_for_every_node(spark):
    _, nodes = grid(spark, 20)
    assert sorted(r.trip_id for r in q._trips(nodes).collect()) == list(range(400 - 43))


def test_plan_loop_query_plans_for_every_node(spark):
    found = {r.plan_id for r in QUERIES["plan_loop"](spark, "/root/testdata/sf0.001").select("plan_id").distinct().collect()}
    assert len(found) > 150 and len({i % 211 for i in found}) > 150
