"""Pairs of tracks that cover each other: blocks of tracks that lie together meet in one task, which compares all of them at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import geo
from cadenza.plans.lineage import store

METRES = geo.EARTH_RADIUS_M * np.pi / 180


def _near(lat1, lon1, lat2, lon2) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _flat(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All values of arrays, and which array each is from."""
    values = [np.asarray(x, float) for x in arrays]
    return (np.concatenate(values) if values else np.zeros(0)), np.repeat(np.arange(len(values)), [len(x) for x in values])


def hits(samples: pd.DataFrame, points: pd.DataFrame, radius_m: float) -> np.ndarray:
    """For each row of ``samples`` (s_lat, s_lon) and of ``points`` (p_lat, p_lon): how many samples have a point within the radius.

    Fine cells settle what is surely near or surely far, a bit for each track; the rest is measured.
    """
    (sy, s_of), (sx, _) = _flat(samples["s_lat"]), _flat(samples["s_lon"])
    (py, p_of), (px, _) = _flat(points["p_lat"]), _flat(points["p_lon"])
    count = np.zeros((len(samples), len(points)), np.int64)
    pad = radius_m * 1.001 / METRES
    known, there = np.isfinite(sy) & np.isfinite(sx), np.isfinite(py) & np.isfinite(px)
    sy, sx, s_of, py, px, p_of = sy[known], sx[known], s_of[known], py[there], px[there], p_of[there]
    if not len(sy) or not len(py):
        return count
    low, high = max(sy.min(), py.min()) - pad, min(sy.max(), py.max()) + pad
    ks, kp = (sy >= low) & (sy <= high), (py >= low) & (py <= high)
    sy, sx, s_of, py, px, p_of = sy[ks], sx[ks], s_of[ks], py[kp], px[kp], p_of[kp]
    if not len(sy) or not len(py):
        return count
    lats = np.abs(np.concatenate([sy, py]))
    least, most = max(np.cos(np.radians(lats.max())), 1e-9), max(np.cos(np.radians(lats.min())), 1e-9)
    fine = radius_m / 8
    step_y, step_x = fine / METRES, fine / METRES / least
    cells = lambda y, x: np.floor(y / step_y).astype(np.int64) * (1 << 31) + np.floor(x / step_x).astype(np.int64)
    own, s_cell = np.unique(cells(sy, sx), return_inverse=True)
    there, p_cell = np.unique(cells(py, px), return_inverse=True)
    bits = np.zeros((len(there), (len(points) + 7) // 8), np.uint8)
    np.bitwise_or.at(bits, (p_cell, p_of >> 3), (128 >> (p_of & 7)).astype(np.uint8))
    sure, maybe, reach = np.zeros((len(own), bits.shape[1]), np.uint8), np.zeros((len(own), bits.shape[1]), np.uint8), 10
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            farthest = fine * np.hypot(abs(i) + 1, (abs(j) + 1) * most / least)
            if fine * np.hypot(max(abs(i) - 1, 0), max(abs(j) - 1, 0)) > radius_m * 1.001:
                continue
            at = np.searchsorted(there, own + i * (1 << 31) + j)
            found = np.flatnonzero((at < len(there)) & (there[np.minimum(at, len(there) - 1)] == own + i * (1 << 31) + j))
            (sure if farthest < radius_m * 0.999 else maybe)[found] |= bits[at[found]]
    maybe &= ~sure
    by_track = np.argsort(s_of, kind="stable")
    for part in np.array_split(by_track, max(1, len(by_track) * len(points) // 30_000_000)):
        if len(part):
            tracks, first = np.unique(s_of[part], return_index=True)
            count[tracks] += np.add.reduceat(np.unpackbits(sure[s_cell[part]], axis=1, count=len(points)), first, axis=0, dtype=np.int64)
    open_cells = np.flatnonzero(maybe.any(1))
    if not len(open_cells):
        return count
    flags = np.unpackbits(maybe[open_cells], axis=1, count=len(points)).astype(bool)
    row = np.full(len(own), -1)
    row[open_cells] = np.arange(len(open_cells))
    asked = np.flatnonzero(row[s_cell] >= 0)
    order = np.lexsort((py, p_of))
    begin = np.searchsorted(p_of[order], np.arange(len(points) + 1))
    for t in np.flatnonzero(flags.any(0)):
        mine = order[begin[t] : begin[t + 1]]
        s = asked[flags[row[s_cell[asked]], t]]
        a, b = np.searchsorted(py[mine], sy[s] - pad), np.searchsorted(py[mine], sy[s] + pad, side="right")
        n = b - a
        which = np.repeat(np.arange(len(s)), n)
        p = mine[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
        near = np.unique(which[_near(sy[s][which], sx[s][which], py[p], px[p]) <= radius_m])
        np.add.at(count[:, t], s_of[s[near]], 1)
    return count


def forest(linked: np.ndarray) -> np.ndarray:
    """Links (i, j) that join the same nodes as a symmetric matrix of links, as few as can be."""
    rest, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if rest[start]:
            rest[start], todo = False, [start]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(linked[i] & rest)
                rest[new] = False
                out.extend((i, int(j)) for j in new)
                todo.extend(new.tolist())
    return np.array(out, np.int64).reshape(-1, 2)


def mutual_hits(tracks: DataFrame, radius_m: float, alike, least: float | None = None, digits: int | None = None, block: int = 512) -> DataFrame:
    """(a, b, hits_a, n_a, hits_b, n_b), a < b: pairs of tracks of which a sample of one is near a point of the other.

    tracks: (id, level, own, lat, lon, length_m, cy, cx, s_lat, s_lon, p_lat, p_lon), arrays of samples and of points; pairs
    are sought on a level in neighbouring cells, one of them on its ``own`` level, and must be ``alike`` (a function of two
    frames, to a matrix). With ``least``, only links by that share (to ``digits``) of either, and of these only enough to join the same groups.
    """
    tracks = store(tracks)
    sizes = tracks.groupBy("level", "cy", "cx").agg(F.expr(f"cast(ceil(count(1) / {block}) as long)").alias("parts"))
    placed = store(tracks.join(sizes, ["level", "cy", "cx"]).withColumn("block", F.expr("struct(level, cy, cx, pmod(xxhash64(id), parts) as part)")).drop("parts"))
    blocks = placed.select("block", "level", "cy", "cx").distinct()
    around = blocks.selectExpr("block as x", "level", "cy", "cx").withColumn("_c", F.explode(F.expr("transform(sequence(0, 8), i -> struct(cy + i div 3 - 1 as cy, cx + i % 3 - 1 as cx))"))).selectExpr("x", "level", "_c.cy as cy", "_c.cx as cx")
    pairs = store(around.join(blocks.withColumnRenamed("block", "y"), ["level", "cy", "cx"]).where("x <= y").select("x", "y"))
    rows = placed.drop("level", "cy", "cx")
    sides = pairs.selectExpr("x", "y", "inline(CASE WHEN x = y THEN array(struct(0 as side, x as block)) ELSE array(struct(0 as side, x as block), struct(1 as side, y as block)) END)")
    sent = sides.join(rows, "block").drop("block")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        one = group[group["side"] == 0].reset_index(drop=True)
        two = group[group["side"] == 1].reset_index(drop=True)
        same = group["x"].iloc[0] == group["y"].iloc[0]
        two = one if same else two
        names = ["a", "b", "hits_a", "n_a", "hits_b", "n_b"]
        ok = alike(one, two) & (one["own"].to_numpy()[:, None] | two["own"].to_numpy()[None, :]) & (one["id"].to_numpy()[:, None] != two["id"].to_numpy()[None, :])
        if same:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        if not ok.any():
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        there = hits(one, two, radius_m)
        back = there.T if same else hits(two, one, radius_m).T  # in a block with itself, the other way is the other half
        n1, n2 = one["s_lat"].map(len).to_numpy(np.int64), two["s_lat"].map(len).to_numpy(np.int64)
        ok &= (there > 0) | (back > 0)
        if least is not None:
            shares = np.maximum(there / n1[:, None], back / n2[None, :])
            ok &= (shares if digits is None else np.floor(shares * 10.0**digits + 0.5) / 10.0**digits) >= least
            if same:
                edges = forest(ok | ok.T)
            else:
                edges = forest(np.block([[np.zeros((len(one), len(one)), bool), ok], [ok.T, np.zeros((len(two), len(two)), bool)]]))
                edges = np.sort(edges, axis=1) - [0, len(one)]
            i, j = edges.T
        else:
            i, j = np.nonzero(ok)
        a, b = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
        turn = a > b
        return pd.DataFrame(dict(zip(names, (np.where(turn, b, a), np.where(turn, a, b), np.where(turn, back[i, j], there[i, j]), np.where(turn, n2[j], n1[i]), np.where(turn, there[i, j], back[i, j]), np.where(turn, n1[i], n2[j])))))

    return sent.groupBy("x", "y").applyInPandas(compare, "a long, b long, hits_a long, n_a long, hits_b long, n_b long")


def _arrays(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(id, <name>_lat, <name>_lon): each track's places as arrays."""
    per = rows.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(order, "lat", "lon"))).alias("p"))
    return per.selectExpr("id", f"transform(p, q -> q.lat) as {name}_lat", f"transform(p, q -> q.lon) as {name}_lon")


def mutual_coverage(summaries: DataFrame, samples: DataFrame, points: DataFrame, radius_m: float, apart_m: float, max_gap_m: float = 7000.0, max_ratio: float = 0.15, least: float | None = None, top_lat: float = 80.0) -> DataFrame:
    """``mutual_hits`` of rides whose centroids are less than ``apart_m`` apart and whose lengths are alike (session_id, lat, lon, length_m; samples by k, points by idx)."""
    from cadenza.operators.tracks import _cells

    placed = _cells(summaries, apart_m, top_lat).selectExpr("session_id as id", "0 as level", "true as own", "lat", "lon", "length_m", "cy", "cx")
    # Stored, since Spark fails to zip the parts of a union whose sides have unlike numbers of them.
    both = placed.join(_arrays(store(samples), "session_id", "k", "s"), "id").join(_arrays(points, "session_id", "idx", "p"), "id")

    def alike(one, two):
        x, y = (f["length_m"].to_numpy() for f in (one, two))
        close = _near(*(f[c].to_numpy()[k] for f, k in ((one, np.s_[:, None]), (two, np.s_[None, :])) for c in ("lat", "lon"))) < apart_m
        return close & (np.abs(x[:, None] - y) <= np.minimum(max_gap_m, max_ratio * np.minimum(x[:, None], y)))

    return mutual_hits(both, radius_m, alike, least, digits=6)


def interval_hits(points: DataFrame, sizes: DataFrame, radius_m: float, tolerance_m: float, least: float | None = None) -> DataFrame:
    """``mutual_hits`` of intervals (interval_id, idx, lat, lon; sizes: interval_id, distance_m) alike in length.

    A level holds lengths up to twice its least, and those that ``tolerance_m`` brings down to it; its cells are wide enough
    that intervals with a near point lie in neighbouring ones.
    """
    arrays = _arrays(points, "interval_id", "idx", "p")
    at = points.groupBy(F.col("interval_id").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    level = lambda m: f"cast(floor(log2(greatest({m}, 128e0))) as int)"
    t = sizes.selectExpr("interval_id as id", "distance_m as length_m").join(at, "id").join(arrays, "id")
    t = t.withColumn("_own", F.expr(level("length_m"))).withColumn("level", F.explode(F.expr(f"sequence({level(f'length_m - {geo.number(tolerance_m * 1.001)}')}, _own)"))).withColumn("own", F.expr("level = _own"))
    size = f"(2e0 * (pow(2e0, level + 1) + {geo.number(tolerance_m)}) + {geo.number(radius_m)})"
    t = t.withColumn("cy", F.expr(f"cast(floor(lat / ({size} / 111000e0)) as bigint)")).withColumn("cx", F.expr(f"cast(floor(lon / ({size} / {geo.metres_per_degree_lon('80e0')} * 1.01e0)) as bigint)"))
    t = t.selectExpr("id", "level", "own", "lat", "lon", "length_m", "cy", "cx", "p_lat as s_lat", "p_lon as s_lon", "p_lat", "p_lon")

    def alike(one, two):
        (a, b), pad = ((f["length_m"].to_numpy() for f in (one, two))), 2 * radius_m / 111000.0
        south, north = ([f["p_lat"].map(lambda x, way=way: way(np.asarray(x, float))).to_numpy(float) for f in (one, two)] for way in (np.fmin.reduce, np.fmax.reduce))
        return (np.abs(a[:, None] - b) <= tolerance_m) & (south[0][:, None] <= north[1] + pad) & (south[1][None, :] <= north[0][:, None] + pad)

    return mutual_hits(t, radius_m, alike, least, block=1024)
