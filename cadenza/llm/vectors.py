"""Nearest neighbours by randomly rotated one-bit codes: estimates with error bounds choose the vectors to rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.plans.lineage import materialize


@dataclass(frozen=True)
class VectorIndex:
    """``fit_rows`` bounds the sample that centroids are fitted on; every vector is indexed. ``chunk_rows``: vectors one
    task compares at a time; longer lists are dealt to several. ``epsilon``: width of the error bound in deviations."""

    k: int = 10
    fit_rows: int = 10_000
    max_lists: int = 1024
    list_rows: int = 400
    probe_share: float = 0.6
    min_probes: int = 32
    chunk_rows: int = 4096
    epsilon: float = 2.5
    seed: int = 11


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, n_lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:n_lists]]
    for _ in range(rounds):
        nearest = (((centroids * centroids).sum(1)) - 2 * sample @ centroids.T).argmin(1)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def encode(vectors: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit residuals, the residuals' lengths, and the inner products of unit and code."""
    rest = (vectors - centroid) @ turn
    length = np.sqrt((rest * rest).sum(1))
    unit = rest / np.where(length > 0, length, 1)[:, None]
    fit = np.abs(unit).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def distance_bounds(bits, length, fit, queries, centroid, turn, epsilon):
    """(lower, upper) bounds of squared distances, queries by vectors, from the codes alone."""
    dim = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    rest = (queries - centroid) @ turn
    q_length = np.sqrt((rest * rest).sum(1))
    unit = (rest / np.where(q_length > 0, q_length, 1)[:, None]).astype(np.float32)
    estimate = (unit @ signs.T) / np.sqrt(dim) / fit[None, :]
    error = epsilon * np.sqrt(np.maximum(1 - fit * fit, 0) / (fit * fit) / max(dim - 1, 1))[None, :]
    base = length[None, :] ** 2 + q_length[:, None] ** 2
    scale = 2 * length[None, :] * q_length[:, None]
    return base - scale * np.minimum(estimate + error, 1), base - scale * np.maximum(estimate - error, -1)


def _arrays(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search_block(ids, vectors, code, q_ids, queries, centroid, turn, config: VectorIndex) -> list[tuple[int, int, float]]:
    """(query, vector, distance): for each query the k nearest of a block, nearest first, ties to smaller ids.

    The k-th least upper bound limits which vectors are compared exactly. A query's own id is no candidate.
    """
    bits, length, fit = code
    out = []
    for at in range(0, len(q_ids), 64):
        qs, own = queries[at : at + 64], q_ids[at : at + 64]
        low, high = distance_bounds(bits, length, fit, qs, centroid, turn, config.epsilon)
        for i, q in enumerate(own):
            allowed = ids != q
            n = int(allowed.sum())
            if not n:
                continue
            top = np.where(allowed, high[i], np.inf)
            limit = np.partition(top, min(config.k, n) - 1)[min(config.k, n) - 1]
            pick = np.flatnonzero(allowed & (low[i] <= limit + 1e-9 * abs(limit) + 1e-12))
            gap = vectors[pick] - qs[i]
            # Component after component, so that the score does not depend on how a sum is split.
            dist = np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1])
            best = np.lexsort((ids[pick], dist))[: config.k]
            out += [(int(q), int(ids[pick[b]]), float(dist[b])) for b in best]
    return out


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part: an id, no null or non-finite component, not all zero. Floats stay floats, all else becomes double."""
    v = F.col("embedding") if dict(table.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )


def nearest_neighbours(table: DataFrame, every: int = 100, config: VectorIndex = VectorIndex()) -> DataFrame:
    """For each query (vec_id divisible by ``every``): query_id, rank, vec_id and score, the Euclidean distance.

    Vectors are dealt to the lists of their nearest centroids and coded there; a query looks into the lists nearest to
    it. Lists longer than ``chunk_rows`` are split by id over several tasks, each of which returns its own best, so a
    list that holds a third of all vectors is no single task. Queries that found fewer than k of the vectors there
    get a second search of all lists. Vectors of another dimension than most are compared among themselves. Equal
    rows of one vec_id are one vector.
    """
    spark = table.sparkSession
    rows = materialize(usable_vectors(table).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")))
    result = None
    for dim, total in [(r["dim"], r["n"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()]:
        part = _search(rows.where(F.col("dim") == dim).select("vec_id", "v"), dim, total, every, config)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return result


def _search(rows: DataFrame, dim: int, total: int, every: int, config: VectorIndex) -> DataFrame:
    n_lists = int(max(1, min(config.max_lists, total // config.list_rows)))
    kind = dict(rows.dtypes)["v"]  # floats travel as floats; kernels compute with doubles
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.fit_rows).toArrow()
    centroids = fit_centroids(_arrays(sample["v"].combine_chunks(), dim), n_lists, config.seed)
    n_lists = len(centroids)
    turn = rotation(dim, config.seed)
    squares = (centroids * centroids).sum(1)
    probes = min(n_lists, max(config.min_probes, int(n_lists * config.probe_share)))

    def deal(n_near: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _arrays(batch.column(1), dim)
                near = squares - 2 * v @ centroids.T
                lists = np.argpartition(near, min(n_near, n_lists) - 1, axis=1)[:, :n_near] if n_near < n_lists else np.tile(np.arange(n_lists), (len(v), 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

        return run

    dealt_schema = f"vec_id bigint, v {kind}, lists array<int>"
    indexed = rows.mapInArrow(deal(1), dealt_schema).select("vec_id", "v", F.col("lists")[0].alias("list"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = _arrays(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False)
            bits, length, fit = encode(v, centroids[own], turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(fit)], names=["vec_id", "v", "list", "bits", "length", "fit"])

    coded = materialize(indexed.mapInArrow(code, f"vec_id bigint, v {kind}, list int, bits binary, length double, fit double"))
    # One row a list: at most max_lists, whatever the number of vectors.
    chunks = [(r["list"], -(-r["n"] // config.chunk_rows)) for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()]
    per_list = F.broadcast(rows.sparkSession.createDataFrame(chunks, "list int, chunks int"))
    left = coded.join(per_list, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
    best_first = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def block(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if vectors.num_rows and queries.num_rows:
            bits = np.frombuffer(b"".join(vectors["bits"].to_pylist()), np.uint8).reshape(vectors.num_rows, -1)
            v, q = (_arrays(t["v"].combine_chunks(), dim) for t in (vectors, queries))
            codes = (bits, vectors["length"].to_numpy(), vectors["fit"].to_numpy())
            found = search_block(vectors["vec_id"].to_numpy(), v, codes, queries["vec_id"].to_numpy(), q, centroids[key[0].as_py()], turn, config)
        q_ids, ids, dist = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q_ids, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(dist, pa.float64())})

    def look(queries: DataFrame, n_near: int) -> DataFrame:
        asked = queries.mapInArrow(deal(n_near), dealt_schema).select("vec_id", "v", F.explode("lists").alias("list")).join(per_list, "list")
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        found = left.groupBy("list", "chunk").cogroup(asked.groupBy("list", "chunk")).applyInArrow(block, "query_id bigint, vec_id bigint, score double")
        found = found.dropDuplicates(["query_id", "vec_id", "score"])
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= config.k)

    queries = rows.where(F.col("vec_id") % every == 0)
    first = materialize(look(queries, probes))
    if probes < n_lists:
        enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(config.k, total - 1)).select(F.col("query_id").alias("vec_id"))
        short = materialize(queries.join(enough, "vec_id", "left_anti"))
        if not short.isEmpty():
            again = materialize(look(short, n_lists))
            first = first.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return first.select("query_id", "rank", "vec_id", "score")
