"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.plans.lineage import discard, store


#: From so many edges on, a hub's edges are too many for one task.
MANY_EDGES = 1_000_000


def _star(pairs: DataFrame, large: bool, keep) -> DataFrame:
    """One star pass: connects each node's neighbours (the larger ones, or the smaller ones) to the least of them.

    ``keep`` may store the least neighbours before the join: both of its sides are then plain shuffles, which Spark can
    split where a hub has most of the rows.
    """
    if large:
        near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = keep(near.groupBy("a").agg(F.min("b").alias("m")))
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return keep(moved.where("a <> b").distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one orderable type); root is the component's least node.

    Alternating large-star and small-star passes: logarithmically many rounds even on long chains, each with
    aggregates that combine before the shuffle. Self-loops give a component of one; edges with a null are left out.
    """
    clean = store(edges.select("a", "b").where("a is not null and b is not null").distinct())
    loops = clean.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    pairs, before, many = clean.where("a <> b"), None, clean.count() > MANY_EDGES
    for _ in range(max_rounds):
        scratch: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            if not many:
                return df
            scratch.append(store(df))
            return scratch[-1]

        last, half = pairs, _star(pairs, True, keep)
        pairs = store(_star(half, False, keep))
        discard(*scratch, *([last] if before is not None else []))
        state = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    known = stars.unionByName(roots)
    alone = loops.join(known.select("node"), "node", "left_anti")
    return known.unionByName(alone)
