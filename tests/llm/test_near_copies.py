"""Shuffle files that op4 and the near-copy stage of the pipeline leave, and whole sets of repeated rows."""

import os
import random

import pytest

from cadenza.llm import near_copies
from cadenza.plans import lineage


def shuffle_files(spark):
    places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for p in places for d, _, names in os.walk(p.getPath()) for x in names if x.endswith(".data")}


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


def test_shuffles_of_shingles_are_freed_as_soon_as_read(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, 2000)) for i in range(300)], "doc_id long, text string").repartition(4).cache()
    assert docs.count() == 300
    before, left = set(shuffle_files(spark)), []

    def store(df):
        left.append(sum(size for f, size in shuffle_files(spark).items() if f not in before))
        return lineage.store(df)

    monkeypatch.setattr(near_copies, "store", store)
    near_copies.near_copy_components(docs, near_copies.NearCopies(3, 90))
    # The prefixes hold 90,000 shingles of 8 bytes; no step finds those of an earlier one still there.
    assert len(left) > 5 and max(left) < 100_000


@pytest.mark.parametrize("send_ids", [1_000_000, 0])
@pytest.mark.parametrize("block", [512, 8])
def test_whole_sets_of_repeated_rows_reach_their_groups_once(spark, monkeypatch, block, send_ids):
    rng = random.Random(5)
    rows = []
    for family in range(6):
        w = words(rng, 200).split()
        for i in range(20):
            v = w[:]
            v[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
            rows += [(100 * family + i, " ".join(v))] * rng.choice([1, 1, 1, 4])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, real = [], near_copies._whole_sets

    def whole_sets(*a):
        seen.append(real(*a))
        return seen[-1].cache()

    monkeypatch.setattr(near_copies, "_whole_sets", whole_sets)
    got = near_copies.near_copy_components(docs, near_copies.NearCopies(3, 90, block=block, send_ids=send_ids))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == sorted((i, i // 100 * 100) for i, _ in rows)
    kept = near_copies.drop_near_copies(docs, near_copies.NearCopies(3, 90, block=block, send_ids=send_ids))
    assert sorted(r.doc_id for r in kept.collect()) == [100 * f for f in range(6)]
    assert all(x.count() == x.select("node").distinct().count() == 120 for x in seen[:1])
