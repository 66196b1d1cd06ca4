"""Mixing sources to target weights: hash-random keys, range-wise prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.plans.lineage import materialize

WORD_GAP = r"[ \t\n\x0B\f\r]+"
#: Up to so many sources the plan (a few numbers a source) is a literal table, which Spark sends to all; above, it is joined by shuffle.
MAX_LITERAL_SOURCES = 5_000
#: Rows that one key range of a source should hold.
RANGE_ROWS = 2_000
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white spaces."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ \t\n\x0b\f\r]+", "x"), "[ \t\n\x0b\f\r]+", "")
    return F.length(t).cast("long")


def draw_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A random-looking key of 32 hexadecimal digits that any engine can compute again; rows without an id go by their text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit(""))))), F.lit(f":{seed}")))


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> dict:
    """Target words by source: weights repeat along the sources (by code point, null last); nothing above cap times its size.

    Sharing the excess anew until no target is above its cap ends at one level for all uncapped sources, found here by
    going through the sources in the order in which they reach their caps.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    total, filled, weight = sum(n for _, n in sizes), 0, sum(w for _, _, w in rows)
    level = 0.0
    for _, n, w in sorted(rows, key=lambda x: x[1] * cap / x[2]):
        level = (total - filled) / weight
        if cap * n / w >= level:
            break
        filled, weight = filled + cap * n, weight - w
        if weight == 0:
            break
    return {s: (n, min(float(cap * n), level * w)) for s, n, w in rows}


def _ranges(key: Column, n_ranges: Column) -> Column:
    """The key range, from 0 to n_ranges - 1, in the order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * n_ranges).cast("int")


def document_sizes(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, key), stored."""
    return materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw_key(F.col("doc_id"), F.col("text"), seed).alias("key")))


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes`` (doc_id, source, size, key) with source_size, target, budget, before (words of the source's earlier keys), taken.

    Each source takes whole epochs of its words and, for the rest of its budget (its target in whole words), the
    documents of lowest key, the last one in part. Within a source rows are dealt to key ranges of about RANGE_ROWS
    rows; range totals are summed up along the ranges, and a window runs within each range only, so a source of any
    share is spread over many tasks. Ties of the key go by doc_id and size; equal rows are interchangeable.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    targets = source_targets([(r["source"], r["size"]) for r in per], weights)
    plan = [(r["source"], r["size"], targets[r["source"]][1], max(1, -(-r["rows"] // RANGE_ROWS))) for r in per]
    spark = sizes.sparkSession
    table = spark.createDataFrame(plan, "source string, source_size bigint, target double, n_ranges int")
    side = F.broadcast(table) if len(plan) <= MAX_LITERAL_SOURCES else table
    same = sizes["source"].eqNullSafe(side["source"])
    df = sizes.join(side, same).drop(side["source"])
    df = df.withColumn("range", _ranges(F.col("key"), F.col("n_ranges")))
    sums = df.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("earlier"))
    sums = sums.withColumnsRenamed({"source": "s", "range": "r"})
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    df = df.withColumn("before", F.col("earlier") + F.col("inside")).withColumn("budget", F.round("target").cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    taken = (epochs * F.col("size") + part).cast("long")
    return df.select("doc_id", "source", "size", "source_size", "target", "budget", "before", taken.alias("taken"), "key")


def mix_documents(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and taken. Null texts have size 0; nothing is dropped."""
    return mix_sizes(document_sizes(docs, seed), weights)


def mixed_rows(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: documents of ``docs``, repeated by their epochs, the last one of a source if most of it is taken.

    A source's cut is one key: all documents below it get one epoch more. So the documents, with their texts, are not
    shuffled; only the keys' ranges around the cuts are sorted. Documents of equal doc_id and source share a key.
    """
    mixed = mix_sizes(document_sizes(docs, seed), weights)
    whole = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0))
    mixed = mixed.withColumn("times", whole.cast("int"))
    # The most times of a source, and the last key that has them; below stands the least number of times.
    per = mixed.where("size > 0").groupBy("source").agg(F.max("times").alias("most"), F.min("times").alias("least"), F.max(F.struct("times", "key")).alias("top"))
    cuts = [(r["source"], r["most"], r["least"], r["top"]["key"]) for r in per.collect()]
    table = docs.sparkSession.createDataFrame(cuts, "cut_source string, most int, least int, cut string")
    side = F.broadcast(table) if len(cuts) <= MAX_LITERAL_SOURCES else table
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(side, F.col("row.source").eqNullSafe(F.col("cut_source")))
    times = F.when(draw_key(F.col("row.doc_id"), F.col("row.text"), seed) <= F.col("cut"), F.col("most")).otherwise(F.col("least"))
    return joined.withColumn("times", times).select(F.inline(F.array_repeat("row", F.col("times"))))
