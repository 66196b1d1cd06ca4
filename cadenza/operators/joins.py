"""Joins that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many rows are no burden to one task, whatever their keys.
ONE_TASK = 20_000


def join_hot(rows: DataFrame, values: DataFrame, key: str, parts: int = 256) -> DataFrame:
    """Left join of ``rows`` with ``values`` (at most one row a key, no null key) on a column ``key``, whatever the skew of ``rows``.

    Keys that hold more than a ``parts``-th of all rows are hot. There can be no more than ``parts`` of them, at any size
    of the input, so their values are broadcast and their rows stay where they are; all other rows are shuffled. Rows
    with a null key get nulls, without a shuffle. Both inputs should be stored tables: each is read more than once.
    """
    added = [c for c in values.columns if c != key]
    total = rows.count()
    if total <= ONE_TASK:
        return rows.join(values, key, "left").select(*rows.columns, *added)
    known = rows.where(F.col(key).isNotNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = [r[0] for r in counts.where(F.col("_rows") > total // parts).select(key).collect()]
    empty = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in added])
    if not hot:
        return known.join(values, key, "left").select(*rows.columns, *added).unionByName(empty)
    is_hot = F.col(key).isin(hot)
    spread = known.where(~is_hot).join(values.where(~is_hot), key, "left")
    held = known.where(is_hot).join(F.broadcast(values.where(is_hot)), key, "left")
    return spread.select(*rows.columns, *added).unionByName(held.select(*rows.columns, *added)).unionByName(empty)
