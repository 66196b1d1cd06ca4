"""Streams: folder sync, gates on fixes, throttling, smoothed headings and queries kept current.

Times are those of the events. State is kept by key and times out by watermark, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving_files(spark: SparkSession, folder: str, suffix: str, per_batch: int = 1000) -> DataFrame:
    """New files of a folder as (path, content). The checkpoint is the cursor: it moves on only after a batch without errors."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", per_batch).load(folder).select("path", "content")


def kept_current(changes: DataFrame, recompute: Callable[[SparkSession], DataFrame], table: str, checkpoint: str, settle: str = "0 seconds", keep: int = 2):
    """Recompute a result after each batch of changes; ``settle`` is the time between batches, in which changes gather.

    Each result is a version of its own below ``table``, and counts once it is whole: readers (``current``) never see a
    gap, and a crash leaves the version before. A batch that is repeated writes its version anew. ``keep``: versions
    that stay for readers still at work.
    """
    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        recompute(spark).write.mode("overwrite").parquet(f"{table}/version={number:012d}")
        for old in versions(spark, table)[:-keep]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/{old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=settle)


def versions(spark: SparkSession, table: str) -> list[str]:
    """Names of the whole versions of a table kept current, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(table)):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path(table))]
    return sorted(n for n in names if n.startswith("version=") and fs.exists(path(f"{table}/{n}/_SUCCESS")))


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest whole version of a table kept current; None before the first."""
    found = versions(spark, table)
    return spark.read.parquet(f"{table}/{found[-1]}") if found else None


def latest_of_both(one: DataFrame, two: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The latest row of each of two tables by key, side by side (batch, or within ``kept_current``); keys that only one has are left out."""
    def last(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias(name))
    return last(one, "one").join(last(two, "two"), key)


def import_batches(files: DataFrame, import_files: Callable[[DataFrame], DataFrame], after: Callable[[SparkSession], None], checkpoint: str):
    """Import new files batch by batch, one batch at a time, and regroup once a batch: ``after`` runs only if the batch brought a ride.

    ``import_files`` stores the rides of (path, content) rows and returns a row for each result (kind: success, error, small).
    """
    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty() and not import_files(batch).where("kind = 'success'").isEmpty():
            after(batch.sparkSession)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def usable_fixes(fixes: DataFrame, max_accuracy_m: float, max_age: str = "120 seconds") -> DataFrame:
    """Fixes (ts, seen_at, accuracy_m) that are exact and fresh enough."""
    return fixes.where((F.col("accuracy_m") <= max_accuracy_m) & (F.col("ts") >= F.col("seen_at") - F.expr(f"interval {max_age}")))


def _keyed(rows: DataFrame, key: str, out: str, state: str, step, late: str) -> DataFrame:
    """Fold each key's rows by time; ``step(state, row)`` gives the next state and the row to emit or None."""
    names = [c.strip().split()[0] for c in out.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, emitted = (held.get if held.exists else None), []
        batch = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for row in batch.itertuples(index=False):
            now, found = step(now, row)
            if found is not None:
                emitted.append((k[0], *found))
        held.update(now)
        held.setTimeoutTimestamp(int(batch["ts"].max().timestamp() * 1000) + 3_600_000)
        yield pd.DataFrame(emitted, columns=names)

    marked = rows.withWatermark("ts", late)
    return marked.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def throttled(rows: DataFrame, key: str, value: str, seconds: float = 5.0, late: str = "1 minute") -> DataFrame:
    """(key, ts, value): at most one row per key in ``seconds``, the first after each pause."""
    def step(state, row):
        at = row.ts.timestamp()
        if state is not None and at - state[0] < seconds:
            return state, None
        return (at,), (row.ts, float(getattr(row, value)))
    return _keyed(rows.select(key, "ts", value), key, f"{key} long, ts timestamp, {value} double", "at double", step, late)


def turn(a: float, b: float) -> float:
    """The signed angle from one heading to another, -180 up to 180."""
    return (b - a + 180.0) % 360.0 - 180.0


def smoothed_headings(rows: DataFrame, key: str, alpha: float = 0.15, least: float = 1.0, late: str = "1 minute") -> DataFrame:
    """(key, ts, heading): an exponential mean around the circle, shown when it has turned by ``least`` degrees since last shown."""
    def step(state, row):
        if state is None:
            return (row.heading, row.heading), (row.ts, row.heading)
        mean = (state[0] + alpha * turn(state[0], row.heading)) % 360.0
        return ((mean, mean), (row.ts, mean)) if abs(turn(state[1], mean)) >= least else ((mean, state[1]), None)
    return _keyed(rows.select(key, "ts", "heading"), key, f"{key} long, ts timestamp, heading double", "mean double, shown double", step, late)


def first_good_fix(fixes: DataFrame, key: str, max_accuracy_m: float = 20.0, wait_s: float = 5.0) -> DataFrame:
    """Per key the first exact fix within ``wait_s`` of the request, else the latest fix of that time (batch)."""
    soon = fixes.where(F.unix_millis("ts") - F.unix_millis("asked_at") <= wait_s * 1000)
    good = F.col("accuracy_m") <= max_accuracy_m
    shown = F.struct("ts", "accuracy_m")
    return soon.groupBy(key).agg(F.coalesce(F.min(F.when(good, shown)), F.max(shown)).alias("f")).select(key, "f.ts", "f.accuracy_m")
