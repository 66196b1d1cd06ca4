"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished job are no longer read once its result is stored; lost ones are made anew.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A session on this machine alone that names none gets one of its own; on a cluster, whose machines would not see it, that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, was)


def store(df: DataFrame) -> DataFrame:
    """Compute ``df`` once as a Parquet table in the shared folder, and free the shuffle files that it took.

    Later steps read the columns they need, and know the table's size. The table goes with ``discard``, or when the
    session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadenza-{uuid.uuid4().hex}"
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_remove, spark, path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def materialize(df: DataFrame) -> DataFrame:
    """Another name of ``store``, for results that take their place in a longer plan."""
    return store(df)


def discard(*stored: DataFrame) -> None:
    """Remove tables made by ``store`` that nothing will read again."""
    for df in stored:
        _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sealed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` reduced to ``columns``, such that filters on them stay above the steps that make them.

    A filter on a computed column is otherwise pushed below its computation and computes it anew at each mention. The
    columns pass through a generator of one row, which the optimiser does not look into.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))
