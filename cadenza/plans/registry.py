"""Registers queries by name, with the SQL that another engine computes the same rows by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources.proxies import table, with_proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, plan: Callable[..., DataFrame], tables: str, oracle: str | None = None) -> None:
    """``plan`` takes the named tables as DataFrames; ``oracle`` may name proxies."""
    names = tables.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(*[table(spark, sf_dir, t) for t in names])

    query.__name__ = name
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = with_proxies(oracle)
