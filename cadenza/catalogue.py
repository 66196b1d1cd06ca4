"""All queries of the library and their SQL."""

from cadenza.plans import format_queries, history_queries, path_queries, ride_queries, road_queries  # noqa: F401  registers its queries
from cadenza.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
