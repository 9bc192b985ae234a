"""All queries of the engine's own operators, and their SQL."""

from lectern.plans import layout_queries, motion_queries, search_queries, state_queries, stream_queries
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "layout_queries", "motion_queries", "search_queries", "state_queries", "stream_queries"]
