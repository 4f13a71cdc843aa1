"""Named queries (Spark builders + DuckDB twins)."""

from textsim.plans import (analysis_queries, calibration_queries, compare_queries, lookup_queries, pair_queries, semantic_queries,  # noqa: F401
                           io_queries, report_queries, style_queries, text_queries)
from textsim.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
