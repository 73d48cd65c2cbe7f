"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from quire.plans import compare_queries, layout_queries, outline_queries, page_queries, reference_queries, retrieval_queries, review_queries, search_queries, source_queries, stream_queries, takeoff_queries  # noqa: F401  they register themselves
from quire.plans.base import ORACLE_SQL_BY_QUERY, QUERIES

__all__ = ["ORACLE_SQL_BY_QUERY", "QUERIES"]
