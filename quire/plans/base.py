"""Registration of queries: a name, the query and, where it has one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL_BY_QUERY: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL_BY_QUERY[f.__name__] = sql
        return f

    return register
