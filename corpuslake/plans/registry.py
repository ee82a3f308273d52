"""All queries over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslake.plans.tables import table  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


from corpuslake.plans import queries_analytics, queries_corpus, queries_lists, queries_more, queries_sql, queries_store, queries_text, queries_versions  # noqa: E402, F401
