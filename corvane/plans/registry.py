"""All queries of the core, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    import importlib

    for name in ("text_queries", "lexical_queries", "search_queries", "evaluation_queries", "state_queries", "content_queries", "relational_queries", "parsing_queries", "dense_queries", "storage_queries"):
        importlib.import_module(f"corvane.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact vector search; the smallest data hold no query whose id is divisible by 100, so hybrid search has no rows there."""
    _load()
    return _QUERIES["v1_nearest"](spark, d)
