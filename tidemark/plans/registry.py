"""All registered queries of the engine with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name, with DuckDB SQL of the same rows if there is any."""

    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which consecutive documents of a source changed most."""
    return _QUERIES["most_changed_documents"](spark, sf_dir)
