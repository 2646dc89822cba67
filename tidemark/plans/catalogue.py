"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already: another way to the same rows has the same."""
    return _sql[name]


def queries() -> dict[str, Query]:
    from . import queries_evaluation, queries_models, queries_operators, queries_panel, queries_scale  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
