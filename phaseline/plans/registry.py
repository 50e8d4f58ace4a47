"""Registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a function under its name, with DuckDB SQL of the same rows if there is any.

    ``ints`` are columns that Spark has as 32-bit whole numbers.
    """

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            narrow = ", ".join(f'CAST("{c}" AS INTEGER) AS "{c}"' for c in ints)
            _SQL[f.__name__] = f"SELECT * REPLACE ({narrow}) FROM ({sql})" if ints else sql
        return f

    return add


def _load() -> None:
    from . import case_queries, count_queries, lag_queries, mode_queries, panel_queries, source_queries, statistic_queries, streaming_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
