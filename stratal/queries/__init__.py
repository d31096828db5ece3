"""The query catalogue over the driver's tables: each query with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_PARTS = ("relational", "rules", "dimensions", "reconciliation", "kpis", "runs", "pages", "platform", "sinks")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that has the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for part in _PARTS:
        import_module(f"{__name__}.{part}")
