"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Inventory ids that a query shows, by query.
OPERATORS: dict[str, str] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, the operators it exercises and, if there is one, equivalent SQL."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], OPERATORS[name] = f, ops
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
