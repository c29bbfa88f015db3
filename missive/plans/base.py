"""Registration of queries and the spelling of their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is any."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return ", ".join(map(quoted, values))
