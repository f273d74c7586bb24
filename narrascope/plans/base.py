"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that it is compared with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], names: str) -> str:
    """A VALUES table for SQL; strings are quoted, lists become list literals."""

    def one(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(one, x)) + "]"
        return "NULL" if x is None else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"
