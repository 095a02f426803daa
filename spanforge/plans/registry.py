"""Where queries and the SQL that checks them are listed together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is listed twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals; the nudge sends exact ties the same way in every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)


def R6(expr: str) -> str:
    """The SQL text of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0)"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
