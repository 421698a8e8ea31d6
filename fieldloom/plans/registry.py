"""Registered queries: an operator bound to the shared tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the same result for DuckDB."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Round to six digits; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def q6(expr: str) -> str:
    """The SQL twin of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def stamp(c: Column | str) -> Column:
    """A timestamp as text, so that no client's time type matters in comparisons."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def qstamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
