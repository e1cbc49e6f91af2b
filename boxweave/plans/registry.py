"""Where queries over the given tables, and the SQL to check them, are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as ``name``, with its DuckDB twin if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, so that two engines agree on a double."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c, 6)
    label = name or (column if isinstance(column, str) else None)
    return out.alias(label) if label else out
