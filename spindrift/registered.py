"""The registry of queries over the driver's tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import stable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ROI = ["roi"]


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(stable(c).alias(c) if c in names else F.col(c) for c in df.columns))


def st(x: str, name: str) -> str:
    """``stable`` in SQL."""
    return f"round({x} + 1e-8::DOUBLE, 6) AS {name}"
