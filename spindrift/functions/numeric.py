"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(x: Column | str) -> Column:
    """Round to 6 places off the ties that float noise decides."""
    return F.round(F.col(x) + F.lit(1e-8) if isinstance(x, str) else x + F.lit(1e-8), 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def log2_term(p: Column) -> Column:
    """p log2 p, 0 for p = 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
