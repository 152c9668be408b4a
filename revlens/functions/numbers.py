"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_money(c: str | Column, precision: int = 10, scale: int = 2) -> Column:
    """Convert to DECIMAL(precision, scale), rounding half up.

    A value that does not fit (or text that is not a number) becomes NULL
    rather than failing the job; ``quality.rejects`` counts these.
    """
    return _c(c).try_cast(f"decimal({precision},{scale})")
