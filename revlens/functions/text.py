"""Text cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_spaces(c: str | Column) -> Column:
    """Strip leading and trailing spaces only (tabs and newlines stay)."""
    return F.trim(_c(c))


def trim_lower(c: str | Column) -> Column:
    """lower(ltrim(rtrim(x)))."""
    return F.lower(trim_spaces(c))


def snake(c: str | Column) -> Column:
    """Trim, lower case, and every inner space to an underscore."""
    return F.replace(trim_lower(c), F.lit(" "), F.lit("_"))


def replace_literal(c: str | Column, old: str, new: str) -> Column:
    """Replace a literal substring (no regex semantics)."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def varchar(c: str | Column, n: int = 50) -> Column:
    """A cast to VARCHAR(n) that really cuts to n characters."""
    return F.substring(_c(c).cast("string"), 1, n)
