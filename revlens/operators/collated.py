"""Comparison as the original database does it: case-insensitive, trailing spaces ignored.

The scripts ran where 'CPC ' = 'cpc'.  The other operators compare exactly;
these use Spark's string collations on group and join keys instead, so the
text keeps the spelling it was stored with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Case-insensitive and blind to trailing spaces.
COLLATION = "UTF8_LCASE_RTRIM"


def collated(c: Column | str) -> Column:
    """A text column that compares without case and trailing spaces."""
    return F.collate(F.col(c) if isinstance(c, str) else c, COLLATION)


def group_collated(df: DataFrame, key: Column, name: str, sums: Sequence[str] = ()) -> DataFrame:
    """Rows, spellings and sums per collated key.

    ``name`` (the first spelling in code-point order), rows, spellings,
    and the sum of each of ``sums``.  Exact spellings are counted first, by a
    hash aggregate with map-side combine; only one row a spelling meets the
    collated comparison, which Spark plans as a sort.
    """
    exact = df.groupBy(key.alias("_text")).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_{i}") for i, c in enumerate(sums)])
    return exact.groupBy(collated("_text").alias("_key")).agg(
        F.min("_text").alias(name), F.sum("_rows").alias("rows"), F.count("_text").alias("spellings"),
        *[F.sum(f"_{i}").alias(c) for i, c in enumerate(sums)]).drop("_key")


def join_collated(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join of two text columns under the collation (hashed and sorted by collation key; NULL matches nothing)."""
    return left.join(right, collated(left[left_key]) == collated(right[right_key]), how)
