"""Keep-one-row-per-key de-duplication without a window.

``ROW_NUMBER() OVER (PARTITION BY key ORDER BY c) ... rn = 1`` sends every row
of a key to one task and sorts it there; a hot key (a third of all rows)
becomes one straggler.  The same answer comes from an aggregate of
``min/max(struct(order, tie_break, rest))``.  With text in the struct Spark
plans it as a sort-based aggregate: every task sorts its rows by key (spilling
if it must) and keeps one row per key before anything is shuffled, so the
shuffle is small and a hot key is no task's burden.

Struct comparison is field by field with NULL smallest, so ``min`` is
``ORDER BY c ASC NULLS FIRST`` and ``max`` is ``ORDER BY c DESC NULLS LAST``,
which is also how T-SQL orders NULLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order_by: str, descending: bool,
             tie_break: Sequence[str] | None = None) -> DataFrame:
    """One row per ``keys``: the first row by ``order_by`` (then ``tie_break``).

    Ties are broken by ``tie_break`` in the same direction, then by all
    remaining columns, so the result is deterministic.
    """
    keys = list(keys)
    tie_break = list(tie_break or [])
    rest = [c for c in df.columns if c not in keys and c != order_by and c not in tie_break]
    fields = [order_by, *tie_break, *rest]
    pick = F.max if descending else F.min
    kept = (df.groupBy(*keys)
              .agg(pick(F.struct(*[F.col(c) for c in fields])).alias("_row"))
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in fields]))
    return kept.select(*df.columns)
