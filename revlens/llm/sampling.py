"""Bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_UNIT = 1 << 40


def per_group(rows: DataFrame, group: str, n: int, id_col: str = "id") -> DataFrame:
    """At most ``n`` distinct ids of each group, with the group: those of the smallest hash of the id.

    The distinct ids of a group are estimated first (HyperLogLog, 2 % error, no
    shuffle of ids), and a hash threshold of about 2n ids a group is applied
    where the rows are read.  Repeats go before the ranking, so it sees a few
    thousand rows whatever the size of the table, of a group or of an id.
    """
    counts = F.broadcast(rows.groupBy(group).agg(F.approx_count_distinct(id_col, 0.02).alias("__n")))  # one row a group
    at = F.pmod(F.xxhash64(id_col), F.lit(_UNIT))
    near = rows.join(counts, group).withColumn("__at", at).filter(F.col("__at") * F.col("__n") < F.lit(float(2 * n * _UNIT)))
    rank = Window.partitionBy(group).orderBy("__at", id_col)
    return near.select(id_col, group, "__at").distinct().withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= n).select(id_col, group)
