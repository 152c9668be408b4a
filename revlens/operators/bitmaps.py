"""Distinct counts as stored bitmaps that add up.

COUNT(DISTINCT id) per group cannot be summed over groups, and several of them
in one aggregate multiply every row (Expand).  Here ids get dense numbers once;
a group's distinct ids are bits in 4 KB bitmaps, one per 32,768 numbers, built
by a partial and a final aggregate.  Bitmaps of months OR together to quarters,
and a count is the sum of their bits: all with Spark's own bitmap functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import month_start
from revlens.operators.funnel import MONEY_SUM, _rate, lead_base
from revlens.session import written


def dense_numbers(df: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """(key, name): the distinct non-NULL values of ``key``, numbered from 0 in their order, written.

    Values are range-partitioned and numbered within each partition; the sizes
    of the partitions before, one row each, are the offsets.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(n, key)
    placed = written(ids.withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return written(placed.withColumn("_no", here - 1).join(offsets, "_part").select(key, (F.col("_before") + F.col("_no")).alias(name)), name)


def distinct_bitmaps(df: DataFrame, by: str, number: str, metrics: Mapping[str, Column | None]) -> DataFrame:
    """(by, bucket, one bitmap per metric): the numbers of rows where the metric's condition holds (None: all rows)."""
    pos = F.bitmap_bit_position(number)
    aggs = [F.bitmap_construct_agg(pos if c is None else F.when(c, pos)).alias(m) for m, c in metrics.items()]
    return df.where(F.col(number).isNotNull()).groupBy(by, F.bitmap_bucket_number(number).alias("bucket")).agg(*aggs)


def merged(bitmaps: DataFrame, by: Column, name: str, metrics: list[str]) -> DataFrame:
    """Bitmaps of coarser groups (months to quarters): the OR of the finer ones."""
    return bitmaps.groupBy(by.alias(name), "bucket").agg(*[F.bitmap_or_agg(m).alias(m) for m in metrics])


def counted(bitmaps: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, one count per metric)."""
    return bitmaps.groupBy(by).agg(*[F.sum(F.bitmap_count(m)).alias(m) for m in metrics])



def funnel_bitmaps(leads: DataFrame, opportunities: DataFrame, sales: DataFrame, by: Column, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, lead bitmaps, opportunity bitmaps) of the funnel by ``by``, written: what to store per group."""
    base = lead_base(leads, opportunities, sales).withColumn(name, by)
    base = base.join(dense_numbers(leads, "lead_id", "lead_no"), "lead_id", "left").join(dense_numbers(opportunities, "opportunity_id", "opp_no"), "opportunity_id", "left")
    base = written(base, "numbered-funnel")
    on = lambda c: F.col(c) == 1
    lead = distinct_bitmaps(base, name, "lead_no", {"leads": None, "mqls": on("mql_status"), "sqls": on("sql_status")})
    opp = distinct_bitmaps(base, name, "opp_no", {"opps": None, "won_opps": on("win_flag")})
    return base, written(lead, "lead-bitmaps"), written(opp, "opportunity-bitmaps")


def funnel(leads: DataFrame, opportunities: DataFrame, sales: DataFrame, by: Column, name: str) -> DataFrame:
    """``funnel.funnel`` with its distinct counts from bitmaps."""
    base, lead, opp = funnel_bitmaps(leads, opportunities, sales, by, name)
    sums = base.groupBy(name).agg(F.sum("pipeline_amount").cast(MONEY_SUM).alias("pipeline_amount"),
                                  F.sum(F.when(F.col("win_flag") == 1, F.col("revenue"))).cast(MONEY_SUM).alias("closed_won_revenue"))
    out = sums.alias("s")
    for side, metrics in ((lead, ["leads", "mqls", "sqls"]), (opp, ["opps", "won_opps"])):
        side = counted(side, name, metrics).withColumnRenamed(name, "_key")
        out = out.join(side, F.col(name).eqNullSafe(F.col("_key")), "left").drop("_key")
    n = lambda m: F.coalesce(F.col(m), F.lit(0)).cast("bigint")
    return out.select(name, *[n(m).alias(m) for m in ("leads", "mqls", "sqls", "opps", "won_opps")], "pipeline_amount", "closed_won_revenue",
                      _rate(n("opps"), n("leads")).alias("lead_to_opp_rate"), _rate(n("won_opps"), n("opps")).alias("opp_to_win_rate"),
                      _rate(n("won_opps"), n("leads")).alias("lead_to_win_rate"))


def funnel_by_month(leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> DataFrame:
    return funnel(leads, opportunities, sales, month_start("created_at"), "month_start")


def funnel_by_source(leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> DataFrame:
    return funnel(leads, opportunities, sales, F.col("lead_source"), "lead_source")
