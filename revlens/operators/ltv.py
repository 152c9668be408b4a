"""Lifetime value, churn and acquisition cost.

* lifetime_months = number of subscription rows of the account;
* total_ltv = sum of mrr over them;
* final_status = MAX(status): lexicographic, so one 'churned' row wins;
* churn_rate = share of accounts whose final status is 'churned'.

``avg_lifetime_months`` is the true average (DOUBLE); the original dialect
truncated an integer average, which ``integer_avg=True`` reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_SUM = "decimal(38,2)"
CHURNED = "churned"
ABM, NON_ABM = "ABM", "Non-ABM"
SEGMENTS = ["region", "employee_bucket", "subscription_plan", "abm_tier"]


def account_ltv(subscriptions: DataFrame) -> DataFrame:
    """account_id, lifetime_months, total_ltv, final_status.

    ``MAX(status)`` over a string cannot live in a hash-aggregation buffer,
    so a single aggregate would sort the whole subscription table.  The
    counts and sums are hash-aggregated per (account, status) first (with
    map-side combine); the string maximum then runs over that result, a
    handful of rows per account.
    """
    per_status = subscriptions.groupBy("account_id", "status").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("mrr").alias("_mrr"))
    return per_status.groupBy("account_id").agg(
        F.sum("_n").alias("lifetime_months"),
        F.sum("_mrr").cast(MONEY_SUM).alias("total_ltv"),
        F.max("status").alias("final_status"))


def ltv_segments(subscriptions: DataFrame, accounts: DataFrame, abm_accounts: DataFrame) -> DataFrame:
    """Account LTV with segments and ABM flag (accounts: inner, ABM: left).

    Repeated ABM rows of an account repeat the account, as in the original.
    """
    ltv = account_ltv(subscriptions)
    seg = ltv.join(accounts.select("account_id", "industry", "employee_bucket", "region",
                                   "subscription_plan"), "account_id")
    abm = abm_accounts.select(F.col("account_id").alias("_abm_id"), "abm_tier")
    j = seg.join(abm, seg.account_id == abm._abm_id, "left")
    return j.select(*seg.columns,
                    F.when(F.col("_abm_id").isNotNull(), ABM).otherwise(NON_ABM).alias("abm_status"),
                    "abm_tier")


def _metrics(integer_avg: bool = False) -> list[Column]:
    months = F.avg("lifetime_months")
    if integer_avg:
        months = F.floor(months)
    return [F.avg("total_ltv").cast("decimal(38,6)").alias("avg_ltv"),
            months.alias("avg_lifetime_months"),
            (F.sum(F.when(F.col("final_status") == CHURNED, 1).otherwise(0)).cast("double")
             / F.count(F.lit(1)).cast("double")).alias("churn_rate")]


def ltv_by(segments: DataFrame, key: str, integer_avg: bool = False) -> DataFrame:
    """key, avg_ltv, avg_lifetime_months, churn_rate."""
    return segments.groupBy(key).agg(*_metrics(integer_avg))


def ltv_by_abm(segments: DataFrame) -> DataFrame:
    return ltv_by(segments, "abm_status")


def ltv_by_industry(segments: DataFrame) -> DataFrame:
    return ltv_by(segments, "industry").orderBy(F.desc_nulls_last("avg_ltv"))


def ltv_by_segment(segments: DataFrame, keys: list[str] = SEGMENTS) -> DataFrame:
    """Long form over several segment columns:
    segment, segment_value, accounts, avg_ltv, avg_lifetime_months, churn_rate.

    Each account row is unpivoted into one row per segment column and one
    aggregation runs over the result, so the LTV pipeline is computed once
    (a union of per-column aggregates would recompute it per column).
    """
    pairs = [x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]
    long = segments.select(F.stack(F.lit(len(keys)), *pairs).alias("segment", "segment_value"),
                           "total_ltv", "lifetime_months", "final_status")
    return (long.groupBy("segment", "segment_value")
                .agg(F.count(F.lit(1)).alias("accounts"), *_metrics())
                .orderBy("segment", "segment_value"))


def overall_ltv(subscriptions: DataFrame) -> DataFrame:
    """avg_ltv, avg_lifetime_months, churn_rate over all subscribing accounts."""
    return account_ltv(subscriptions).agg(*_metrics())


def overall_cac(spend: DataFrame, sales: DataFrame) -> DataFrame:
    """CAC = all spend / count of non-null order_id in sales (NULL when none)."""
    total = spend.agg(F.sum("spend").alias("spend"))
    customers = sales.agg(F.count("order_id")).scalar()     # scalar subquery, run once
    return total.select(
        (F.col("spend") / F.nullif(customers, F.lit(0))).cast("decimal(38,6)").alias("CAC"))


def spend_vs_attribution(spend: DataFrame, first_by_month: DataFrame) -> DataFrame:
    """Spend per month and channel beside first-touch results:
    month_start, channel, spend, customers_acquired, total_revenue, cac, roas."""
    s = spend.groupBy("month_start", "channel").agg(F.sum("spend").cast(MONEY_SUM).alias("spend"))
    j = s.join(first_by_month, ["month_start", "channel"], "left")
    zero = F.lit(0).cast("bigint")
    return j.select(
        "month_start", "channel", "spend",
        F.coalesce("customers_acquired", zero).alias("customers_acquired"),
        F.coalesce("total_revenue", F.lit(0).cast(MONEY_SUM)).alias("total_revenue"),
        (F.col("spend") / F.nullif(F.col("customers_acquired"), F.lit(0))).cast("decimal(18,2)").alias("cac"),
        (F.col("total_revenue") / F.nullif(F.col("spend"), F.lit(0))).cast("decimal(18,4)").alias("roas"),
    ).orderBy("month_start", "channel")
