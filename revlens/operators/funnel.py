"""Lead funnel by source or month, and the monthly overview.

``lead_base`` is leads LEFT JOIN opportunities LEFT JOIN sales, so an
opportunity with two sales counts its amount twice in ``pipeline_amount``
(as the original query does).

The seven metrics need five distinct counts; they stay one aggregate
(see ``funnel``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import month_start

MONEY_SUM = "decimal(38,2)"


def lead_base(leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> DataFrame:
    l = leads.select("lead_id", F.col("source").alias("lead_source"), "created_at",
                     F.col("mql_flag").alias("mql_status"), F.col("sql_flag").alias("sql_status"))
    o = opportunities.select(F.col("lead_id").alias("_lead"), "opportunity_id", "stage",
                             F.col("amount").alias("pipeline_amount"), "win_flag")
    s = sales.select(F.col("opportunity_id").alias("_opp"), "order_id",
                     F.col("booked_amount").alias("revenue"))
    # Opportunities meet sales first: joined the other way round, every lead
    # without an opportunity would carry a NULL key into the second join and
    # all of them would land in one task.
    deals = o.join(s, o.opportunity_id == s._opp, "left").drop("_opp")
    return l.join(deals, l.lead_id == deals._lead, "left").drop("_lead")


def _rate(num: Column, den: Column) -> Column:
    return (num * F.lit(1.0) / F.nullif(den, F.lit(0))).cast("decimal(18,4)")


def funnel(base: DataFrame, key: Column, key_name: str) -> DataFrame:
    """Funnel metrics per ``key`` over a lead_base, in one aggregate.

    Catalyst plans the five distinct counts as one Expand followed by a
    two-phase aggregate (each row is replicated once per distinct key and
    combined map-side), so the lead/opportunity/sales join runs once.
    Splitting the work into per-grain branches would make every branch
    recompute that join, because each branch prunes the shared subplan
    differently and no exchange can be reused.
    """
    won = F.col("win_flag") == 1
    leads = F.count_distinct("lead_id")
    opps = F.count_distinct("opportunity_id")
    # COUNT(DISTINCT CASE WHEN c THEN k END) written as a FILTER on the same
    # column: Catalyst then expands once per distinct column (lead_id,
    # opportunity_id) instead of once per distinct expression.
    won_opps = F.expr("count(DISTINCT opportunity_id) FILTER (WHERE win_flag = 1)")
    return base.groupBy(key.alias(key_name)).agg(
        leads.alias("leads"),
        F.expr("count(DISTINCT lead_id) FILTER (WHERE mql_status = 1)").alias("mqls"),
        F.expr("count(DISTINCT lead_id) FILTER (WHERE sql_status = 1)").alias("sqls"),
        opps.alias("opps"), won_opps.alias("won_opps"),
        F.sum("pipeline_amount").cast(MONEY_SUM).alias("pipeline_amount"),
        F.sum(F.when(won, F.col("revenue"))).cast(MONEY_SUM).alias("closed_won_revenue"),
        _rate(opps, leads).alias("lead_to_opp_rate"),
        _rate(won_opps, opps).alias("opp_to_win_rate"),
        _rate(won_opps, leads).alias("lead_to_win_rate"))


def lead_funnel(leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per lead_source."""
    base = lead_base(leads, opportunities, sales)
    return (funnel(base, F.col("lead_source"), "lead_source")
            .orderBy(F.desc_nulls_last("closed_won_revenue")))


def funnel_by_month(leads: DataFrame, opportunities: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per month of lead creation."""
    base = lead_base(leads, opportunities, sales)
    return funnel(base, month_start("created_at"), "month_start").orderBy("month_start")


def overview_by_month(leads: DataFrame, opportunities: DataFrame, sales: DataFrame,
                      spend: DataFrame) -> DataFrame:
    """month_start, leads, opportunities, won_opps, win_rate, won_sales, acv,
    revenue, spend, cac: each counted in the month of its own date (lead
    created, opportunity created, sale booked, spend month); cac = spend /
    order ids booked in the month.

    Every source gives (month, measure) rows, and one aggregate over their
    union, combined map-side, puts the measures of a month side by side.
    """
    m = "month_start"
    one = F.lit(1)
    won_ids = opportunities.where(F.col("win_flag") == 1).select(F.col("opportunity_id").alias("_won"))
    won_sales = sales.join(won_ids, sales.opportunity_id == won_ids._won, "left_semi")
    parts = [
        leads.select(month_start("created_at").alias(m), one.alias("leads")),
        opportunities.select(month_start("created_at").alias(m), one.alias("opportunities"),
                             (F.col("win_flag") == 1).cast("int").alias("won_opps")),
        won_sales.select(month_start("booked_at").alias(m), one.alias("won_sales"), F.col("booked_amount").alias("revenue")),
        sales.select(month_start("booked_at").alias(m), F.col("order_id").isNotNull().cast("int").alias("_orders")),
        spend.select(F.col("month_start").alias(m), "spend"),
    ]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p, allowMissingColumns=True)
    counts = ["leads", "opportunities", "won_opps", "won_sales", "_orders"]
    month = long.groupBy(m).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
                                *[F.sum(c).cast(MONEY_SUM).alias(c) for c in ("revenue", "spend")])
    return month.select(
        m, "leads", "opportunities", "won_opps", _rate(F.col("won_opps"), F.col("opportunities")).alias("win_rate"),
        "won_sales", (F.col("revenue") / F.nullif(F.col("won_sales"), F.lit(0))).cast("decimal(18,2)").alias("acv"),
        "revenue", "spend",
        (F.col("spend") / F.nullif(F.col("_orders"), F.lit(0))).cast("decimal(18,2)").alias("cac")).orderBy(m)
