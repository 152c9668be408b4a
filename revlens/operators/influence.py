"""Channel influence on opportunities, pipeline and customers.

A record is influenced by a channel when its contact had at least one touch
of that channel on or before the record's date.  That holds exactly when the
contact's *earliest* touch of the channel is on or before the date, so
touches are first reduced to ``(contact, channel) -> min(ts)``: the join is
then bounded by contacts x channels instead of all touches, and a contact
with millions of touches contributes one row per channel.

The channel stays NULL when the touch has none (no 'Unknown' here).
Fractions are ratios (0.25), not percents: 2, 2 and 4 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import written

MONEY_SUM = "decimal(38,2)"


def contact_channel_first(touches: DataFrame) -> DataFrame:
    """(contact_id, touch_type) -> first_ts."""
    t = touches.where(F.col("contact_id").isNotNull() & F.col("ts").isNotNull())
    return t.groupBy("contact_id", "touch_type").agg(F.min("ts").alias("first_ts"))


def opps_with_contact(opportunities: DataFrame, leads: DataFrame) -> DataFrame:
    """opportunity_id, stage, amount, opp_created_at, contact_id."""
    return (opportunities.join(leads.select("lead_id", "contact_id"), "lead_id")
            .select("opportunity_id", "stage", "amount",
                    F.col("created_at").alias("opp_created_at"), "contact_id"))


def _influenced(records: DataFrame, touches: DataFrame, date_col: str) -> DataFrame:
    r, c = records.alias("r"), contact_channel_first(touches).alias("c")
    cond = ((F.col("r.contact_id") == F.col("c.contact_id"))
            & (F.col("c.first_ts") <= F.col(f"r.{date_col}").cast("timestamp_ntz")))
    return r.join(c, cond)


def opportunity_touches(opportunities: DataFrame, leads: DataFrame, touches: DataFrame) -> DataFrame:
    """Distinct (opportunity_id, amount, stage, opp_created_at, touched_channel)."""
    j = _influenced(opps_with_contact(opportunities, leads), touches, "opp_created_at")
    return j.select("r.opportunity_id", "r.amount", "r.stage", "r.opp_created_at",
                    F.col("c.touch_type").alias("touched_channel")).distinct()


def _ratio(num, den, scale: int):
    return (num * F.lit(1.0) / den).cast(f"decimal(18,{scale})")


def opp_influence(opportunities: DataFrame, leads: DataFrame, touches: DataFrame) -> DataFrame:
    """channel, ops_influenced, influence_opps_pct; base = all opportunity ids."""
    j = _influenced(opps_with_contact(opportunities, leads), touches, "opp_created_at")
    per = j.groupBy(F.col("c.touch_type").alias("channel")).agg(
        F.count_distinct("r.opportunity_id").alias("ops_influenced"))
    # The base is an uncorrelated scalar subquery, run once and inlined.
    base = opportunities.agg(F.count_distinct("opportunity_id")).scalar()
    return (per.select("channel", "ops_influenced",
                       _ratio(F.col("ops_influenced"), base, 2).alias("influence_opps_pct"))
               .orderBy(F.desc_nulls_last("influence_opps_pct")))


def pipeline_influence(opportunities: DataFrame, leads: DataFrame, touches: DataFrame) -> DataFrame:
    """channel, pipeline_influenced, influence_pipeline_pct; base = all pipeline.

    Sums over the distinct (opportunity, amount, stage, date, channel) rows,
    while the base sums raw opportunity rows.
    """
    ot = opportunity_touches(opportunities, leads, touches)
    per = ot.groupBy(F.col("touched_channel").alias("channel")).agg(
        F.sum("amount").alias("_p"))
    base = opportunities.agg(F.sum("amount")).scalar()
    return (per.select("channel", F.col("_p").cast(MONEY_SUM).alias("pipeline_influenced"),
                       _ratio(F.col("_p"), base, 2).alias("influence_pipeline_pct"))
               .orderBy(F.desc_nulls_last("influence_pipeline_pct")))


def customer_influence(won: DataFrame, touches: DataFrame) -> DataFrame:
    """channel, buyers_influenced, influence_customers_pct; base = won sales with a contact."""
    won = written(won, "won_sales")       # joined and counted for the base
    j = _influenced(won, touches, "booked_at")
    per = j.groupBy(F.col("c.touch_type").alias("channel")).agg(
        F.count_distinct("r.order_id").alias("buyers_influenced"))
    base = won.agg(F.count_distinct("order_id")).scalar()
    return (per.select("channel", "buyers_influenced",
                       _ratio(F.col("buyers_influenced"), base, 4).alias("influence_customers_pct"))
               .orderBy(F.desc_nulls_last("influence_customers_pct")))
