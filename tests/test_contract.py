"""Driver contract: entry smoke, registry/oracle consistency, every query
against its DuckDB oracle on the driver tables, and invariants."""

from decimal import Decimal

import pytest

import __spark_entry__ as E
from revlens.plans.queries import REGISTRY
from tests.conftest import SF_MID, SF_SMALL
from tools.oracle_check import compare


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["channel", "num_sales", "total_revenue"]
    assert df.count() >= 0


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(E.queries()) and set(REGISTRY) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_match_oracle_small(spark):
    report = compare(spark, SF_SMALL, set(REGISTRY), verbose=False)
    assert len(report) == len(REGISTRY)
    bad = {k: v for k, v in report.items() if v["status"] != "match"}
    assert not bad, bad


def test_adapter_exercises_the_operators(spark):
    """What de-duplication, DISTINCT, normalising and reject counts are for occurs in the driver's data."""
    q = {k: (lambda k=k: REGISTRY[k](spark, SF_MID)) for k in REGISTRY}
    assert q["buyers"]().count() < q["won_sales"]().count()
    assert q["dedup_earliest"]().count() < q["stage_opportunities"]().count()
    assert q["touches_normalized"]().exceptAll(q["touches"]()).count() > 0
    assert all(r.rejected > 0 for r in q["date_rejects"]().collect())
    assert sum(r.rejected > 0 for r in q["convert_rejects"]().collect()) >= 8
    r = q["qa_reconcile"]().collect()[0]
    assert r.total_won_revenue != r.revenue_in_attribution
    assert "Unknown" in {r.channel for r in q["first_touch_by_channel"]().collect()}
    assert sum(r.repeated_keys > 0 for r in q["dup_key_checks"]().collect()) >= 5


def test_appended_files_are_seen(spark, tmp_path):
    from revlens.sources import driver
    path = f"{tmp_path}/orders.parquet"
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(100).write.parquet(path)
    assert driver.load(spark, str(tmp_path))["driver.orders"].count() == 100
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(50).write.mode("append").parquet(path)
    assert driver.load(spark, str(tmp_path))["driver.orders"].count() == 150


def _scalar(df, col):
    return df.collect()[0][col]


def test_attribution_reconciles_with_won_revenue(spark):
    """Revenue of first and last touch is that of one row per touched order;
    linear credit of an order is the average over its rows' touches, so with
    repeated order ids it lies between.  Won sales without touches are the rest."""
    q = E.queries()
    untouched = _scalar(q["qa_untouched"](spark, SF_MID), "revenue_with_no_touches")
    total = _scalar(q["qa_reconcile"](spark, SF_MID), "revenue_in_attribution")
    won = q["won_sales"](spark, SF_MID)
    touched = q["order_touches"](spark, SF_MID).select("order_id")
    rows = won.join(touched, "order_id", "left_semi")
    assert _scalar(rows.agg({"sale_amount": "sum"}), "sum(sale_amount)") + untouched == total
    once = rows.groupBy("order_id").count().where("count = 1").select("order_id")
    for key in ("first_touch", "last_touch"):
        part = q[key](spark, SF_MID).join(once, "order_id", "left_semi")
        assert _scalar(part.agg({"sale_amount": "sum"}), "sum(sale_amount)") == _scalar(rows.join(once, "order_id", "left_semi").agg({"sale_amount": "sum"}), "sum(sale_amount)")
    linear = q["linear_touch"](spark, SF_MID).join(once, "order_id", "left_semi")
    credit = _scalar(linear.agg({"attributed_revenue": "sum"}), "sum(attributed_revenue)")
    assert abs(credit - _scalar(rows.join(once, "order_id", "left_semi").agg({"sale_amount": "sum"}), "sum(sale_amount)")) <= Decimal("0.05")


def test_monthly_reports_sum_to_channel_reports(spark):
    q = E.queries()
    by_ch = {r.channel: (r.num_sales, r.total_revenue)
             for r in q["first_touch_by_channel"](spark, SF_MID).collect()}
    agg = {}
    for r in q["first_touch_by_month"](spark, SF_MID).collect():
        n, s = agg.get(r.channel, (0, Decimal(0)))
        agg[r.channel] = (n + r.customers_acquired, s + r.total_revenue)
    assert agg == by_ch


@pytest.mark.parametrize("key", ["opp_influence", "customer_influence"])
def test_influence_fractions_in_unit_interval(spark, key):
    col = {"opp_influence": "influence_opps_pct", "customer_influence": "influence_customers_pct"}[key]
    for r in E.queries()[key](spark, SF_MID).collect():
        assert Decimal(0) <= r[col] <= Decimal(1)


def test_dedup_gives_unique_keys(spark):
    q = E.queries()
    leads = q["stage_leads"](spark, SF_MID)
    assert leads.count() == leads.select("lead_id").distinct().count() == 15000
    contacts = q["stage_contacts"](spark, SF_MID)
    assert contacts.count() == contacts.select("contact_id").distinct().count()


def test_one_row_per_touched_order(spark):
    q = E.queries()
    touched = q["order_touches"](spark, SF_MID)
    n = touched.count()
    assert n == touched.select("order_id").distinct().count() > 0
    for key in ("first_touch", "last_touch"):
        df = q[key](spark, SF_MID)
        assert df.count() == df.select("order_id").distinct().count() == n
