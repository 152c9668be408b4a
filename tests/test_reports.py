"""Influence, funnel, LTV and CAC on mini fixtures, against the plain-Python twin."""

import datetime as dt
from decimal import Decimal

import pytest

from revlens.operators import attribution as A
from revlens.operators import funnel as FN
from revlens.operators import influence as INF
from revlens.operators import ltv as LTV
from revlens.operators.touches import touches_from
from tests import brute
from tests.fixtures import ABM, ACCOUNTS, SPEND, SUBS, attribution_tables, frame

D = dt.date


@pytest.fixture(scope="module")
def edge(spark):
    tables = attribution_tables(spark)
    return tables


def test_opp_influence_matches_literal(spark, edge):
    held, t = edge, touches_from(edge)
    ours = INF.opp_influence(edge["opportunities_stg"], edge["leads_stg"], t)
    assert brute.rows(ours) == brute.rows(brute.opp_influence(brute.collect(held)))


def test_pipeline_influence_matches_literal(spark, edge):
    held, t = edge, touches_from(edge)
    ours = INF.pipeline_influence(edge["opportunities_stg"], edge["leads_stg"], t)
    assert brute.rows(ours) == brute.rows(brute.pipeline_influence(brute.collect(held)))


def test_customer_influence_matches_literal(spark, edge):
    held, t = edge, touches_from(edge)
    won = A.won_sales(edge["sales_stg"], edge["opportunities_stg"], edge["leads_stg"])
    ours = INF.customer_influence(won, t)
    assert brute.rows(ours) == brute.rows(brute.customer_influence(brute.collect(held)))
    by = {r.channel: r for r in ours.collect()}
    assert None in by                      # NULL channel stays NULL (no 'Unknown' here)


def _funnel_tables(spark):
    leads = frame(spark, "leads_stg", [
        (1, 1, "web", D(2024, 1, 1), None, 1, 1), (2, 2, "web", D(2024, 1, 2), None, 1, 0),
        (3, 3, "event", D(2024, 1, 3), None, 0, 0),                 # source without opportunities
        (4, 4, None, D(2024, 2, 3), None, 1, 0),                    # NULL source
    ])
    opps = frame(spark, "opportunities_stg", [
        (10, 1, "won", Decimal("100.00"), D(2024, 1, 5), None, 1),
        (11, 2, "lost", Decimal("40.00"), D(2024, 1, 6), None, 0),
        (12, 4, "won", Decimal("10.00"), D(2024, 2, 6), None, 1),
    ])
    sales = frame(spark, "sales_stg", [
        (100, 10, Decimal("60.00"), D(2024, 1, 9)), (101, 10, Decimal("40.00"), D(2024, 1, 9)),  # two sales
        (102, 12, Decimal("10.00"), D(2024, 2, 9)),
    ])
    return leads, opps, sales


def test_lead_funnel_matches_literal(spark):
    leads, opps, sales = _funnel_tables(spark)
    held = brute.collect({"leads_stg": leads, "opportunities_stg": opps, "sales_stg": sales})
    ours = FN.lead_funnel(leads, opps, sales)
    assert brute.rows(ours) == brute.rows(brute.lead_funnel(held))
    by = {r.lead_source: r for r in ours.collect()}
    assert by["event"].opps == 0 and by["event"].lead_to_opp_rate == Decimal("0.0000")
    assert by["event"].opp_to_win_rate is None and by["event"].closed_won_revenue is None
    # the opportunity with two sales counts its amount twice in the pipeline
    assert by["web"].pipeline_amount == Decimal("240.00")
    assert by[None].leads == 1


def test_overview_by_month(spark):
    leads, opps, sales = _funnel_tables(spark)
    spend = frame(spark, "spend_stg", SPEND)
    rows = {r.month_start: r for r in FN.overview_by_month(leads, opps, sales, spend).collect()}
    jan = rows[D(2024, 1, 1)]
    assert (jan.leads, jan.opportunities, jan.won_opps, jan.won_sales) == (3, 2, 1, 2)
    assert jan.win_rate == Decimal("0.5000") and jan.acv == Decimal("50.00")
    assert jan.spend == Decimal("100.00")


@pytest.fixture(scope="module")
def ltv_tables(spark):
    subs = frame(spark, "subscriptions_stg", SUBS)
    acc = frame(spark, "accounts_stg", ACCOUNTS)
    abm = frame(spark, "abm_accounts_stg", ABM)
    return subs, acc, abm


def test_account_ltv_final_status(ltv_tables):
    subs, _, _ = ltv_tables
    got = {r.account_id: r for r in LTV.account_ltv(subs).collect()}
    assert got["2"].final_status == "churned"        # churned then active stays churned
    assert got["2"].lifetime_months == 3 and got["2"].total_ltv == Decimal("60.00")


def test_ltv_by_abm(ltv_tables):
    seg = LTV.ltv_segments(*ltv_tables)
    got = {r.abm_status: r for r in LTV.ltv_by_abm(seg).collect()}
    # account 3 is not in accounts (inner join); account 2 repeats per ABM row
    assert got["ABM"].churn_rate == 1.0 and got["ABM"].avg_ltv == Decimal("60.000000")
    assert got["Non-ABM"].avg_lifetime_months == 1.5      # true average, not truncated
    assert got["Non-ABM"].avg_ltv == Decimal("13.750000")


def test_overall_ltv_uses_all_accounts(ltv_tables):
    subs, _, _ = ltv_tables
    r = LTV.overall_ltv(subs).collect()[0]
    assert r.avg_lifetime_months == 7 / 4
    assert r.churn_rate == 0.25


def test_overall_cac(spark):
    spend = frame(spark, "spend_stg", SPEND)
    sales = frame(spark, "sales_stg", [(1, 1, Decimal("1.00"), D(2024, 1, 1)),
                                       (1, 2, Decimal("1.00"), D(2024, 1, 1)),     # duplicate: both count
                                       (None, 3, Decimal("1.00"), D(2024, 1, 1))])  # NULL: not counted
    assert LTV.overall_cac(spend, sales).collect()[0].CAC == Decimal("75.000000")
    empty = sales.where("false")
    assert LTV.overall_cac(spend, empty).collect()[0].CAC is None   # no sales: NULL, not an error


def test_opps_edge_pipeline_and_opp_influence(spark):
    """opps_edge: lead missing, NULL amount, two opportunities of one lead,
    one opportunity id with two amounts (distinct rows summed, raw base)."""
    leads = frame(spark, "leads_stg", [(1, 1, "web", D(2024, 1, 1), None, 1, 1), (2, 2, "web", D(2024, 1, 1), None, 1, 1)])
    opps = frame(spark, "opportunities_stg", [
        (10, 1, "open", Decimal("100.00"), D(2024, 1, 10), None, 0),
        (11, 1, "open", None, D(2024, 1, 10), None, 0),                     # NULL amount
        (12, 2, "open", Decimal("30.00"), D(2024, 1, 10), None, 0),
        (12, 2, "open", Decimal("50.00"), D(2024, 1, 10), None, 0),         # same id, second amount
        (13, 99, "open", Decimal("7.00"), D(2024, 1, 10), None, 0),         # lead missing
    ])
    web = frame(spark, "web_sessions_stg", [(1, dt.datetime(2024, 1, 2, 9), "paid", 1, "g", "cpc", "c", 1),
                                            (1, dt.datetime(2024, 1, 3, 9), "paid", 1, "g", "cpc", "c", 2),
                                            (2, dt.datetime(2024, 1, 4, 9), "paid", 1, "g", "cpc", "c", 3)])
    email = frame(spark, "email_engagement_stg", [(2, D(2024, 1, 5), "nl", "email", "c", 4)])
    acts = frame(spark, "sales_activities_stg", [])
    tables = {"leads_stg": leads, "opportunities_stg": opps, "web_sessions_stg": web,
              "email_engagement_stg": email, "sales_activities_stg": acts}
    held, t = tables, touches_from(tables)
    pipe = INF.pipeline_influence(opps, leads, t)
    assert brute.rows(pipe) == brute.rows(brute.pipeline_influence(brute.collect(held)))
    got = {r.channel: r.pipeline_influenced for r in pipe.collect()}
    # paid: opp 10 (100) + NULL + both rows of opp 12 (30 + 50); email: opp 12 rows only
    assert got == {"paid": Decimal("180.00"), "email": Decimal("80.00")}
    opp = INF.opp_influence(opps, leads, t)
    assert brute.rows(opp) == brute.rows(brute.opp_influence(brute.collect(held)))
    assert {r.channel: r.ops_influenced for r in opp.collect()} == {"paid": 3, "email": 1}


def test_integer_average_option(ltv_tables):
    """D1: the original dialect truncates AVG over integers; integer_avg gives that."""
    seg = LTV.ltv_segments(*ltv_tables)
    exact = {r.abm_status: r.avg_lifetime_months for r in LTV.ltv_by(seg, "abm_status").collect()}
    trunc = {r.abm_status: r.avg_lifetime_months
             for r in LTV.ltv_by(seg, "abm_status", integer_avg=True).collect()}
    assert exact["Non-ABM"] == 1.5 and trunc["Non-ABM"] == 1
