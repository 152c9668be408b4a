import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.operators import attribution as A
from revlens.operators.touches import touches_from
from tests import brute
from tests.fixtures import attribution_tables


@pytest.fixture(scope="module")
def edge(spark):
    tables = attribution_tables(spark)
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    return tables, won, touches_from(tables)


@pytest.fixture(scope="module")
def held(edge):
    return brute.collect(edge[0])


def test_touches_filters(edge):
    _, _, t = edge
    ids = {int(r.touch_id) for r in t.collect()}
    assert 102 not in ids            # web session without campaign
    assert 302 not in ids            # no_answer
    assert 303 not in ids            # NULL outcome is not a touch either
    assert {101, 103, 104, 105, 106, 107, 201, 202, 203, 301, 304} == ids
    web_email = [r for r in t.collect() if r.touch_id == "106"][0]
    assert web_email.touch_type == "email"      # a session channel 'email' stays 'email'


def test_won_sales(edge):
    _, won, _ = edge
    got = sorted((int(r.order_id), int(r.contact_id)) for r in won.collect())
    # lost opportunity (3) and order without lead (5) are out; order 2 appears twice
    assert got == [(1, 1), (2, 2), (2, 5), (4, 4), (6, 1)]


def test_first_touch_edges(spark, edge):
    _, won, t = edge
    ft = {int(r.order_id): r for r in A.first_touch(won, t).collect()}
    assert set(ft) == {1, 2, 6}                 # order 4 has no touch
    assert ft[1].touch_type == "paid" and ft[1].touch_ts == dt.datetime(2024, 1, 1, 9)
    # two touches at one instant: NULL channel sorts first
    assert ft[2].touch_type is None and ft[2].sale_amount == Decimal("250.00")


def test_last_touch_edges(edge):
    _, won, t = edge
    lt = {int(r.order_id): r for r in A.last_touch(won, t).collect()}
    # email on the booking day counts, the 08:00 web touch that day does not
    assert lt[1].touch_type == "email"
    assert lt[6].touch_type == "organic"
    # duplicate order_id 2: one rank group over both rows
    assert lt[2].touch_type == "sales" and lt[2].sale_amount == Decimal("40.00")


def test_linear_split_over_three(edge):
    _, won, t = edge
    lin = A.linear_touch(won, t).where("order_id = '1'").collect()
    assert {r.touch_type for r in lin} == {"paid", "sales", "email"}
    assert all(r.touches_per_order == 3 for r in lin)
    assert all(r.attributed_revenue == Decimal("33.333333333") for r in lin)


@pytest.mark.parametrize("ours,twin", [
    (lambda w, t: A.single_touch_by_channel(A.first_channel(w, t)), lambda h: brute.single(h, last=False)),
    (lambda w, t: A.single_touch_by_channel(A.first_touch(w, t)), lambda h: brute.single(h, last=False)),
    (lambda w, t: A.single_touch_by_channel(A.last_channel(w, t)), lambda h: brute.single(h, last=True)),
    (lambda w, t: A.single_touch_by_channel(A.last_touch(w, t)), lambda h: brute.single(h, last=True)),
    (lambda w, t: A.linear_by_channel(A.linear_touch(w, t)), brute.linear),
    (A.linear_credit_by_channel, brute.linear),
    (lambda w, t: A.qa_untouched(w, t), brute.untouched),
])
def test_reports_match_brute_force(edge, held, ours, twin):
    _, won, t = edge
    assert brute.rows(ours(won, t)) == brute.rows(twin(held))


def utm_twin(held, label):
    return [("first", *r) for r in brute.single(held, False, label)] + [("last", *r) for r in brute.single(held, True, label)] \
        + [("linear", *r) for r in brute.linear(held, label)]


@pytest.mark.parametrize("label", ["medium", "campaign"])
def test_utm_reports_match_brute_force(edge, held, label):
    _, won, t = edge
    assert brute.rows(A.attribution_by(won, t, f"utm_{label}")) == brute.rows(utm_twin(held, label))


def test_expected_channel_totals(edge):
    _, won, t = edge
    first = {r.channel: (r.num_sales, r.total_revenue)
             for r in A.single_touch_by_channel(A.first_touch(won, t)).collect()}
    assert first == {"paid": (2, Decimal("400.00")), "Unknown": (1, Decimal("250.00"))}
    lin = {r.channel: r.total_revenue_credit
           for r in A.linear_by_channel(A.linear_touch(won, t)).collect()}
    assert lin["organic"] == Decimal("60.00") and lin["Unknown"] == Decimal("62.50")


def test_monthly_sums_equal_channel_totals(edge):
    _, won, t = edge
    by_month = A.linear_by_month(A.linear_touch(won, t)).groupBy("channel").agg(
        F.round(F.sum("total_revenue_credit"), 2).alias("s"))
    by_channel = A.linear_by_channel(A.linear_touch(won, t))
    a = {r.channel: r.s for r in by_month.collect()}
    b = {r.channel: r.total_revenue_credit for r in by_channel.collect()}
    assert a == b


HOT_DAYS = 60


def hot_tables(spark):
    """One contact holds 80% of 6,000 web touches and two thirds of 300 orders."""
    days = HOT_DAYS
    web = spark.range(6000).select(
        F.when(F.col("id") % 10 < 8, F.lit("1")).otherwise((F.col("id") % 50 + 2).cast("string")).alias("contact_id"),
        F.timestamp_add("MINUTE", (F.col("id") * 13) % (days * 1440),
                        F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz").alias("started_at"),
        F.when(F.col("id") % 3 == 0, "paid").when(F.col("id") % 3 == 1, "organic").otherwise("social")
         .alias("channel"),
        F.lit("1").alias("campaign_id"), F.lit("g").alias("utm_source"), F.lit("cpc").alias("utm_medium"),
        F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("utm_campaign"),
        F.col("id").cast("string").alias("touch_id"))
    email = spark.range(0).select(F.lit("1").alias("contact_id"),
                                  F.current_date().alias("sent_at"), F.lit("x").alias("utm_source"),
                                  F.lit("x").alias("utm_medium"), F.lit("x").alias("utm_campaign"),
                                  F.col("id").alias("touch_id"))
    acts = spark.range(0).select(F.col("id").cast("string").alias("activity_id"), F.lit("1").alias("contact_id"),
                                 F.current_date().alias("ts"), F.lit("call").alias("type"),
                                 F.lit("connected").alias("outcome"))
    orders = spark.range(300).select(
        F.col("id").alias("order_id"), F.col("id").alias("opportunity_id"),
        (F.col("id") * 7 % 1000 + 1).cast("decimal(10,2)").alias("booked_amount"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") * 11 % (days + 10)).cast("int")).alias("booked_at"))
    opps = orders.select("opportunity_id", F.col("opportunity_id").alias("lead_id"), F.lit("won").alias("stage"),
                         F.col("booked_amount").alias("amount"), F.col("booked_at").alias("created_at"),
                         F.lit(1).alias("win_flag"))
    leads = orders.select(F.col("opportunity_id").alias("lead_id"),
                          F.when(F.col("order_id") % 3 > 0, F.lit("1")).otherwise((F.col("order_id") % 50 + 2)
                           .cast("string")).alias("contact_id"),
                          F.lit("web").alias("source"), F.col("booked_at").alias("created_at"),
                          F.lit(1).alias("mql_flag"), F.lit(1).alias("sql_flag"))
    tables = {"web_sessions_stg": web, "email_engagement_stg": email, "sales_activities_stg": acts,
              "sales_stg": orders, "opportunities_stg": opps, "leads_stg": leads}
    return tables


def test_hot_contact_matches_brute_force_and_stays_bounded(spark):
    """One contact holds most touches and orders: the pair-free plan must
    agree with the pairs while its window groups stay bounded by days."""
    tables = hot_tables(spark)
    held = brute.collect(tables)
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    t = touches_from(tables)
    assert brute.rows(A.single_touch_by_channel(A.first_channel(won, t))) == brute.rows(brute.single(held, last=False))
    assert brute.rows(A.single_touch_by_channel(A.last_channel(won, t))) == brute.rows(brute.single(held, last=True))
    assert brute.rows(A.linear_by_channel(A.linear_touch(won, t))) == brute.rows(brute.linear(held))
    assert brute.rows(A.linear_credit_by_channel(won, t)) == brute.rows(brute.linear(held))
    # the hot contact's largest window group is bounded by distinct days, not by its 4,800 touches
    assert A.channel_days(t).where("contact_id = '1'").count() <= (HOT_DAYS + 1) * 3
    assert A.days(A.channel_days(t)).where("contact_id = '1'").count() <= HOT_DAYS + 1


def test_many_campaigns_and_days_of_one_contact(spark):
    """UTM reports of a contact with hundreds of campaigns on many booking days:
    equal to the pairs, and no plan step holds days x campaigns."""
    tables = hot_tables(spark)
    web = tables["web_sessions_stg"].withColumn("utm_campaign", F.concat(F.lit("c"), (F.col("touch_id").cast("bigint") % 700).cast("string")))
    tables = {**tables, "web_sessions_stg": web}
    held = brute.collect(tables)
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    report = A.attribution_by(won, touches_from(tables), "utm_campaign")
    assert brute.rows(report) == brute.rows(utm_twin(held, "campaign"))


def test_ten_thousand_channels_of_one_contact(spark):
    """Linear credit of a contact with 10,000 channels: the report, made without
    (day, channel) pairs, equals the detail's sums, and the detail's query
    points are the pairs that its result has."""
    tables = hot_tables(spark)
    web = spark.range(10_000).select(
        F.lit("1").alias("contact_id"), F.timestamp_add("MINUTE", F.col("id") * 8, F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz").alias("started_at"),
        F.concat(F.lit("channel "), F.col("id").cast("string")).alias("channel"), F.lit("1").alias("campaign_id"), F.lit("g").alias("utm_source"),
        F.lit("cpc").alias("utm_medium"), F.lit("c").alias("utm_campaign"), F.col("id").cast("string").alias("touch_id"))
    tables = {**tables, "web_sessions_stg": web, "sales_stg": tables["sales_stg"].where("order_id < 40")}
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    t = touches_from(tables)
    detail = A.linear_touch(won, t)
    report = {r[0]: tuple(r) for r in A.linear_credit_by_channel(won, t).collect()}
    summed = {r[0]: tuple(r) for r in A.linear_by_channel(detail).collect()}
    assert len(report) > 9_000 and report == summed
    assert detail.count() == sum(r[1] for r in report.values())


def test_ties_at_one_instant_pick_the_same_touch(spark):
    """Touches of one contact, instant and channel differ in id and UTM text only: first takes the least, last the greatest."""
    tables = hot_tables(spark)
    one = tables["web_sessions_stg"].where("touch_id < 6").withColumn("contact_id", F.lit("1")).withColumn("channel", F.lit(None).cast("string"))
    one = one.withColumn("started_at", F.lit(dt.datetime(2023, 12, 1)).cast("timestamp_ntz"))
    one = one.withColumn("utm_campaign", F.when(F.col("touch_id") != "3", F.concat(F.lit("u"), "touch_id")))
    one = one.unionByName(one.where("touch_id = '0'").withColumn("touch_id", F.lit(None).cast("string")).withColumn("utm_campaign", F.lit("no id")))
    tables = {**tables, "web_sessions_stg": one}
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    t = touches_from(tables)
    assert {(r.touch_type, r.utm_campaign) for r in A.first_touch(won, t).collect()} == {(None, "no id")}
    assert {(r.touch_type, r.utm_campaign) for r in A.last_touch(won, t).collect()} == {(None, "u5")}
    assert A.first_touch(won, t).count() == won.where("contact_id = '1'").count()


def test_repeated_order_ids_in_utm_reports(spark):
    """Order ids on several rows, contacts and days (and a NULL order id) count once per value."""
    tables = hot_tables(spark)
    sales = tables["sales_stg"].withColumn("order_id", F.when(F.col("order_id") % 7 == 0, F.lit("same")).when(F.col("order_id") % 11 == 0, F.lit(None)).otherwise((F.col("order_id") % 90).cast("string")))
    tables = {**tables, "sales_stg": sales}
    held = brute.collect(tables)
    won = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"])
    got = A.attribution_by(won, touches_from(tables), "utm_campaign")
    count = lambda rs: {(r[0], r[1]): r[2] for r in rs if r[0] == "linear"}
    want = {k: n - 1 for k, n in count(utm_twin(held, "campaign")).items()}  # the twin counts the NULL id as one order
    assert count(brute.rows(got)) == want
    assert {r[:2]: r[3] for r in brute.rows(got)} == {r[:2]: r[3] for r in brute.rows(utm_twin(held, "campaign"))}


def test_dedupe_keys_option(edge):
    tables, won, _ = edge
    dedup = A.won_sales(tables["sales_stg"], tables["opportunities_stg"], tables["leads_stg"],
                        dedupe_keys=True)
    got = sorted((int(r.order_id), int(r.contact_id), r.booked_at) for r in dedup.collect())
    # order 2 keeps its latest booking (contact 5, 2024-01-20); the default keeps both rows
    assert got == [(1, 1, dt.date(2024, 1, 10)), (2, 5, dt.date(2024, 1, 20)),
                   (4, 4, dt.date(2024, 1, 15)), (6, 1, dt.date(2024, 2, 1))]
    assert won.count() == 5
