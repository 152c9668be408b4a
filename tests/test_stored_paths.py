"""Stored staged tables, numbered touch paths, distinct counts, observed rejects, collated comparison."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from revlens.operators import quality as Q
from revlens.operators import staging as STG
from revlens.operators.collated import group_collated, join_collated
from revlens.operators.touch_index import order_path_ends, touch_index
from revlens.session import written
from revlens.sources.stored import StagedStore, store_deals, stored_lead_base, stored_won_sales
from tests.conftest import SF_SMALL
from tests.test_plans import _count, _plan

TOUCH = ("contact_id string, ts timestamp_ntz, touch_type string, source_label string, campaign_id string, utm_source string, "
         "utm_medium string, utm_campaign string, touch_id string")


def touch_rows(n=900, seed=6):
    """A third of the touches are one contact's; equal instants, missing channels, contacts and instants, and equal rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        contact = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"c{rng.randrange(40)}"
        ts = None if i % 37 == 0 else dt.datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(3))
        rows.append((contact, ts, rng.choice(["web", "email", None]), None, None, "u", "m", "x", f"t{i if i % 10 else 0}"))
    return rows


def place(r):
    return (r[1], r[2] is not None, r[2] or "", r[8])


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_touch_numbers_with_a_hot_contact(spark, partitions):
    rows = touch_rows()
    got = touch_index(spark.createDataFrame(rows, TOUCH), partitions).collect()
    by = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            by.setdefault(r[0], []).append(r)
    want = [(c, i, place(r)) for c, own in by.items() for i, r in enumerate(sorted(own, key=place), 1)]
    assert sorted((r.contact_id, r.touch_no, place(tuple(r))) for r in got) == sorted(want)


def test_path_ends_equal_the_pairs(spark):
    rows = touch_rows()
    rng = random.Random(1)
    won = [(f"o{i // 2}", i, dt.date(2024, 1, rng.randrange(1, 24)) if i % 13 else None, "hot" if i % 3 == 0 else None if i % 17 == 0 else f"c{rng.randrange(50)}") for i in range(120)]
    df = spark.createDataFrame(won, "order_id string, sale_amount long, booked_at date, contact_id string")
    want = []
    for o, a, day, c in won:
        own = sorted((r for r in rows if c is not None and day and r[0] == c and r[1] is not None and r[1] <= dt.datetime.combine(day, dt.time())), key=place)
        if own:
            want.append((o, a, c, len(own), own[0][8], own[0][1], own[-1][8], own[-1][1]))
    got = order_path_ends(df, spark.createDataFrame(rows, TOUCH), 9).collect()
    assert sorted((r.order_id, r.sale_amount, r.contact_id, r.touches, r.first_touch_id, r.first_touch_ts, r.last_touch_id, r.last_touch_ts) for r in got) == sorted(want)


def test_a_hot_contact_is_numbered_in_many_partitions(spark):
    rows = [("hot", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "web", None, None, None, None, None, str(i)) for i in range(5000)]
    df = touch_index(spark.createDataFrame(rows, TOUCH).repartition(4), 10)
    assert "hashpartitioning(_part" in _plan(spark, df).replace("#", " #").replace("_part ", "_part")
    assert [r.touch_no for r in df.orderBy("ts").collect()] == list(range(1, 5001))
    spread = written(spark.createDataFrame(rows, TOUCH).repartitionByRange(10, "contact_id", "ts").withColumn("p", F.spark_partition_id()), "spread")
    assert spread.select("p").distinct().count() >= 8


# ---- stored tables ---------------------------------------------------------

LEADS = [("L1", "c1", "web", dt.date(2024, 1, 1), None, 1, 0), ("L1", "c2", "ads", dt.date(2024, 1, 2), None, 1, 1), (None, "c3", "web", None, None, 0, 0), ("L4", "c4", None, None, None, 0, 1)]
OPPS = [("O1", "L1", "F", 10, None, None, 1), ("O1", "L1", "F", 11, None, None, 1), ("O2", None, "F", 5, None, None, 1), (None, "L4", "F", 7, None, None, 1), ("O5", "L4", "P", 9, None, None, 0)]
SALES = [("S1", "O1", 100, dt.date(2024, 2, 1)), ("S1", "O1", 101, None), ("S2", "O2", 50, None), ("S3", None, 70, None), (None, "O5", 90, None), (None, "O1", 3, None)]


def small(spark):
    return (spark.createDataFrame(LEADS, "lead_id string, contact_id string, source string, created_at date, first_response_at date, mql_flag int, sql_flag int"),
            spark.createDataFrame(OPPS, "opportunity_id string, lead_id string, stage string, amount int, created_at date, close_date date, win_flag int"),
            spark.createDataFrame(SALES, "order_id string, opportunity_id string, booked_amount int, booked_at date"))


def test_stored_chain_equals_the_plain_one(spark):
    from revlens.operators.attribution import won_sales
    from revlens.operators.funnel import lead_base
    leads, opps, sales = small(spark)
    store = StagedStore(spark, 5)
    store_deals(store, leads, opps, sales)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(stored_won_sales(store)) == key(won_sales(sales, opps, leads))
    plain = lead_base(leads, opps, sales)
    assert key(stored_lead_base(store).select(*plain.columns)) == key(plain)
    assert key(store["leads_stg"]) == key(leads)
    store.drop()
    with pytest.raises(KeyError):
        store["leads_stg"]


def test_stored_chain_has_no_shuffle(spark):
    """Neither where the deals are made nor where they meet the leads; with broadcasts off, so that the join is one of buckets."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, E.queries()["stored_won_sales"](spark, SF_SMALL))
        assert _count(plan, "Exchange") == 0 and _count(plan, "SortMergeJoin") == 1 and "SelectedBucketsCount" in plan, plan
        store = StagedStore(spark, 4)
        leads, opps, sales = small(spark)
        store_deals(store, leads, opps, sales)
        o, s = store["opportunities_stg"], store["sales_stg"].withColumnRenamed("opportunity_id", "k")
        assert _count(_plan(spark, o.join(s, o.opportunity_id == s.k, "left")), "Exchange") == 0
        files = store["leads_stg"].inputFiles()
        assert len(files) <= 4  # one a bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# ---- profiles and rejects --------------------------------------------------

def test_distinct_counts_of_all_types(spark):
    rows = [(1, 0.0, "a", b"\x00", [1], dt.date(2024, 1, 1)), (1, -0.0, "A", b"\x01", [1, None], None), (None, float("nan"), "a ", None, [1], dt.date(2024, 1, 1)), (2, float("nan"), "", b"\x00", None, None)]
    df = spark.createDataFrame(rows, "i int, `d.x` double, s string, b binary, l array<int>, t date")
    got = {r.column: r.distinct_values for r in Q.distinct_counts(df).collect()}
    want = {c: df.agg(F.count_distinct(F.col(f"`{c}`"))).first()[0] for c in df.columns}
    assert got == want == {"i": 2, "d.x": 2, "s": 4, "b": 2, "l": 2, "t": 1}
    empty = Q.profile(df.limit(0), "x", exact_distinct=True).collect()
    assert {r.distinct_values for r in empty} == {0} and len(empty) == 6


def test_distinct_counts_take_two_shuffles_and_no_expand(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plan = _plan(spark, Q.distinct_counts(df))
    assert _count(plan, "Exchange") == 2 and _count(plan, "Expand") == 0 and _count(plan, "Scan parquet") == 1


def test_observed_rejects_come_from_the_staging_write(spark):
    raw = spark.createDataFrame([("c1", "bad", "1"), ("c1", "bad", "x"), (None, "2024-01-01", "2"), ("c1", "2024-01-05", "2")], "contact_id string, created_at string, email string")
    raw = raw.withColumn("lead_source", F.lit("s")).withColumn("rid", F.monotonically_increasing_id())
    staged, counts = Q.observed_rejects(STG.PIPELINES["crm_contacts"], raw, STG.conversions("crm_contacts", raw), "crm_contacts")
    assert counts == {"created_at": 2}
    assert sorted(map(str, staged.collect())) == sorted(map(str, STG.stage_contacts(raw).collect()))
    spend = spark.createDataFrame([("x", "1.5"), ("y", "n/a"), (None, None), ("z", "999999999999")], "channel string, spend string")
    staged, counts = Q.observed_rejects(STG.PIPELINES["spend"], spend, STG.conversions("spend", spend), "spend")
    assert counts == {"spend": 2} and staged.count() == 4
    staged, counts = Q.observed_rejects(STG.PIPELINES["spend"], spend.limit(0), STG.conversions("spend", spend), "spend")
    assert counts == {"spend": 0} and staged.count() == 0


# ---- collation -------------------------------------------------------------

def test_collated_groups_and_joins(spark):
    df = spark.createDataFrame([("CPC ", 1), ("cpc", 2), ("Cpc  ", 4), (" cpc", 8), (None, 16), ("É", 32), ("é", 64)], "m string, n int")
    got = {r.m: (r.rows, r.spellings, r.n) for r in group_collated(df, F.col("m"), "m", ["n"]).collect()}
    assert got == {"CPC ": (3, 3, 7), " cpc": (1, 1, 8), None: (1, 0, 16), "É": (2, 2, 96)}
    right = spark.createDataFrame([("CPC", "paid"), (None, "none"), ("social", "s")], "k string, kind string")
    assert sorted(r.n for r in join_collated(df, right, "m", "k").collect()) == [1, 2, 4]
    exact = df.groupBy("m").count().count()
    assert exact == 7 and len(got) == 4


def test_collated_report_differs_from_the_exact_one(spark):
    rows = E.queries()["touches_by_medium_collated"](spark, SF_SMALL).collect()
    assert any(r.spellings > 1 for r in rows)
