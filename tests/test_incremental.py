"""Winner tables, distinct bitmaps and monthly marts: stored state that is brought up to date in parts."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from revlens.functions import month_start
from revlens.operators import bitmaps as BM
from revlens.operators import funnel as FN
from revlens.operators.dedup import keep_one
from revlens.operators.winners import WinnerTable
from revlens.plans.monthly import MonthlyMart
from revlens.session import scratch_path
from tests.conftest import SF_SMALL
from tests.test_plans import _count, _plan

ROW = "k string, at date, v int"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else None if i % 19 == 0 else f"k{rng.randrange(60)}", dt.date(2024, 1, rng.randrange(1, 9)) if i % 7 else None, rng.randrange(30)) for i in range(n)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("descending", [True, False])
def test_batches_in_any_order_equal_one_pass(spark, descending):
    data = rows()
    whole = spark.createDataFrame(data, ROW)
    want = sorted(map(str, keep_one(whole, ["k"], "at", descending, ["v"]).collect()))
    batches = [data[:150], data[100:300], [], data[250:], data[:150]]  # overlapping, empty and repeated
    for order in (batches, batches[::-1]):
        table = WinnerTable(spark, scratch_path(spark, "winners"), whole.schema, ["k"], "at", descending, ["v"], parts=5)
        for b in order:
            table.merge(spark.createDataFrame(b, ROW))
        assert sorted(map(str, table.read().collect())) == want


def test_a_batch_replaces_only_the_parts_it_touches(spark):
    table = WinnerTable(spark, scratch_path(spark, "winners"), spark.createDataFrame([], ROW).schema, ["k"], "at", True, parts=16)
    table.merge(spark.createDataFrame(rows(), ROW))
    before = files(table.path)
    table.merge(spark.createDataFrame([("new", dt.date(2025, 1, 1), 1)], ROW))
    after = files(table.path)
    assert len(before) > 8 and len(set(before) - set(after)) <= 1 and len(set(after) - set(before)) == 1
    assert all(after[f] == before[f] for f in set(before) & set(after))
    assert table.read().where("k = 'new'").count() == 1


def test_dense_numbers(spark):
    df = spark.createDataFrame([(k,) for k, *_ in rows()], "k string")
    got = {r.k: r.no for r in BM.dense_numbers(df, "k", "no", partitions=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted({k for k, *_ in rows() if k}))}


def test_months_of_bitmaps_add_up_to_quarters(spark):
    rng = random.Random(1)
    data = [(dt.date(2024, rng.randrange(1, 8), 1), f"L{rng.randrange(50_000)}", rng.randrange(2)) for _ in range(60_000)]
    df = spark.createDataFrame(data, "m date, id string, flag int")
    numbered = df.join(BM.dense_numbers(df, "id", "no"), "id")
    months = BM.distinct_bitmaps(numbered, "m", "no", {"ids": None, "flagged": F.col("flag") == 1})
    got = {r.m: (r.ids, r.flagged) for r in BM.counted(months, "m", ["ids", "flagged"]).collect()}
    distinct = lambda keep: len({i for m, i, f in data if keep(m, f)})
    assert got == {m: (distinct(lambda x, f: x == m), distinct(lambda x, f: x == m and f)) for m in got}
    quarters = BM.counted(BM.merged(months, F.quarter("m"), "q", ["ids", "flagged"]), "q", ["ids", "flagged"])
    assert {r.q: (r.ids, r.flagged) for r in quarters.collect()} == {
        q: (distinct(lambda x, f: (x.month + 2) // 3 == q), distinct(lambda x, f: (x.month + 2) // 3 == q and f)) for q in (1, 2, 3)}


def test_funnel_from_bitmaps_equals_the_plain_one(spark):
    leads = spark.createDataFrame([("L1", "c", "web", dt.date(2024, 1, 1), None, 1, 0), ("L2", "c", "web", None, None, 0, 1), (None, "c", "ads", dt.date(2024, 2, 1), None, 1, 1), ("L4", "c", None, dt.date(2024, 2, 1), None, 1, 1)],
                                  "lead_id string, contact_id string, source string, created_at date, first_response_at date, mql_flag int, sql_flag int")
    opps = spark.createDataFrame([("O1", "L1", "F", 10, 1), ("O1", "L1", "F", 11, 1), ("O3", "L2", "P", 5, 0), (None, "L1", "F", 3, 1), ("O5", "L4", "F", 2, None)],
                                 "opportunity_id string, lead_id string, stage string, amount int, win_flag int")
    sales = spark.createDataFrame([("S1", "O1", 7), ("S2", "O1", 8), ("S3", None, 9)], "order_id string, opportunity_id string, booked_amount int")
    for ours, plain in ((BM.funnel_by_source, FN.lead_funnel), (BM.funnel_by_month, FN.funnel_by_month)):
        got, want = ours(leads, opps, sales), plain(leads, opps, sales)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_no_expand_in_the_funnel_from_bitmaps(spark):
    plan = _plan(spark, E.queries()["lead_funnel_bitmaps"](spark, SF_SMALL))
    assert _count(plan, "Expand") == 0


def test_a_changed_month_rewrites_its_partition_alone(spark):
    shape = "month_start date, channel string, amount int"
    m = [dt.date(2024, i, 1) for i in (1, 2, 3)]
    state = [(m[i % 3], f"c{i % 4}", i) for i in range(60)] + [(None, "c1", 5)]
    build = lambda d: d.groupBy("month_start", "channel").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    mart = MonthlyMart(spark, scratch_path(spark, "mart"), build)
    same = lambda data: sorted(map(str, mart.read().select("month_start", "channel", "total", "n").collect())) == sorted(map(str, build(spark.createDataFrame(data, shape)).collect()))
    assert mart.refresh(spark.createDataFrame(state, shape)) == [None, *m] and same(state)
    first = files(mart.path)
    assert mart.refresh(spark.createDataFrame(state[::-1], shape)) == [] and files(mart.path) == first and same(state)
    changed = [(*r[:2], r[2] + 1) if r[0] == m[1] and r[2] == 4 else r for r in state] + [(dt.date(2024, 4, 1), "c9", 1)]
    assert mart.refresh(spark.createDataFrame(changed, shape)) == [m[1], dt.date(2024, 4, 1)] and same(changed)
    second = files(mart.path)
    kept = {f for f in first if "2024-02" not in f}
    assert kept <= set(second) and all(second[f] == first[f] for f in kept) and not {f for f in first if "2024-02" in f} & set(second)
    gone = [r for r in changed if r[0] != m[0]]
    assert mart.refresh(spark.createDataFrame(gone, shape)) == [] and same(gone)
    assert mart.refresh(spark.createDataFrame([], shape)) == [] and mart.read().count() == 0
