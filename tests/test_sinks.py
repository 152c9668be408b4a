"""Sinks: staged tables and marts written to the shared folder and read back."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir
from revlens.sources import driver, marts
from revlens.sources.marts import export_report, read_back, write_table
from tests.conftest import SF_SMALL


def _path(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/test-sinks/{name}-{uuid.uuid4().hex}"


def test_staged_table_partitioned_round_trip(spark):
    spend = driver.load(spark, SF_SMALL)["spend_stg"]
    path = _path(spark, "spend_stg")
    write_table(spend, path, partition_by=["month_start"])
    back = spark.read.parquet(path).select(*spend.columns)
    assert back.exceptAll(spend).count() == 0 and spend.exceptAll(back).count() == 0
    # partition pruning: a month filter reads one directory
    plan = back.where(F.col("month_start") == "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_bucketed_table(spark):
    sales = driver.load(spark, SF_SMALL)["sales_stg"]
    name = f"sales_stg_b_{uuid.uuid4().hex[:8]}"
    write_table(sales, _path(spark, name), bucket=(4, ["order_id"]), table=name)
    t = spark.table(name)
    assert t.count() == sales.count()
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_report_export_csv(spark):
    report = spark.createDataFrame([("email", 2, 10.5), ("paid", 1, 3.25)], "channel string, n long, v double")
    path = _path(spark, "report")
    export_report(report, path)
    back = read_back(spark, path, schema=report.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, report.collect()))
    assert back.rdd.getNumPartitions() == 1


def test_user_crm_tables_end_to_end(spark):
    """Raw CRM tables written as Parquet, loaded with load_crm, give the same
    report as the registered query over the driver tables."""
    from revlens.operators import attribution as A
    from revlens.operators.touches import touches_from
    from revlens.plans.queries import REGISTRY
    from revlens.sources.crm import load_crm, won_sales_of
    cat = driver.load(spark, SF_SMALL)
    raw = {"sales": cat["sales"], "opportunities": cat["opportunities"],
           "web_sessions": cat["web_sessions"], "email_engagement": cat["email_engagement"],
           "sales_activities": cat["sales_activities"],
           "leads": cat["leads"]}
    base = _path(spark, "crm")
    for name, df in raw.items():
        write_table(df, f"{base}/{name}")
    crm = load_crm(spark, {name: f"{base}/{name}" for name in raw})
    ours = A.single_touch_by_channel(A.first_touch(won_sales_of(crm), touches_from(crm)))
    expected = REGISTRY["first_touch_by_channel"](spark, SF_SMALL)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, expected.collect()))


def test_user_csv_tables_end_to_end(spark):
    """The same from CSV files: declared types apply, text dates and amounts are
    converted by the staging pipelines, linear and pipeline reports included."""
    from revlens.operators import attribution as A
    from revlens.operators import influence as INF
    from revlens.operators.touches import touches_from
    from revlens.plans.queries import REGISTRY
    from revlens.sources.crm import load_crm, won_sales_of
    cat = driver.load(spark, SF_SMALL)
    names = ["sales", "opportunities", "leads", "web_sessions", "email_engagement", "sales_activities", "spend"]
    base = _path(spark, "crm-csv")
    for name in names:
        write_table(cat[name], f"{base}/{name}", fmt="csv")
    crm = load_crm(spark, {name: f"{base}/{name}" for name in names}, fmt="csv")
    won, t = won_sales_of(crm), touches_from(crm)
    for key, ours in (("linear_by_channel", A.linear_by_channel(A.linear_touch(won, t))),
                      ("pipeline_influence", INF.pipeline_influence(crm["opportunities_stg"], crm["leads_stg"], t)),
                      ("stage_spend", crm["spend_stg"])):
        expected = REGISTRY[key](spark, SF_SMALL)
        assert sorted(map(repr, ours.select(*[c for c in expected.columns if c != "month_start"]).collect())) == \
            sorted(map(repr, expected.select(*[c for c in expected.columns if c != "month_start"]).collect())), key
    with pytest.raises(ValueError):
        load_crm(spark, {"assets": f"{base}/spend"}, fmt="csv")


def test_export_of_a_detail_table_is_ordered_parts(spark, monkeypatch):
    monkeypatch.setattr(marts, "FILE_ROWS", 300)
    path = _path(spark, "detail")
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"v{i}") for i in range(1000)]
    export_report(spark.createDataFrame(rows, "k int, v string").repartition(7), path, order_by=["k"])
    names = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    parts = [open(os.path.join(path, f)).read().splitlines() for f in names]
    assert len(parts) == 4 and all(p[0] == "k,v" for p in parts)
    assert [int(line.split(",")[0]) for p in parts for line in p[1:]] == sorted(k for k, _ in rows)
    empty = _path(spark, "empty")
    export_report(spark.createDataFrame([], "k int, v string"), empty)
    assert read_back(spark, empty, schema="k int, v string").count() == 0


def test_refresh_marts(spark):
    """All marts written in one run equal the registered queries."""
    from revlens.plans.marts import refresh_marts
    from revlens.plans.queries import REGISTRY
    out = _path(spark, "marts")
    written = refresh_marts(driver.load(spark, SF_SMALL), out)
    assert len(written) == 20
    for name in ("first_touch_by_channel", "linear_by_month", "customer_influence", "ltv_by_abm",
                 "attribution_by_utm_campaign"):
        back = spark.read.parquet(written[name])
        expected = REGISTRY[name](spark, SF_SMALL)
        assert sorted(map(repr, back.select(*expected.columns).collect())) == sorted(map(repr, expected.collect())), name
