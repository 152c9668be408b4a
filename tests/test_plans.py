"""Plan-shape guards: the scale properties the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from revlens.operators import attribution as A
from revlens.operators.touches import touches_from
from revlens.session import checkpoint_dir, written
from revlens.sources import driver
from tests.conftest import SF_SMALL


def _plan(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _count(plan: str, node: str) -> int:
    return len(re.findall(rf"^\(\d+\) {node}\s*$", plan, flags=re.M))


# Shuffles of the returned plan; frames that several branches read were
# written while it was built.
BUDGET = {"first_touch_by_channel": 4, "last_touch_by_channel": 7, "linear_by_channel": 6,
          "attribution_by_utm_medium": 13, "lead_funnel": 5, "overview_by_month": 3, "ltv_by_segment": 5, "opp_influence": 7}


@pytest.mark.parametrize("key", sorted(BUDGET))
def test_shuffle_budget(spark, key):
    plan = _plan(spark, E.queries()[key](spark, SF_SMALL))
    assert _count(plan, "Exchange") <= BUDGET[key], plan


def test_no_semi_join_before_touch_aggregation(spark):
    plan = _plan(spark, E.queries()["last_touch_by_channel"](spark, SF_SMALL))
    assert "LeftSemi" not in plan


def test_subscription_aggregate_is_hash_based(spark):
    plan = _plan(spark, E.queries()["account_ltv"](spark, SF_SMALL))
    # the scan-side aggregate (account, status) is a hash aggregate
    first_agg = re.search(r"^\(\d+\) (HashAggregate|SortAggregate)\s*\nInput.*\nKeys \[2\]", plan, flags=re.M)
    assert first_agg and first_agg.group(1) == "HashAggregate"


def test_scans_are_pruned(spark):
    plan = _plan(spark, E.queries()["last_touch_by_channel"](spark, SF_SMALL))
    for schema in re.findall(r"ReadSchema: struct<(.*?)>$", plan, flags=re.M):
        assert schema.count(":") <= 5          # never the whole table
    assert "PushedFilters: [In(event_type" in plan


@pytest.mark.parametrize("reduce", [A.channel_days, lambda t: A.days(A.channel_days(t)), lambda t: A.value_days(t, "utm_campaign")])
def test_raw_touches_meet_a_hash_aggregate(spark, reduce):
    """What the reports do to raw touches first is hash-based: no task sorts its raw touches."""
    plan = _plan(spark, reduce(touches_from(driver.load(spark, SF_SMALL))))
    tree = plan[:plan.index("\n\n")].split("\n")
    union = max(i for i, line in enumerate(tree) if "Union (" in line)  # the union of touch sources is the deepest
    above = next(line for line in reversed(tree[:union]) if "Aggregate (" in line)
    assert "HashAggregate" in above, plan


def test_picked_touches_are_fetched_without_sorting_raw_touches(spark):
    """Raw touches meet the picked instants in hash joins; only above them is anything sorted, by the aggregate over text."""
    touches = touches_from(driver.load(spark, SF_SMALL))
    instants = written(touches.select(*A.INSTANT).where("contact_id = '1'").distinct(), "instants")
    plan = _plan(spark, A.touches_at(touches, instants, F.min))
    tree = plan[:plan.index("\n\n")].split("\n")
    join = min(i for i, line in enumerate(tree) if "Join" in line)
    assert "ShuffledHashJoin" in tree[join] and any("Aggregate" in line for line in tree[:join]), plan
    assert not any("Sort" in line for line in tree[join:]), plan


def test_one_plan_at_every_size(spark):
    """No code asks for a size before it picks a plan; a written frame is not written twice."""
    import pathlib

    import revlens
    source = "".join(p.read_text() for p in pathlib.Path(revlens.__file__).parent.glob("*/*.py") if p.parent.name != "llm")
    assert "sizeInBytes" not in source and "minBytes" not in source
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey")
    once = written(df, "t")
    assert once is not df and once.count() == df.count() and written(once, "t") is once
    files = once.inputFiles()
    assert files and all(checkpoint_dir(spark).rstrip("/").split(":")[-1] in f for f in files)


def test_shared_folder_is_required_on_a_cluster(spark):
    class Remote:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        checkpoint_dir(Remote())
