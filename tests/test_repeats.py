"""Repeated keys by a counting Bloom filter: equal to the plain forms, and few rows of unique keys pass."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.operators import quality as Q, repeats as R
from tests.test_plans import _plan


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def mixed(spark):
    """A third of the rows with one key, a tenth without a key, some keys twice, the rest once."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).when(n % 10 == 1, F.lit(None).cast("string")).when(n % 7 == 2, F.concat(F.lit("t"), F.floor(n / 14))).otherwise(F.concat(F.lit("u"), n))
    return spark.range(6000, numPartitions=7).select(key.alias("k"), (n % 4).alias("k2"), (n * 37 % 101).alias("o"), n.alias("v"))


# 1 << 15: the least filter; more keys than counters can tell apart come with the single-block test below
@pytest.mark.parametrize("counters", [None, R.BLOCK])
@pytest.mark.parametrize("keys", [["k"], ["k", "k2"]])
def test_equal_to_the_plain_forms(mixed, keys, counters):
    assert _rows(R.duplicate_rows(mixed, keys, counters)) == _rows(Q.duplicate_rows(mixed, keys))
    assert _rows(R.dedup_preview(mixed, keys, "o", True, ["v"], counters)) == _rows(Q.dedup_preview(mixed, keys, "o", True, ["v"]))
    checks = {"a": (mixed, keys), "b": (mixed, ["v"])}
    assert _rows(R.duplicate_keys(checks, counters)) == _rows(Q.duplicate_keys(checks))


def test_a_saturated_filter_loses_no_row(spark):
    """More keys than counters: everything passes, and the result stays exact."""
    df = spark.range(60000).select(F.when(F.col("id") < 50, F.col("id") % 25).otherwise(F.col("id")).alias("k"))
    assert R.maybe_repeated(df, ["k"], R.BLOCK).count() > 50000
    assert _rows(R.duplicate_rows(df, ["k"], R.BLOCK)) == _rows(Q.duplicate_rows(df, ["k"]))


def test_rows_of_unique_keys_do_not_pass(spark):
    """Rows that pass are in proportion to the repeated keys' rows; across tasks, too."""
    df = spark.range(200000, numPartitions=9).select(F.when(F.col("id") % 20000 < 3, F.col("id") % 20000).otherwise(F.col("id")).alias("k"))
    repeated = Q.duplicate_rows(df, ["k"]).count()
    passed = R.maybe_repeated(df, ["k"]).count()
    assert repeated == 30 and 30 <= passed <= 30 + 0.025 * 200000


def test_rows_are_filtered_without_a_shuffle(spark, mixed, tmp_path):
    mixed.write.parquet(f"{tmp_path}/t")
    plan = _plan(spark, R.maybe_repeated(spark.read.parquet(f"{tmp_path}/t"), ["k"]))
    assert len(re.findall(r"^\(\d+\) BroadcastHashJoin", plan, flags=re.M)) == 2
    assert not re.findall(r"^\(\d+\) (Exchange|Sort)\b", plan, flags=re.M), plan


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "k string, o int, block int, words string")
    assert R.duplicate_rows(none, ["k"]).count() == 0 and R.dedup_preview(none, ["k"], "o", True).count() == 0
    assert [tuple(r) for r in R.duplicate_keys({"x": (none, ["k"])}).collect()] == [("x", 0, 0)]
    some = spark.createDataFrame([("a", 1, 2, "w"), ("a", 1, 2, "w"), ("b", None, None, None), (None, 1, 1, "x")], none.schema)
    assert _rows(R.duplicate_rows(some, ["k"])) == _rows(some.where("k = 'a'"))


def test_merge_holds_one_block():
    """Blocks cut anywhere between batches: a counter is seen again if two tasks saw it or one saw it twice."""
    rng = np.random.default_rng(3)
    rows = [(b, rng.integers(0, 256, R.BLOCK // 8, np.uint8) & rng.integers(0, 256, R.BLOCK // 8, np.uint8)) for b in (0, 0, 0, 4, 5, 5)]
    twice = [rng.integers(0, 256, R.BLOCK // 8, np.uint8) & o for _, o in rows]
    batches = [pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows[i:j]], pa.int32()), "once": pa.array([o.tobytes() for _, o in rows[i:j]]),
                                           "again": pa.array([t.tobytes() for t in twice[i:j]])}) for i, j in ((0, 2), (2, 5), (5, 6))]
    got = {b: np.array(w, "<i8").view(np.uint8) for out in R._merge(batches) for b, w in zip(out.column("block").to_pylist(), out.column("words").to_pylist(), strict=True)}
    for block in (0, 4, 5):
        bits = sum(np.unpackbits(o).astype(int) + np.unpackbits(t) for (b, o), t in zip(rows, twice, strict=True) if b == block)
        assert (np.unpackbits(got[block]) == (bits > 1)).all()
