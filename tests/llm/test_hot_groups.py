"""A third of the rows are copies of one text, a third near copies of another, and many hold one benchmark passage."""

import random
import struct

import pytest
import xxhash

from revlens.llm import bottom_k, decontaminate, packing, sampling, simhash, warc
from revlens.session import written
from tests.llm import test_bottom_k, test_decontaminate, test_packing, test_simhash, test_warc
from tests.llm.edges import frame

PASSAGE = " ".join(f"bench{i}" for i in range(40))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    copy, near = text(150), text(400).split()
    rows = []
    for i in range(1500):
        if i % 3 == 0:
            t = copy
        elif i % 3 == 1:
            words = list(near)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        else:
            t = text(rng.randint(1, 60)) + (" " + PASSAGE if i % 2 else "")
        rows.append((i, t, "en", "hot" if i % 3 else "s", len(t), "k", "s", "l", "f"))
    return rows


def test_simhash_components(spark, data):
    prints = {r[0]: test_simhash.brute_print(r[1]) for r in data}
    want = test_simhash.brute_components(prints)
    got = simhash.components(frame(spark, data)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = simhash.keep_one(frame(spark, data)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_contaminated_rows(spark, data):
    items = [(1, PASSAGE), (2, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.scan(frame(spark, data), bench))
    assert test_decontaminate.result(got) == sorted(test_decontaminate.brute([(r[0], r[1]) for r in data], items), key=str)


def test_packing_and_fingerprints(spark, data):
    df = written(frame(spark, data), "hot").repartition(7)
    assert test_packing.check(packing.pack(df).collect(), {r[0]: r[1] for r in data}) < 200
    assert test_bottom_k.result(bottom_k.digest(bottom_k.compare_with_edit(df))) == test_bottom_k.brute([(r[0], r[1]) for r in data])


def test_revisits_of_one_payload(spark, data):
    pages = [(r[0], f"http://h{r[0] % 2}.example/{r[0] % 5}", r[1] * 3) for r in data]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert test_warc.result(warc.histories(df)) == test_warc.brute([(p[0], p[2]) for p in pages])


def test_merged_sketch_of_a_key_with_most_parts(spark, data):
    parts = [("hot" if i % 10 else f"k{i}", r[1]) for i, r in enumerate(data)]
    df = bottom_k.with_sketch(spark.createDataFrame(parts, "key string, text string"), "text", "s")
    got = {r["key"]: r["s"] for r in bottom_k.merge(df, "key", "s").collect()}
    union = set().union(*(test_bottom_k.sketch(t)[1] for k, t in parts if k == "hot"))
    assert got["hot"] == sorted(union)[:bottom_k.K] and len(got) == 151


def test_fitting_sample_of_repeated_ids(spark):
    """Ids count once: neither do copies of one id fill the sample nor does their number leave a class without a row."""
    at = lambda i: (xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() % (1 << 40), i)  # noqa: E731, Spark's hash of a long
    first, lone = min(range(400), key=at), max(range(400), key=at)
    data = [(i, "a") for i in range(400)] + [(first, "a")] * 500 + [(lone, "b")] * 2000
    got = sampling.per_group(spark.createDataFrame(data, "id bigint, lang string"), "lang", 20).collect()
    assert sorted(r["id"] for r in got if r["lang"] == "a") == sorted(sorted(range(400), key=at)[:20])
    assert [r["id"] for r in got if r["lang"] == "b"] == [lone]
