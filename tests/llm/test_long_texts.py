"""Texts of one to three million characters go through every operator whole."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from revlens.llm import bottom_k, decontaminate, html_extract, language_id, packing, quality, secret_scan, simhash, token_shards, warc
from revlens.session import written
from tests.llm import test_bottom_k, test_decontaminate, test_simhash, test_warc
from tests.llm.edges import frame


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma", "x1", "né"], k=300_000)), "a" * 2_000_000, "b" + " " * 1_500_000 + "c", "".join(r.choices("!?.\n", k=1_000_000)),
             "short", None, "".join(r.choices("0123456789abcdef", k=1_000_000)), " ".join(r.choices(["alpha", "beta", "gamma", "x1", "né"], k=300_000)) + " bench one two"]
    return [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t), "k", "s", "l", "f") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return written(frame(spark, rows), "long-texts")


def test_exact_operators(spark, rows, docs):
    prints = {r[0]: test_simhash.brute_print(r[1]) for r in rows}
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(docs).collect()} == test_simhash.brute_components(prints)
    bench = spark.createDataFrame([(1, "bench one two")], "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.scan(docs, bench))
    assert test_decontaminate.result(got) == sorted(test_decontaminate.brute([(r[0], r[1]) for r in rows], [(1, "bench one two")]), key=str)
    assert test_bottom_k.result(bottom_k.digest(bottom_k.compare_with_edit(docs))) == test_bottom_k.brute([(r[0], r[1]) for r in rows])
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"))
    assert test_warc.result(warc.histories(pages)) == test_warc.brute([(r[0], r[1]) for r in rows])


def test_other_operators_and_the_pipeline(spark, rows, docs):
    n = len(rows)
    assert secret_scan.scan(docs).count() == n and secret_scan.redact(docs).count() == n
    lengths = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(lengths) == n and all(r["n"] == r["t"] for r in lengths)
    assert token_shards.total_rows(token_shards.materialise(docs)) > 0
    assert language_id.predict(docs, language_id.fit(docs, F.lit(True))).count() == n
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id bigint, quality int")
    assert quality.score(docs, quality.fit(docs, labels, F.lit(True))).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"))
    model = html_extract.train(["<nav>menu here</nav><article><h1>Title words</h1><p>Some words of text, and more.</p></article><footer>foot</footer>"] * 3)
    assert html_extract.extract(pages, model).count() == n
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, "/root/testdata/sf0.001"), "long-stage")
    assert corpus_pipeline.pack(spark, now, "").count() > 0
