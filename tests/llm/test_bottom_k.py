import base64
import hashlib
import math

import xxhash
from pyspark.sql import functions as F

from revlens.llm import bottom_k, queries
from tests.conftest import SF_SMALL
from tests.llm.edges import frame, rows


def sketch(text, k=128):
    words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        out.add(h >> 16)
    return sorted(out)[:k], out


def near(a, b, k=128):
    if not a and not b:
        return 1.0
    low = set(sorted(set(a) | set(b))[:k])
    return len(low & set(a) & set(b)) / len(low)


def string(s):
    return base64.b64encode(b"".join(x.to_bytes(6, "big") for x in s)).decode()


def brute(docs):
    """Rows by id, for documents with distinct non-null ids."""
    order = sorted(docs, reverse=True)
    out = {}
    for j, (i, text) in enumerate(order):
        text, after = text or "", order[(j + 1) % len(order)][1] or ""
        f = len(text) // 3
        edited = text[:len(text) - f] + after[:f]
        a, e, n = sketch(text)[0], sketch(edited)[0], sketch(after)[0]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), string(a), string(e), round(near(a, e), 9), round(near(a, n), 9))
    return out


def result(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF_SMALL, "documents").collect()]
    df = queries.op8_bottom_k(spark, SF_SMALL)
    assert result(df) == brute(docs) and df.count() == len(docs)


def test_edges(spark):
    data = [(7 * i - 20, *r[1:]) for i, r in enumerate(rows())]
    assert result(bottom_k.digest(bottom_k.compare_with_edit(frame(spark, data)))) == brute([(r[0], r[1]) for r in data])
    assert bottom_k.compare_with_edit(frame(spark, [])).count() == 0
    one = result(bottom_k.digest(bottom_k.compare_with_edit(frame(spark, data[:1]))))
    assert one == brute([(data[0][0], data[0][1])])
    got = bottom_k.digest(bottom_k.compare_with_edit(frame(spark))).collect()  # repeated and null ids
    assert len(got) == len(rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(by_text[10]) == 1


def test_every_successor_is_found_across_ranges(spark):
    data = [(i * 3, f"text number {i} " * 4, None, None, None, "k", "s", "l", "f") for i in range(700)]
    assert result(bottom_k.digest(bottom_k.compare_with_edit(frame(spark, data)))) == brute([(r[0], r[1]) for r in data])


def test_merged_parts_equal_the_whole_and_estimates_hold(spark):
    words = [f"w{i}" for i in range(4000)]
    texts = {"a": words[:3000], "b": words[1000:4000]}
    parts = [(k, " ".join(w[i:i + 504])) for k, w in texts.items() for i in range(0, len(w) - 4, 500)]
    df = bottom_k.with_sketch(spark.createDataFrame(parts, "key string, text string"), "text", "s")
    got = {r["key"]: r["s"] for r in bottom_k.merge(df, "key", "s").collect()}
    for k, w in texts.items():
        assert got[k] == sketch(" ".join(w))[0]
    pair = spark.createDataFrame([(got["a"], got["b"])], "a array<bigint>, b array<bigint>")
    r = pair.select(bottom_k.resemblance(F.col("a"), F.col("b")).alias("j"), bottom_k.distinct_shingles(F.col("a")).alias("n"), bottom_k.containment(F.col("a"), F.col("b")).alias("c")).first()
    true = 1996 / (2996 * 2 - 1996)
    assert abs(r["j"] - true) < 4 * math.sqrt(true * (1 - true) / 128)
    assert abs(r["n"] / 2996 - 1) < 0.4 and abs(r["c"] - 1996 / 2996) < 0.25


def test_plan_has_no_python(spark):
    plan = queries.op8_bottom_k(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
