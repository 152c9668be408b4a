import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from revlens.llm import language_id, quality, queries
from tests.conftest import SF_MID
from tests.llm.edges import frame, rows


def test_language_held_out_accuracy_and_columns(spark):
    docs = {r["doc_id"]: r for r in queries.table(spark, SF_MID, "documents").withColumn("held", queries.part(4) == 2).collect()}
    got = queries.op6_language_id(spark, SF_MID).collect()
    assert len(got) == len(docs) and all(r["held_out"] == docs[r["doc_id"]]["held"] for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    data = [(i, *r[1:]) for i, r in enumerate(rows())] + [(100 + i, t, lang, None, None, "k", "s", "l", "f") for i, (t, lang) in enumerate(
        [("der die und nicht ein", "de"), ("the and of to in", "en"), ("1234 !!", "en"), ("中文", None), ("", "de")] * 3)]
    df = frame(spark, data)
    model = language_id.fit(df, F.col("doc_id") >= 0)
    got = language_id.predict(df.withColumn("score", F.lit("old")), model)
    assert set(got.columns) == {*df.columns, "lang_pred", "score"}
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.predict(frame(spark, []), model).count() == 0
    none = language_id.fit(frame(spark, []), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}
    kept = language_id.keep_identified(df, model, least=0.0)
    assert kept.schema == df.schema and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in data)


def test_documents_of_unlearned_languages_go_and_clean_ones_stay(spark):
    docs = queries.table(spark, SF_MID, "documents").select("doc_id", "text", "lang")
    rng = random.Random(11)
    words = {"ru": "и в не на я быть он с что по это она этот к но они мы весь который из у то за свой год от так для же".split(),
             "pl": "się jest przez być może już który która jeszcze bardzo człowiek życie dzień ręka świat część wszystko żeby właśnie chcieć mówić".split()}
    foreign = [" ".join(rng.choice(w) for _ in range(k)) for w in words.values() for k in (30, 100, 2000)]
    foreign += ["".join(chr(rng.randint(0x4E00, 0x6FFF)) for _ in range(k)) for k in (10, 100, 5000)]
    foreign += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(k)) for k in (30, 100, 2000)]
    planted = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(foreign)], docs.schema)
    for learned in (["de", "en", "es", "fr"], ["en", "fr"], ["en"]):  # whatever the number of languages
        own = docs.filter(F.col("lang").isin(learned))
        model = language_id.fit(own, queries.part(4) != 2)
        kept = {r["doc_id"] for r in language_id.keep_identified(own.unionByName(planted), model, least=0.25).collect()}
        clean = {r["doc_id"] for r in own.filter(F.col("text").rlike(r"\p{L}")).collect()}
        assert not {i for i in kept if i >= 10_000_000}, learned
        assert len(clean - kept) <= 0.001 * len(clean), learned


def test_folded_weights_equal_the_kernel_machine():
    """The bucket weights give what the Nystroem features and ridge weights give step by step."""
    texts = ["the and of to in that", "der die und nicht ein mit", "que los las por una con", "of the and in to was", "und der ein die auf", "las que por con los"] * 4
    y = ["en", "de", "es", "en", "de", "es"] * 4
    x = language_id.presence(pa.array(texts))
    model = language_id.train(np.packbits(x, axis=1), y, landmarks=2, ridge=1e-3)
    grams = [{s for n in (1, 2, 3) for s in (t.encode()[i:i + n] for i in range(len(t) - n + 1))} for t in texts]
    assert (x.sum(axis=1) <= [len(g) for g in grams]).all() and (x.sum(axis=1) >= [0.9 * len(g) for g in grams]).all()
    marks = np.concatenate([[i for i, v in enumerate(y) if v == k][:2] for k in sorted(set(y))])
    xf = x.astype(float)
    size = np.sqrt(xf.sum(axis=1))
    kernel = (xf @ xf[marks].T) / np.outer(size, size[marks])
    kll = kernel[marks]
    value, vector = np.linalg.eigh(kll)
    keep = value > 1e-8 * value[-1]
    phi = np.hstack([kernel @ (vector[:, keep] / np.sqrt(value[keep])), np.ones((len(y), 1))])
    target = np.where(np.array(y)[:, None] == np.array(sorted(set(y))), 1.0, -1.0)
    ridge = 1e-3 * np.eye(phi.shape[1])
    ridge[-1, -1] = 0
    want = phi @ np.linalg.solve(phi.T @ phi / 8 + ridge, phi.T @ target / 8)
    assert np.abs(model.scores(x) - want).max() < 1e-3


def test_quality_held_out_accuracy_and_clean_documents_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF_MID, "labels").collect()}
    got = queries.op4_quality(spark, SF_MID).collect()
    assert len(got) == queries.table(spark, SF_MID, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert sum(r["predicted"] for r in held if labels[r["doc_id"]]) >= 0.98 * sum(labels[r["doc_id"]] for r in held)


def test_quality_edges(spark):
    df = frame(spark, [(i, *r[1:]) for i, r in enumerate(rows())])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (8, 0, 0), (12, 0, 1), (12, 1, 1), (99, 1, 0), (None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, labels, F.lit(True))
    out = quality.score(df.withColumn("score", F.lit("old")), model)
    assert set(out.columns) == {*df.columns, "score"} and all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == len(rows())
    assert quality.score(frame(spark, []), model).count() == 0
    assert quality.fit(frame(spark, []), labels, F.lit(True)) is None
    assert {r["score"] for r in quality.score(df, None).collect()} == {0.5}


def test_quality_gradients_and_attention():
    r = np.random.default_rng(0)
    sizes = [1, 3, 5, 2]
    x, first, label = r.normal(size=(sum(sizes), quality.FEATURES)) * 0.1, np.concatenate([[0], np.cumsum(sizes)]), np.array([0.0, 1, 1, 0])
    model = quality.initial(1)
    f = model.forward(x, first)
    assert np.allclose(np.add.reduceat(f["a"], first[:-1]), 1)

    def loss():
        y = model.forward(x, first)["y"]
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    grads = model.gradients(x, first, label)
    for k, g in grads.items():
        flat, gf = np.atleast_1d(model.p[k]).reshape(-1), np.atleast_1d(g).reshape(-1)
        for i in r.choice(len(flat), min(4, len(flat)), replace=False):
            old, eps = model.p[k].copy(), 1e-5
            up, down = old.copy().reshape(-1), old.copy().reshape(-1)
            up[i] += eps
            down[i] -= eps
            model.p[k] = up.reshape(old.shape)
            a = loss()
            model.p[k] = down.reshape(old.shape)
            b = loss()
            model.p[k] = old
            assert abs((a - b) / (2 * eps) - gf[i]) < 1e-6, k


def test_passages_cover_whole_texts():
    texts = ["", "a", "word " * 1000, "é" * 700, None]
    x, first = quality.passages(pa.array(texts))
    assert np.diff(first).tolist() == [max(1, -(-len((t or "").encode()) // quality.PASSAGE)) for t in texts]
    assert x.shape == (first[-1], quality.FEATURES) and np.isfinite(x).all()
    again, start = quality.passages(pa.array(["der " * 200, "one two three four five six seven"]))
    assert again[0, -quality.WORD_FEATURES] > 0.9 and again[start[1], -quality.WORD_FEATURES] == 0


def test_fits_do_not_depend_on_the_order_of_rows_that_share_an_id(spark):
    texts = ["the cat and the dog sit on the mat", "der Hund und die Katze sind nicht hier", "le chat et le chien ne sont pas la", "12 34", None]
    data = [(i, texts[(i + k) % 5], texts[i % 3][:3]) for i in range(12) for k in range(3)]
    models, nets = [], []
    for order in (1, -1):
        df = spark.createDataFrame(data[::order], "doc_id bigint, text string, lang string").repartition(2 + order)
        models.append(language_id.fit(df, F.lit(True)))
        labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
        nets.append(quality.fit(df, labels, F.lit(True)))
    probe = spark.createDataFrame([(1, "the dog and the hund"), (2, None), (3, "x")], "doc_id bigint, text string")
    for make, pair in ((language_id.predict, models), (quality.score, nets)):
        one, two = (make(probe, m).orderBy("doc_id").collect() for m in pair)
        assert one == two
