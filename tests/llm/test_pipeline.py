import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from revlens.llm import language_id, queries, secret_scan
from tests.conftest import SF_SMALL
from tests.llm import test_decontaminate, test_packing, test_simhash
from tests.llm.edges import frame


def test_every_stage_and_the_run_equal_brute_force(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    columns = docs.schema
    model = language_id.fit(docs, queries.part(4) != 2)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if told[r["doc_id"]][0] != "und" and told[r["doc_id"]][1] >= 0.25}
    assert all(any(c.isalpha() for c in t) for t in left.values())
    now = corpus_pipeline.identify_language(spark, docs, SF_SMALL)
    assert now.schema == columns and {r["doc_id"]: r["text"] for r in now.collect()} == left

    groups = test_simhash.brute_components({i: test_simhash.brute_print(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    now = corpus_pipeline.near_dedup(spark, now, SF_SMALL)
    assert now.schema == columns and {r["doc_id"]: r["text"] for r in now.collect()} == left

    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF_SMALL, "benchmark").collect()]
    dirty = {x[0] for x in test_decontaminate.brute(list(left.items()), items) if x[-1]}
    assert dirty
    left = {i: t for i, t in left.items() if i not in dirty}
    now = corpus_pipeline.remove_benchmark(spark, now, SF_SMALL)
    assert now.schema == columns and {r["doc_id"]: r["text"] for r in now.collect()} == left

    scanner = secret_scan.Scanner(secret_scan.EntropyRule())
    found = {i: scanner.spans(t) for i, t in left.items()}
    now = corpus_pipeline.mask_secrets(spark, now, SF_SMALL)
    assert now.schema == columns
    masked = {r["doc_id"]: r["text"] for r in now.collect()}
    assert any(b or m for b, m in found.values())
    for i, t in left.items():
        covered = {p for a, _, b in found[i][0] for p in range(a, b)} | {p for a, b in found[i][1] for p in range(a, b)}
        want = "".join("\x00" if p in covered else c for p, c in enumerate(t))
        import re
        assert re.sub("\x00+", "[REDACTED]", want) == masked[i]

    pieces = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert test_packing.check(pieces, masked) <= 0.001 * sum(p["length"] for p in pieces)


def test_stages_on_empty_and_awkward_rows(spark):
    for docs in (frame(spark, []), frame(spark)):
        columns = docs.schema
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_SMALL)
            assert docs.schema == columns
        assert corpus_pipeline.pack(spark, docs, SF_SMALL).filter(F.col("length") <= 0).count() == 0


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "pack"]
    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op") and k[2].isdigit()) == list(range(1, 14))
