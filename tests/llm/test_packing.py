import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlens.llm import packing, queries, tokens
from tests.conftest import SF_SMALL
from tests.llm.edges import frame, rows


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def check(pieces, texts, limit=2048):
    """Every id in one piece, crc of its ids, no sequence over the limit, offsets without gap; returns padding."""
    own, seqs, t = defaultdict(list), defaultdict(list), reference()
    for p in pieces:
        own[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    assert set(own) == set(texts)
    for doc, ps in own.items():
        ids = t.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF_SMALL, "documents").collect()}
    pieces = queries.op10_pack(spark, SF_SMALL).collect()
    assert check(pieces, texts) <= 0.001 * sum(p["length"] for p in pieces)


def test_edges(spark):
    data = [(i, *r[1:]) for i, r in enumerate(rows())]
    pieces = packing.pack(frame(spark, data)).collect()
    check(pieces, {r[0]: r[1] for r in data})
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark)).groupBy().sum("length").collect()[0][0] == sum(p["length"] for p in pieces)  # null and repeated ids too


def test_both_vocabulary_files_give_equal_ids():
    fast, own = tokens.Encoder(tokens.default_vocabulary()), tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = ["a", "Z", " ", "  ", "\n", "\t", "1", "'s", "é", "ß", "中", "🙂", "<|endoftext|>", "...", "_", " ", " ", "\x00", "́"]
    cases = ["", None, "a" * 30_000, " " * 5000, "a" + " " * 150_000 + "b" + "\n" * 120_000, "x " + " \n" * 1_000_000, *(r[1] for r in rows())] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for c in cases:
        assert fast.document(c).tolist() == own.document(c).tolist()


def test_all_three_limits_hold_and_bins_are_full():
    limits = packing.Limits(tokens=64, segments=6, loss=50)
    rng = random.Random(4)
    packer, out, docs = packing.Packer(limits), [], {}
    for i in range(4000):
        n, loss_from = rng.choice([1, 2, 9, 20, 40, 64, 65, 300]), rng.choice([0, 1, 5, 30])
        docs[i] = (np.arange(n, dtype="<u4"), loss_from)
        out += packer.put(i, *docs[i])
    out += packer.close()
    seqs, seen = defaultdict(list), defaultdict(int)
    for p in out:
        seqs[p[5]].append(p)
        seen[p[0]] += p[2]
        ids, loss_from = docs[p[0]]
        assert p[7] == max(0, p[1] + p[2] - max(p[1], loss_from)) and p[3] == zlib.crc32(ids[p[1]:p[1] + p[2]].tobytes())
    assert seen == {i: len(d[0]) for i, d in docs.items()}
    for ps in seqs.values():
        assert sum(p[2] for p in ps) <= 64 and len(ps) <= 6 and sum(p[7] for p in ps) <= 50
        assert sorted(p[6] for p in ps)[0] == 0
    full = sum(sum(p[2] for p in ps) == 64 or len(ps) == 6 or sum(p[7] for p in ps) == 50 for ps in seqs.values())
    assert full >= len(seqs) - 8


def test_prompt_tokens_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "Question one?", "Answer."), (2, None, "Only text")], "doc_id bigint, prompt string, text string")
    got = {r["doc_id"]: r for r in packing.pack(df, prompt_col="prompt").groupBy("doc_id").agg(F.sum("loss_tokens").alias("loss"), F.sum("length").alias("n")).collect()}
    e = tokens.Encoder(tokens.default_vocabulary())
    assert got[1]["loss"] == len(e.document("Answer.")) and got[1]["n"] == len(e.document("Question one?")) - 1 + got[1]["loss"]
    assert got[2]["loss"] == len(e.document("Only text")) - 1
