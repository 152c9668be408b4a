import zlib

import numpy as np

from revlens.llm import queries, token_shards as ts
from revlens.llm.tokens import Encoder, default_vocabulary
from revlens.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.edges import frame, rows


def test_permutation_is_a_bijection_with_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 65_537):
        slots = ts.permute(np.arange(n), n, 99)
        assert sorted(slots.tolist()) == list(range(n))
        assert ts.permute(slots, n, 99, back=True).tolist() == list(range(n))
    a, b = ts.permute(np.arange(1000), 1000, 1), ts.permute(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def check(spark, df, texts, length, n_rows):
    """Every document's ids lie, in one piece, in the stream of some task; all tokens and nothing else."""
    folder = scratch_path(spark, "test-shards")
    shards = ts.materialise(df, folder, length=length, rows=n_rows)
    listed = sorted(shards.collect())
    total = ts.total_rows(shards)
    back = ts.read_back(shards, total).collect()
    assert sorted(r["slot"] for r in back) == list(range(total)) == sorted(r["sequence"] for r in back)
    stream = {}
    for s in listed:
        assert s["first_slot"] == s["shard"] * n_rows and s["n_rows"] <= n_rows
        for slot, at, ids in ts.read_rows(s["path"]):
            assert len(ids) == length and at == 32 + (slot - s["first_slot"]) * length * 2
            stream[int(ts.permute(np.array([slot]), total, 0x5EED, back=True)[0])] = ids
    crc = {r["slot"]: r["ids_crc32"] for r in back}
    for i, ids in stream.items():
        assert crc[int(ts.permute(np.array([i]), total, 0x5EED)[0])] == zlib.crc32(ids.astype("<u4").tobytes())
    joined = np.concatenate([stream[i] for i in range(total)]) if total else np.empty(0)
    e = Encoder(default_vocabulary())
    want = [e.document(t) for t in texts]
    assert sorted(joined[joined != ts.PAD].tolist()) == sorted(np.concatenate(want)[np.concatenate(want) != ts.PAD].tolist())
    body = joined.astype("<u2").tobytes()
    assert all(w.astype("<u2").tobytes() in body for w in want)
    if listed:  # resume in the middle of a shard
        s = listed[0]
        middle = s["first_slot"] + s["n_rows"] // 2
        assert [x[0] for x in ts.read_rows(s["path"], middle)] == list(range(middle, s["first_slot"] + s["n_rows"]))


def test_whole_table(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    check(spark, docs, [r["text"] for r in docs.collect()], 256, 64)
    assert queries.op9_token_shards(spark, SF_SMALL).count() > 0


def test_edges(spark):
    check(spark, frame(spark), [r[1] for r in rows()], 64, 16)
    shards = ts.materialise(frame(spark, []))
    assert shards.count() == 0 and ts.read_back(shards, ts.total_rows(shards)).count() == 0


def test_more_shards_than_ranges(spark):
    """Shards of two sequences, many more than shuffle partitions: each is written once, by one task, in slot order."""
    docs = queries.table(spark, SF_SMALL, "documents")
    check(spark, docs, [r["text"] for r in docs.collect()], 256, 2)


def test_special_tokens_and_long_space_are_the_json_files_ids():
    from tokenizers import Tokenizer

    from revlens.llm import tokens
    path = default_vocabulary().removesuffix(".tiktoken") + ".json"
    own, e, j = Tokenizer.from_file(path), Encoder(default_vocabulary()), Encoder(path)
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n x", "<|endoftext", "  <|endoftext|>  ", "<|ENDOFTEXT|>",
                 "a" + " " * (tokens.LONG_SPACE - 1) + "b", "a" + " " * tokens.LONG_SPACE + "b", "\n" * (tokens.LONG_SPACE + 1)):
        want = own.encode(text, add_special_tokens=False).ids + [1]
        assert e.document(text).tolist() == want == j.document(text).tolist(), text[:40]
    assert 50256 in e.document("x<|endoftext|>y").tolist()
