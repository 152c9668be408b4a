import base64
import gzip
import hashlib
import io
import random
import zlib

from revlens.llm import queries, warc
from revlens.session import scratch_path
from tests.conftest import SF_MID


def brute(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    by = {}
    for i, html in pages:
        by.setdefault((html or "").encode(), []).append(i)
    out = {}
    for body, ids in by.items():
        for i in ids:
            revisit = len(body) >= 1000 and i != max(ids)
            out[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None)
    return out


def result(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    pages = [(r["page_id"], r["html"]) for r in queries.table(spark, SF_MID, "pages").collect()]
    df = queries.op7_warc(spark, SF_MID)
    assert result(df) == brute(pages)
    assert df.count() == len(pages)


PAGES = [(1, "http://A.example.com:80/x?q=1#f", "a" * 999), (2, "http://a.example.com/x", "a" * 999), (3, "https://www.b.org/", "é" * 500), (9, "https://b.org/", "é" * 500),
         (4, None, "é" * 500), (5, "http://[bad", None), (6, "", ""), (7, "http://c.d/ü?ß", "<html>\r\n\r\nWARC/1.1\r\n" + "z" * 300_000), (8, "x\r\ny", "\x00\x1f\x8b" * 900)]


def test_edges(spark):
    df = spark.createDataFrame([(i, u, h, "extra", "extra") for i, u, h in PAGES], "page_id bigint, url string, html string, digest string, payload string")
    got = warc.histories(df)
    assert result(got) == brute([(i, h) for i, _, h in PAGES])
    rows = got.collect()
    key = [(r["url_key"], r["timestamp"]) for r in rows]
    assert key == sorted(key) and {r["url_key"] for r in rows if r["page_id"] in (4, 6)} == {""}
    assert warc.histories(df.filter("page_id < 0")).count() == 0
    repeated = warc.histories(df.union(df.filter("page_id = 9")).union(spark.createDataFrame([(None, "u", "é" * 500, "", "")], df.schema)))
    back = [(r["page_id"], r["record_type"], r["refers_to"]) for r in repeated.filter("payload_bytes = 1000").collect()]
    assert sorted(back, key=str) == sorted([(9, "response", None), (9, "response", None), (3, "revisit", 9), (4, "revisit", 9), (None, "revisit", 9)], key=str)


def test_archives_are_plain_warc(spark):
    """Each archive is a chain of gzip members whose records a simple reader can walk."""
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    archives = warc.write_archives(df, scratch_path(spark, "test-warc")).collect()
    seen = 0
    for a in archives:
        with open(a["path"].removeprefix("file:"), "rb") as f:
            data = f.read()
        text, rest = b"", data
        while rest:
            d = zlib.decompressobj(31)
            text += d.decompress(rest)
            rest = d.unused_data
        while text:
            head, _, body = text.partition(b"\r\n\r\n")
            n = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
            assert head.startswith(b"WARC/1.1") and body[n:n + 4] == b"\r\n\r\n"
            if b"WARC-Type: response" in head:
                payload = body[:n].partition(b"\r\n\r\n")[2]
                assert base64.b32encode(hashlib.sha1(payload).digest()) in head
            text, seen = body[n + 4:], seen + 1
        assert a["records"] >= 1
    assert seen == len(PAGES)


def test_members_cross_block_borders():
    parts = [b"a" * 10, b"", b"b" * 5000, b"c"]
    data = b"".join(gzip.compress(p) for p in parts)
    for block in (1, 7, 64, 1 << 16):
        got = list(warc.members(io.BytesIO(data), block))
        assert [c for _, _, c in got] == parts
        assert [data[o:o + n] for o, n, _ in got] and sum(n for _, n, _ in got) == len(data)


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for k in range(0, 20):
        runs = [sorted(((rng.randint(0, 9),), i) for _ in range(rng.randint(0, 12))) for i in range(k)]
        assert list(warc.loser_merge([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
