"""WARC archives of pages, read back and merged into globally ordered capture histories.

1. Payload digests are counted; of equal payloads of at least ``REVISIT_BYTES``
   the capture with the largest id is the response, the others revisit it.
2. Tasks write gzip WARC files (one member a record) to the shared folder:
   a response holds the HTTP headers and the payload, a revisit the headers and
   the digest and record it refers to.
3. Each archive is read back record by record; its captures, sorted by URL key
   and timestamp, are one run.
4. External merge: the runs are split by ranges of (URL key, timestamp), and in
   each range a loser tree merges them k ways, so the ranges one after another
   hold every URL's captures in order.

Files are written through the file system of the folder's URL to a name of the
attempt's own, and only names that a finished task returned are read.

Defined results: null html is empty, null URLs have an empty key and the target
URI "about:blank"; repeated rows are captures of their own, and all rows that
share the largest id of a payload are responses; a null id is written as such
and revisits the largest id, or is a response where all ids of its payload are
null; extra columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from revlens.llm.arrow import batch_of, chunks
from revlens.session import scratch_path, written

#: Least payload of a revisit, in bytes.
REVISIT_BYTES = 1000
#: Bytes after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: The tables have no capture time: page n is taken n seconds after this.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)

_PAGE = "urn:capture:"
_NONE = "none"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, lower case, then path and query; no scheme, port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + query.lower()


def sha1_base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


# --- writing ----------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str) -> bytes:
    """One WARC record as a gzip member; a revisit if ``refers_to`` is given."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    body = http + (payload if refers_to is None else b"")
    date = (EPOCH + timedelta(seconds=(page_id or 0) % 10 ** 9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = "".join(c for c in (url or "about:blank") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PAGE}{serial}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1_base32(digest)}",
            f"X-Page-Id: {_NONE if page_id is None else page_id}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(plain) + pack.flush()


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row to an archive; returns (path, records) of the archives."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest")
    repeated = large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = written(repeated.select(F.col("digest").alias("group"), "first"), "payload-groups")
    placed = rows.join(groups, F.col("digest") == F.col("group"), "left")
    answer = F.col("group").isNull() | F.col("id").eqNullSafe(F.col("first"))
    every = placed.select("id", "url", "payload", "digest", "first", answer.alias("answer"))

    out_schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for part in chunks(batch, "payload"):
                cols = [part.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first", "answer")]
                for i, url, body, digest, first, answer in zip(*cols, strict=True):
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(i, url, body, digest, None if answer else first, str(i) if i is not None else uuid.uuid4().hex)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                        yield batch_of(out_schema, path=[f"{folder.rstrip('/')}/{name}"], records=[records])
        if out is not None:
            out.close()
            yield batch_of(out_schema, path=[f"{folder.rstrip('/')}/{name}"], records=[records])

    return written(every.mapInArrow(run, "path string, records bigint"), "archives")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# --- reading ----------------------------------------------------------------

def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of a stream."""
    at = start = 0
    unpack, out, data = zlib.decompressobj(31), io.BytesIO(), b""
    while data or (data := stream.read(block)):
        data = bytes(data)
        out.write(unpack.decompress(data))
        at += len(data) - len(unpack.unused_data)
        data = unpack.unused_data
        if unpack.eof:
            yield start, at - start, out.getvalue()
            start, unpack, out = at, zlib.decompressobj(31), io.BytesIO()
    if at != start:
        raise ValueError("the archive ends inside a record")


def parse(content: bytes) -> dict:
    """A record's capture: id, URL, timestamp, type, reference, full payload's digest and size, and the payload (empty for a revisit)."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    told = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = named["warc-type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != told:
            raise ValueError(f"record {named['warc-record-id']} does not hold its payload")
    page, refers = named["x-page-id"], named.get("warc-refers-to", "").strip("<>").removeprefix(_PAGE)
    return {"page_id": None if page == _NONE else int(page), "url": named["warc-target-uri"], "timestamp": named["warc-date"], "record_type": kind,
            "refers_to": int(refers) if kind == "revisit" else None, "payload_digest": told, "payload_bytes": size, "payload": payload}


_CAPTURE = [("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
CAPTURE = ", ".join(f"`{n}` {'bigint' if t == pa.int64() else 'string'}" for n, t in _CAPTURE)
_KEY = ("url_key", "timestamp", "archive", "offset")


def runs(archives: DataFrame) -> DataFrame:
    """The captures of each archive, read back whole and sorted by URL key and timestamp."""
    schema = pa.schema(_CAPTURE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = open_folder(path)
                found = []
                with fs.open_input_stream(name, compression=None) as f:
                    for offset, length, content in members(f):
                        c = parse(content)
                        uri = c["url"] if c["url"] != "about:blank" else None
                        found.append((url_key(uri), c["timestamp"], c["page_id"], c["payload_bytes"], c["payload_digest"], c["record_type"], c["refers_to"], path, offset, length))
                found.sort(key=lambda r: (r[0], r[1], r[7], r[8]))
                for i in range(0, len(found), 10_000):
                    yield batch_of(schema, **{n: list(v) for (n, _), v in zip(_CAPTURE, zip(*found[i: i + 10_000], strict=True), strict=True)})

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(run, CAPTURE)


def loser_merge(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """K-way merge of sorted iterators: inner nodes keep losers, so a step replays one path of log2(k) matches."""
    k = len(sources)
    if not k:
        return
    heads = [next(s, None) for s in sources]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    tree = [0] * k  # tree[0]: the winner; tree[1:]: the loser of each match
    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    tree[0] = winners[1] if k > 1 else 0
    while heads[tree[0]] is not None:
        w = tree[0]
        yield heads[w]
        heads[w] = next(sources[w], None)
        node = (k + w) // 2
        while node:
            if not beats(w, tree[node]):
                tree[node], w = w, tree[node]
            node //= 2
        tree[0] = w


def merged(sorted_runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key and timestamp: ranges in partition order, each merged from its runs."""
    schema = pa.schema(_CAPTURE)
    names = [n for n, _ in _CAPTURE]
    at = [names.index(k) for k in _KEY]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}  # a run's rows of this range arrive in the run's order
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(row[names.index("archive")], []).append(row)
        keyed = [((tuple(r[i] for i in at), r) for r in rows) for _, rows in sorted(parts.items())]
        out: list[tuple] = []
        for _, row in loser_merge([iter(k) for k in keyed]):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(schema, **{n: list(v) for n, v in zip(names, zip(*out, strict=True), strict=True)})
                out = []
        if out:
            yield batch_of(schema, **{n: list(v) for n, v in zip(names, zip(*out, strict=True), strict=True)})

    n = int(sorted_runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted_runs.repartitionByRange(n, *_KEY).mapInArrow(run, CAPTURE)


def histories(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write the archives, read them back and return every capture in global order."""
    found = written(runs(write_archives(pages, folder, **columns)), "capture-runs")
    return merged(found)


def digest(captures: DataFrame) -> DataFrame:
    """The contract's columns from ``histories``' rows."""
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")
