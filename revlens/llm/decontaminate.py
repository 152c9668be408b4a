"""Benchmark decontamination as a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window).  A document contains a window exactly when it contains all of the
window's shingles in place, so one necessary prefix shingle per window is
enough to find every candidate: the one that is rarest in the documents.

1. Windows and their shingles (5 words, or the whole of a shorter window).
2. One pass over the documents counts every benchmark shingle; shingles are
   ordered by that count, and each window's rarest becomes its prefix.
3. A second pass emits, per document, its number of words and the places of
   prefix shingles with the words around them.
4. These join the windows on the prefix; length and positional bounds and the
   exact comparison of the window's words decide.
5. The hit words of a document are the union of its window intervals.

In both passes a Bloom filter keeps the places of other shingles out of the
shuffle: 16 bits and two hashes a distinct shingle (1.4 % of other places pass),
32 MB at the most, reached at 16.8 million shingles; false positives only add
rows that the join removes.  The benchmark itself is never collected or
broadcast by this module.

Defined results: null texts have no word; a document without words is not
contaminated; items without words make no window; items with a null id count
no item but hit words; repeated document rows each get their own result,
repeated items count once; extra columns are ignored by ``scan`` and kept by
``keep_clean``; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from revlens.llm.arrow import HASH_BASE, LOWER, batch_of, chunks, mixed, run_hashes, runs, text_bytes
from revlens.llm.spelling import Bloom
from revlens.session import written

#: Words are runs of these bytes: 0-9, a-z and everything beyond ASCII (UTF-8).
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

WINDOW_WORDS = 13
SHINGLE_WORDS = 5


class Words:
    """The words of a chunk of texts: borders, text numbers and hashes."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(column)
        self.data = LOWER[raw]
        self.starts, self.ends, self.doc = runs(WORD[self.data], offsets)
        self.counts = np.bincount(self.doc, minlength=len(column)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hash = run_hashes(self.data, self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs of ``k`` words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(n, np.uint64(k))
        for j in range(k):
            h = (h + self.hash[j: j + n]) * HASH_BASE
        whole = np.flatnonzero(self.doc[:n] == self.doc[k - 1: k - 1 + n])
        return whole, mixed(h[whole])

    def text(self, a: int, b: int) -> str:
        """Words a..b-1, joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)).decode()


# --- benchmark side ---------------------------------------------------------

def windows(items: DataFrame, size: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, window, offset, hash): every window of every item with its shingles."""
    schema = pa.schema([("item", pa.string()), ("words", pa.int32()), ("window", pa.string()), ("offset", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 1 << 18):
                w = Words(part.column("text"))
                ids = part.column("item").to_pylist()
                by_length = {k: dict(zip(*(x.tolist() for x in w.shingles(k)), strict=True)) for k in range(1, shingle + 1)}
                rows = []
                for d, item in enumerate(ids):
                    n, at = int(w.counts[d]), int(w.first[d])
                    length, k = min(n, size), min(n, shingle)
                    for a in range(at, at + n - length + 1) if n else ():
                        text = w.text(a, a + length)
                        rows += [(item, length, text, j, np.uint64(by_length[k][a + j]).astype(np.int64)) for j in range(length - k + 1)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield batch_of(schema, **dict(zip(schema.names, map(list, cols), strict=True)))

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, words int, window string, offset int, hash bigint")


def bloom(hashes: DataFrame) -> Bloom:
    """A Bloom filter of ``hash``, with 16 bits a distinct value and at most 32 MB."""
    keys = hashes.select(F.col("hash").alias("key")).distinct()
    return Bloom(keys, keys.count())


def rarest(spark, docs: DataFrame, found: DataFrame, text_col: str, lengths: list[int]) -> DataFrame:
    """(hash, n): how often the documents have each benchmark shingle."""
    bits = spark.sparkContext.broadcast(bloom(found.select("hash")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                for k in lengths:
                    _, h = w.shingles(k)
                    value, n = np.unique(h[bits.value.has(h)], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_pydict({"hash": pa.array(value.view(np.int64)), "n": pa.array(n)})

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


# --- document side ----------------------------------------------------------

def places(spark, docs: DataFrame, prefix: DataFrame, size: int, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """Per document row: (uid, id, n_words, places of prefix shingles with the words around them)."""
    bits = spark.sparkContext.broadcast(bloom(prefix.select("hash")))
    place = pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("from", pa.int64()), ("around", pa.string())])
    schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"))
                got: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for k in lengths:
                    at, h = w.shingles(k)
                    here = np.flatnonzero(bits.value.has(h))
                    for p, x in zip(at[here].tolist(), h[here].view(np.int64).tolist(), strict=True):
                        d = int(w.doc[p])
                        lo = max(int(w.first[d]), p - (size - k))
                        hi = min(int(w.first[d + 1]), p + size)
                        got[d].append({"hash": x, "pos": p - int(w.first[d]), "from": lo - int(w.first[d]), "around": w.text(lo, hi)})
                yield batch_of(schema, uid=np.arange(uid, uid + part.num_rows), id=part.column("id"), n_words=w.counts, places=got)
                uid += part.num_rows

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "uid bigint, id bigint, n_words bigint, places array<struct<hash:bigint,pos:bigint,from:bigint,around:string>>")


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, share: int = 20,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, items (ids as sorted strings) and contaminated.

    ``share``: a document with hits in 1/share of its words or more is contaminated.
    """
    spark = docs.sparkSession
    found = written(windows(items, size, shingle, item_col, item_text_col), "windows")
    lengths = sorted(r["k"] for r in found.select(F.least("words", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` rows
    known = rarest(spark, docs, found, text_col, lengths)
    ranked = found.join(known, "hash")  # a window with a shingle that no document has can occur nowhere, but its others may be common
    first = ranked.groupBy("window", "words").agg(F.min(F.struct("n", "hash", "offset")).alias("p"), F.count_distinct("offset").alias("seen"))
    first = first.filter(F.col("seen") == F.col("words") - F.least("words", F.lit(shingle)) + 1)
    prefix = written(first.select("window", "words", F.col("p.hash").alias("hash"), F.col("p.offset").alias("offset")), "window-prefixes")

    rows = written(places(spark, docs, prefix, size, lengths, id_col, text_col), "prefix-places")
    place = rows.select("uid", "n_words", F.explode("places").alias("p")).select("uid", "n_words", "p.*")
    start = F.col("pos") - F.col("offset")
    fits = (start >= F.col("from")) & (start + F.col("words") <= F.col("n_words"))
    words = F.slice(F.split("around", " "), (start - F.col("from") + 1).cast("int"), F.col("words"))
    same = place.join(prefix, "hash").filter(fits).filter(F.array_join(words, " ") == F.col("window"))
    hits = same.select("uid", start.alias("start"), (start + F.col("words")).alias("end"), "window").distinct()

    before = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    words_hit = hits.select("uid", "start", "end").distinct().withColumn("new", new).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    owners = found.filter("item IS NOT NULL").select("window", "item").distinct()
    own = hits.select("uid", "window").distinct().join(owners, "window").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))

    out = rows.select("uid", "id", "n_words").join(words_hit, "uid", "left").join(own, "uid", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay.

    A row is known by its id and its text, so rows that share an id are judged
    each by itself.  Rows without an id stay.
    """
    text = F.col(options.get("text_col", "text")).cast("string")
    named = docs.withColumn("__row", F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("bigint"), text)))
    dirty = scan(named, items, id_col="__row", **options).filter(F.col("contaminated") & F.col("__row").isNotNull())
    dirty = written(dirty.select(F.col("__row").alias("__dirty")).distinct(), "contaminated")
    return named.join(dirty, named["__row"] == dirty["__dirty"], "left_anti").drop("__row")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
