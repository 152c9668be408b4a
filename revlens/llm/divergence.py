"""Source divergence audit: how far the vocabularies of a language's sources lie apart, by Gustavson row accumulation.

Within each language the term counts form a sparse matrix with a row per
source and a column per kept term.  The divergence of two sources is a sum over
all kept terms of f(p, q), where p and q are the smoothed shares of the term in
either source; most of the terms are absent from one or both.  With p0 the
share of an absent term, the sum over all V kept terms splits into

    V * f(p0_g, p0_h)                                     no source has the term
  + sum over g's terms of  f(p_g, p0_h) - f(p0_g, p0_h)   corrections of the zero baseline
  + sum over h's terms of  f(p0_g, p_h) - f(p0_g, p0_h)
  + sum over shared terms of  f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h) + f(p0_g, p0_h)

1. Terms are counted in each task (one dictionary per source, emptied at
   ``FLUSH`` entries), then summed by Spark.
2. Terms in enough documents of the language are kept; shares are exact
   integers, from decimal arithmetic.
3. The matrix is cut into blocks of columns, a task each.  There the columns
   form a term-major index, and each row in turn scatters its terms through it
   into one dense accumulator over its peers: no pair of postings is emitted,
   only one partial sum per pair of sources and block.  The corrections need
   the distinct shares of a row alone, not its terms.
4. Partial sums are added by Spark.  All sums are 64-bit integers.

A task holds one block of the index, and vectors as long as the number of
sources of one language; the result has the square of that number in rows.

Defined results: null text, lang and source are empty strings; a source
without kept terms keeps all its rows of part ``pair``; a language without kept
terms has value 0 there; repeated rows count again; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm.arrow import batch_of, chunks
from revlens.llm.blocks import ascii_lower, blocks
from revlens.session import written

#: A term: ASCII letters and everything beyond ASCII.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 10
#: Terms listed per source.
TOP = 10
SCALE = 1_000_000_000
#: Entries of a task's dictionaries before they are sent on.
FLUSH = 300_000
#: Postings of a block of the term-major index, about: as many as there are pairs of sources (so that partial
#: sums are no more rows than postings), within these bounds.
BLOCK_POSTINGS = (1 << 16, 1 << 21)
#: Posting pairs evaluated at once.
PAIRS = 1 << 20


# --- counting ---------------------------------------------------------------

def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that have it.  ``docs``: text, lang, source."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            if n:
                yield batch_of(schema, lang=[lang] * len(n), source=[source] * len(n), term=list(n), n=list(n.values()), docs=[d[t] for t in n])
        held.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                    n, d = held.setdefault((lang, source), (Counter(), Counter()))
                    before, own = len(n), set()
                    for piece in blocks(text, BREAK):
                        terms = TERM.findall(ascii_lower(piece))
                        n.update(terms)
                        own.update(terms)
                    d.update(own)
                    size += len(n) - before
                    if size > FLUSH:
                        yield from flushed(held)
                        size = 0
        yield from flushed(held)

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact (decimal arithmetic beyond 64 bits); 0 without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(count) + F.lit(2).cast("decimal(2,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    low = wide(total) + F.lit(2).cast("decimal(2,0)") * wide(terms)
    return F.when(terms == 0, F.lit(0)).otherwise(1 + F.call_function("div", top, low)).cast("bigint")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^31, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def matrix(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(postings, groups), both written.

    postings: lang, term, g, source, n, p, and q, the share of the term in the whole language.
    groups: lang, source, g (0.. in order of the source), total, terms (V of the language), p0.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(rows).withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)) \
        .withColumn("first", (F.row_number().over(of_term.orderBy("source")) == 1).cast("int"))
    kept = written(counts.filter(F.col("in_docs") >= least).select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms")

    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = written(kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms")), "language-totals")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    groups = rows.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left") \
        .select("lang", "source", zero("total").alias("total"), zero("terms").alias("terms"), zero("lang_total").alias("lang_total"),
                (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"))
    groups = written(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "source-groups")
    postings = kept.join(groups, ["lang", "source"]).select(
        "lang", "term", "g", "source", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    return written(postings, "term-shares"), groups


# --- row accumulation -------------------------------------------------------

def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of 64-bit integers below 2^31."""
    d = p - q
    return d * d // (p + q)


class Block:
    """The term-major index of some columns of one language, and what its rows add to each peer."""

    def __init__(self, p0: np.ndarray, term: np.ndarray, group: np.ndarray, p: np.ndarray):
        """``p0``: by source; ``term`` (ascending numbers), ``group``, ``p``: the postings."""
        self.p0, self.group, self.p = p0, group, p
        terms, self.column = np.unique(term, return_inverse=True)
        self.start = np.searchsorted(term, terms, side="left")
        self.length = np.diff(np.append(self.start, len(term)))
        order = np.argsort(group, kind="stable")
        self.rows = np.split(order, np.searchsorted(group[order], np.arange(1, len(p0))))

    def baseline(self, g: int) -> np.ndarray:
        """Per peer: the corrections of the zero baseline for row g's terms."""
        acc = np.zeros(len(self.p0), np.int64)
        none = f(np.full_like(self.p0, self.p0[g]), self.p0)
        for p, n in zip(*np.unique(self.p[self.rows[g]], return_counts=True), strict=True):
            acc += n * (f(np.full_like(self.p0, p), self.p0) - none)
        return acc

    def scatter(self, g: int) -> np.ndarray:
        """Per peer: the corrections for the terms that row g and the peer share."""
        acc, mine = np.zeros(len(self.p0), np.int64), self.rows[g]
        ends = np.cumsum(self.length[self.column[mine]])
        at = 0
        while at < len(mine):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            own = mine[at: stop]
            n = self.length[self.column[own]]
            first = np.repeat(self.start[self.column[own]] - (np.cumsum(n) - n), n)
            peers = first + np.arange(int(n.sum()))
            p, h, q = np.repeat(self.p[own], n), self.group[peers], self.p[peers]
            p0, q0 = np.full_like(p, self.p0[g]), self.p0[h]
            np.add.at(acc, h, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
            at = stop
        return acc


def _accumulate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, sorted by term (header rows, without a term, first), to partial sums (lang, g, h, value)."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])
    key, head, index, last, term_at = None, [], [], None, 0

    def done() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        lang, number = key
        g, p0, terms = (np.concatenate(x) for x in zip(*head, strict=True))
        order = np.argsort(g)
        p0, v, s = p0[order], int(terms[0]), len(g)
        if not v:  # no kept term in the language
            p0 = np.ones(s, np.int64)
        term, group, p = (np.concatenate(x) for x in zip(*index, strict=True)) if index else (np.empty(0, np.int64),) * 3
        block, everyone = Block(p0, term, group, p), np.arange(s, dtype=np.int32)
        for row in range(s):
            here = np.full(s, row, np.int32)
            none = f(np.full_like(p0, p0[row]), p0) * (v if number == 0 else 0)
            fix = block.baseline(row)
            for a, b, acc in ((here, everyone, none + fix + block.scatter(row)), (everyone, here, fix)):
                some = (a != b) & ((acc != 0) | (number == 0))
                if some.any():
                    yield batch_of(schema, lang=[lang] * int(some.sum()), g=a[some], h=b[some], value=acc[some])

    for batch in batches:
        lang, term = batch.column("lang").to_pylist(), batch.column("term").to_pylist()
        number, g, p, terms = (batch.column(c).to_numpy().astype(np.int64) for c in ("block", "g", "p", "terms"))
        cut = [i for i in range(len(lang)) if not i or lang[i] != lang[i - 1] or number[i] != number[i - 1]] + [len(lang)]
        for a, b in zip(cut, cut[1:], strict=False):
            if (lang[a], int(number[a])) != key:
                yield from done()
                key, head, index, last = (lang[a], int(number[a])), [], [], None
            own = np.empty(b - a, np.int64)
            for i in range(a, b):
                if term[i] != last:
                    last, term_at = term[i], term_at + 1
                own[i - a] = -1 if last is None else term_at
            real = own >= 0
            if not real.all():
                head.append((g[a:b][~real], p[a:b][~real], terms[a:b][~real]))
            if real.any():
                index.append((own[real], g[a:b][real], p[a:b][real]))
    yield from done()


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value): the divergence of every two sources of a language, both ways."""
    pairs = groups.groupBy("lang").count().agg(F.sum(F.col("count") * F.col("count")).alias("n")).first()["n"] or 0
    number = max(1, -(-postings.count() // min(max(pairs, BLOCK_POSTINGS[0]), BLOCK_POSTINGS[1])))
    cells = postings.select("lang", F.pmod(F.xxhash64("term"), F.lit(number)).cast("int").alias("block"), "term", "g", "p", F.lit(0).cast("bigint").alias("terms"))
    header = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("block"), F.lit(None).cast("string").alias("term"), "g", F.col("p0").alias("p"), "terms")
    sorted_blocks = cells.unionByName(header).repartition("lang", "block").sortWithinPartitions("lang", "block", "term")
    return sorted_blocks.mapInArrow(_accumulate, "lang string, g int, h int, value bigint").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: per source its peers by divergence (``pair``) and its ``top`` most over-used terms (``term``)."""
    postings, groups = matrix(docs, least)
    sums = pair_sums(postings, groups)
    name = groups.select("lang", "g", "source")
    pairs = sums.join(name, ["lang", "g"]).join(name.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = postings.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    listed = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(listed)
