"""Spelling variants: words one edit apart, found in a reduced alphabet, and the likely form of each.

1. Words are the letter runs of the texts, with a planted slip: where 31
   divides the CRC-32 of ``<id>:<run>``, one code point of the run is missing.
   They are counted in each task, then by Spark.
2. Every letter is hashed to one of ``SYMBOLS`` symbols.  An edit of a word is
   the same edit, or none, of its reduced word, so two words one edit apart
   have reduced words at most one edit apart.
3. The full one-edit neighbourhood of each word's reduced form (deletions,
   replacements, insertions, and itself) meets the reduced vocabulary.
   Reduced words are 64-bit polynomial hashes: every neighbour's hash follows
   from prefix and suffix sums in one step, and equal reduced words have equal
   hashes, so a collision can only add a candidate.
4. A Bloom filter of the reduced vocabulary, sized by it up to
   ``FILTER_BITS``, drops neighbours that nothing has before the shuffle.
   Beyond that size more of them are shuffled; no result changes.
5. The join condition is the edit distance of the original strings.
6. Per word its near words are counted and the most frequent one is picked;
   roots follow by pointer jumping over the forms.

A word has at most about 2 * length * alphabet near words, whatever the size of
the vocabulary, so no group is unbounded.

Defined results: null texts have no word; a null id is written as nothing
before the colon; repeated rows count again; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm.arrow import batch_of, chunks, mixed
from revlens.llm.blocks import ascii_lower, blocks
from revlens.session import written

#: Letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
BREAK = re.compile(f"[^{LETTERS}]")
#: One run in SLIP has a code point deleted.
SLIP = 31
#: Code points and occurrences of a word, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: Symbols of the reduced alphabet.
SYMBOLS = 8
#: Entries of a task's dictionary before they are sent on.
FLUSH = 300_000
#: Most bits of the Bloom filter (32 MB), and bits per reduced word below that.
FILTER_BITS, BITS_PER_WORD = 1 << 28, 16
#: Neighbours made at once.
CELLS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- words ------------------------------------------------------------------

def slipped(run: str, doc_id: int | None) -> str:
    """The run, without one code point where the CRC-32 of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with enough code points and occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # shorter runs make no word

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in chunks(batch, "text"):
                for text, doc in zip(part.column("text").to_pylist(), part.column("id").to_pylist(), strict=True):
                    for piece in blocks(text or "", BREAK):
                        for word, n in Counter(runs.findall(ascii_lower(piece))).items():
                            held[slipped(word, doc)] += n
                    if len(held) > FLUSH:
                        yield batch_of(schema, word=list(held), n=list(held.values()))
                        held.clear()
        yield batch_of(schema, word=list(held), n=list(held.values()))

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(run, "word string, n bigint").filter(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- reduced alphabet -------------------------------------------------------

def reduce_alphabet(words: list[str], symbols: int) -> np.ndarray:
    """(word, place): the symbol, from 1, of every letter of words of one length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)
    return mixed(codes) % np.uint64(symbols) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def own_key(reduced: np.ndarray) -> np.ndarray:
    """The hash of each reduced word."""
    return mixed((reduced * _powers(reduced.shape[1])).sum(axis=1, dtype=np.uint64))


def neighbour_keys(reduced: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of the whole one-edit neighbourhood of reduced words of one length, themselves included, each once."""
    n, length = reduced.shape
    power, inverse = _powers(length + 1), np.uint64(_INVERSE)
    prefix = np.zeros((n, length + 1), np.uint64)
    np.cumsum(reduced * power[:-1], axis=1, out=prefix[:, 1:])
    whole = prefix[:, -1:]
    rows = np.arange(n)
    yield rows, mixed(whole[:, 0])
    step = max(1, CELLS // max(n, 1))
    for a in range(0, length + 1, step):
        at = slice(a, min(a + step, length + 1))
        here, kept = prefix[:, at], slice(a, min(a + step, length))
        before = np.concatenate([np.zeros((n, 1), np.uint64), reduced], axis=1)[:, at]  # the letter before each gap
        for symbol in range(1, symbols + 1):
            s = np.uint64(symbol)
            new = before != s  # an insertion behind an equal letter is the same as before it
            yield np.nonzero(new)[0], mixed((here + s * power[at] + (whole - here) * np.uint64(_BASE))[new])
            other = reduced[:, kept] != s
            yield np.nonzero(other)[0], mixed((whole + (s - reduced[:, kept]) * power[kept])[other])
        if kept.start < length:
            gone = reduced[:, kept] != before[:, : kept.stop - a]  # of equal letters in a row one deletion
            rest = (whole - prefix[:, a + 1: kept.stop + 1]) * inverse
            yield np.nonzero(gone)[0], mixed((prefix[:, kept] + rest)[gone])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers, words) of each length, a bounded number of letters at once."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        numbers = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (64 * int(length)))
        for i in range(0, len(numbers), step):
            yield numbers[i: i + step], [words[j] for j in numbers[i: i + step]]


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` (word, n) with the hash of the reduced word."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.uint64)
            for numbers, own in _by_length(batch.column("word").to_pylist()):
                key[numbers] = own_key(reduce_alphabet(own, symbols))
            yield batch_of(schema, word=batch.column("word"), n=batch.column("n"), key=key.view(np.int64))

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, key bigint")


class Bloom:
    """A Bloom filter of two bits a key, over keys that are hashes already."""

    def __init__(self, keys: DataFrame, count: int):
        bits = 1 << 16
        while bits < min(BITS_PER_WORD * count, FILTER_BITS):
            bits *= 2
        self.mask, self.shift = np.uint64(bits - 1), np.uint64(36)
        at = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 36).bitwiseAND(F.lit(bits - 1)))).alias("bit"))
        words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        got = words.toArrow()  # bits / 64 rows at most
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for bit in (keys & self.mask, (keys >> self.shift) & self.mask):
            out &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


# --- near words and forms ---------------------------------------------------

def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, other, other_n): every two words exactly one edit apart, both ways.  ``words``: a written table (word, n) of distinct words."""
    spark = words.sparkSession
    index = written(_keyed(words, symbols), "reduced-words")
    bloom = spark.sparkContext.broadcast(Bloom(index.select("key").distinct(), index.count()))
    schema = pa.schema([("key", pa.int64()), ("word", pa.string())])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for batch in batches:
            for _, own in _by_length(batch.column("word").to_pylist()):
                column = pa.array(own, pa.string())
                for at, keys in neighbour_keys(reduce_alphabet(own, symbols), symbols):
                    some = known.has(keys)
                    if some.any():
                        yield batch_of(schema, key=keys[some].view(np.int64), word=column.take(pa.array(at[some])))

    probes = words.select("word").mapInArrow(probe, "key bigint, word string").alias("p")
    other = index.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")).alias("x")
    one_edit = (F.col("p.key") == F.col("x.key")) & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)
    return probes.join(other, one_edit).select("word", "other", "other_n").distinct()


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word.  ``forms``: a written table (word, form), without cycles."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        far = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(reach.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        reach = nxt.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, symbols: int = SYMBOLS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    spark = docs.sparkSession
    words = written(word_counts(docs, least_length, least_count, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("other"))).alias("best")
    near = near_words(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.rank") >= times * F.col("n")
    found = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n")), "word-forms")
    ends = roots(spark, found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
