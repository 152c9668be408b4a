"""Repeated keys without shuffling the rows of unique ones.

A counting Bloom filter of two bits a counter (not seen, seen once, seen again)
is an aggregate over the keys.  Each task counts its own rows in two bitmaps
and sends the blocks it has touched; equal blocks are merged in a sorted stream,
so a task holds one block, however many tasks have sent it.  Two keys' hashes
may share a counter, but all rows of a repeated key find their counters "seen
again".  Those rows, and the few others that the filter lets through, are all
that ``quality``'s exact counts then shuffle.

The filter has 16 counters a row, ``MOST`` at the most (32 MB when broadcast;
64 MB in a task that counts).  1.4 % of the rows with a unique key pass it then;
beyond 17 million rows the share grows, and the results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators import quality as Q
from revlens.session import written

#: Counters of a block, a row, and a filter at the most (powers of two).
BLOCK, A_ROW, MOST = 1 << 15, 16, 1 << 28
#: The bit from which a key's second counter is read off its hash.
SECOND = 32


def _counters(rows: int) -> int:
    n = BLOCK
    while n < min(A_ROW * rows, MOST):
        n *= 2
    return n


def _count(counters: int):
    """Per task: (block, once, again), bitmaps of the counters that its keys have met."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(counters // 8, np.uint8), np.zeros(counters // 8, np.uint8)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            mask = np.uint64(counters - 1)
            at, n = np.unique(np.concatenate([h & mask, (h >> np.uint64(SECOND)) & mask]), return_counts=True)
            if not len(at):
                continue
            at = at.astype(np.int64)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            byte = byte[first]
            new = np.bitwise_or.reduceat(bit, first)
            again[byte] |= (once[byte] & new) | np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), first)
            once[byte] |= new
        once, again = once.reshape(-1, BLOCK // 8), again.reshape(-1, BLOCK // 8)
        for part in np.array_split(np.flatnonzero(once.any(axis=1)), max(1, counters // BLOCK // 256)):
            if len(part):
                yield pa.RecordBatch.from_pydict({"block": pa.array(part, pa.int32()), "once": pa.array([x.tobytes() for x in once[part]], pa.binary()),
                                                  "again": pa.array([x.tobytes() for x in again[part]], pa.binary())})
    return run


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, words) of rows sorted by block: a counter is seen again if one task says so or two have seen it."""
    def out(block: int, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "words": pa.array([again.view("<i8")], pa.list_(pa.int64()))})

    held: int | None = None
    once = again = np.empty(0, np.uint8)
    for batch in batches:
        for block, o, a in zip(batch.column("block").to_pylist(), batch.column("once"), batch.column("again"), strict=True):
            o, a = (np.frombuffer(x.as_buffer(), np.uint8) for x in (o, a))
            if block != held:
                if held is not None:
                    yield out(held, again)
                held, once, again = block, o.copy(), a.copy()
            else:
                again |= a | (once & o)
                once |= o
    if held is not None:
        yield out(held, again)


def repeat_filter(df: DataFrame, keys: Sequence[str], counters: int | None = None) -> tuple[DataFrame, int]:
    """The filter of a frame's keys, written: ((block, words) of counters seen again, number of counters)."""
    n = counters or _counters(df.count())
    counted = df.select(F.xxhash64(*keys).alias("h")).mapInArrow(_count(n), "block int, once binary, again binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, words array<bigint>")
    return written(merged, "repeat-filter"), n


def maybe_repeated(df: DataFrame, keys: Sequence[str], counters: int | None = None) -> DataFrame:
    """The rows whose key the filter has seen again: all rows of repeated keys, and some others.

    A row meets the block of each of its two counters in a broadcast semi join
    (``MOST`` bounds the blocks), so the rows are not shuffled.  NULL is a key
    like any other here.
    """
    blocks, n = repeat_filter(df, keys, counters)
    h = F.xxhash64(*keys)
    out = df.withColumns({"__at0": h.bitwiseAND(F.lit(n - 1)), "__at1": F.shiftrightunsigned(h, SECOND).bitwiseAND(F.lit(n - 1))})
    for i in range(2):
        at = F.col(f"__at{i}")
        seen = blocks.toDF(f"__block{i}", f"__words{i}")
        out = out.join(F.broadcast(seen), (F.floor(at / BLOCK).cast("int") == F.col(f"__block{i}")) & _bit(F.col(f"__words{i}"), at), "left_semi")
    return out.drop("__at0", "__at1")


def _bit(words: Column, at: Column) -> Column:
    """Whether a block's bit of counter ``at`` is set."""
    inside = at.bitwiseAND(F.lit(BLOCK - 1))
    word = F.get(words, F.shiftright(inside, 6).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), inside.bitwiseAND(F.lit(63)).cast("int"))) != 0


def duplicate_rows(df: DataFrame, keys: Sequence[str], counters: int | None = None) -> DataFrame:
    """``quality.duplicate_rows``, which counts the rows that the filter lets through."""
    return Q.duplicate_rows(written(maybe_repeated(df, keys, counters), "maybe-repeated"), keys)


def duplicate_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], counters: int | None = None) -> DataFrame:
    """``quality.duplicate_keys``, which counts the keys that the filters let through."""
    return Q.duplicate_keys({name: (maybe_repeated(df.select(*keys).dropna(), keys, counters), keys) for name, (df, keys) in tables.items()})


def dedup_preview(df: DataFrame, keys: Sequence[str], order_by: str, descending: bool,
                  tie_break: Sequence[str] | None = None, counters: int | None = None) -> DataFrame:
    """``quality.dedup_preview`` of the rows that the filter lets through: no other row can go."""
    return Q.dedup_preview(written(maybe_repeated(df, keys, counters), "maybe-repeated"), keys, order_by, descending, tie_break)
