"""Byte-level access to text columns inside Arrow batches.

The map stages of this subpackage run as ``mapInArrow``: Spark partitions the
rows, and each batch is handled as flat numpy buffers.  Batches are cut into
runs of rows of at most ``CHUNK_BYTES`` of text (one row at least), so memory
follows the chunk, or the longest single text, and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
CHUNK_BYTES = 1 << 20

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``limit`` bytes of ``text`` (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text with the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]] if data is not None and len(offs) else np.empty(0, np.uint8)
    return raw, (offs - offs[0]).astype(np.int64)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes that cross no text border: (starts, ends, text number)."""
    n = len(member)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: An odd number, so it has an inverse modulo 2^64.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(HASH_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with every bit depending on every other."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], from prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(HASH_BASE, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from arrays or lists by name."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
         for f in schema for c in [columns[f.name]]], schema=schema)
