"""Sequence packing as vector bin packing with the dot-product heuristic.

Every document is a vector of demands: tokens, one segment, loss-bearing
tokens.  A sequence is a bin with a limit on each.  The open bin takes, again
and again, the waiting document that fits whole and has the largest weighted
dot product of its demand and the bin's free space (weights: how scarce each
dimension is among those waiting).  When none fits whole, the best one is cut
to the space that is left, so a bin closes full unless its segment or loss
limit is reached.  A document of more than a bin is first cut into full bins.

A task packs its own rows in a stream and holds ``POOL`` waiting documents of
less than one sequence each; nothing is shuffled.  The last, partly filled
bin of a task is dealt into sequences whose sizes are powers of two, which
need no padding.

Defined results: a null text is empty and has the end token alone; rows are
packed independently, so repeated rows and null ids are each packed; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.arrow import batch_of, chunks
from revlens.llm.tokens import Encoder, default_vocabulary

#: Waiting documents among which a bin chooses.
POOL = 1024


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Item:
    """Tokens of one document that wait: ids[at:], of which those from ``loss_from`` on bear loss."""

    doc: int | None
    ids: np.ndarray
    at: int
    loss_from: int

    def loss(self, a: int, b: int) -> int:
        return max(0, b - max(a, self.loss_from))


class Packer:
    """Places documents into sequences; ``put`` and ``close`` return finished pieces.

    A piece is (doc, start, length, ids_crc32, doc_tokens, sequence, offset, loss tokens).
    """

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits = limits
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.sequence = first_sequence
        self.items: list[Item | None] = [None] * POOL
        self.free_slots = list(range(POOL))
        self.need = np.zeros((POOL, 3))  # waiting tokens, segments, loss tokens; 0 segments: free slot
        self.bin: list[tuple[Item, int, int]] = []
        self.room = self.caps.copy()

    # pieces

    def _piece(self, item: Item, a: int, b: int, offset: int) -> tuple:
        return (item.doc, a, b - a, zlib.crc32(item.ids[a:b].tobytes()), len(item.ids), self.sequence, offset, item.loss(a, b))

    def _emit(self, parts: list[tuple[Item, int, int]]) -> list[tuple]:
        out, offset = [], 0
        for item, a, b in parts:
            out.append(self._piece(item, a, b, offset))
            offset += b - a
        self.sequence += 1
        return out

    def _flush(self) -> list[tuple]:
        parts, self.bin, self.room = self.bin, [], self.caps.copy()
        return self._emit(parts) if parts else []

    def _take(self, item: Item, b: int) -> None:
        a, item.at = item.at, b
        self.bin.append((item, a, b))
        self.room -= (b - a, 1, item.loss(a, b))

    def _cut(self, item: Item) -> int:
        """The furthest end of a piece from item.at that the open bin can hold."""
        end = min(len(item.ids), item.at + int(self.room[0]))
        return min(end, max(item.at, item.loss_from) + int(self.room[2]))

    # documents

    def put(self, doc: int | None, ids: np.ndarray, loss_from: int = 1) -> list[tuple]:
        out: list[tuple] = []
        item = Item(doc, ids, 0, loss_from)
        while len(ids) - item.at > self.limits.tokens or item.loss(item.at, len(ids)) > self.limits.loss:
            b = min(len(ids), item.at + self.limits.tokens, max(item.at, loss_from) + self.limits.loss)
            out += self._emit([(item, item.at, b)])
            item.at = b
        if item.at == len(ids):
            return out
        slot = self.free_slots.pop()
        self.items[slot] = item
        self.need[slot] = (len(ids) - item.at, 1, item.loss(item.at, len(ids)))
        while not self.free_slots:
            out += self._step()
        return out

    def _step(self) -> list[tuple]:
        """One placement: a whole document, or a cut that closes the bin."""
        waiting = self.need[:, 1] > 0
        weight = self.need.sum(axis=0) / self.caps
        gain = (self.need / self.caps) @ (weight * self.room / self.caps)
        fits = waiting & (self.need <= self.room).all(axis=1)
        slot = int(np.argmax(np.where(fits, gain, -1.0)))
        if fits[slot]:
            item = self.items[slot]
            self._take(item, len(item.ids))
            self.items[slot] = None
            self.need[slot] = 0
            self.free_slots.append(slot)
            return [] if (self.room[:2] >= 1).all() else self._flush()
        if self.room[1] >= 1 and waiting.any():
            slot = int(np.argmax(np.where(waiting, gain, -1.0)))
            item = self.items[slot]
            if (b := self._cut(item)) > item.at:
                self._take(item, b)
                self.need[slot] = (len(item.ids) - item.at, 1, item.loss(item.at, len(item.ids)))
        return self._flush()

    def close(self) -> list[tuple]:
        out: list[tuple] = []
        while (self.need[:, 1] > 0).any():
            out += self._step()
        left, self.bin, self.room = self.bin, [], self.caps.copy()
        total = sum(b - a for _, a, b in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            parts = []
            while size:
                item, a, b = left.pop(0)
                c = min(b, a + size)
                parts.append((item, a, c))
                size -= c - a
                if c < b:
                    left.insert(0, (item, c, b))
            out += self._emit(parts)
        return out


_COLUMNS = [("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str | None = None, prompt_col: str | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    With ``prompt_col`` (instruction data) the prompt's tokens come first and
    bear no loss; without it every token but a document's first bears loss.
    Sequence ids are distinct over all tasks, not consecutive between tasks.
    """
    path = vocabulary or default_vocabulary()
    schema = pa.schema(_COLUMNS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            return batch_of(schema, **{n: list(c) for (n, _), c in zip(_COLUMNS, zip(*pieces, strict=True), strict=True)})

        for batch in batches:
            for part in chunks(batch, "text"):
                pieces: list[tuple] = []
                for doc, prompt, text in zip(part.column("id").to_pylist(), part.column("prompt").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids, loss_from = encoder.document(text), 1
                    if prompt is not None:
                        before = encoder.document(prompt)[:-1]
                        ids, loss_from = np.concatenate([before, ids]), max(1, len(before))
                    pieces += packer.put(doc, ids, loss_from)
                if pieces:
                    yield out(pieces)
        if pieces := packer.close():
            yield out(pieces)

    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), prompt.alias("prompt"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join(f"{n} bigint" for n, _ in _COLUMNS)).withColumnRenamed("doc", id_col)
