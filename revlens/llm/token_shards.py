"""Training-order materialisation of token sequences in fixed-stride shards.

1. Tasks tokenise their documents, join the ids and cut them into sequences of
   ``LENGTH`` tokens; they are written once with (task, number in the task).
2. The number of sequences per task gives every sequence a dense index.
3. A keyed Feistel permutation of [0, N) maps index to global slot: a balanced
   network over the next even number of bits, walked until it lands below N.
4. Slots are range-partitioned; each range writes its shards in slot order.
   A shard is a 32-byte header and rows of fixed length, so slot s lies at
   header + (s mod rows) * row bytes of shard s // rows, and a reader can stop
   and resume at any slot.

Shards are written to the shared folder through the file system of its URL.
A task writes to a name of its own and then moves the file to its place, so a
second attempt replaces the first with the same bytes.

Defined results: a null text is empty and has its end token alone; repeated
rows and null ids are all tokenised; a task's last sequence is filled up with
``PAD``; extra columns are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from revlens.llm.arrow import batch_of, chunks
from revlens.llm.tokens import Encoder, default_vocabulary
from revlens.session import scratch_path, written

#: Tokens of a sequence, sequences of a shard, id that fills up.
LENGTH = 8192
ROWS = 512
PAD = 0
ROUNDS = 6

_HEADER = "<8sIIQII"  # magic, tokens a row, bytes a token, first slot, rows, zero
_HEADER_BYTES = struct.calcsize(_HEADER)
_MAGIC = b"TOKSHRD1"
_MASK = (1 << 64) - 1


def _round(right: np.ndarray, key: int, r: int) -> np.ndarray:
    """A keyed 64-bit mix of one half (splitmix-style finaliser)."""
    h = right + np.uint64((key ^ (0x9E3779B97F4A7C15 * (r + 1))) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _network(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for r in (range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)):
        if back:
            left, right = right ^ (_round(left, key, r) & low), left
        else:
            left, right = right, left ^ (_round(right, key, r) & low)
    return (left << np.uint64(half)) | right


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each index below n (``back``: the index of each slot), a bijection of [0, n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):  # cycle-walking: the network's domain is less than 4 times [0, n)
        out[todo] = _network(out[todo], half, key, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


SEQUENCE = "task int, number bigint, n_tokens int, body binary"


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(task, number, n_tokens, body): the joined ids of each task's documents, cut to ``length``."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("task", pa.int32()), ("number", pa.int64()), ("n_tokens", pa.int32()), ("body", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, number = Encoder(path), TaskContext.get().partitionId(), 0
        rest = np.empty(0, "<u4")

        def cut(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            rows = [ids[i: i + length] for i in range(0, len(ids), length)]
            out = batch_of(schema, task=[task] * len(rows), number=list(range(number, number + len(rows))), n_tokens=[len(r) for r in rows],
                           body=[r.astype(token_type(encoder.size)).tobytes() for r in rows])
            number += len(rows)
            return out

        for batch in batches:
            for part in chunks(batch, "text"):
                ids = np.concatenate([rest, *(encoder.document(t) for t in part.column("text").to_pylist())])
                whole = len(ids) - len(ids) % length
                rest = ids[whole:]
                if whole:
                    yield cut(ids[:whole])
        if len(rest):
            yield cut(rest)

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, SEQUENCE)


def token_type(vocabulary_size: int) -> str:
    """The smallest little-endian unsigned type that holds every id."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def materialise(docs: DataFrame, folder: str | None = None, key: int = 0x5EED, length: int = LENGTH, rows: int = ROWS,
                vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """Write the shards and return one row per shard: shard, path, first_slot, n_rows."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    vocab = vocabulary or default_vocabulary()
    kind = token_type(Encoder(vocab).size)
    path = scratch_path(spark, "sequences")
    # neighbouring sequences compress together in Parquet's pages
    sequences(docs, length, vocab, text_col).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)
    cut = spark.read.schema(SEQUENCE).parquet(path)
    per_task = sorted((r["task"], r["n"]) for r in cut.groupBy("task").agg(F.count("*").alias("n")).collect())  # one row a task
    total, before = 0, {}
    for task, n in per_task:
        before[task], total = total, total + n
    offsets = spark.sparkContext.broadcast(before)
    shard_count = -(-total // rows)
    out_schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("n_tokens", pa.int32()), ("body", pa.binary())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)  # for the shuffle
        for batch in batches:
            first = np.array([offsets.value[t] for t in batch.column("task").to_pylist()], np.int64)
            slot = permute(first + batch.column("number").to_numpy(), total, key)
            yield batch_of(out_schema, shard=pa.array(slot // rows), slot=pa.array(slot), n_tokens=batch.column("n_tokens"), body=[small.compress(b) for b in batch.column("body").to_pylist()])

    shard_schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_slot", pa.int64()), ("n_rows", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else _uri(folder))
        fs.create_dir(base, recursive=True)
        big, width = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
        out, now, name, done, count = None, None, "", [], 0

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                fs.move(name, f"{base}/{_shard_name(now)}")
                done.append((now, f"{folder.rstrip('/')}/{_shard_name(now)}", now * rows, count))
                out = None

        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if shard != now:
                    finish()
                    now, count, name = shard, 0, f"{base}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                    out.write(struct.pack(_HEADER, _MAGIC, length, width, shard * rows, min(rows, total - shard * rows), 0))
                raw = big.decompress(body)
                out.write(raw + np.full(length - len(raw) // width, PAD, kind).tobytes())
                count += 1
        finish()
        if done:
            yield batch_of(shard_schema, **{n: list(c) for n, c in zip(shard_schema.names, zip(*done, strict=True), strict=True)})

    slots = cut.mapInArrow(place, "shard bigint, slot bigint, n_tokens int, body binary")
    parts = max(1, min(shard_count, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # slots are dense, so the bounds of the ranges are known: no sampling pass
    at = F.floor(F.col("shard") * parts / max(shard_count, 1)).cast("int")
    ordered = slots.repartitionById(parts, at).sortWithinPartitions("slot").select("shard", "body")
    return written(ordered.mapInArrow(write, "shard bigint, path string, first_slot bigint, n_rows bigint"), "shards")


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:")


def _shard_name(shard: int) -> str:
    return f"shard-{shard:012d}.tok"


def read_rows(path: str, first_slot: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(slot, byte offset, tokens) of a shard file from ``first_slot`` on, in one sequential read."""
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else _uri(path))
    with fs.open_input_file(name) as f:
        magic, length, width, slot, n, _ = struct.unpack(_HEADER, f.read(_HEADER_BYTES))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token shard")
        at = max(0, first_slot - slot)
        f.seek(_HEADER_BYTES + at * length * width)
        for i in range(at, n):
            yield slot + i, _HEADER_BYTES + i * length * width, np.frombuffer(f.read(length * width), f"<u{width}")


def read_back(shards: DataFrame, total: int, key: int = 0x5EED) -> DataFrame:
    """One row per sequence as the shard files have it: slot, sequence (its index before the permutation), shard, byte_offset, tokens' CRC-32 (unsigned 32-bit ids)."""
    schema = pa.schema([("slot", pa.int64()), ("sequence", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                got = [(slot, at, zlib.crc32(ids.astype("<u4").tobytes())) for slot, at, ids in read_rows(path)]
                slot, at, crc = (list(c) for c in zip(*got, strict=True))
                yield batch_of(schema, slot=slot, sequence=pa.array(permute(np.array(slot), total, key, back=True)), shard=[shard] * len(slot), byte_offset=at, ids_crc32=crc)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("shard", "path").repartition(n).mapInArrow(run, "slot bigint, sequence bigint, shard bigint, byte_offset bigint, ids_crc32 bigint")


def total_rows(shards: DataFrame) -> int:
    return shards.agg(F.sum("n_rows")).first()[0] or 0
