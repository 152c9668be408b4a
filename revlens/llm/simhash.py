"""SimHash near-duplicates by generalised pigeonhole search in Hamming space.

1. Every whole text becomes a 64-bit fingerprint (3-word shingles, XXH64).
2. Equal fingerprints collapse to one row with their smallest doc_id.
3. The 64 bits are grouped into m partitions, correlated bits together, from
   the 64 x 64 co-occurrence counts over all fingerprints.
4. Thresholds t_1..t_m with t_i >= -1 and sum(t_i) = tau - m + 1 guarantee that
   a fingerprint within tau bits is within t_i bits in some partition i
   (-1: not probed).  Each fingerprint gets its own thresholds: a dynamic
   programme minimises probes plus estimated candidates, from byte histograms
   of all fingerprints and a Count-Min sketch of all partition values.
5. Probe rows (all values within t_i bits) meet index rows by partition and
   value; a pair is verified by the bit count of its XOR.
6. Links become components: smallest label over neighbours, then pointer
   jumping, until nothing changes.

No step collects fingerprints or links to the driver: it sees the 64 x 64
counts, 256 counts per byte of a partition, and 2 * ``WIDTH`` counters per
partition, whatever the table holds.  A group of near copies crowds one value of
a partition; there the sketch's count makes the programme probe other partitions
instead.

Defined results: null and empty texts have no word, so their fingerprint is
zero and they link like any other; rows with a null doc_id get a fingerprint
and no component; repeated rows appear once per row; extra columns are ignored
by ``components`` and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_intdigest

from revlens.llm.arrow import HASH_BASE, batch_of, chunks, mixed
from revlens.session import written

BITS = 64
#: Counters of each of a partition's two sketch rows (a power of two), and of a block in which they are sent.
WIDTH, SKETCH_BLOCK = 1 << 18, 1 << 14
#: Shingles hashed at once.
BLOCK = 1 << 16


# --- fingerprints -----------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if over half of its shingle hashes have it."""
    words = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not words:
        return 0
    k = min(shingle, len(words))
    total = len(words) - k + 1
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(k))))
    hashes = map(partial(xxh64_intdigest, seed=42), grams)
    ones = np.zeros(BITS, np.int64)
    while len(block := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > total))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, hash) per row of ``docs``; fp is the fingerprint's 64 bits as a signed long, hash the whole text's."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [fingerprint(t or b"", shingle) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield batch_of(schema, id=part.column("id"), fp=pa.array(np.array(found, np.uint64).view(np.int64)), hash=part.column("hash"))

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(run, "id bigint, fp bigint, hash bigint")


# --- partitions and thresholds ----------------------------------------------

def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i in range(0, len(fps), BLOCK):
                x = np.unpackbits(fps[i: i + BLOCK].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                total += len(x)
        if total:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(BITS * BITS + 1)), "n": pa.array(np.append(both.ravel(), total).astype(np.int64))})

    got = {r["pos"]: r["n"] for r in nodes.select("fp").mapInArrow(run, "pos bigint, n bigint").groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    return got.get(BITS * BITS, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of equal size (but for one), correlated bits together, grown greedily."""
    p = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for size in [BITS // m + (i < BITS % m) for i in range(m)]:
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(left), key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def ball(width: int, t: int) -> int:
    """Number of values within t bits of one of ``width`` bits."""
    n, total = 1, 0
    for d in range(max(t, -1) + 1):
        total += n
        n = n * (width - d) // (d + 1)
    return total


def choose_m(total: int, tau: int) -> int:
    """Number of partitions with the least probes and expected candidates if bits were even."""
    def cost(m: int) -> float:
        width = BITS // m
        best = {0: 0.0}
        for _ in range(m):
            best = {s: min(best[q] + (ball(width, t) * (1 + total / 2.0 ** width) if t >= 0 else 0)
                           for q in best for t in range(-1, tau + 1) if q + t == s)
                    for s in {q + t for q in best for t in range(-1, tau + 1)}}
        return best[tau - m + 1]

    return min(range(1, tau + 2), key=cost)


def extract(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of a group of bits of each fingerprint."""
    out = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def byte_groups(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each partition's bits in blocks of 8 at most."""
    return [[g[i: i + 8] for i in range(0, len(g), 8)] for g in groups]


def value_counts(nodes: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of the 256 values of every block of every partition, over all fingerprints."""
    blocks = byte_groups(groups)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {(i, j): np.zeros(256, np.int64) for i, g in enumerate(blocks) for j, _ in enumerate(g)}
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for (i, j), a in acc.items():
                a += np.bincount(extract(fps, blocks[i][j]).astype(np.int64), minlength=256)
        for (i, j), a in acc.items():
            v = np.flatnonzero(a)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(v), i)), "j": pa.array(np.full(len(v), j)), "v": pa.array(v), "n": pa.array(a[v])})

    out = {(i, j): np.zeros(256) for i, g in enumerate(blocks) for j, _ in enumerate(g)}
    for r in nodes.select("fp").mapInArrow(run, "i bigint, j bigint, v bigint, n bigint").groupBy("i", "j", "v").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]][r["v"]] = r["n"]
    return out


def _counters(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A partition value's counter in either row."""
    h = mixed(values + HASH_BASE)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), (h >> np.uint64(BITS - WIDTH.bit_length() + 1)).astype(np.int64)


def value_sketch(nodes: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """(partition, row, counter): a Count-Min sketch of all values of every partition, of the same size for any table.

    Tasks send compressed blocks of counters, which are summed block by block;
    2 * ``WIDTH`` counters a partition reach the driver.
    """
    m = len(groups)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((m, 2, WIDTH), np.uint32)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                for row, at in zip(sketch[i], _counters(extract(fps, g)), strict=True):
                    np.add.at(row, at, np.uint32(1))
        blocks = sketch.reshape(-1, SKETCH_BLOCK)
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([int(b)], pa.int32()), "counts": pa.array([pack(blocks[b].tobytes())], pa.binary())})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(unpack(counts), np.uint32).astype(np.uint64)
        for b, counts in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    shape = "block int, counts binary"
    out = np.zeros((2 * m * WIDTH // SKETCH_BLOCK, SKETCH_BLOCK))
    for r in nodes.select("fp").mapInArrow(count, shape).repartition("block").mapInArrow(add, shape).collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint64)
    return out.reshape(m, 2, WIDTH)


def sketched(sketch: np.ndarray, total: int, values: np.ndarray) -> np.ndarray:
    """About how many fingerprints have each value of a partition: what its counters hold beyond the load that any has."""
    a, b = _counters(values)
    load = total / WIDTH
    return np.maximum(np.minimum(sketch[0][a], sketch[1][b]) - load - 3 * load ** 0.5, 0)


class Allocation:
    """Estimated candidates and thresholds per fingerprint.

    ``heavy``: (partition, value) -> its count, where known; ``sketch``: of all
    values (``value_sketch``).
    """

    def __init__(self, total: int, groups: list[list[int]], counts: dict[tuple[int, int], np.ndarray], heavy: dict[tuple[int, int], int], tau: int,
                 sketch: np.ndarray | None = None):
        self.total, self.groups, self.tau, self.sketch = total, groups, tau, sketch
        self.blocks = byte_groups(groups)
        v = np.arange(256, dtype=np.uint8)
        apart = np.unpackbits((v[:, None] ^ v[None, :])[..., None], axis=2).sum(axis=2)
        #: For each block and value: the share of fingerprints at 0..tau bits from it.
        self.near = {k: np.stack([(apart == d) @ (c / max(total, 1)) for d in range(tau + 1)], axis=1) for k, c in counts.items()}
        self.heavy = []
        for i in range(len(groups)):
            own = sorted((x, n) for (g, x), n in heavy.items() if g == i)
            self.heavy.append((np.array([x for x, _ in own], np.uint64), np.array([n for _, n in own], float)))

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprint, partition, threshold + 1): probes plus estimated candidates."""
        out = np.zeros((len(fps), len(self.groups), self.tau + 2))
        for i, blocks in enumerate(self.blocks):
            share = None
            for j, bits in enumerate(blocks):
                s = self.near[i, j][extract(fps, bits).astype(np.int64)]
                share = s if share is None else np.stack([sum(share[:, a] * s[:, d - a] for a in range(d + 1)) for d in range(self.tau + 1)], axis=1)
            least = np.zeros(len(fps))
            values, n = self.heavy[i]
            if len(values):
                key = extract(fps, self.groups[i])
                at = np.minimum(np.searchsorted(values, key), len(values) - 1)
                least = np.where(values[at] == key, n[at], 0.0)
            if self.sketch is not None:
                least = np.maximum(least, sketched(self.sketch[i], self.total, extract(fps, self.groups[i])))
            for t in range(self.tau + 1):
                out[:, i, t + 1] = ball(len(self.groups[i]), t) + np.maximum(self.total * share[:, : t + 1].sum(axis=1), least)
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprint, partition): t_i of least total cost with sum tau - m + 1, by dynamic programming."""
        cost, m = self.costs(fps), len(self.groups)
        goal = self.tau - m + 1
        best: dict[int, np.ndarray] = {0: np.zeros(len(fps))}
        steps: list[dict[int, np.ndarray]] = []
        for i in range(m):
            nxt: dict[int, np.ndarray] = {}
            came: dict[int, np.ndarray] = {}
            for s in best:
                for t in range(-1, self.tau + 1):
                    c, q = best[s] + cost[:, i, t + 1], s + t
                    if q not in nxt:
                        nxt[q], came[q] = c.copy(), np.full(len(fps), t)
                    else:
                        better = c < nxt[q]
                        nxt[q][better], came[q][better] = c[better], t
            best = nxt
            steps.append(came)
        out = np.zeros((len(fps), m), np.int64)
        left = np.full(len(fps), goal)
        for i in reversed(range(m)):
            for s, came in steps[i].items():
                here = left == s
                out[here, i] = came[here]
            left -= out[:, i]
        return out


# --- links ------------------------------------------------------------------

def links(nodes: DataFrame, tau: int = 2) -> DataFrame:
    """(a, b): ids of fingerprints at most ``tau`` bits apart, each pair once.

    ``nodes``: a written table of distinct fingerprints (fp) with an id (rep).
    """
    total, both = bit_counts(nodes)
    groups = group_bits(total, both, choose_m(total, tau))
    m = len(groups)
    counts = value_counts(nodes, groups)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(fps), i, np.int32)), "key": pa.array(extract(fps, g).view(np.int64)), "fp": batch.column("fp"), "rep": batch.column("rep")})

    shape = "part int, key bigint, fp bigint, rep bigint"
    index = nodes.select("fp", "rep").mapInArrow(keys, shape)
    shared = nodes.sparkSession.sparkContext.broadcast(Allocation(total, groups, counts, {}, tau, value_sketch(nodes, groups)))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        flips = [[[sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(g)), d)] for t in range(tau + 1)] for g in groups]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fp").to_numpy().view(np.uint64)
                reps = part.column("rep").to_numpy()
                chosen = plan.thresholds(fps)
                for i, g in enumerate(groups):
                    for t in range(tau + 1):
                        rows = np.flatnonzero(chosen[:, i] == t)
                        if not len(rows):
                            continue
                        around = np.array(flips[i][t], np.uint64)
                        key = (extract(fps[rows], g)[:, None] ^ around[None, :]).ravel()
                        yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(key), i, np.int32)), "key": pa.array(key.view(np.int64)),
                                                          "fp": pa.array(np.repeat(fps[rows].view(np.int64), len(around))), "rep": pa.array(np.repeat(reps[rows], len(around)))})

    p, x = nodes.select("fp", "rep").mapInArrow(probe, shape).alias("p"), index.alias("x")
    near = (F.col("p.part") == F.col("x.part")) & (F.col("p.key") == F.col("x.key")) & (F.col("p.fp") < F.col("x.fp")) \
        & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("x.fp"))) <= tau)
    # the probes of either fingerprint find the pair; those of the smaller one are used
    return p.join(x, near).select(F.col("p.rep").alias("a"), F.col("x.rep").alias("b")).distinct()


def label_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with an edge.

    ``edges``: a written table (a, b).  Every round takes the smallest label
    among neighbours and then the label's own label; labels are written each
    round, so a lost executor costs a reread.  No star or group is gathered:
    rounds are joins on nodes (of bounded degree) and minima.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        low = both.join(of, "other").groupBy("node").agg(F.min("near").alias("near"))
        seen = labels.join(low, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        nxt = written(seen.join(jump, "low", "left").select("node", F.least("low", "next").alias("label"), (F.least("low", "next") < F.col("label")).alias("changed")), "labels")
        if nxt.filter("changed").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", "label")


def grouped(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """``fingerprints`` with ``group``, the smallest fingerprint of the component, and ``component_id``, its smallest id.

    Fingerprints are the nodes: texts that share an id are not linked by it.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "fingerprint-nodes")
    edges = written(links(nodes.select("fp", F.col("fp").alias("rep")), max_bits), "fingerprint-links")
    labels = label_components(spark, edges)
    linked = nodes.join(labels, nodes["fp"] == labels["node"])
    least = written(linked.groupBy("label").agg(F.min("rep").alias("least")), "component-ids")  # of known size: a hot label is not dealt out
    by_fp = nodes.join(labels, nodes["fp"] == labels["node"], "left").join(least, "label", "left") \
        .select("fp", F.coalesce("label", "fp").alias("group"), F.coalesce("least", "rep").alias("component_id"))
    return prints.join(by_fp, "fp", "left")


def components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``, the smallest id reachable by links."""
    out = grouped(docs, shingle, max_bits, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (one of them, if repeated).

    Rows that share an id and are not linked are kept apart.  Rows without an
    id belong to no component and stay.
    """
    groups = grouped(docs, shingle, max_bits, id_col, text_col).filter(F.col("component_id") == F.col("id"))
    kept = written(groups.groupBy("id", "group").agg(F.min("hash").alias("__hash")).select(F.col("id").alias("__keep"), "__hash"), "kept-rows")
    named = docs.filter(F.col(id_col).isNotNull()).withColumn("__text", F.xxhash64(F.col(text_col).cast("string")))
    rank = Window.partitionBy(id_col, "__text").orderBy(F.col(text_col))
    chosen = named.join(kept, (named[id_col] == kept["__keep"]) & (named["__text"] == kept["__hash"]), "left_semi") \
        .withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").drop("__rank", "__text")
    return chosen.unionByName(docs.filter(F.col(id_col).isNull()))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``components``' rows."""
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
