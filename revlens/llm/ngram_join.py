"""Jaccard join of shingle sets by token-combination prefixes.

A document's set holds its distinct shingles (4 words; the whole sequence if it
has fewer), as 64-bit hashes.  Two sets link when 100 * intersection >= 85 *
union.  Linked sets miss at most e = n - ceil(85 n / 100) tokens of each other.

1. One pass makes each document's set, of which it keeps the number of tokens
   and a hash (equal sets are one node from here on), and counts all tokens in
   a Count-Min sketch of fixed size.  What a counter holds beyond the mean load
   sets a token's level: 0, not above the noise; then doubling.
2. Tokens are ordered by level, then by hash.  Levels make classes: rare tokens
   are indexed alone, frequent ones by pairs, the most frequent by triples.
   The tokens of a class of k-combinations are dealt over some subclasses;
   p tokens of one subclass are worth p - k + 1, since that many losses are
   needed before no k of them are left in common.  A set's prefix is extended
   until it is worth e + 1: then e losses cannot spoil every combination, and
   linked sets share a key.  The number of subclasses follows from the set's
   size, by powers of two; a set within reach of smaller partners is also
   indexed by their number.  There are so few subclasses that every set reaches
   e + 1 with its own tokens.
3. Keys are counted, with the least and largest set size, and those of one set,
   or of two whose sizes lie too far apart, are left out; a second pass makes
   the postings of the other keys.  (A Bloom filter of these keys, of bounded
   size, keeps others out; what it lets through is removed exactly.)  Of keys
   that the very same sets have, one is kept: the others make no other pair.
4. Candidates share a key, are near enough in size, and differ in few enough
   bits of their parity maps (each token flips one of at least n / 2 bits, so
   maps differ in at most as many bits as the sets in tokens; the longer map is
   folded).  They are verified on the whole sets, which a further pass makes
   for the nodes of candidates alone.
5. ``components`` needs no pair within a group that is linked already.  In
   ``STAR_ROUNDS`` rounds each node is compared with its likeliest pivot of
   another component (some nodes of each key are pivots: ``PIVOTS``, by round;
   all rounds but the last take keys of many nodes alone: ``STAR_NODES``, as
   few nodes make few pairs and most postings are theirs).  Then all candidates
   of different components that are left are listed; in ``BEST_ROUNDS`` rounds
   each node's likeliest is verified and pairs that have come to lie in one
   component are struck off; the rest is verified.  ``links`` verifies all
   candidates.  In ``components`` two nodes that have one of their ``FIRST``
   smallest keys in common meet under the smallest such key alone.

Hashes decide equality of shingles (64 bits) and sets (64 bits over all tokens
and their number).

Defined results: null and empty texts have no token, size 0 and no link, so
they are their own component; rows without an id get their size and no
component, and link nothing; repeated rows appear once per row; rows that share
an id and not the text are not linked by the id; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm.arrow import CHUNK_BYTES, HASH_BASE, LOWER, batch_of, chunks, mixed, run_hashes, runs, text_bytes
from revlens.llm.simhash import label_components
from revlens.llm.spelling import Bloom
from revlens.session import written

SHINGLE_WORDS = 4
#: Sets link when 100 * intersection >= SHARE * union.
SHARE = 85
#: Counters of each of the sketch's two rows (powers of two), and of a block in which they are sent.
WIDTH, SKETCH_BLOCK = 1 << 20, 1 << 15
#: Counts beyond the mean load that lift a token over level 0: this many, or six standard deviations.
LEAST_EXCESS = 16
#: The first level that is indexed by pairs, and by triples.
PAIR_LEVEL, TRIPLE_LEVEL = 1, 6
#: 64-bit words of the folded parity maps that are compared inside a join.
FOLDED = 4
#: Smallest keys of a node that tell whether a pair is made under another key.
FIRST = 8
#: Rounds of ``components``, and pivots of a key.
STAR_ROUNDS, BEST_ROUNDS, PIVOTS = 3, 1, (2, 16, 16)
#: Nodes of a key, at least, that takes part in each round with pivots: with fewer than 33, all its pairs are no more than those with 16 pivots.
STAR_NODES = (33, 33, 2)
#: Nodes that a task remembers, so as not to send one twice.
SEEN = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True


# --- sets -------------------------------------------------------------------

def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text); a long text is hashed in blocks of ``CHUNK_BYTES``, cut at white space."""
    raw, offsets = text_bytes(column)
    found, row, at, n = [], [], 0, len(raw)
    while at < n:
        end = n
        if n - at > 2 * CHUNK_BYTES:
            gaps = np.flatnonzero(SPACE[raw[at + CHUNK_BYTES: at + 2 * CHUNK_BYTES]])
            if len(gaps):
                end = at + CHUNK_BYTES + int(gaps[0]) + 1
        data = LOWER[raw[at: end]]
        borders = np.concatenate([[at], offsets[(offsets > at) & (offsets < end)], [end]]) - at
        starts, ends, _ = runs(~SPACE[data], borders)
        found.append(run_hashes(data, starts, ends))
        row.append(np.searchsorted(offsets, starts + at, side="right") - 1)
        at = end
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    return np.concatenate(found), np.bincount(np.concatenate(row), minlength=len(column)).astype(np.int64)


def _by_row(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by row, then value."""
    first = np.argsort(value)
    small = row[first].astype(np.uint16 if not len(row) or row[-1] < 1 << 16 else np.int64)
    return first[np.argsort(small, kind="stable")]


class Sets:
    """The shingle sets of some texts: ``row`` and ``token`` sorted by both, ``size`` per text."""

    def __init__(self, column: pa.Array, shingle: int):
        word, count = _word_hashes(column)
        first = np.concatenate([[0], np.cumsum(count)])
        rows, tokens = [], []
        for k in range(1, shingle + 1):
            of = np.flatnonzero(count >= k if k == shingle else count == k)
            n = count[of] - k + 1
            at = np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            h = np.full(len(at), np.uint64(k))
            for j in range(k):
                h = (h + word[at + j]) * HASH_BASE
            rows.append(np.repeat(of, n))
            tokens.append(mixed(h))
        row, token = np.concatenate(rows), np.concatenate(tokens)
        order = np.argsort(row, kind="stable")
        row, token = row[order], token[order]
        order = _by_row(row, token)
        row, token = row[order], token[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        self.row, self.token = row[new], token[new]
        self.size = np.bincount(self.row, minlength=len(column)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def nodes(self) -> np.ndarray:
        """A hash of each set (0 if empty)."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.token + HASH_BASE), dtype=np.uint64)])
        total = sums[self.first[1:]] - sums[self.first[:-1]]
        return np.where(self.size > 0, mixed(total + self.size.astype(np.uint64)), np.uint64(0))

    def maps(self) -> list[np.ndarray]:
        """The parity map of each set, in 64-bit words: a power of two of them, at least ``FOLDED``, with n / 2 bits or more."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(self.size)
        words = np.maximum(FOLDED, 1 << np.ceil(np.log2(np.maximum(self.size, 1) / 128)).clip(0).astype(np.int64))
        for w in np.unique(words):
            texts = np.flatnonzero(words == w)
            for i in range(0, len(texts), max(1, (1 << 20) // int(w))):
                own = self.only(texts[i: i + max(1, (1 << 20) // int(w))])
                at = own.row * (64 * int(w)) + (own.token >> np.uint64(20)).astype(np.int64) % (64 * int(w))
                odd = np.bincount(at, minlength=len(own.size) * 64 * int(w)).reshape(-1, 64 * int(w)) & 1
                for t, m in zip(texts[i:].tolist(), np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8"), strict=False):
                    out[t] = m
        return out

    def only(self, texts: np.ndarray) -> Sets:
        """The sets of some texts (ascending numbers), numbered anew."""
        out = object.__new__(Sets)
        n = self.size[texts]
        at = np.repeat(self.first[texts] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.row, out.token, out.size = np.repeat(np.arange(len(texts)), n), self.token[at], n
        out.first = np.concatenate([[0], np.cumsum(n)])
        return out


# --- token levels -----------------------------------------------------------

def _counters(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(WIDTH - 1)
    return (token & mask).astype(np.int64), ((token >> np.uint64(32)) & mask).astype(np.int64)


def scan(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One pass, written: (id, node, size) per row of ``docs``, and each task's sketch in compressed blocks (block, counts)."""
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])
    shape = "id bigint, node bigint, size bigint, block int, counts binary"
    none = lambda n, kind: pa.nulls(n, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, WIDTH), np.uint32)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part.column("text"), shingle)
                for counts, at in zip(sketch, _counters(sets.token), strict=True):
                    np.add.at(counts, at, np.uint32(1))
                n = part.num_rows
                yield batch_of(schema, id=part.column("id"), node=pa.array(sets.nodes().view(np.int64)), size=sets.size, block=none(n, pa.int32()), counts=none(n, pa.binary()))
        blocks = sketch.reshape(-1, SKETCH_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in some:
            yield batch_of(schema, id=none(1, pa.int64()), node=none(1, pa.int64()), size=none(1, pa.int64()), block=[int(b)], counts=[pack(blocks[b].tobytes())])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, shape), "set-sizes")


def levels(scanned: DataFrame) -> np.ndarray:
    """(sketch row, counter): the level of each counter; sums of ``2 * WIDTH`` counters reach the driver, whatever the input."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(unpack(counts), np.uint32).astype(np.uint64)
        for b, counts in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = scanned.filter("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary")
    sketch = np.zeros((2 * WIDTH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint64)
    for r in parts.collect():
        sketch[r["block"]] = np.frombuffer(r["counts"], np.uint64)
    sketch = sketch.reshape(2, WIDTH)
    load = float(sketch[0].sum()) / WIDTH
    least = max(LEAST_EXCESS, 6 * load ** 0.5)
    return (1 + np.floor(np.log2(np.maximum((sketch - load) / least, 0.5)))).clip(0, 63).astype(np.uint8)


# --- keys -------------------------------------------------------------------

def losses(size: np.ndarray) -> np.ndarray:
    """Tokens that a set may miss of a linked one."""
    return size - (SHARE * size + 99) // 100


def _combined(tokens: np.ndarray, salt: int) -> np.ndarray:
    """A key of each row of tokens."""
    h = np.full(len(tokens), np.uint64(salt))
    for j in range(tokens.shape[1]):
        h = mixed((h + tokens[:, j]) * HASH_BASE)
    return h


def keys(sets: Sets, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): the prefix keys of every set, each once."""
    own = np.frexp(sets.size.astype(float))[1]  # sizes 2^(b-1) .. 2^b - 1 have b
    fewest = (SHARE * sets.size + 99) // 100
    found = [_scheme_keys(sets, level, int(b), np.flatnonzero(reach)) for b in np.unique(np.concatenate([own, own - 1])) if b > 0
             for reach in [(own == b) | ((own - 1 == b) & (fewest < 1 << b))] if reach.any()]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text, key = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def _scheme_keys(sets: Sets, level: np.ndarray, b: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``keys`` of some texts, of 2^(b-1) tokens at least, with the subclasses for sizes from 2^(b-1)."""
    s = sets.only(texts)
    spare = (SHARE * (1 << (b - 1)) + 99) // 100 - 1  # subclasses of k-combinations cost k - 1 tokens each: spend no more
    dealt = {2: spare // 2, 3: spare // 4}
    a, c = _counters(s.token)
    lv = np.minimum(level[0][a], level[1][c])
    order = _by_row(s.row, (lv.astype(np.uint64) << np.uint64(58)) | (s.token >> np.uint64(6)))
    row, token, lv = s.row[order], s.token[order], lv[order]
    k = np.where((lv >= TRIPLE_LEVEL) & (dealt[3] > 0), 3, np.where((lv >= PAIR_LEVEL) & (dealt[2] > 0), 2, 1))

    worth, group, many = np.ones(len(row), np.int64), np.full(len(row), -1), np.flatnonzero(k > 1)
    if len(many):
        parts = np.array([0, 1, max(dealt[2], 1), max(dealt[3], 1)])[k[many]]
        group[many] = (row[many] * 2 + k[many] - 2) * (spare + 1) + (token[many] >> np.uint64(24)).astype(np.int64) % parts
        by = many[np.argsort(group[many], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], group[by][1:] != group[by][:-1]]))
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) + 1
        worth[by] = rank >= k[by]
    before = np.cumsum(worth) - worth
    before -= before[s.first[:-1][row]]
    prefix = before <= losses(s.size)[row]

    alone = prefix & (k == 1)
    texts_out, keys_out = [row[alone]], [mixed(token[alone] + np.uint64(b * int(HASH_BASE) % (1 << 64)))]
    for size in (2, 3):
        members = np.flatnonzero(prefix & (k == size))
        members = members[np.argsort(group[members], kind="stable")]
        if not len(members):
            continue
        _, starts, n = np.unique(group[members], return_index=True, return_counts=True)
        for width in np.unique(n[n >= size]):
            at = members[starts[n == width][:, None] + np.arange(width)]
            for combo in combinations(range(int(width)), size):
                texts_out.append(row[at[:, 0]])
                keys_out.append(_combined(token[at[:, combo]], 64 * size + b))
    return texts[np.concatenate(texts_out)], np.concatenate(keys_out)


# --- postings and candidates ------------------------------------------------

def _passed(docs: DataFrame, shingle: int, id_col: str, text_col: str, shape: str, make) -> DataFrame:
    """``make(sets, nodes)`` for the sets of rows with an id, as rows of ``shape``; a task leaves out nodes that it remembers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(part.column("text"), shingle)
                nodes = sets.nodes()
                if len(seen) > SEEN:
                    seen.clear()
                first = [i for i, (x, n) in enumerate(zip(nodes.tolist(), sets.size.tolist(), strict=True)) if n and not (x in seen or seen.add(x))]
                yield from make(sets.only(np.array(first, np.int64)), nodes[first])

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, shape)


def shared_postings(docs: DataFrame, scanned: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((key, node, size) of keys that sets of near enough sizes share, one key of those with the same sets, (node, map)), both read from written tables."""
    spark = docs.sparkSession
    level = spark.sparkContext.broadcast(levels(scanned))

    def sized_keys(sets: Sets, _nodes) -> Iterator[pa.RecordBatch]:
        text, key = keys(sets, level.value)
        yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "size": pa.array(sets.size[text])})

    counted = _passed(docs, shingle, id_col, text_col, "key bigint, size bigint", sized_keys).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    repeated = written(counted.filter((F.col("n") > 2) | ((F.col("n") == 2) & (100 * F.col("least") >= SHARE * F.col("most")))).select("key"), "repeated-prefix-keys")
    bloom = spark.sparkContext.broadcast(Bloom(repeated, repeated.count()))

    def postings(sets: Sets, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        text, key = keys(sets, level.value)
        some = bloom.value.has(key)
        text, key = text[some], key[some]
        own = np.unique(text)
        if len(own):
            ends = np.append(np.searchsorted(text, own), len(text)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(nodes[own].view(np.int64)), "size": pa.array(sets.size[own]), "map": pa.array(sets.only(own).maps(), pa.list_(pa.int64())),
                "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))})

    rows = _passed(docs, shingle, id_col, text_col, "node bigint, size bigint, map array<bigint>, keys array<bigint>", postings)
    rows = written(rows.dropDuplicates(["node"]), "keyed-sets")
    flat = rows.select(F.explode("keys").alias("key"), "node", "size")
    both = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]  # 128 bits tell sets of nodes apart
    sets = flat.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), *both).filter("low < high")
    shared = sets.groupBy("x1", "x2").agg(F.min("key").alias("key")).select("key")
    return written(flat.join(shared, "key", "left_semi"), "shared-postings"), rows.select("node", "map")


def whole_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, tokens), written: the sets of the nodes in ``pairs`` (a, b).  ``nodes``: a document (rep) of each node.

    A Bloom filter of the documents, of bounded size, decides whose text is
    hashed; what it lets through besides is not asked for by any pair.
    """
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(F.xxhash64("rep").alias("key")), "candidate-documents")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom(wanted, wanted.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = np.flatnonzero(bloom.value.has(batch.column("at").to_numpy().view(np.uint64)))
            for part in chunks(batch.select(["text"]).take(pa.array(asked)), "text"):
                s = Sets(part.column("text"), shingle)
                yield pa.RecordBatch.from_pydict({"node": pa.array(s.nodes().view(np.int64)),
                                                  "tokens": pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(s.token.view(np.int64)))})

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("bigint")).alias("at"))
    return written(rows.mapInArrow(run, "node bigint, tokens array<bigint>").dropDuplicates(["node"]), "whole-sets")


def allowed(n: Column, m: Column) -> Column:
    """Tokens in which linked sets of n and m tokens differ at most; negative if the sizes are too far apart."""
    shared = F.floor(((n + m) * SHARE + (99 + SHARE)) / (100 + SHARE))
    return F.when(100 * F.least(n, m) >= SHARE * F.greatest(n, m), n + m - 2 * shared).otherwise(-1)


def folded(parity: Column, words: Column) -> Column:
    """A parity map of ``words`` 64-bit words from a longer one (powers of two)."""
    at = lambda i: F.transform(F.sequence(i, F.size(parity) - 1, words), lambda j: F.get(parity, j))
    merge = lambda i: F.aggregate(at(i), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(parity) == words, parity).otherwise(F.transform(F.sequence(F.lit(0), words - 1), merge))


def apart(x: Column, y: Column) -> Column:
    """Bits in which two parity maps differ."""
    words = F.least(F.size(x), F.size(y))
    bits = F.zip_with(folded(x, words), folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda p, q: p + q)


def candidates(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b, bits) of the pairs (a, b, most) whose parity maps differ in ``most`` bits at most."""
    x, y = maps.toDF("a", "x"), maps.toDF("b", "y")
    return pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "most", apart(F.col("x"), F.col("y")).alias("bits")).filter("bits <= most").drop("most")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(100 * both >= SHARE * (F.size("x") + F.size("y") - both)).select("a", "b")


def set_nodes(scanned: DataFrame) -> DataFrame:
    """(node, rep), written: the smallest id of each node."""
    return written(scanned.filter("block IS NULL AND id IS NOT NULL AND size > 0").groupBy("node").agg(F.min("id").alias("rep")), "set-nodes")


def links(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b): every two different sets that link, as nodes, a < b.  ``scan`` has the nodes of the documents."""
    scanned = scan(docs, shingle, id_col, text_col)
    p, maps = shared_postings(docs, scanned, shingle, id_col, text_col)
    most = allowed(F.col("l.size"), F.col("r.size"))
    pairs = p.alias("l").join(p.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & (most >= 0))
    pairs = written(candidates(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), most.alias("most")), maps), "candidates")
    return verified(pairs.select("a", "b"), whole_sets(docs, set_nodes(scanned), pairs, shingle, id_col, text_col))


# --- components -------------------------------------------------------------

def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``postings`` (key, node, size) with the component (``label``) of each node, written."""
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    own = labels.select("node", F.col("label").alias("__label"))
    return written(postings.join(own, "node", "left").select("key", "node", "size", F.coalesce("__label", "node").alias("label")), "labelled-postings")


def _best(pairs: DataFrame) -> DataFrame:
    """Of (a, b, bits) the pair with the fewest bits of each a."""
    return pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("v")).select("a", F.col("v.b").alias("b"))


def _held(postings: DataFrame, maps: DataFrame, least: int = 2) -> DataFrame:
    """The postings of keys with several components and ``least`` nodes, with the smallest component (``main``), folded maps and the node's ``FIRST`` smallest keys, written."""
    main = postings.groupBy("key").agg(F.min("label").alias("main"), F.max("label").alias("top"), F.count(F.lit(1)).alias("n"))
    main = written(main.filter((F.col("main") < F.col("top")) & (F.col("n") >= least)).select("key", "main"), "main-components")
    words = maps.select("node", *[folded(F.col("map"), F.lit(FOLDED))[i].alias(f"m{i}") for i in range(FOLDED)])
    of = postings.join(main, "key").groupBy("node").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("key", "main"))).alias("keys"))
    held = of.join(words, "node").withColumn("first", F.slice(F.col("keys.key"), 1, FIRST))
    return written(held.select(F.explode("keys").alias("k"), "node", "size", "label", "first", *words.columns[1:]).select("k.*", "node", "size", "label", "first", *words.columns[1:]), "open-postings")


def _near(left: DataFrame, right: DataFrame, different) -> DataFrame:
    """(a, b, most) of the postings of one key whose components are ``different`` and whose sizes and folded maps allow a link.

    Every key that two nodes of different components share is in the held
    postings; of two nodes with a common one among the ``FIRST`` smallest keys
    of both, the smallest of these is their smallest shared key, and makes the
    pair alone.
    """
    most = allowed(F.col("l.size"), F.col("r.size"))
    bits = [F.bit_count(F.col(f"l.m{i}").bitwiseXOR(F.col(f"r.m{i}"))) for i in range(FOLDED)]
    near = different(F.col("l.label"), F.col("r.label")) & (sum(bits[1:], bits[0]) <= most)
    here = F.coalesce(F.array_min(F.array_intersect("l.first", "r.first")) >= F.col("l.key"), F.lit(True))
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & near & here)
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), most.alias("most"))


def _stars(held: DataFrame, maps: DataFrame, seed: int) -> DataFrame:
    """(a, b), written: nodes outside a key's main component, each with its likeliest pivot of another one; the first nodes of a key by hash are pivots."""
    fields = ["node", "size", "label", "first", *[f"m{i}" for i in range(FOLDED)]]
    at = F.xxhash64("node", F.lit(seed))
    pivots = held.withColumn("at", at).groupBy("key", F.pmod("at", F.lit(PIVOTS[seed])).alias("part")).agg(F.min(F.struct("at", *fields)).alias("v"))
    pivots = written(pivots.select("key", *[f"v.{c}" for c in fields]), "pivots")
    return written(_best(candidates(_near(held.filter("label > main"), pivots, lambda l, r: l != r), maps)), "star-pairs")


def _rest(held: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b, bits), written: all candidates of different components.

    Of each key's postings those of its main component are on one side only, so
    the pairs within that component, however many, are not looked at.
    """
    return written(candidates(_near(held.filter("label > main"), held, lambda l, r: r < l), maps), "candidates")


class _Links:
    """Verified links so far and the components that they make."""

    def __init__(self, spark):
        self.spark, self.edges, self.labels = spark, None, None

    def add(self, pairs: DataFrame, sets: DataFrame) -> None:
        new = written(verified(pairs, sets), "links")
        if not new.isEmpty():
            self.edges = new if self.edges is None else written(self.edges.unionByName(new), "links")
            self.labels = label_components(self.spark, self.edges)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that do not lie in one component."""
        if self.labels is None:
            return pairs
        la, lb = self.labels.toDF("a", "la"), self.labels.toDF("b", "lb")
        return pairs.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")


def components(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links)."""
    scanned = scan(docs, shingle, id_col, text_col)
    nodes = set_nodes(scanned)
    postings, maps = shared_postings(docs, scanned, shingle, id_col, text_col)
    sets_of = lambda pairs: whole_sets(docs, nodes, pairs, shingle, id_col, text_col)

    found = _Links(docs.sparkSession)
    for k in range(STAR_ROUNDS):
        pairs = _stars(_held(_labelled(postings, found.labels), maps, STAR_NODES[k]), maps, k)
        found.add(pairs, sets_of(pairs))
    pairs = _rest(_held(_labelled(postings, found.labels), maps), maps)
    sets = sets_of(pairs)
    for _ in range(BEST_ROUNDS):
        best = written(_best(pairs), "best-pairs")
        found.add(best, sets)
        pairs = written(found.apart(pairs.join(best, ["a", "b"], "left_anti")), "candidates")
    found.add(pairs.select("a", "b"), sets)

    by_node = nodes.select("node", F.col("rep").alias("component_id"))
    if found.labels is not None:
        linked = nodes.join(found.labels, "node")
        least = written(linked.groupBy("label").agg(F.min("rep").alias("least")), "component-ids")  # of known size: a hot label is not dealt out
        by_node = nodes.join(found.labels, "node", "left").join(least, "label", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    rows = scanned.filter("block IS NULL").select("id", "node", "size").join(by_node, "node", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
