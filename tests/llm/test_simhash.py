import random
from collections import defaultdict

import numpy as np
import xxhash

from revlens.llm import queries, simhash
from revlens.session import written
from tests.conftest import SF_MID
from tests.llm.edges import frame, rows


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, tau=2):
    """{id: smallest reachable id} over all pairs of distinct fingerprints."""
    fps = sorted(set(prints.values()))
    a = np.array(fps, np.uint64)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= tau):
            x, y = root(f), root(fps[j])
            parent[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 1 << 62)
    for i, f in prints.items():
        least[root(f)] = min(least[root(f)], i)
    return {i: least[root(f)] for i, f in prints.items()}


def test_whole_table_equals_brute_force(spark):
    docs = queries.table(spark, SF_MID, "documents").collect()
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs}
    want = brute_components(prints)
    got = queries.op2_simhash(spark, SF_MID).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert any(i != c for i, c in want.items())


def test_edge_rows(spark):
    got = simhash.digest(simhash.components(frame(spark))).collect()
    assert len(got) == len(rows())
    prints = {r[0]: brute_print(r[1]) for r in rows() if r[0] is not None}
    want = brute_components(prints)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.components(frame(spark, [])).count() == 0


def test_crowded_fingerprints_equal_brute_force(spark):
    """Tight clusters (many near copies in one partition value) and uniform noise, for several radii."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        weak = rng.sample(range(64), 9)
        for _ in range(150):
            fps.add(base ^ sum(1 << b for b in rng.sample(weak, rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(300)}
    prints = dict(enumerate(sorted(fps)))
    nodes = written(spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in prints.items()], "fp bigint, rep bigint"), "test-nodes")
    a = np.array(list(prints.values()), np.uint64)
    for tau in (0, 1, 2, 3):
        got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(nodes, tau).collect()}
        want = {(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= tau).tolist() if i < j}
        assert got == want


def test_thresholds_obey_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2 ** 64, 500, dtype=np.uint64)
    for tau, m in ((2, 3), (2, 2), (3, 4), (1, 1)):
        groups = simhash.group_bits(0, np.zeros((64, 64)), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        counts = {(i, j): np.bincount(simhash.extract(fps, bits).astype(int), minlength=256).astype(float)
                  for i, g in enumerate(simhash.byte_groups(groups)) for j, bits in enumerate(g)}
        t = simhash.Allocation(500, groups, counts, {}, tau).thresholds(fps)
        assert (t.sum(axis=1) == tau - m + 1).all() and t.min() >= -1


def test_heavy_value_moves_probes_elsewhere():
    groups = simhash.group_bits(0, np.zeros((64, 64)), 3)
    counts = {(i, j): np.full(256, 1e6 / 256) for i, g in enumerate(simhash.byte_groups(groups)) for j, _ in enumerate(g)}
    fps = np.array([0], np.uint64)
    assert simhash.Allocation(10 ** 6, groups, counts, {}, 2).thresholds(fps).tolist() == [[0, 0, 0]]
    moved = simhash.Allocation(10 ** 6, groups, counts, {(0, 0): 500_000, (1, 0): 400_000}, 2).thresholds(fps)[0]
    assert moved[0] == moved[1] == -1 and moved[2] == 2


def test_long_chain_is_one_component(spark):
    n = 300
    edges = written(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a bigint, b bigint"), "test-chain")
    got = {r["node"]: r["label"] for r in simhash.label_components(spark, edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_keep_one_keeps_each_group_once(spark):
    df = frame(spark)
    out = simhash.keep_one(df)
    assert out.schema == df.schema
    prints = {r[0]: brute_print(r[1]) for r in rows() if r[0] is not None}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(set(brute_components(prints).values()))
    assert got.count(None) == 2


def test_unlinked_texts_of_one_id_stay(spark):
    a, b = (" ".join(f"{p}{i * i % 997}" for i in range(80)) for p in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b), (4, None), (4, "other words here")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, None), (4, "other words here")], key=str)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.components(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}
    split = spark.createDataFrame([(2, a), (2, b), (3, a), (5, b), (1, b)], "doc_id bigint, text string")  # id 2 links nothing
    assert {(r["doc_id"], r["component_id"]) for r in simhash.components(split).collect()} == {(2, 2), (2, 1), (3, 2), (5, 1), (1, 1)}


def _crowded(spark, total, members):
    """Random fingerprints and ``members`` that differ in the bits of the third partition alone."""
    rng = np.random.default_rng(members)
    groups = simhash.group_bits(0, np.zeros((64, 64)), 3)
    base, free = rng.integers(0, 2 ** 64, dtype=np.uint64), groups[2]
    values = rng.choice(1 << len(free), members, replace=False)
    kept = base & ~np.uint64(sum(1 << b for b in free))
    crowd = np.array([kept | np.uint64(sum(1 << b for j, b in enumerate(free) if int(v) >> j & 1)) for v in values], np.uint64)
    noise = rng.integers(0, 2 ** 64, total, dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in np.concatenate([noise, crowd]).view(np.int64)], "fp bigint").repartition(5)
    return groups, noise, crowd, nodes


def test_sketch_sees_small_groups_of_a_large_table(spark):
    groups, noise, crowd, nodes = _crowded(spark, 60000, 12)  # 1 of 5,000 fingerprints
    sketch = simhash.value_sketch(nodes, groups)
    assert sketch.shape == (3, 2, simhash.WIDTH) and (sketch.sum(axis=2) == 60012).all()
    for i in (0, 1):
        assert 9 <= simhash.sketched(sketch[i], 60012, simhash.extract(crowd, groups[i])).min() <= 13
        assert (simhash.sketched(sketch[i], 60012, simhash.extract(noise, groups[i])) < 2).mean() > 0.99
    assert simhash.sketched(sketch[2], 60012, simhash.extract(crowd, groups[2])).max() < 4


def test_crowded_value_of_the_sketch_moves_probes_elsewhere(spark):
    groups, noise, crowd, nodes = _crowded(spark, 20000, 400)
    plan = simhash.Allocation(20400, groups, simhash.value_counts(nodes, groups), {}, 2, simhash.value_sketch(nodes, groups))
    assert (plan.thresholds(crowd) == [-1, -1, 2]).all()
    assert (plan.thresholds(noise) == 0).all(axis=1).mean() > 0.99
