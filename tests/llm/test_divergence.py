import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from revlens.llm import divergence
from tests.llm.edges import LONG, frame


def brute(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    group, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        group[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        own = {s: {t: c[t] for t in kept} for (x, s), c in group.items() if x == lang}
        own_lang = {t: sum(o[t] for o in own.values()) for t in kept}
        p = lambda c: {t: 1 + 10 ** 9 * (n + 2) // (sum(c.values()) + 2 * v) for t, n in c.items()}
        shares, q = {s: p(c) for s, c in own.items()}, p(own_lang)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, a in shares.items():
            pairs = [(o, sum(f(a[t], b[t]) for t in kept)) for o, b in shares.items() if o != s]
            terms = [(t, f(a[t], q[t])) for t in kept if own[s][t] > 0 and a[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(order, 1) if part == "pair" or r <= top]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n=400, sources=7):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "été", "Straße", "x", "y", "zz", *[f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(90)]]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % sources}"
        lean = hash_of(source)
        words = [vocabulary[min(rng.randrange(len(vocabulary)), (rng.randrange(len(vocabulary)) + lean) % len(vocabulary))] for _ in range(rng.randint(0, 60))]
        lang = ["en", "de", None, ""][i % 4] if i % 5 else "en"
        rows.append((i, None if i % 41 == 0 else rng.choice([" ", ", ", "1"]).join(words), lang, None if i % 29 == 0 else source, 0, "k", "s", "l", "f"))
    return rows


def hash_of(text):
    return sum(map(ord, text)) % 50


def test_equals_every_term_of_every_pair(spark):
    rows = corpus()
    assert result(divergence.audit(frame(spark, rows).repartition(5))) == brute(rows)


def test_blocks_flushes_and_slices_change_nothing(spark, monkeypatch):
    rows = corpus(150)
    want = brute(rows, least=3, top=4)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", (40, 40))
    df = frame(spark, rows)
    assert result(divergence.audit(df, least=3, top=4)) == want
    block = divergence.Block(np.array([5, 9, 7]), np.array([0, 0, 1, 1, 2]), np.array([0, 2, 0, 1, 2]), np.array([50, 60, 70, 80, 90]))
    whole = [block.scatter(g).tolist() for g in range(3)]
    monkeypatch.setattr(divergence, "PAIRS", 1)
    assert [block.scatter(g).tolist() for g in range(3)] == whole


def test_awkward_rows(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s" if i != 7 else None, 0, "k", "s", "l", "f") for i, t in
            [(1, None), (2, ""), (3, LONG), (4, LONG), (None, "one Two"), (None, "one Two"), (7, "éé ÉÉ é1é"), (8, "\x00a\x00b"), (9, "🙂x")] * 6]
    assert result(divergence.audit(frame(spark, rows))) == brute(rows)


def test_no_kept_term_and_no_rows(spark):
    rows = [(i, f"only{'abc'[i]}", "en", f"s{i}", 0, "k", "s", "l", "f") for i in range(3)] + [(9, "lone", "de", "s", 0, "k", "s", "l", "f")]
    got = result(divergence.audit(frame(spark, rows)))
    assert got == brute(rows) and len(got) == 6 and {r[4] for r in got} == {0}
    assert result(divergence.audit(frame(spark, []))) == []


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 9_000_000_000_000, 123_456_789_012_345, 987_654_321
    df = spark.createDataFrame([(n, total, terms)], "n bigint, total bigint, terms bigint")
    got = df.select(divergence.share(*(divergence.F.col(c) for c in df.columns))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 2) // (total + 2 * terms)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_blocks_cut_no_token(monkeypatch, size):
    from revlens.llm.blocks import blocks
    text = "ab cde  fghijklmnop,q\nrs" * 3
    pieces = list(blocks(text, divergence.BREAK, size))
    assert "".join(pieces) == text and [t for x in pieces for t in divergence.TERM.findall(x)] == divergence.TERM.findall(text)
