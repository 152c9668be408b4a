import random
import re
import zlib
from collections import Counter

import numpy as np

from revlens.llm import spelling
from revlens.session import written
from tests.llm.edges import LONG, frame


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def result(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def corpus(n=1200):
    rng = random.Random(5)
    letters = "aeinrstÀéïÿ×÷"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 30)):
            w = bases[min(rng.randrange(25), rng.randrange(25))]
            if rng.random() < 0.12:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind != 1):]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, None if i % 37 == 0 else rng.choice([" ", ", ", "3"]).join(words), "en", "s", 0, "k", "s", "l", "f"))
    chain = " ".join(["abcdefgx"] * 600 + ["abcdefg"] * 50 + ["abcdeég"] * 4)  # a slip moves all of one document's copies of a run
    return [*rows, (n + 1, chain, "en", "s", 0, "k", "s", "l", "f")]


def test_equals_all_pairs_of_words(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(r[1] != "" for r in want) > 20 and any(r[1] not in ("", r[2]) for r in want)  # forms, and chains of them
    assert result(spelling.variants(frame(spark, rows).repartition(5))) == want


def test_small_steps_and_a_full_filter_change_nothing(spark, monkeypatch):
    rows = corpus(200)
    words = written(spark.createDataFrame([(r[0], r[3]) for r in brute(rows)], "word string, n bigint"), "words")
    want = sorted(map(tuple, spelling.near_words(words).collect()))
    assert want == sorted((a, b, n) for a, _ in words.collect() for b, n in words.collect() if one_edit(a, b))
    monkeypatch.setattr(spelling, "FILTER_BITS", 64)
    assert sorted(map(tuple, spelling.near_words(words, symbols=2).collect())) == want


def test_neighbourhood_is_whole_and_each_once(monkeypatch):
    for size in (1 << 20, 3):
        monkeypatch.setattr(spelling, "CELLS", size)
        for word in ([1, 1, 2, 3], [2, 2, 2], [1], [3, 1, 3, 1, 1]):
            around = {tuple(word)}
            for i in range(len(word) + 1):
                around |= {(*word[:i], s, *word[i:]) for s in (1, 2, 3)}
                if i < len(word):
                    around |= {(*word[:i], s, *word[i + 1:]) for s in (1, 2, 3)} | {(*word[:i], *word[i + 1:])}
            want = sorted(int(spelling.own_key(np.array([x], np.uint64).reshape(1, -1))[0]) for x in around)
            got = [int(k) for _, keys in spelling.neighbour_keys(np.array([word], np.uint64), 3) for k in keys]
            assert sorted(got) == want


def test_awkward_rows(spark):
    rows = [(i, t, "en", "s", 0, "k", "s", "l", "f") for i, t in
            [(1, None), (2, ""), (3, LONG), (4, "A" * 3000 + " " + "a" * 2999), (5, "a" * 3000), (6, "a" * 2999), (None, "Strasse STRASSE strassé"), (None, "strassé"),
             (7, "éééééééé ééééééé"), (7, "éééééééé ÉÉÉÉÉÉÉ"), (8, "abcdefg\x00abcdefg abcdefgh🙂abcdefgh"), (9, "sixsix sixsix")] * 3]
    assert result(spelling.variants(frame(spark, rows))) == brute(rows)
    assert result(spelling.variants(frame(spark, []))) == []


def test_a_third_of_all_runs_are_one_word(spark):
    rows = [(i, "commonword " * 30 + f"commonwor{'abcdefghijklm'[i % 13]}", "en", "hot", 0, "k", "s", "l", "f") for i in range(300)]
    assert result(spelling.variants(frame(spark, rows).repartition(6))) == brute(rows)
