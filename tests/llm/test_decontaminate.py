import hashlib
import random
import re

from revlens.llm import decontaminate, queries
from tests.conftest import SF_MID
from tests.llm.edges import LONG, frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    """[(id, n_words, n_hit, item ids, contaminated)] by looking at every place."""
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(size, len(w)) + 1) if w else ():
            found.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(k) for k in found}
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i:i + n])) in found:
                    hit.update(range(i, i + n))
                    own |= found[t]
        ids = sorted(str(x) for x in own if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, SF_MID, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF_MID, "benchmark").collect()]
    want = sorted(brute(docs, items), key=str)
    assert result(queries.op5_decontaminate(spark, SF_MID)) == want
    assert any(x[-1] for x in want) and any(x[2] and not x[-1] for x in want)


def test_edges_and_short_items(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    data = rows() + [(50 + i, t, "en", "s", 0, "k", "s", "l", "f") for i, t in enumerate([
        base, base.upper() + " tail", "x " * 300 + base, base.replace(" ", ", "), "one two three", "short item", "a short item b",
        " ".join([base] * 3), "the the the the the the the the the the the the the the the"])]
    data.append((50, "clean words under an id seen before", "en", "s", 0, "k", "s", "l", "f"))
    items = [(1, base), (1, base), (2, "short item"), (3, "one"), (None, "alpha beta"), (4, None), (5, ""), (6, "!!!"), (7, "the " * 13), (8, LONG[:400]), (9, "🙂🙃")]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.digest(decontaminate.scan(frame(spark, data), bench))
    assert result(got) == sorted(brute([(r[0], r[1]) for r in data], items), key=str)
    clean = decontaminate.keep_clean(frame(spark, data), bench)
    kept = [r for r in data if r[0] is None or not brute([(r[0], r[1])], items)[0][-1]]
    assert sorted(str((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(str((r[0], r[1])) for r in kept)
    assert len({r[0] for r in data if r[0] == 50 and r in kept}) == 1 and clean.columns == frame(spark, data).columns  # a clean row beside a contaminated one
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(frame(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.scan(frame(spark), none).collect()} == {0}


def test_random_small_vocabulary(spark):
    """Few distinct words, so that windows overlap, repeat and share prefixes."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 6, 13, 15]))) for i in range(12)]
    docs = [(i, text(rng.choice([1, 5, 20, 120])), None, None, None, "k", "s", "l", "f") for i in range(80)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert result(decontaminate.digest(decontaminate.scan(frame(spark, docs), bench))) == sorted(brute([(d[0], d[1]) for d in docs], items), key=str)
