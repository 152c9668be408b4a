import random
import re

import numpy as np
import pytest

from revlens.llm import boost, html_extract as hx, queries
from revlens.llm.dom import Page
from tests.conftest import SF_MID

HTML = [
    (1, "u1", "<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Products</a></ul></nav>"
              "<header class='site-header'><div>Site name</div></header><article><h1>The headline of it all</h1><p>First   paragraph &amp; more,\n with words; enough of them to read.<p>Second <b>bold</b> paragraph,"
              " which has a fair number of words. It goes on.</article><aside class=sidebar><h3>Related</h3><ul><li><a href=/x>One link</a></ul></aside><div class='comments'><div class=comment><b>Joe</b><p>Nice text, thanks.</p></div></div>"
              "<footer>&copy; 2024 Site &middot; All rights</footer></body></html>"),
    (2, "u2", None), (3, None, ""), (4, "u4", "<<<>>> <div"), (5, "u5", "<p>" * 3000 + "deep" + "<div>" * 3000), (None, "u6", "plain words only, no tags at all. They are the page."),
    (7, "u7", "<html><body><article><p>" + "long text goes on, word after word. " * 20_000 + "</p></article></body></html>"), (1, "u1", "<article><p>Again the same id, with other text in it.</p></article>"),
]


@pytest.fixture(scope="module")
def model(spark):
    return hx.fit(queries.table(spark, SF_MID, "pages"))


def article_text(source):
    """What the generated pages mark as article, by splitting at its paragraphs."""
    import html
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_pages_outside_the_fitting_sample(spark, model):
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").filter("page_id >= 500").limit(600).collect()
    got = hx.texts([p["html"] for p in pages], model)
    exact = sum(g == article_text(p["html"]) for g, p in zip(got, pages, strict=True))
    assert exact >= 0.99 * len(pages)


def test_query_has_every_page(spark):
    got = queries.op3_html_extract(spark, SF_MID).collect()
    source = {r["page_id"]: (r["url"], r["html"]) for r in queries.table(spark, SF_MID, "pages").collect()}
    assert len(got) == len(source)
    exact = sum(r["text"] == article_text(source[r["page_id"]][1]) for r in got)
    assert exact >= 0.98 * len(got)
    assert all(r["url"] == source[r["page_id"]][0] and r["n_chars"] == len(r["text"]) for r in got)


def test_rebuilt_layouts_without_semantic_elements(spark, model):
    rng = random.Random(123)
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").filter("page_id between 300 and 420").collect()
    found = [hx.blocks_of(p["html"]) for p in pages]
    other = [t for m, o in found for t in o + m]
    hit = extra = missed = 0
    for main, _ in found:
        page = Page(hx.variants(main, other, rng))
        label = hx.labels_of(page)
        want = {i for i, t in enumerate(page.tag) if not t and label[i]}
        got = set(hx.decode(page, hx.weigh(page, model.margin(hx.features(page)))))
        hit, extra, missed = hit + len(want & got), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_tables_without_any_semantic_element(spark):
    pages = [p["html"] for p in queries.table(spark, SF_MID, "pages").orderBy("page_id").collect()]
    for plain in ("div", 'div class="content"'):
        other = [p.replace("<article>", f"<{plain}>").replace("</article>", "</div>") for p in pages]
        got = hx.texts(other, hx.train(other[:120]))
        assert sum(g == article_text(p) for g, p in zip(got, pages, strict=True)) >= 0.95 * len(pages)


def test_edges(spark, model):
    df = spark.createDataFrame([(i, u, h, "extra") for i, u, h in HTML], "page_id bigint, url string, html string, text string")
    got = {(r["page_id"], r["url"], r["n_chars"]): r["text"] for r in hx.extract(df, model).collect()}
    assert len(got) == len(HTML) and all(k[2] == len(t) for k, t in got.items())
    by = {k[:2]: t for k, t in got.items() if k[0] not in (1,)}
    assert by[2, "u2"] == by[3, None] == ""
    assert by[7, "u7"] == " ".join(("long text goes on, word after word. " * 20_000).split())
    main = next(t for k, t in got.items() if k[0] == 1 and "headline" in t)
    assert main.split("\n") == ["The headline of it all", "First paragraph & more, with words; enough of them to read.", "Second bold paragraph, which has a fair number of words. It goes on."]
    assert hx.extract(df.filter("page_id < 0"), model).count() == 0
    assert hx.extract(df, hx.fit(df.filter("page_id < 0"))).count() == len(HTML)  # nothing to fit on


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(4)
    for _ in range(200):
        page = Page("".join(rng.choice(["<div>", "</div>", "<p>", "x ", "<section>", "</section>"]) for _ in range(9)))
        n = len(page.tag)
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        best = max(sum(odds[i] for i in range(1, n) if m >> i & 1) for m in range(1, 1 << n, 2)
                   if all(not m >> i & 1 or m >> page.parent[i] & 1 for i in range(1, n)))
        got = hx.decode(page, odds)
        # the kept runs' total cannot be read off alone; rebuild the kept set from the decoder's rule
        value = odds.copy()
        value[0] = 0
        for i in range(n - 1, 0, -1):
            value[page.parent[i]] += max(0, value[i])
        assert abs(value[0] - best) < 1e-9
        for i in got:
            while i:
                assert value[i] > 0
                i = page.parent[i]


def test_malformed_pages_take_linear_time():
    import time
    for page in ['<p class="' * 40_000, "<a " * 100_000, "<" * 300_000, "<!" * 200_000, "<!--" * 50_000, "<div>" * 30_000, "<b '" * 50_001, "<script>" * 20_000,
                 "<div>" * 30_000 + "</section><li></li>" * 30_000, "<ul>" + "<div>" * 30_000 + "<li>x</li>" * 30_000]:
        t = time.time()
        Page(page)
        assert time.time() - t < 5, page[:10]


def test_reader():
    p = Page("a<p>b<br>c<p>d<ul><li>e<li>f &lt;g&gt;</ul><!-- <p>no -->h<script>if (a<b) '</p>'</script><x-y>i</x-y> j")
    assert [t for t in p.text if t] == ["a", "b c", "d", "e", "f <g>", "h", "i j"]
    assert [t for t in Page('<div title="a > b">x</div><a title=\'<p>\'>y</a>').text if t] == ["x", "y"]
    assert [t for t in Page("<table><tr><td>1<td>2<tr><td>3</table>").text if t] == ["1", "2", "3"]


def test_boosting_fits_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = boost.fit(x[:1500], y[:1500], np.ones(1500))
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_hidden_text_is_no_text():
    from revlens.llm.dom import Page, hides

    shown = lambda source: [t for t in Page(source).text if t]
    for attrs in (" hidden", ' hidden=""', " class=x hidden id=y", ' style="display:none"', " style='color: red; DISPLAY :\n none'", " style=display:none", ' id="a"hidden', " hidden/"):
        assert hides(attrs), attrs
        if not attrs.endswith("/"):
            assert shown(f"<p>a</p><div{attrs}><p>b</p>c</div><p>d</p>") == ["a", "d"], attrs
            assert shown(f"<p>a <span{attrs}>b <span>c</span> d</span> e</p>") == ["a e"], attrs
    for attrs in ("", ' class="hidden"', ' aria-hidden="true"', " data-hidden", ' title="display:none"', ' style="display:block"', ' data-x="style=display:none"'):
        assert not hides(attrs), attrs
        assert shown(f"<div{attrs}>b</div>") == ["b"], attrs
    assert shown("<body style='display:none'><p>a</p></body>") == ["a"]  # shown by a script
    assert shown("<p>a<b hidden>b<p>c</p>d") == ["a", "c", "d"]  # ends with its block
    assert shown("<div hidden><div>a</div>b</div></div>c") == ["c"]
    assert shown("<ul><li hidden>a<li>b</ul>") == ["b"]
