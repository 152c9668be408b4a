"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Every block element and text run of a page becomes a node with features:
subtree density (text, links, tags, punctuation), tokens of class, id and role
(its own and its ancestors'), depth, and statistics of its siblings.  Boosted
trees give each node the log odds of holding main text.  Decoding then keeps
the set of nodes with the largest sum of log odds among those in which every
kept node's parent is kept, so a choice never contradicts one above or below
it; one pass up and one down the tree find it.  The kept text runs, joined by
line breaks in page order, are the text.

Pages carry no labels.  The fitting sample is ``FIT_PAGES`` pages (smallest
hash of the id).  Where such a page has an article or main element, its text
blocks are known (in a table without such pages they are guessed from where the
paragraphs are); ``variants`` rebuilds pages from these blocks with the
semantic element kept or replaced by a plain one, and with menus, headers,
footers, sidebars, notices, adverts, forms and comments around and inside it,
so the labels are known and the trees cannot lean on one page layout.

Defined results: null and empty html have empty text; a page without any
kept run has empty text; repeated rows and null ids are extracted like others;
extra columns are ignored; an empty table gives no rows.  Pages are read whole.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm import boost
from revlens.llm.arrow import batch_of, chunks
from revlens.llm.dom import ATTRIBUTE, MARK, SILENT, Page

#: Pages of the fitting sample and rebuilt pages from each.
FIT_PAGES = 200
VARIANTS = 4
#: With fewer pages that have an article or main element, the main element of the others is guessed.
LEAST_KNOWN = 10

# Word stems in class, id and role tokens, by kind of page part.
STEMS = {
    "main": "article content post entry body story main text prose page".split(),
    "menu": "nav menu breadcrumb pager pagination toc tabs skip toolbar".split(),
    "header": "header masthead banner logo branding topbar site-title tagline hero".split(),
    "footer": "footer foot copyright legal colophon contentinfo bottom".split(),
    "side": "side sidebar aside widget related recommend popular trending rail complementary secondary".split(),
    "notice": "cookie notice consent gdpr alert modal popup overlay warning announcement disclaimer privacy paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promoted banner-ad adsense outbrain taboola affiliate".split(),
    "form": "form search login signup subscribe newsletter register input".split(),
    "comment": "comment comments reply replies discussion respond disqus review feedback".split(),
    "share": "share sharing social tags tag byline author meta date credits print follow".split(),
}
KINDS = list(STEMS)
_STEM = {s: i for i, k in enumerate(KINDS) for s in STEMS[k]}
TAG_GROUPS = [{"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "dialog"}, {"article"}, {"main"}, {"section"}, {"ul", "ol", "menu", "li", "dl", "dt", "dd"},
              {"table", "tr", "td", "th", "tbody", "thead"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre", "figcaption"}, {"div"}, {"body", "html"}]
HASHED = 16


def _tokens(attrs: str) -> tuple[int, int]:
    """Bit sets of a node's attribute tokens: kinds of page part, and hashed buckets."""
    kinds = buckets = 0
    if not attrs:
        return 0, 0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("style", "hidden", "aria-hidden"):
            continue
        for word in value.split():
            kinds |= 1 << _STEM[word] if word in _STEM else 0
            for piece in word.replace("_", "-").split("-"):
                if piece:
                    stem = piece if piece in _STEM else piece.rstrip("s0123456789")
                    if stem in _STEM:
                        kinds |= 1 << _STEM[stem]
                    buckets |= 1 << (sum(map(ord, stem)) * 31 % HASHED)
    return kinds, buckets


_BITS = 1 << np.arange(max(len(KINDS), HASHED, len(TAG_GROUPS)))
_GROUP = {t: 1 << i for i, g in enumerate(TAG_GROUPS) for t in g}


def features(page: Page) -> np.ndarray:
    """(node, feature) of a page."""
    n = len(page.tag)
    parent = np.array(page.parent)
    depth, size, links, marks, words, tags, digits = ([0] * n for _ in range(7))
    own_kind, all_kind, own_bucket, group, all_group, order, children = ([0] * n for _ in range(7))
    for i in range(1, n):
        p = page.parent[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        tag = page.tag[i]
        if tag:
            own_kind[i], own_bucket[i] = _tokens(page.attrs[i])
            group[i] = _GROUP.get(tag, 0)
            tags[i] = 1
        else:
            t = page.text[i]
            own_bucket[i], group[i] = own_bucket[p], group[p]
            size[i], links[i], words[i] = len(t), page.link[i], t.count(" ") + 1
            marks[i] = t.count(".") + t.count(",") + t.count(";") + t.count("?") + t.count("!")
            digits[i] = t.count("»") + t.count("©") + t.count("·")
        all_kind[i] = all_kind[p] | own_kind[i]
        all_group[i] = all_group[p] | group[i]
    before, so_far = [0] * n, 0
    for i in range(1, n):
        before[i] = so_far
        so_far += size[i]
    runs = [1 if s else 0 for s in size]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        size[p] += size[i]
        links[p] += links[i]
        marks[p] += marks[i]
        words[p] += words[i]
        tags[p] += tags[i]
        runs[p] += runs[i]
        digits[p] += digits[i]
    a = lambda v: np.array(v, np.float64)
    size, links, marks, words, tags, runs, before, children, order, depth = map(a, (size, links, marks, words, tags, runs, before, children, order, depth))
    total = max(1.0, size[0])
    up = np.maximum(parent, 0)
    siblings = children[up]
    sum_size = np.bincount(up[1:], weights=np.log1p(size[1:]), minlength=n)
    some = np.maximum(size, 1)
    long_word = np.minimum(size / np.maximum(words, 1), 30)
    base = [depth, np.log1p(size), links / some, np.log1p(tags), np.log1p(size / (tags + 1)), size / total, marks / some, long_word, np.log1p(siblings), order / np.maximum(siblings, 1),
            sum_size[up] / np.maximum(siblings, 1), np.log1p(size[up]), size / np.maximum(size[up], 1), links[up] / np.maximum(size[up], 1), before / total, np.log1p(runs), np.log1p(size / np.maximum(runs, 1)),
            np.log1p(a(digits)), a([0.0 if t else 1.0 for t in page.tag]), np.log1p(links)]
    bit = lambda v, k: (np.array(v, np.int64)[:, None] & _BITS[None, :k] != 0).astype(np.float64)
    return np.hstack([np.stack(base, axis=1), bit(own_kind, len(KINDS)), bit(all_kind, len(KINDS)), bit(own_bucket, HASHED), bit(group, len(TAG_GROUPS)), bit(all_group, len(TAG_GROUPS))])


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """Text runs of the best set of nodes in which every kept node's parent is kept.

    best[v] = max(0, odds[v] + sum of best over v's children); the root is kept.
    """
    n = len(page.tag)
    best = [float(o) for o in odds]
    best[0] = 0.0
    for i in range(n - 1, 0, -1):
        if page.tag[i] in SILENT:
            best[i] = 0.0
        if best[i] > 0:
            best[page.parent[i]] += best[i]
        else:
            best[i] = 0.0
    kept = [True] + [False] * (n - 1)
    out = []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
        if kept[i] and not page.tag[i]:
            out.append(i)
    return out


def weigh(page: Page, odds: np.ndarray) -> np.ndarray:
    """Log odds as decoding adds them: bounded, elements at half weight beside the text runs."""
    run = np.array([not t for t in page.tag])
    return np.clip(odds, -6, 6) * np.where(run, 1.0, 0.5)


# --- fitting ----------------------------------------------------------------

_NOT_MAIN = ("nav", "header", "footer", "aside", "form")


def inside_main(page: Page, guess: bool = False) -> list[bool]:
    """Whether each node is in the main element, but not in a menu or the like within it.

    The main element is the first article or main; with ``guess`` and none of
    these it is the element whose own paragraphs have the most text outside
    links, in no menu, header, footer, sidebar or form by tag or attributes.
    """
    n = len(page.tag)
    inside, root = [False] * n, next((i for i, t in enumerate(page.tag) if t in ("article", "main")), n)
    if root == n and guess:
        bad, own = [False] * n, [0] * n
        for i in range(1, n):
            p = page.parent[i]
            bad[i] = bad[p] or page.tag[i] in _NOT_MAIN or page.tag[i] in SILENT or bool(page.attrs[i] and _tokens(page.attrs[i])[0] >> 1)
            if not page.tag[i] and not bad[i]:
                block = page.parent[p] if page.tag[p] in ("p", "h1", "h2", "h3", "blockquote", "pre") else p
                own[max(block, 0)] += len(page.text[i]) - 3 * page.link[i]
        root = max(range(n), key=lambda i: own[i]) if max(own) > 0 else n
    for i in range(root, n):
        inside[i] = (i == root or inside[max(page.parent[i], 0)]) and page.tag[i] not in _NOT_MAIN
    return inside


def blocks_of(source: str, guess: bool = False) -> tuple[list[str], list[str]]:
    """(text runs inside the main element, all other runs)."""
    page = Page(source)
    inside = inside_main(page, guess)
    return [t for t, k in zip(page.text, inside, strict=True) if t and k], [t for t, k in zip(page.text, inside, strict=True) if t and not k]


def variants(main: list[str], other: list[str], rng: random.Random) -> str:
    """A page of known labels (data-keep) from main blocks and other pages' text."""
    esc = html.escape
    pick = lambda lo, hi: [esc(rng.choice(other)) for _ in range(rng.randint(lo, hi))]
    phrase = lambda: " ".join(rng.choice(other).split()[: rng.randint(1, 5)])
    attr = lambda kind: rng.choice(['class="{}"', 'id="{}"', 'class="x-{} box"', 'class="{}-wrap"', 'class="block {}"']).format(rng.choice(STEMS[kind]))
    links = lambda lo, hi: "".join(f'<li><a href="/{i}">{esc(phrase())}</a></li>' for i in range(rng.randint(lo, hi)))

    def wrap(kind: str, tag: str, inner: str) -> str:
        plain = rng.random() < 0.25 and tag not in ("div", "section", "p", "span")
        return f"<{tag} data-keep=0{'' if plain else ' ' + attr(kind)}>{inner}</{tag}>"

    def paragraphs(texts: list[str]) -> str:
        return "".join(f"<p>{t}</p>" if rng.random() < 0.8 else f"<div>{t}</div>" for t in texts)

    parts = {
        "menu": lambda: wrap("menu", rng.choice(["nav", "div", "ul"]), f"<ul>{links(2, 9)}</ul>"),
        "header": lambda: wrap("header", rng.choice(["header", "div"]), f"<div>{esc(phrase())}</div>" + (f"<p>{esc(phrase())}</p>" if rng.random() < 0.6 else f"<h1>{esc(phrase())}</h1>")),
        "footer": lambda: wrap("footer", rng.choice(["footer", "div"]), rng.choice([f"&copy; 2024 {esc(phrase())} &middot; {pick(1, 1)[0]}", paragraphs(pick(1, 2)), f"<ul>{links(1, 5)}</ul>&copy; {esc(phrase())}"])),
        "side": lambda: wrap("side", rng.choice(["aside", "div", "section"]), rng.choice([f"<h3>{esc(phrase())}</h3><ul>{links(2, 6)}</ul>", paragraphs(pick(1, 3)), f"<h2>{esc(phrase())}</h2>" + paragraphs(pick(1, 2))])),
        "notice": lambda: wrap("notice", rng.choice(["div", "section", "aside", "dialog"]), rng.choice([paragraphs(pick(1, 1)) + "<button>OK</button>", pick(1, 1)[0], f"<p>We use cookies. {pick(1, 1)[0]}</p>"])),
        "advert": lambda: wrap("advert", rng.choice(["div", "aside", "section"]), rng.choice([pick(1, 1)[0], paragraphs(pick(1, 2)), f'<a href="/x">{pick(1, 1)[0]}</a>'])),
        "form": lambda: wrap("form", rng.choice(["form", "div"]), f"<label>{esc(phrase())}</label><input name=a><p>{pick(1, 1)[0]}</p><button>{esc(phrase())}</button>"),
        "comment": lambda: wrap("comment", rng.choice(["div", "section", "ol", "ul"]), f"<h3>{rng.randint(1, 90)} {esc(phrase())}</h3>" + "".join(f"<{t} {attr('comment')}><b>{esc(phrase())}</b><p>{x}</p></{t}>" for x in pick(1, 4) for t in [rng.choice(["div", "li", "article"])])),
        "share": lambda: wrap("share", rng.choice(["div", "p", "ul"]), rng.choice([links(1, 4), f"<span>{esc(phrase())}</span>"])),
    }
    some = lambda kinds, p: "".join(parts[k]() for k in rng.sample(kinds, len(kinds)) if rng.random() < p)
    body = []
    if rng.random() < 0.5:  # a headline of a few words
        body.append(f"<h1>{esc(' '.join(main[-1].split()[: rng.randint(2, 8)]))}</h1>")
    for j, text in enumerate(main):
        t = esc(text)
        tag = "h1" if j == 0 and len(main) > 1 and len(text) < 120 else rng.choices(["p", "div", "blockquote", "li", "h2"], [12, 1, 0.7, 0.7, 0.7 if len(text) < 100 else 0])[0]
        inner = rng.choice([t, t, t, f"<b>{t}</b>", f"<span>{t}</span>"])
        body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
        if rng.random() < 0.5 / len(main):
            body.append(parts[rng.choice(["advert", "share", "side", "form", "notice"])]())
    tail = some(["share", "comment", "form", "side"], 0.25)
    open_tag = rng.choice(["article", "article", "main", f"div {attr('main')}", f"section {attr('main')}", "div"])
    container = f"<{open_tag} data-keep=1>{''.join(body)}{tail}</{open_tag.split()[0]}>"
    for _ in range(rng.randint(0, 2)):
        container = f"<div{rng.choice(['', ' ' + attr('main'), ' class=row', ' id=wrapper'])}>{container}{some(['side', 'advert', 'comment'], 0.2)}</div>"
    return f"<html><head><title>{esc(phrase())}</title></head><body>{some(['header', 'menu', 'notice', 'advert'], 0.55)}{container}{some(['comment', 'side', 'advert', 'form', 'menu', 'notice'], 0.35)}{some(['footer', 'notice'], 0.6)}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    """1 for nodes that hold main text, from the marks of ``variants``."""
    keep = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        m = MARK.search(page.attrs[i]) if page.attrs[i] else None
        keep[i] = m[1] == "1" if m else keep[page.parent[i]]
    return holds_text(page, keep)


def holds_text(page: Page, main: list[bool]) -> np.ndarray:
    """1 for main text runs and every node above one."""
    out = [int(k and not page.tag[i]) for i, k in enumerate(main)]
    for i in range(len(out) - 1, 0, -1):
        out[page.parent[i]] |= out[i]
    return np.array(out, float)


#: Blocks for a fitting sample without any article: the trees then know generated pages only.
_FALLBACK = [f"Paragraph {i} has some words, and a second clause; it ends here. " * (1 + i % 4) for i in range(12)]


def fit(pages: DataFrame, n_pages: int = FIT_PAGES, per_page: int = VARIANTS, id_col: str = "page_id", html_col: str = "html") -> boost.Boosted:
    """Boosted trees from at most ``n_pages`` pages of the table."""
    ids = pages.filter(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(n_pages).distinct()
    picked = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "id", "left_semi")  # at most n_pages ids
    taken = sorted((r["id"], r["html"] or "") for r in picked.groupBy("id").agg(F.min("html").alias("html")).collect())
    return train([h for _, h in taken], per_page)


def train(sources: list[str], per_page: int = VARIANTS) -> boost.Boosted:
    rng = random.Random(0)
    found = [blocks_of(s) for s in sources]
    guess = sum(bool(m) for m, _ in found) < LEAST_KNOWN
    if guess:
        found = [blocks_of(s, guess) for s in sources]
    other = [t for _, o in found for t in o] + [t for m, _ in found for t in m] or _FALLBACK
    known = [(s, m) for s, (m, _) in zip(sources, found, strict=True) if m] or [("", _FALLBACK[:k]) for k in range(1, 12)]
    x, y, w = [], [], []

    def learn(page: Page, label: np.ndarray, weight: float) -> None:
        if len(page.tag) > 1:
            share = np.maximum(1, np.bincount(label[1:].astype(int), minlength=2))
            x.append(features(page)[1:])
            y.append(label[1:])
            w.append(weight * (len(label) / share)[label[1:].astype(int)] / 2)

    for source, main in known:
        own = Page(source)
        learn(own, holds_text(own, inside_main(own, guess)), float(per_page))
        for _ in range(per_page):
            page = Page(variants(main, other, rng))
            learn(page, labels_of(page), 1.0)
    return boost.fit(np.concatenate(x), np.concatenate(y), np.concatenate(w))


# --- extraction -------------------------------------------------------------

def texts(sources: list[str | None], model: boost.Boosted) -> list[str]:
    """Main text of each page."""
    pages = [Page(s or "") for s in sources]
    sizes = [len(p.tag) for p in pages]
    odds = model.margin(np.concatenate([features(p) for p in pages])) if pages else np.empty(0)
    out, at = [], 0
    for page, n in zip(pages, sizes, strict=True):
        out.append("\n".join(page.text[i] for i in decode(page, weigh(page, odds[at: at + n]))))
        at += n
    return out


def extract(pages: DataFrame, model: boost.Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``."""
    known = pages.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 1 << 20):
                got = texts(part.column("html").to_pylist(), known.value)
                yield batch_of(schema, id=part.column("id"), url=part.column("url"), text=got, n_chars=[len(t) for t in got])

    picked = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "id bigint, url string, text string, n_chars bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
