"""A small forgiving HTML reader: one pass over tags to parallel node lists.

Nodes are elements and text runs, in page order; a parent comes before its
children.  A text run is the text between two block borders with its white
space collapsed and character references decoded.  Unclosed paragraphs, list
items, cells and options end where the next one starts; stray end tags are
ignored; the content of scripts, styles and the like is no text, nor is what a
``hidden`` attribute or ``display: none`` hides.
"""

from __future__ import annotations

import html
import re
from collections import Counter

# Names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
SILENT = RAW | frozenset("head title select textarea datalist".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul head title select textarea
    script style noscript template iframe svg math object canvas datalist""".split())
#: A start tag ends these open elements, up to the nearest of the borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set())}
CLOSES_P = BLOCK - frozenset("body html head title td th tr tbody thead tfoot caption option legend summary script style noscript template iframe svg math object canvas select textarea datalist".split())
P_BORDERS = frozenset("article aside body div section main td th li table form header footer nav button object dd figure blockquote fieldset details dialog".split())

# Outside quotes a tag holds no "<", so a stray one costs no scan to the end of the page.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"""(?:^|[\s"/])hidden(?=[\s=/]|$)""", re.IGNORECASE)
STYLE = re.compile(r"""(?<![\w-])style\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|"[^"]*"|'[^']*'""", re.IGNORECASE)
MARK = re.compile(r"""\bdata-keep=([01])""")


def hides(attrs: str) -> bool:
    """Whether an element with these attributes is not shown: ``hidden``, or ``display: none`` in its style."""
    low = attrs.lower()
    if "hidden" in low and HIDDEN.search(QUOTED.sub('""', attrs)):
        return True
    return "none" in low and any("display:none" in "".join(html.unescape(m[1] or "").lower().split()) for m in STYLE.finditer(attrs))


class Page:
    """Parallel lists over nodes: tag ('' for a text run), parent, attributes, text, link characters."""

    def __init__(self, source: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.text: list[str] = [""]
        self.link: list[int] = [0]
        self._stack = [0]
        self._opened: Counter[str] = Counter()  # elements of each name on the stack: no search for what is not there
        self._run: list[str] = []
        self._run_link = 0
        self._links = 0
        self._silent = 0
        self._hidden: set[int] = set()  # open blocks that are not shown
        self._veil = ["", 0]  # an inline element that is not shown, and how many of its name are open within
        self._read(source)

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                # inline elements are not nodes of their own: the run belongs to the nearest block
                self._add("", self._stack[-1], "", text, min(self._run_link, len(text)))
            self._run, self._run_link = [], 0

    def _add(self, tag: str, parent: int, attrs: str, text: str = "", link: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        self.text.append(text)
        self.link.append(link)
        return len(self.tag) - 1

    def _pop_to(self, depth: int) -> None:
        self._flush()
        while len(self._stack) > depth:
            node = self._stack.pop()
            tag = self.tag[node]
            self._opened[tag] -= 1
            self._silent -= tag in SILENT or node in self._hidden
            self._veil = ["", 0]

    def _end(self, names, borders) -> None:
        """Close the innermost open element of ``names`` that no border hides (all of them for cells in a row)."""
        if not any(self._opened[n] for n in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in borders:
                return
            if tag in names:
                self._pop_to(depth)
                if len(names) < 3:
                    return

    def _say(self, raw: str) -> None:
        if not self._silent and not self._veil[1] and raw:
            text = html.unescape(raw) if "&" in raw else raw
            self._run.append(text)
            if self._links:
                self._run_link += len(text.strip())

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if not m:
                self._say(source[at:])
                break
            self._say(source[at: m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if source.startswith("<![CDATA[", m.start()):
                    self._say(m[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
            else:
                attrs = m[3] if m[3] is not None else m[6]
                self._open(name, attrs)
                if name in RAW and not attrs.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
                    at = end.end() if end else size
                    self._close(name)
        self._pop_to(1)

    def _open(self, name: str, attrs: str) -> None:
        if name == "a":
            self._links = 1
        if name not in BLOCK:
            if name == "br" or name in VOID:
                self._run.append(" ") if not self._silent and self._run else None
            elif self._veil[1]:
                self._veil[1] += name == self._veil[0]
            elif not attrs.endswith("/") and hides(attrs):
                self._veil = [name, 1]
            return
        self._flush()
        if name in CLOSES_P:
            self._end({"p"}, P_BORDERS)
        if name in ENDS:
            self._end(*ENDS[name])
        node = self._add(name, self._stack[-1], attrs)
        if name not in VOID:
            self._stack.append(node)
            self._opened[name] += 1
            if name not in ("html", "body") and hides(attrs):  # a script shows these later
                self._hidden.add(node)
            self._silent += name in SILENT or node in self._hidden

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = 0
        if name not in BLOCK:
            self._veil[1] -= bool(self._veil[1]) and name == self._veil[0]
            return
        for depth in range(len(self._stack) - 1, 0, -1) if self._opened[name] else ():
            if self.tag[self._stack[depth]] == name:
                self._pop_to(depth)
                return
        self._flush()
