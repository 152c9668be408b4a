"""Secret scans: patterns plus sliding-window entropy over candidate strings.

Three patterns find the base spans.  The entropy method then adds spans: in
every run of token characters a window of fixed width slides one character at
a time; the Shannon entropy of the window's characters is kept by incremental
counts (one character leaves, one enters).  A window counts under the class of
its characters (hexadecimal, alphanumeric, base64) when its entropy reaches
that class's threshold and it holds a character that the allow list does not
explain; overlapping windows join into one span.  Of a span the base spans are
cut out; what is left of it stays where it is itself as random as a window.

Defined results: a null text is empty and has no span; rows are independent,
so repeated rows and null ids give one output row each; extra columns are kept
by ``redact`` and ignored by ``scan``.  Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm.arrow import batch_of, chunks

# Fixed values of the result contract: patterns, least lengths, kind order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # AKIA and its whole run, 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
#: Least characters of what is left of an entropy span beside base spans.
REST_LEAST = 8


@dataclass(frozen=True)
class EntropyRule:
    """Parameters of the entropy method."""

    window: int = 20
    #: Least bits a character in a window, by class.
    hex_bits: float = 3.0
    alnum_bits: float = 3.6
    base64_bits: float = 3.8
    #: What is no secret: stretches of a run between marks or its ends.
    allow: tuple[str, ...] = field(default=(
        r"(?i:(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/=]+)",      # integrity digests
        r"(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})",       # UUID
        r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",               # the published example key
        r"(?i:[a-z0-9]{0,60}?(?:example|dummy|placeholder|xxxx)[a-z0-9]{0,60}+)",
        r"[0-9]{1,8}+[a-z]*+",                                     # numbers, 2nd, 10gb
        r"(?:[A-Z]?[a-z]++)?+[0-9]{0,8}+",                         # a word and its number, as in part1, Page12
        # CamelCase2Names3: a word begins with a capital; three changes between words and numbers at most
        r"[a-z]*+(?:[A-Z][a-z]{2,}+)*+(?:[0-9]{1,8}+(?:[A-Z][a-z]{2,}+)++)?+(?:[0-9]{1,8}+|[A-Z])?+",
    ))


def base_spans(text: str, whole: bool = False) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches; an assignment's span is its value, or with ``whole`` the match."""
    found, group = [], 0 if whole else 2
    if ":" in text or "=" in text:
        found += [(m.start(group), 0, m.end(group)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


_HEX, _DIGIT, _UPPER, _LOWER, _MARK = 1, 2, 4, 8, 16


def _char_class(c: str) -> int:
    if c.isdigit():
        return _HEX | _DIGIT
    if c.isalpha():
        return (_HEX if c in "abcdefABCDEF" else 0) | (_UPPER if c.isupper() else _LOWER)
    return _MARK


_CLASS = {chr(i): _char_class(chr(i)) for i in range(33, 127)}


def entropy_windows(s: str, rule: EntropyRule, explained: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """Joined high-entropy windows of one candidate, as (start, end) in it.

    With ``explained`` (ordered, disjoint) only windows with a letter or digit outside of it.

    The sum of c*log2(c) over the window's character counts is updated for the
    character that leaves and the one that enters; so are the counts per class.
    """
    w = rule.window
    if len(s) < w:
        return
    clog = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]  # w + 1: the entering character comes first
    counts: dict[str, int] = {}
    hexes = digits = uppers = lowers = marks = 0
    total = 0.0
    start = end = -1
    last = len(s) if explained is None else -1  # the last unexplained letter or digit so far
    at = 0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += clog[n + 1] - clog[n]
        k = _CLASS[c]
        hexes += k & 1
        digits += (k >> 1) & 1
        uppers += (k >> 2) & 1
        lowers += (k >> 3) & 1
        marks += (k >> 4) & 1
        if explained is not None and k != _MARK:
            while at < len(explained) and explained[at][1] <= i:
                at += 1
            if at == len(explained) or i < explained[at][0]:
                last = i
        if i >= w:
            o = s[i - w]
            n = counts[o]
            counts[o] = n - 1
            total += clog[n - 1] - clog[n]
            k = _CLASS[o]
            hexes -= k & 1
            digits -= (k >> 1) & 1
            uppers -= (k >> 2) & 1
            lowers -= (k >> 3) & 1
            marks -= (k >> 4) & 1
        if i >= w - 1 and last > i - w:
            bits = math.log2(w) - total / w
            if hexes == w:
                hot = bits >= rule.hex_bits and digits and digits < w
            elif not marks:
                hot = bits >= rule.alnum_bits and digits and (uppers or lowers)
            else:
                hot = bits >= rule.base64_bits and digits and uppers and lowers
            if hot:
                a = i - w + 1
                if start >= 0 and a <= end:
                    end = i + 1
                else:
                    if start >= 0:
                        yield start, end
                    start, end = a, i + 1
    if start >= 0:
        yield start, end


class Scanner:
    """Base and entropy spans of texts, with compiled parameters."""

    def __init__(self, rule: EntropyRule, whole: bool = False):
        self.rule, self.whole = rule, whole
        self.candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % rule.window)
        self.allow = re.compile(r"(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join(f"(?:{a})" for a in rule.allow)) if rule.allow else None
        self.digit = re.compile(r"[0-9]")

    def explained(self, s: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.allow.finditer(s) if m.end() > m.start()] if self.allow else []

    def entropy_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        out = []
        for m in self.candidate.finditer(text):
            s = m.group()
            if not self.digit.search(s):
                continue
            explained = self.explained(s)
            for a, b in entropy_windows(s, self.rule, explained):
                a, b = a + m.start(), b + m.start()
                touched = [(x, y) for x, _, y in base if x < b and a < y]
                if touched:
                    out += self.rest(text, a, b, touched, [(x + m.start(), y + m.start()) for x, y in explained])
                else:
                    out.append((a, b))
        return out

    def rest(self, text: str, a: int, b: int, base: list[tuple[int, int]], explained: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """What is left of text[a:b] without the ordered spans ``base``: pieces that are as random as a window themselves."""
        at = a
        for x, y in [*base, (b, b)]:
            piece = text[at:x]
            start = at + len(piece) - len(piece.lstrip("+/_=-"))
            end = at + len(piece.rstrip("+/_=-"))
            at = max(at, y)
            if end - start < REST_LEAST:
                continue
            own = [(max(p, start) - start, min(q, end) - start) for p, q in explained if p < end and start < q]
            w = min(self.rule.window, end - start)
            scale = math.log2(w) / math.log2(self.rule.window)  # a shorter piece can reach less
            rule = replace(self.rule, window=w, hex_bits=self.rule.hex_bits * scale, alnum_bits=self.rule.alnum_bits * scale, base64_bits=self.rule.base64_bits * scale)
            if any(True for _ in entropy_windows(text[start:end], rule, own)):
                yield start, end

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        base = base_spans(text or "", self.whole)
        return base, self.entropy_spans(text or "", base)


_SPAN = "struct<kind:string,start:bigint,end:bigint>"


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule(), id_col: str = "doc_id", text_col: str = "text",
         whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, start, end).

    Positions are code points, the end exclusive; spans are ordered by start,
    then kind (assign, access, hex, entropy).  With ``whole`` an assignment's
    span is the whole match, name and sign included, not its value alone.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rule, whole)
        names = (*KINDS, "entropy")
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for t in part.column("text").to_pylist():
                    base, more = scanner.spans(t)
                    rows.append([{"kind": names[k], "start": a, "end": b} for a, k, b in sorted(base + [(a, 3, b) for a, b in more])])
                yield batch_of(schema, id=part.column("id"), spans=rows)

    return picked.select(F.col("id").cast("bigint"), "text").mapInArrow(run, f"id bigint, spans array<{_SPAN}>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rule: EntropyRule = EntropyRule(), text_col: str = "text", mark: str = "[REDACTED]",
           length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; all columns stay.

    ``length_col``, where ``docs`` has it, becomes the new number of code
    points of the rows that changed.  A null text stays null.
    """
    out_schema = docs.schema
    has_length = length_col in docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rule)
        for batch in batches:
            for part in chunks(batch, text_col):
                texts, lengths = part.column(text_col).to_pylist(), part.column(length_col).to_pylist() if has_length else None
                for i, t in enumerate(texts):
                    if not t:
                        continue
                    base, more = scanner.spans(t)
                    if not base and not more:
                        continue
                    out, at = [], 0
                    for a, b in sorted([(a, b) for a, _, b in base] + more):
                        if b <= at:
                            continue
                        if a >= at:
                            out += [t[at:a], mark]
                        at = b
                    texts[i] = "".join([*out, t[at:]])
                    if has_length:
                        lengths[i] = len(texts[i])
                new = {text_col: texts} | ({length_col: lengths} if has_length else {})
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else c for f, c in zip(part.schema, part.columns, strict=True)], schema=part.schema)

    return docs.mapInArrow(run, out_schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``scan``'s rows."""
    line = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    base_line = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", base_line), 256).alias("base_sha256"), F.concat_ws(",", line).alias("spans"),
        count("entropy").alias("n_entropy"))


def text_digest(text: str | None, rule: EntropyRule = EntropyRule()) -> tuple[str, str]:
    """(base_sha256, spans) of one text, for small checks."""
    base, more = Scanner(rule).spans(text)
    names = (*KINDS, "entropy")
    line = lambda xs: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(xs))
    return hashlib.sha256(line(base).encode()).hexdigest(), line(base + [(a, 3, b) for a, b in more])
