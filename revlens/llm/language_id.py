"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte 1-, 2- and 3-grams (letters lower-cased, other
ASCII as one separator).  The kernel of two texts is the presence kernel
|A n B| / sqrt(|A| |B|).  Landmark texts L give the Nystroem map
k(x, L) K_LL^(-1/2); kernel ridge regression on it is solved one versus rest.

The presence kernel is an inner product, so the landmarks, K_LL^(-1/2) and the
ridge weights multiply out to one weight per n-gram bucket and language:
a batch of texts is scored by one matrix product, X W, and a division by
sqrt(|A|).  2-grams and 3-grams are hashed into a fixed number of buckets.

The ridge outputs sum to 2 - K for K languages whatever the text, so the best
of them never falls below a floor and cannot tell a language that was not
learned.  Evidence is judged apart, whatever K: the mean log-odds of the
text's n-grams, as often as the language's learned rows have them against an
even spread over the buckets.  It counts in full from ``FULL_EVIDENCE`` of the
learned rows' median on, and the score is at most that share.

Fitting uses a bounded sample: ``FIT_PER_LANGUAGE`` rows of each language,
those of the smallest hash of the id.  Only their bit sets (fixed size) reach
the driver.  Scoring covers every whole text.

Defined results: a null text, and one without any letter, is ``und`` with score
0; rows without a language are not learned from; repeated rows and null ids are
scored like others; extra columns are kept by ``predict``; without any row to
learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revlens.llm.arrow import batch_of, chunks, text_bytes
from revlens.llm.sampling import per_group

UNKNOWN = "und"
#: Rows per language in the fitting sample, and how many of these are landmarks.
FIT_PER_LANGUAGE = 1000
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-4
#: Texts scored at once; each takes BUCKETS bytes.
ROWS = 256
#: Rows spread out at once while fitting; each takes 4 x BUCKETS bytes.
SPREAD = 256
#: Added to the count of learned rows that have a bucket.
PRIOR = 0.5
#: Share of the learned rows' median log-odds from which on a text's evidence is full.
FULL_EVIDENCE = 0.5

_TWO, _THREE = 13, 14  # bits of the buckets of 2-grams and 3-grams
BUCKETS = 256 + (1 << _TWO) + (1 << _THREE)

#: Bytes as the kernel sees them: letters in lower case, all else in ASCII as a separator.
SEEN = np.full(256, 32, np.uint8)
SEEN[97:123] = SEEN[65:91] = np.arange(97, 123)
SEEN[128:] = np.arange(128, 256)


def presence(column: pa.Array) -> np.ndarray:
    """(text, bucket): 1 where the text has an n-gram of the bucket."""
    raw, offsets = text_bytes(column)
    out = np.zeros((len(column), BUCKETS), np.uint8)
    flat = out.ravel()
    c = SEEN[raw].astype(np.uint32)
    lengths = np.diff(offsets)
    base = np.repeat(np.arange(len(column), dtype=np.int64) * BUCKETS, lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(c))  # bytes to the text's end
    flat[base + c] = 1
    if len(c) > 1:
        two = (c[:-1] << np.uint32(8)) | c[1:]
        ok = left[:-1] >= 2
        at = 256 + ((two * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TWO)).astype(np.int64)
        flat[(base[:-1] + at)[ok]] = 1
    if len(c) > 2:
        three = (two[:-1] << np.uint32(8)) | c[2:]
        ok = left[:-2] >= 3
        at = 256 + (1 << _TWO) + ((three * np.uint32(0x85EBCA77)) >> np.uint32(32 - _THREE)).astype(np.int64)
        flat[(base[:-2] + at)[ok]] = 1
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    plain = pc.match_substring_regex(pc.fill_null(column, ""), "[A-Za-z]").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~plain):
        plain[i] = any(ch.isalpha() for ch in column[int(i)].as_py() or "")
    return plain


@dataclass
class Model:
    """Languages, one weight per bucket and language, one offset per language; the same for the log-odds, and their full value."""

    languages: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    odds: np.ndarray
    odds_offsets: np.ndarray
    full: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(text, language): ridge outputs, about 1 for the language and -1 for the others."""
        x = x.astype(np.float32, copy=False)
        size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.weights) / size + self.offsets

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """(text, language): 0 where the n-grams are no likelier in the language than by chance, 1 from ``full`` on."""
        x = x.astype(np.float32, copy=False)
        mean = (x @ self.odds) / np.maximum(x.sum(axis=1, keepdims=True), 1) + self.odds_offsets
        known = self.full > 0  # too few learned rows tell nothing: no text is refused for it
        return np.where(known, np.clip(mean / np.where(known, self.full, 1), 0, 1), 1)


def train(packed: np.ndarray, y: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Nystroem features on the first ``landmarks`` rows of each language, then one-versus-rest ridge.

    ``packed``: a row of bits per text (``presence``, packed).  Rows are spread
    out ``SPREAD`` at a time, so only the landmarks are held as numbers.
    """
    languages = sorted(set(y))
    label = np.array([languages.index(v) for v in y])
    picked = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(languages))])
    marks = _unit(packed[picked])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-8 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])            # K_LL^(-1/2) up to a rotation
    kernel = np.concatenate([_unit(packed[i: i + SPREAD]) @ marks.T for i in range(0, len(packed), SPREAD)]).astype(np.float64)
    phi = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (1 / np.bincount(label, minlength=len(languages)))[label][:, None]
    penalty = ridge * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(phi.T @ (balance * phi) + penalty, phi.T @ (balance * target))
    return Model(languages, marks.T @ (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32), *_odds(packed, label, len(languages)))


def _odds(packed: np.ndarray, label: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds per bucket and language, their offsets, and the value of full evidence.

    A learned row's own log-odds are taken without that row's counts.
    """
    odds, offsets, full = np.zeros((BUCKETS, languages), np.float32), np.zeros(languages, np.float32), np.zeros(languages, np.float32)
    for k in range(languages):
        rows = np.flatnonzero(label == k)
        spread = lambda i: np.unpackbits(packed[rows[i: i + SPREAD]], axis=1)[:, :BUCKETS]  # noqa: E731, B023
        count = sum(spread(i).sum(axis=0, dtype=np.int64) for i in range(0, len(rows), SPREAD))
        odds[:, k] = np.log(count + PRIOR)
        offsets[k] = -np.log(count.sum() / BUCKETS + PRIOR)
        others = np.log(np.maximum(count - 1, 0) + PRIOR).astype(np.float32)
        own = []
        for i in range(0, len(rows), SPREAD):
            x = spread(i).astype(np.float32)
            size = x.sum(axis=1)
            own.append((x @ others) / np.maximum(size, 1) - np.log((count.sum() - size) / BUCKETS + PRIOR))
        full[k] = FULL_EVIDENCE * np.median(np.concatenate(own))
    return odds, offsets, full


def _unit(packed: np.ndarray) -> np.ndarray:
    """Bit rows as numbers, divided by the root of their number of ones."""
    x = np.unpackbits(packed, axis=1)[:, :BUCKETS].astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(docs: DataFrame, usable: Column, per_language: int = FIT_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from at most ``per_language`` rows of each language among the rows where ``usable`` holds."""
    ids = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    sample = per_group(ids, "lang", per_language)
    texts = docs.filter(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), ["id", "lang"], "left_semi").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.groupBy("id", "lang").agg(F.min("text").alias("text"))  # at most per_language a language; of an id's texts the smallest
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                packed = np.packbits(presence(part.column("text")), axis=1)
                yield batch_of(schema, id=part.column("id"), lang=part.column("lang"), bits=[r.tobytes() for r in packed])

    got = rows.select(F.col("id").cast("bigint").alias("id"), "lang", "text").mapInArrow(run, "id bigint, lang string, bits binary").collect()
    if not got:
        none, empty = np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32)
        return Model([], none, empty, none, empty, empty)
    got = sorted(got, key=lambda r: (r["lang"], r["id"], bytes(r["bits"])))
    order = np.random.default_rng(0).permutation(len(got))
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1)
    return train(packed[order], [got[i]["lang"] for i in order])


def pieces(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` bounded in text and in rows."""
    for part in chunks(batch, text_col):
        for i in range(0, part.num_rows, ROWS):
            yield part.slice(i, ROWS)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, at most the evidence for the language) from the text alone; columns of these names give way to them."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2 x BUCKETS x languages numbers
    fields = [f for f in docs.schema if f.name not in (lang_out, score_out)]
    out_schema = T.StructType([*fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for part in pieces(batch, text_col):
                column = part.column(text_col)
                letters = has_letter(column)
                lang, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if m.languages:
                    x = presence(column).astype(np.float32)
                    s = m.scores(x)
                    best, row = s.argmax(axis=1), np.arange(len(s))
                    top = np.minimum(np.clip((s[row, best] + 1) / 2, 0, 1), m.evidence(x)[row, best])
                    lang[letters] = np.array(m.languages, object)[best[letters]]
                    score[letters] = top[letters]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score.astype(float))], names=[*names, lang_out, score_out])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, out_schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is unknown or scored below ``least``; columns stay as they are."""
    lang, score = "__lang_pred", "__lang_score"
    found = predict(docs, model, text_col, lang, score)
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
