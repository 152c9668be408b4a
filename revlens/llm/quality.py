"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` bytes each, the whole text).  Every
passage becomes counts of character-class pairs and a few word statistics, and
an encoder layer maps these to h.  Gated attention

    a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) )

weights the passages, and the weighted sum of the h_i gives the document's
score.  Encoder, attention and output are learned together from document
labels by Adam on the log loss; no passage is ever labelled.

Fitting uses a bounded sample of labelled rows: ``FIT_PER_LABEL`` of each
label, those of the smallest hash of the id.  Scoring covers every passage of
every text.

Defined results: a null or empty text is one passage of zeros; repeated rows
and null ids are scored like others; a document with two labels is learned from
with each; extra columns are kept by ``score``; without any row to learn from
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revlens.llm.arrow import batch_of, run_hashes, runs, text_bytes
from revlens.llm.language_id import pieces
from revlens.llm.sampling import per_group

#: Bytes of a passage.
PASSAGE = 512
#: Rows per label in the fitting sample.
FIT_PER_LABEL = 2000

HIDDEN, GATE = 24, 16

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".?!", ",;:", "()[]{}\"'`", "-_", "#$%&*@^~+=<>|\\/")
CLASSES = len(_GROUPS) + 3  # and other control bytes, first and further bytes of non-ASCII characters
CLASS_OF = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    CLASS_OF[[ord(c) for c in _g]] = _i
CLASS_OF[128:192] = CLASSES - 1
CLASS_OF[192:] = CLASSES - 2

WORD_FEATURES = 6
FEATURES = CLASSES * CLASSES + WORD_FEATURES


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passage features, first passage of each text with the end)."""
    raw, offsets = text_bytes(column)
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    out = np.zeros((n, FEATURES), np.float32)
    if len(raw):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = first[doc] + (np.arange(len(raw)) - offsets[doc]) // PASSAGE
        cls = CLASS_OF[raw]
        same = at[:-1] == at[1:]
        pairs = np.bincount((at[:-1] * (CLASSES * CLASSES) + cls[:-1] * CLASSES + cls[1:])[same], minlength=n * CLASSES * CLASSES)
        pairs = pairs.reshape(n, -1).astype(np.float32)
        out[:, : CLASSES * CLASSES] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
        out[:, CLASSES * CLASSES:] = _word_features(raw, offsets, at, n)
    return out, first


def _word_features(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Per passage: shares of words equal to the word one, two or three before, share of repeated words, mean length, words a byte."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts, ends, doc = runs(~space, offsets)
    where = at[starts] if len(starts) else np.empty(0, np.int64)
    h = run_hashes(raw, starts, ends)
    total = np.bincount(where, minlength=n).astype(np.float32)
    out = np.zeros((n, WORD_FEATURES), np.float32)
    for lag in (1, 2, 3):
        equal = np.flatnonzero((h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])) + lag
        out[:, lag - 1] = np.bincount(where[equal], minlength=n)
    order = np.lexsort((h, where))
    again = order[1:][(h[order][1:] == h[order][:-1]) & (where[order][1:] == where[order][:-1])] if len(h) > 1 else order[:0]
    out[:, 3] = np.bincount(where[again], minlength=n)
    out[:, 4] = np.bincount(where, weights=(ends - starts), minlength=n) / 12
    out[:, :5] /= np.maximum(total, 1)[:, None]
    out[:, 4] = np.minimum(out[:, 4], 4)
    out[:, 5] = total / PASSAGE * 6
    return out


@dataclass
class Model:
    """Encoder (e, e0), gated attention (v, u, w) and output (c, c0)."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, first[:-1]
        h = np.tanh(x @ p["e"] + p["e0"])
        tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        g = (tv * su) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        a = np.exp(g - np.maximum.reduceat(g, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "tv": tv, "su": su, "a": a, "bag": bag, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f, starts = self.p, self.forward(x, first), first[:-1]
        err = (f["y"] - label) / len(label)
        dz = err[:, None] * p["c"][None, :]
        da = (dz[f["bag"]] * f["h"]).sum(axis=1)
        dg = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        gated = dg[:, None] * p["w"][None, :]
        dtv = gated * f["su"] * (1 - f["tv"] ** 2)
        dsu = gated * f["tv"] * f["su"] * (1 - f["su"])
        dh = f["a"][:, None] * dz[f["bag"]] + dtv @ p["v"].T + dsu @ p["u"].T
        de = dh * (1 - f["h"] ** 2)
        return {"e": x.T @ de, "e0": de.sum(axis=0), "v": f["h"].T @ dtv, "u": f["h"].T @ dsu, "w": (f["tv"] * f["su"]).T @ dg,
                "c": f["z"].T @ err, "c0": np.array(err.sum())}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"]


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def initial(seed: int = 0) -> Model:
    r = np.random.default_rng(seed)
    w = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float64)
    return Model({"e": w(FEATURES, HIDDEN) * 2, "e0": np.zeros(HIDDEN), "v": w(HIDDEN, GATE), "u": w(HIDDEN, GATE), "w": w(GATE), "c": w(HIDDEN), "c0": np.zeros(())})


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 5e-3, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the log loss over bags of passage features."""
    model, r = initial(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i: i + batch]
            x = np.concatenate([bags[j] for j in own]).astype(np.float64)
            first = np.concatenate([[0], np.cumsum([len(bags[j]) for j in own])])
            step += 1
            for k, g in model.gradients(x, first, labels[own]).items():
                g = g + decay * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model({k: v.astype(np.float32) for k, v in model.p.items()})


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = FIT_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Model from at most ``per_label`` labelled documents of each label (0, 1) where ``usable`` holds of the label's row."""
    known = labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = per_group(known, "label", per_label)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most 2 x per_label; of an id's texts the smallest
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("bag", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x, first = passages(part.column("text"))
                bags = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield batch_of(schema, id=part.column("id"), label=part.column("label"), bag=bags)

    got = sorted(rows.mapInArrow(run, "id bigint, label int, bag binary").collect(), key=lambda r: (r["id"], r["label"], bytes(r["bag"])))
    if not got:
        return None
    return train([np.frombuffer(bytes(r["bag"]), np.float16).reshape(-1, FEATURES) for r in got], np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) from the text alone; a column of that name gives way to it."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    fields = [f for f in docs.schema if f.name != score_out]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for part in pieces(batch, text_col):
                y = m.scores(*passages(part.column(text_col))) if m else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(y.astype(float))], names=[*names, score_out])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*fields, T.StructField(score_out, T.DoubleType())]))
