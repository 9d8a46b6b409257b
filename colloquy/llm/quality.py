"""Quality classification by naive-Bayes-scaled support vectors.

Features are the distinct n-grams of a text: one to three word *shapes* (runs of
letters of one case shortened to one, and whether the word repeats the one before)
and one to two lower-cased words, hashed.  Each indicator is scaled by the log
ratio of its smoothed shares in the two classes; a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent, and its margins are
turned into probabilities by a logistic fit on held-out thirds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.frames import long_of
from colloquy.llm.tokens import BLANK_SEPARATED, LOWER, slices, window_hashes, word_hashes, words

# Labelled documents the model is fitted on; the smallest hashes of the id are taken.
TRAIN_DOCS = 6_000
BITS = 18
SHAPE_GRAMS, WORD_GRAMS = 3, 2
SMOOTHING = 1.0
COST = 1.0
PASSES = 30
THRESHOLD = 0.3
_SIZE = 1 << BITS

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[0x80:] = ord("a")
_RUN = np.isin(np.arange(256), [ord("A"), ord("a"), ord("0")])


def _grams(hashes: np.ndarray, doc: np.ndarray, longest: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """``(document, feature)`` of all n-grams; features of a kind share a range."""
    docs, features = [], []
    for n in range(1, longest + 1):
        if len(hashes) < n:
            break
        whole = window_hashes(hashes, n)
        good = doc[: len(whole)] == doc[n - 1 :]
        docs.append(doc[: len(whole)][good])
        features.append((whole[good] >> np.uint64(64 - BITS)).astype(np.int64) + kind * _SIZE)
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(docs), np.concatenate(features)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, feature)`` pairs, distinct, sorted; shapes are below 2**BITS, words above."""
    folded = words(buf, offs, BLANK_SEPARATED, LOWER)
    spelled = word_hashes(folded)
    doc = folded.doc()
    kind = _CLASS[buf]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = ~(_RUN[kind[1:]] & (kind[1:] == kind[:-1]))
    inner = offs[(offs > 0) & (offs < len(buf))]
    keep[inner] = True
    moved = np.concatenate([[0], np.cumsum(keep)])[offs]
    shaped = word_hashes(words(kind[keep], moved, BLANK_SEPARATED))
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (spelled[1:] == spelled[:-1]) & (doc[1:] == doc[:-1])
    shaped = shaped + same.astype(np.uint64)
    a, b = _grams(shaped, doc, SHAPE_GRAMS, 0), _grams(spelled, doc, WORD_GRAMS, 1)
    both = np.unique(np.concatenate([a[0], b[0]]) << (BITS + 1) | np.concatenate([a[1], b[1]]))
    return both >> (BITS + 1), both & ((1 << (BITS + 1)) - 1)


@dataclass
class Model:
    """Weight per feature, ready scaled, and the logistic fit of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, doc: np.ndarray, feature: np.ndarray, docs: int) -> np.ndarray:
        out = np.full(docs, self.bias)
        for part in (feature < _SIZE, feature >= _SIZE):
            n = np.bincount(doc[part], minlength=docs)
            total = np.bincount(doc[part], weights=self.weights[feature[part]], minlength=docs)
            out += total / np.sqrt(np.maximum(n, 1))
        return out

    def scores(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def _scaled(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Log-count ratio of every feature."""
    ones, zeros = np.full(2 * _SIZE, SMOOTHING), np.full(2 * _SIZE, SMOOTHING)
    for row, y in zip(rows, label):
        (ones if y else zeros)[row] += 1
    return np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())


def _descend(rows: list[np.ndarray], values: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; the bias is one more feature."""
    w, bias = np.zeros(2 * _SIZE), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(label, 1.0, -1.0)
    norm = np.array([float(v @ v) for v in values]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), COST)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _train(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, float]:
    ratio = _scaled(rows, label)
    values = []
    for row in rows:
        shape = row < _SIZE
        n = np.where(shape, max(1, int(shape.sum())), max(1, int((~shape).sum())))
        values.append((ratio[row] / np.sqrt(n)).astype(np.float32))
    w, bias = _descend(rows, values, label)
    return w * ratio, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's fit by Newton steps on smoothed targets."""
    up, down = int(label.sum()), int((~label).sum())
    target = np.where(label, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -60, 60)))
        q = np.maximum(p * (1 - p), 1e-12)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


def fit(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """Model of the labelled feature rows; without both classes the score is their share of ones."""
    label = label.astype(bool)
    if not len(label) or label.all() or not label.any():
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(2 * _SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.zeros(len(rows))
    fold = np.arange(len(rows)) % 3
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if label[inside].all() or not label[inside].any():
            continue
        w, bias = _train([rows[i] for i in inside], label[inside])
        part = Model(w, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            held[i] = part.margins(np.zeros(len(rows[i]), dtype=np.int64), rows[i], 1)[0]
    w, bias = _train(rows, label)
    return Model(w, bias, *_logistic(held, label))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs`` for which ``train`` (over ``id``) holds.

    Labels of repeated ids must agree, or the id is left out; null ids and labels
    are left out too.
    """
    known = labels.select(long_of(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(train)
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_top")).filter("label = _top").select("id", "label")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in slices(batch.column(2)):
                doc, feature = features(buf, offs)
                cut = np.searchsorted(doc, np.arange(high - low + 1))
                packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(packed, type=pa.binary())], names=["id", "label", "features"])

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["features"], r["label"]) for batch in batches for r in batch.to_pylist())
        model = fit([np.frombuffer(f, dtype=np.int32) for _, f, _ in rows], np.array([y > 0 for _, _, y in rows], dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], type=pa.binary())], names=["model"])

    # The sample is bounded, so one task fits it; the driver gets the weights only.
    marked = picked.mapInArrow(run, "id bigint, label int, features binary")
    return pickle.loads(marked.repartition(1).mapInArrow(train_one, "model binary").first()["model"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 if at least ``THRESHOLD``).

    A null, empty or blank text has no features and gets the score of the bias.
    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            margin = [own.margins(*features(buf, offs), high - low) for low, high, buf, offs in slices(batch.column(at))]
            value = own.scores(np.concatenate(margin)) if margin else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))
