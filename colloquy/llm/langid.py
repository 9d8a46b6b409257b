"""Language identification by rank-order profiles.

A language's profile lists its most frequent letter n-grams (one to three letters,
with ``_`` at word borders) in order.  A document's own list is compared with each
profile: every n-gram adds how far it is out of place, or the most there is
when the profile lacks it.  The nearest profile wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.tokens import slices

GRAMS = 3
PROFILE = 300
# Steepness of the confidence in the difference of mean distances.
STEEPNESS = 25.0
BORDER = 0x5F


@cache
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters or marks."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded UTF-8, and where each document begins in it."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first = buf[lead].astype(np.int64)
    padded = np.concatenate([buf, np.zeros(3, dtype=np.uint8)])
    more = [(padded[lead + k] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    points = np.where(first < 0x80, first, (first & 0x1F) << 6 | more[0])
    points = np.where(first >= 0xE0, (first & 0x0F) << 12 | more[0] << 6 | more[1], points)
    points = np.where(first >= 0xF0, (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2], points)
    return points, np.searchsorted(lead, offs)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, n-gram, count)`` of a run of lower-cased texts, sorted by document and n-gram."""
    points, first = code_points(buf, offs)
    letter = np.zeros(len(points), dtype=bool)
    basic = points < 0x10000
    letter[basic] = _letters()[points[basic]]
    letter[~basic] = [unicodedata.category(chr(c))[0] in "LM" for c in points[~basic]]
    docs = len(offs) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    # Every word is followed by a border; a border also opens each document.
    starts = np.zeros(len(points), dtype=bool)
    starts[first[:-1][first[:-1] < len(points)]] = True
    kept = letter.copy()
    kept[1:] |= letter[:-1] & ~starts[1:]
    symbols = np.where(letter, points, BORDER)[kept]
    owner = doc[kept]
    lengths = np.bincount(owner, minlength=docs)
    where = np.cumsum(lengths + 2) - (lengths + 2)
    stream = np.full(int((lengths + 2).sum()), BORDER, dtype=np.int64)
    stream[np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(where + 1, lengths)] = symbols
    owner = np.repeat(np.arange(docs), lengths + 2)
    parts = []
    code = stream.copy()
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = code[:-1] << 21 | stream[n - 1 :]
        same = owner[: len(code)] == owner[n - 1 :]
        real = (code != BORDER) & (code != (BORDER << 21 | BORDER)) & ((code & ((1 << 42) - 1)) != (BORDER << 21 | BORDER) if n == 3 else True)
        if n == 3:
            real &= (code >> 21) != (BORDER << 21 | BORDER)
        keep = same & real
        parts.append((owner[: len(code)][keep], code[keep]))
    owner, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sizes = np.bincount(owner, minlength=docs)
    # Documents keep their order inside each length; a stable sort puts their n-grams together.
    code = code[np.argsort(owner, kind="stable")]
    ends = np.cumsum(sizes)
    for low, high in zip(ends - sizes, ends):
        code[low:high].sort()
    owner = np.repeat(np.arange(docs), sizes)
    head = np.ones(len(code), dtype=bool)
    head[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(head)
    return owner[at], code[at], np.diff(np.concatenate([at, [len(code)]]))


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def profiles(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text") -> dict[str, list[int]]:
    """The most frequent n-grams of each language over all its training rows, most frequent first, ties to the smaller code."""
    known = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for low, high, buf, offs in slices(_lowered(batch.column(1))):
                own = names[low:high]
                owner, code, n = grams(buf, offs)
                for name in sorted(set(own)):
                    mine = (own == name)[owner]
                    distinct, inverse = np.unique(code[mine], return_inverse=True)
                    sums = np.bincount(inverse, weights=n[mine], minlength=len(distinct)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(distinct), type=pa.string()), pa.array(distinct, type=pa.int64()), pa.array(sums)], names=["lang", "gram", "n"])

    sums = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for row in best.select("lang", "rank", "gram").orderBy("lang", "rank").collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Matcher:
    """Ranks of every profile's n-grams in one table."""

    def __init__(self, known: dict[str, list[int]]):
        self.langs = sorted(known)
        self.vocabulary = np.unique(np.array([g for grams_ in known.values() for g in grams_], dtype=np.int64))
        self.rank = np.full((len(self.vocabulary) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, name in enumerate(self.langs):
            self.rank[np.searchsorted(self.vocabulary, np.array(known[name], dtype=np.int64)), j] = np.arange(len(known[name]))

    def distances(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Mean distance, 0 to 1, of one document's n-grams from each language."""
        order = np.sort(-(n.astype(np.int64) << 32) + np.arange(len(n)))[:PROFILE]
        top = code[order & 0xFFFFFFFF]
        spot = np.searchsorted(self.vocabulary, top)
        spot[spot == len(self.vocabulary)] = 0
        found = self.rank[np.where(self.vocabulary[spot] == top, spot, len(self.vocabulary))]
        away = np.abs(found - np.arange(len(top))[:, None])
        return np.where(found < 0, PROFILE, np.minimum(away, PROFILE)).mean(axis=0) / PROFILE


def identify(docs: DataFrame, known: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and ``id, lang_pred, score, distance`` per row.

    ``score`` is the nearest profile's share when distances are turned into
    weights; ``distance`` is its mean distance.  Null texts and texts without a
    letter are ``und`` with score 1, and so is every text, with score 0, if no
    language is known.  Equal distances go to the smaller name.
    """
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(known) if known else None)
    columns = [*[F.col(c) for c in carry], F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    chosen = docs.select(*columns)
    width = len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value
        for batch in batches:
            rows = batch.num_rows
            lang, score, distance = ["und"] * rows, np.ones(rows), np.ones(rows)
            for low, high, buf, offs in slices(_lowered(batch.column(width))):
                owner, code, n = grams(buf, offs)
                bounds = np.searchsorted(owner, np.arange(high - low + 1))
                for d in np.flatnonzero(np.diff(bounds)):
                    if match is None:
                        score[low + d] = 0.0
                        continue
                    a, b = bounds[d], bounds[d + 1]
                    far = match.distances(code[a:b], n[a:b])
                    best = int(np.argmin(far))
                    lang[low + d] = match.langs[best]
                    distance[low + d] = far[best]
                    score[low + d] = 1.0 / np.exp(-STEEPNESS * (far - far[best])).sum()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(width)], pa.array(lang, type=pa.string()), pa.array(score), pa.array(distance)], names=[*[f"c{k}" for k in range(len(carry))], "id", "lang_pred", "score", "distance"])

    kinds = ", ".join([*[f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry)], f"id {docs.schema[id_col].dataType.simpleString()}", "lang_pred string, score double, distance double"])
    found = chosen.mapInArrow(run, kinds)
    return found.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})
