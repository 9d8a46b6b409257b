"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are integers, so scores are exact.  An inner product becomes a distance by
one more coordinate, which gives every vector the same length L:
``|q|^2 + L^2 - 2 q.x = d(q, x)^2``.  Vectors and queries are cut into blocks by
hash; a task takes one pair of blocks, indexes both in cover trees and walks
the trees together.  A pair of nodes is dropped if the distance of the centres less
both covering radii shows that no pair below can reach the worst k-th score among
the node's queries.  Each pair of blocks yields at most k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.frames import long_of, stored

K = 10
# Score of no vector; its negative is an integer too.
EMPTY = -(1 << 62)
SCALE = 1024
# Vectors and queries of a block, points of a leaf, and vectors that give first bounds.
BLOCK, QUERY_BLOCK, LEAF, SEED = 4096, 512, 32, 2048


@dataclass
class Node:
    """Rows ``low:high`` of the tree's order lie within ``radius`` of ``center``."""

    center: np.ndarray
    radius: float
    low: int
    high: int
    children: list["Node"]


class CoverTree:
    """Levels of covering balls, each half as wide as its parent's; leaves hold a few points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.leaf = leaf
        self.root = self._build(0, len(points), None) if len(points) else None

    def _build(self, low: int, high: int, scale: float | None) -> Node:
        rows = self.order[low:high]
        center = self.points[rows[0]]
        away = np.sqrt(np.maximum(((self.points[rows] - center) ** 2).sum(axis=1), 0.0))
        radius = float(away.max())
        node = Node(center, radius, low, high, [])
        if high - low <= self.leaf or radius == 0.0:
            return node
        # The cover: points in turn become centres of balls of the next scale.
        step = (radius if scale is None else min(scale, radius)) / 2
        rest, cut, groups = rows, away, []
        while len(rest):
            near = cut <= step
            groups.append(rest[near])
            rest = rest[~near]
            if len(rest):
                cut = np.sqrt(np.maximum(((self.points[rest] - self.points[rest[0]]) ** 2).sum(axis=1), 0.0))
            if len(groups) > 64 and len(rest):
                # Points this far apart have no structure to use; they stay together.
                groups.append(rest)
                break
        if len(groups) == 1:
            return self._build(low, high, step)
        self.order[low:high] = np.concatenate(groups)
        at = low
        for g in groups:
            end = at + len(g)
            node.children.append(self._leaf(at, end) if len(g) == len(rest) and g is rest else self._build(at, end, step))
            at = end
        return node

    def _leaf(self, low: int, high: int) -> Node:
        rows = self.points[self.order[low:high]]
        center = rows.mean(axis=0)
        return Node(center, float(np.sqrt(((rows - center) ** 2).sum(axis=1)).max()), low, high, [])


class Best:
    """The k best of every query so far: score falling, then id rising."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), EMPTY)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor

    def worst(self) -> np.ndarray:
        return np.maximum(self.score[:, -1].astype(np.float64), self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores[i, j]`` is that of query ``rows[i]`` and vector ``ids[j]``."""
        k = self.score.shape[1]
        all_scores = np.concatenate([self.score[rows], scores], axis=1)
        all_ids = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        if all_scores.shape[1] > 4 * k:
            # Everything at least as good as the k-th stays, ties included.
            kth = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
            width = int((all_scores >= kth[:, None]).sum(axis=1).max())
            at = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, at, 1), np.take_along_axis(all_ids, at, 1)
        at = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(all_scores, at, 1)
        self.id[rows] = np.take_along_axis(all_ids, at, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, length2: float, floor: np.ndarray) -> Best:
    """Dual-tree search of one block pair; a vector is never its own query's answer."""
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(length2 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)
    # A query keeps its own length: its added coordinate is zero.
    q_tree = CoverTree(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1))
    v_tree = CoverTree(lift(vectors))
    best = Best(len(queries), k, floor)
    norm2 = (queries * queries).sum(axis=1)

    def limit(q: Node, v: Node) -> float:
        """No inner product below the two nodes is larger."""
        gap = max(0.0, float(np.sqrt(((q.center - v.center) ** 2).sum())) - q.radius - v.radius)
        longest = float(norm2[q_tree.order[q.low : q.high]].max())
        return (longest + length2 - gap * gap) / 2 * (1 + 1e-9) + 1e-6

    def walk(q: Node, v: Node) -> None:
        rows = q_tree.order[q.low : q.high]
        if limit(q, v) < best.worst()[rows].min():
            return
        if not v.children and not q.children:
            some = v_tree.order[v.low : v.high]
            exact = queries[rows] @ vectors[some].T
            scores = np.rint(exact).astype(np.int64)
            own = query_ids[rows][:, None] == ids[some][None, :]
            scores[own] = EMPTY
            best.add(rows, scores, ids[some])
            return
        if v.children and (not q.children or v.radius >= q.radius):
            for child in sorted(v.children, key=lambda c: -limit(q, c)):
                walk(q, child)
        else:
            for child in q.children:
                walk(child, v)

    if q_tree.root and v_tree.root:
        walk(q_tree.root, v_tree.root)
    return best


def integers(vector: Column | str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, or null if the vector or a component is unusable."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of every query.

    Queries are the rows that satisfy ``is_query``; candidates are all rows with
    another id.  Ties go to the smaller id, and fewer candidates give fewer rows.
    Null ids and unusable vectors take no part; vectors of different length are
    compared over zeros.  Rows with equal ids are one candidate each and one query
    together, so exact repeats give repeated answers once.
    """
    usable = table.select(long_of(id_col).alias("id"), integers(vector_col).alias("v"), is_query.alias("asks")).filter("id is not null and v is not null")
    usable = stored(usable.dropDuplicates(["id", "v"]), "vectors")
    facts = usable.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x))).first()
    rows, asked, width, length2 = int(facts[0] or 0), int(facts[1] or 0), int(facts[2] or 0), float(facts[3] or 0)
    n, m = max(1, math.ceil(rows / block)), max(1, math.ceil(asked / query_block))
    asks = usable.filter("asks").select("id", "v")
    floors = _floors(usable, asks, k, width, m)
    queries = asks.join(floors, ["id", "v"], "left").select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(m)).alias("qb"), "id", "v", "floor")
    left = queries.withColumns({"vb": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "asks": F.lit(True)}).select("qb", "vb", "asks", "id", "v", "floor")
    right = usable.withColumns({"vb": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n)).cast("int"), "qb": F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))}).select("qb", "vb", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("floor"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, v = group[group["asks"]], group[~group["asks"]]
        if not len(q) or not len(v):
            return _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = search(_dense(q["v"], width), q["id"].to_numpy(), _dense(v["v"], width), v["id"].to_numpy(), k, length2, q["floor"].fillna(-np.inf).to_numpy())
        got = best.score > EMPTY
        return _rows(np.repeat(q["id"].to_numpy(), got.sum(axis=1)), best.id[got], best.score[got])

    found = left.unionByName(right).groupBy("qb", "vb").applyInPandas(run, "query_id bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})


def _dense(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _floors(usable: DataFrame, asks: DataFrame, k: int, width: int, m: int) -> DataFrame:
    """``id, v, floor``: the k-th best score among a few vectors, which the k-th best of all cannot be below.

    The few are the ``SEED`` vectors with the smallest hashes, a bounded broadcast.
    """
    seeds = usable.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SEED).toPandas()
    shared = usable.sparkSession.sparkContext.broadcast((seeds["id"].to_numpy(np.int64), _dense(seeds["v"], width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            q = _dense(pd.Series(batch.column(1).to_pylist()), width)
            scores = q @ vectors.T
            scores[np.asarray(batch.column(0))[:, None] == ids[None, :]] = -np.inf
            floor = np.full(len(q), -np.inf)
            if len(ids) > k:
                floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor)], names=["id", "v", "floor"])

    return asks.mapInArrow(run, "id bigint, v array<bigint>, floor double")
