"""Exact top-k of fused *full* rank lists without ranking everything.

A node outside the first ``R = lists * (60 + k)`` places of every list scores less
than ``k`` nodes of any one list, so only the heads can win.  Their exact places in
the other lists are found by counting, inside the tasks, how many nodes score
better.  No pair of question and node is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.config import RRF_K
from colloquy.operators.local_topk import ARROW, SCORE_BLOCK, LocalTopK
from colloquy.operators.ranking import SCORE_DIGITS, by_score, top_k


class DotScorer:
    """Dot products with question vectors."""

    positive = False

    def __init__(self, names: list, block: np.ndarray):
        self.names, self.block = [(n,) for n in names], block

    def scores(self, column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(np.float64) @ self.block.T


@dataclass(frozen=True)
class RankList:
    """One list: ``source(node_id, payload, grp)`` and the group each question may see.

    ``owner`` maps a question to its group; without it every row is eligible.
    ``scorer`` holds ``names``, ``positive`` and ``scores``.
    """

    name: str
    source: DataFrame
    scorer: Any
    owner: dict | None = None


def _blocks(batches: Iterator[pa.RecordBatch], scorer, owner: dict | None):
    """(ids, scores, allowed) per block; rows a question may not see are masked."""
    step = max(1, SCORE_BLOCK // max(len(scorer.names), 1))
    if owner is not None:
        # Owners as numbers: one lookup per row instead of a comparison per pair.
        held = [owner.get(n[0]) for n in scorer.names]
        code = {g: i for i, g in enumerate(dict.fromkeys(held))}
        groups = np.array([code[g] for g in held])
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            scores = scorer.scores(pa.concat_arrays([part.column(1)]))
            allowed = np.ones(scores.shape, dtype=bool)
            if owner is not None:
                allowed = np.array([code.get(v, -1) for v in part.column(2).to_pylist()])[:, None] == groups[None, :]
            if scorer.positive:
                allowed &= scores > 0
            yield part.column(0).to_numpy(zero_copy_only=False), scores, allowed


def _head(lst: RankList, k: int, qtype: str, ntype: str) -> DataFrame:
    shipped = lst.source.sparkSession.sparkContext.broadcast((lst.scorer, lst.owner))

    def task(batches):
        scorer, owner = shipped.value
        best = LocalTopK(scorer.names, [qtype], ntype, k)
        for ids, scores, allowed in _blocks(batches, scorer, owner):
            best.offer(scores, ids, allowed=allowed)
        out = best.batch(["query_id"])
        if out is not None:
            yield out

    found = lst.source.mapInArrow(task, f"query_id {qtype}, node_id {ntype}, score double")
    return top_k(found, ["query_id"], by_score("score", "node_id"), k)


def _scores_of(lst: RankList, wanted: dict, qtype: str, ntype: str) -> DataFrame:
    """Scores of the wanted nodes as this list sees them."""
    shipped = lst.source.sparkSession.sparkContext.broadcast((lst.scorer, lst.owner, wanted))

    def task(batches):
        scorer, owner, wanted = shipped.value
        askers: dict = {}
        for j, name in enumerate(scorer.names):
            for node in wanted.get(name[0], ()):
                askers.setdefault(node, []).append(j)
        for ids, scores, allowed in _blocks(batches, scorer, owner):
            hits = [(i, j) for i, node in enumerate(ids.tolist()) for j in askers.get(node, ()) if allowed[i, j]]
            if hits:
                rows, cols = np.array(hits).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array([scorer.names[j][0] for j in cols], ARROW[qtype]), pa.array(ids[rows].tolist(), ARROW[ntype]), pa.array(scores[rows, cols])], names=["query_id", "node_id", "score"]
                )

    return lst.source.mapInArrow(task, f"query_id {qtype}, node_id {ntype}, score double")


def _better(lst: RankList, marks: dict, qtype: str, ntype: str) -> DataFrame:
    """How many eligible nodes stand before each marked (score, node)."""
    shipped = lst.source.sparkSession.sparkContext.broadcast((lst.scorer, lst.owner, marks))

    def task(batches):
        scorer, owner, marks = shipped.value
        tally = {n[0]: np.zeros(len(marks[n[0]][0]), dtype=np.int64) for n in scorer.names if n[0] in marks}
        for ids, scores, allowed in _blocks(batches, scorer, owner):
            rounded = np.round(scores, SCORE_DIGITS)
            for j, name in enumerate(scorer.names):
                if name[0] not in tally:
                    continue
                at, nodes = marks[name[0]]
                mine, own = rounded[allowed[:, j], j], ids[allowed[:, j]]
                ordered = np.sort(mine)
                right = np.searchsorted(ordered, at, "right")
                tally[name[0]] += len(mine) - right
                for c in np.flatnonzero(right > np.searchsorted(ordered, at, "left")):
                    tally[name[0]][c] += int(np.sum(own[mine == at[c]] < nodes[c]))
        for q, counts in tally.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(counts), ARROW[qtype]), pa.array(list(marks[q][1]), ARROW[ntype]), pa.array(counts)], names=["query_id", "node_id", "before"]
            )

    return lst.source.mapInArrow(task, f"query_id {qtype}, node_id {ntype}, before bigint").groupBy("query_id", "node_id").agg(F.sum("before").alias("before"))


def fused_topk(lists: list[RankList], k: int) -> DataFrame:
    """``(query_id, node_id, score, rank)`` by unit-weight fusion over full lists; ties by id.

    What the driver holds is ``lists * R`` ids per question, whatever the corpus.
    """
    first = lists[0].source
    types = dict(first.dtypes)
    ntype = types["node_id"]
    qtype = "string" if lists[0].scorer.names and isinstance(lists[0].scorer.names[0][0], str) else "bigint"
    depth = len(lists) * (RRF_K + k)
    heads = None
    for lst in lists:
        h = _head(lst, depth, qtype, ntype).select("query_id", "node_id", F.lit(lst.name).alias("channel"), "rank")
        heads = h if heads is None else heads.unionByName(h)
    known = heads.toPandas()
    wanted = {q: set(g) for q, g in known.groupby("query_id")["node_id"]}
    votes = heads
    for lst in lists:
        have = known[known["channel"] == lst.name]
        listed = {q: set(g) for q, g in have.groupby("query_id")["node_id"]}
        missing = {q: ids - listed.get(q, set()) for q, ids in wanted.items()}
        # A list shorter than the depth is complete: what it lacks has no place in it.
        missing = {q: ids for q, ids in missing.items() if ids and len(listed.get(q, ())) >= depth}
        if not missing:
            continue
        seen = _scores_of(lst, missing, qtype, ntype).toPandas()
        marks = {q: (np.round(g["score"].to_numpy(), SCORE_DIGITS), g["node_id"].to_numpy()) for q, g in seen.groupby("query_id")}
        if marks:
            placed = _better(lst, marks, qtype, ntype)
            votes = votes.unionByName(placed.select("query_id", "node_id", F.lit(lst.name).alias("channel"), (F.col("before") + 1).cast("int").alias("rank")))
    terms = F.array_sort(F.collect_list(F.struct("channel", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("w"))))
    fused = votes.groupBy("query_id", "node_id").agg(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"]).alias("score"))
    return top_k(fused, ["query_id"], by_score("score", "node_id"), k)
