"""BM25 as a scan with in-task top-k, or as joins over an inverted index.

In the index a sentinel term with one posting per document carries document
count and mean length through the same shuffle, so the postings, their
statistics and the scores share one exchange.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from colloquy.functions.text import tokens
from colloquy.operators.local_topk import SCORE_BLOCK, LocalTopK, row_runs
from colloquy.operators.ranking import by_score, top_k
from colloquy.session import cut_lineage

# Fixed values.
K1 = 1.5
B = 0.75
SENTINEL = ""
# Question terms that travel to the tasks at once (tens of megabytes); more questions take more passes.
SCAN_TERMS = 1_000_000
# Tokens and (question, term) hits a task unrolls at once.
TOKEN_BLOCK = 1 << 18
HIT_BLOCK = 1 << 20


def question_terms(queries: DataFrame, text: str = "text", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Distinct terms per question."""
    return queries.select(*keys, F.explode(F.array_distinct(tokens(text))).alias("term"))


def postings(corpus: DataFrame, node: str, text: str, scope: tuple[str, ...] = (), vocabulary: DataFrame | None = None) -> DataFrame:
    """``(scope, node, dl, term, tf)`` with the sentinel posting per document.

    With a vocabulary, other terms are dropped before the shuffle.  Counting is
    combined inside the task that holds the document, so only distinct pairs move.
    """
    words = corpus.select(*scope, F.col(node).alias("node_id"), tokens(text).alias("_t"))
    flat = words.select(
        *scope,
        "node_id",
        F.size("_t").alias("dl"),
        F.explode(F.concat("_t", F.array(F.lit(SENTINEL)))).alias("term"),
    )
    if vocabulary is not None:
        wanted = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(SENTINEL))).distinct()
        flat = flat.join(wanted, "term", "left_semi")
    return flat.groupBy(*scope, "node_id", "dl", "term").agg(F.count("*").alias("tf"))


def group_postings(corpus: DataFrame, group: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings of a collection layer: every group is one document.

    Equal to indexing the concatenated member texts, but the texts are never
    joined up, so a group may hold any share of the corpus.
    """
    words = corpus.select(F.col(group).alias("node_id"), tokens(text).alias("_t"))
    flat = words.select("node_id", F.size("_t").alias("_n"), F.explode(F.concat("_t", F.array(F.lit(SENTINEL)))).alias("term"))
    if vocabulary is not None:
        wanted = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(SENTINEL))).distinct()
        flat = flat.join(wanted, "term", "left_semi")
    counts = flat.groupBy("node_id", "term").agg(F.count("*").alias("tf"), F.sum("_n").alias("_len"))
    lengths = counts.select("node_id", F.when(F.col("term") == SENTINEL, F.col("_len")).alias("dl")).filter("dl IS NOT NULL")
    tf = F.when(F.col("term") == SENTINEL, F.lit(1)).otherwise(F.col("tf")).cast("bigint")
    return counts.join(lengths, "node_id").select("node_id", "dl", "term", tf.alias("tf"))


def term_stats(index: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``(scope, term, df, n_docs, avgdl, idf)``; the sentinel row stays in.

    Both aggregates read ``tf``, so they share the exchange of the index.
    """
    sentinel = F.col("term") == SENTINEL
    per_term = index.groupBy(*scope, "term").agg(F.sum((F.col("tf") > 0).cast("int")).alias("df"))
    n, mean = F.sum(F.when(sentinel, F.col("tf"))), F.avg(F.when(sentinel, F.col("dl")))
    if scope:
        totals = index.groupBy(*scope).agg(n.alias("n_docs"), mean.alias("avgdl"))
        stats = per_term.join(totals, list(scope))
    else:
        totals = index.agg(F.struct(n.alias("n_docs"), mean.alias("avgdl"))).scalar()
        stats = per_term.withColumn("_t", totals).select("term", "df", "_t.n_docs", "_t.avgdl")
    return stats.withColumn("idf", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def document_stats(corpus: DataFrame, node: str, text: str) -> DataFrame:
    """``term_stats`` of all terms of ``postings(corpus, node, text)``, without shuffling the postings.

    Rows of one node and length are one document; their distinct tokens meet once,
    and terms are counted inside the tasks.
    """
    words = corpus.select(F.col(node).alias("node_id"), tokens(text).alias("_t")).filter("_t IS NOT NULL")
    one = words.groupBy("node_id", F.size("_t").alias("dl")).agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct("_t")))).alias("_t"), F.count("*").alias("_n"))
    both = F.concat("_t", F.array(F.lit(SENTINEL)))
    flat = one.select("dl", "_n", F.explode(both).alias("term"))
    sentinel = F.col("term") == SENTINEL
    counts = cut_lineage(flat.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(sentinel, F.col("_n"))).alias("n_docs"), F.avg(F.when(sentinel, F.col("dl"))).alias("avgdl")))
    totals = counts.filter(sentinel).agg(F.struct(F.max("n_docs").alias("n_docs"), F.max("avgdl").alias("avgdl"))).scalar()
    stats = counts.select("term", "df").withColumn("_t", totals).select("term", "df", "_t.n_docs", "_t.avgdl")
    return stats.withColumn("idf", F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def score(index: DataFrame, terms: DataFrame, scope: tuple[str, ...] = (), keys: tuple[str, ...] = ("query_id",), stats: DataFrame | None = None) -> DataFrame:
    """``(scope, keys, node_id, score)`` for every pair that shares a term.

    The joined side is one row per question term; adaptive execution splits the
    postings of a term that most documents contain.  ``stats`` are statistics of a
    larger index of which ``index`` is a part; without them each scope has its own.
    """
    known = terms.join(term_stats(index, scope), [*scope, "term"]) if stats is None else terms.join(stats, "term")
    weights = known.select(*scope, *keys, "term", "idf", "avgdl")
    tf = F.col("tf").cast("double")
    length = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-6)))
    hit = F.col("idf") * tf * (K1 + 1.0) / (tf + length)
    return index.join(weights, [*scope, "term"]).groupBy(*scope, *keys, "node_id").agg(F.sum(hit).alias("score")).filter("score > 0")


class Weights:
    """Question terms with their statistics, in the layout the scan reads."""

    positive = True

    def __init__(self, terms: pa.Table, stats: pa.Table, keys: tuple[str, ...]):
        totals = {t: (n, length) for t, n, length in zip(*(stats.column(c).to_pylist() for c in ("term", "df", "length")))}
        self.n_docs, length = totals.pop(SENTINEL, (0, 0))
        self.avgdl = max(length / self.n_docs if self.n_docs else 1.0, 1e-6)
        vocabulary = sorted(totals)
        df = np.array([totals[t][0] for t in vocabulary], dtype=np.float64)
        self.idf = np.log(1.0 + (self.n_docs - df + 0.5) / (df + 0.5))
        self.vocabulary = pa.array(vocabulary, pa.string())
        names = list(zip(*(terms.column(c).to_pylist() for c in keys)))
        self.names = sorted(set(names))
        index = {name: j for j, name in enumerate(self.names)}
        code = {t: c for c, t in enumerate(vocabulary)}
        pairs = sorted((code[t], index[n]) for t, n in zip(terms.column("term").to_pylist(), names) if t in code)
        flat = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.start = np.searchsorted(flat[:, 0], np.arange(len(vocabulary) + 1))
        self.question = flat[:, 1]

    def scores(self, lists: pa.ListArray) -> np.ndarray:
        """(documents x questions) BM25 for one block of token lists, some documents at a time."""
        out = np.zeros((len(lists), len(self.names)))
        for lo, hi in row_runs(np.diff(lists.offsets.to_numpy()), TOKEN_BLOCK):
            out[lo:hi] = self._scores(lists.slice(lo, hi - lo))
        return out

    def _scores(self, lists: pa.ListArray) -> np.ndarray:
        n, v = len(lists), len(self.vocabulary)
        dl = np.diff(lists.offsets.to_numpy())
        codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(n), dl)
        known = codes >= 0
        cell, tf = np.unique(rows[known] * max(v, 1) + codes[known], return_counts=True)
        row, term = np.divmod(cell, max(v, 1))
        return self.by_question(row, term, tf, dl[row], n)

    def by_question(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray, n: int) -> np.ndarray:
        """Add the hits of (row, term) cells up per row and question; rows ascend."""
        m = len(self.names)
        out = np.zeros((n, m))
        hit = self.idf[term] * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / self.avgdl))
        times = self.start[term + 1] - self.start[term]
        # Whole rows only, so a sum is added up in the same order whatever the block.
        for lo, hi in row_runs(np.bincount(row, weights=times, minlength=n), HIT_BLOCK):
            part = slice(*np.searchsorted(row, [lo, hi]))
            t = times[part]
            first = np.repeat(self.start[term[part]] - np.cumsum(t) + t, t)
            asked = self.question[first + np.arange(len(first))]
            cells = np.repeat((row[part] - lo) * m, t) + asked
            out[lo:hi] = np.bincount(cells, weights=np.repeat(hit[part], t), minlength=(hi - lo) * m).reshape(hi - lo, m)
        return out


def corpus_stats(corpus: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """``(term, df, length)`` of the wanted terms; the sentinel row is the corpus."""
    words = corpus.select(tokens(text).alias("_t"))
    flat = words.select(F.size("_t").alias("_n"), F.explode(F.concat(F.array_distinct("_t"), F.array(F.lit(SENTINEL)))).alias("term"))
    wanted = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(SENTINEL))).distinct()
    # Counted inside the tasks first, so that a term moves once per task and not once per document.
    counts = flat.groupBy("term").agg(F.count("*").alias("df"), F.sum("_n").alias("length"))
    return counts.join(wanted, "term", "left_semi")


def load_weights(corpus: DataFrame, terms: DataFrame, text: str, keys: tuple[str, ...] = ("query_id",)) -> Weights:
    """Question terms (few, see ``SCAN_TERMS``) and their corpus statistics on the driver."""
    return Weights(terms.toArrow(), corpus_stats(corpus, text, terms).toArrow(), keys)


def scan_topk(corpus: DataFrame, terms: DataFrame, k: int, node: str, text: str, keys: tuple[str, ...]) -> DataFrame:
    """Two passes over the corpus and no shuffle of tokens or pair scores.

    The first pass counts documents per question term; the second scores whole
    documents inside the task and passes on local winners only.
    """
    spark = corpus.sparkSession
    types = dict(terms.dtypes)
    node_type = dict(corpus.dtypes)[node]
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", node_id {node_type}, score double"
    weights = load_weights(corpus, terms, text, keys)
    if not weights.names:
        return spark.createDataFrame([], schema + ", rank int")
    shipped = spark.sparkContext.broadcast(weights)
    name_types = [types[c] for c in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        best = LocalTopK(w.names, name_types, node_type, k)
        step = max(1, SCORE_BLOCK // len(w.names))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                best.offer(w.scores(pa.concat_arrays([part.column(1)])), part.column(0).to_numpy(zero_copy_only=False), positive=True)
        out = best.batch(list(keys))
        if out is not None:
            yield out

    found = corpus.select(F.col(node).alias("node_id"), tokens(text).alias("_t")).mapInArrow(task, schema)
    return top_k(found, list(keys), by_score("score", "node_id"), k)


def bm25_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 30,
    node: str = "node_id",
    text: str = "text",
    query_text: str = "text",
    scope: tuple[str, ...] = (),
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Best ``k`` documents per question (and scope, when statistics are per case).

    The corpus is scanned with the question terms at hand, ``SCAN_TERMS`` of them per
    pass.  Statistics per scope need the inverted index.
    """
    terms = question_terms(queries, query_text, (*scope, *keys))
    if not scope:
        return _united([scan_topk(corpus, part, k, node, text, keys) for part in question_parts(terms, keys)])
    index = postings(corpus, node, text, scope, terms)
    scored = score(index, terms, scope, keys)
    return top_k(scored, [*scope, *keys], by_score("score", "node_id"), k)


def question_parts(terms: DataFrame, keys: tuple[str, ...]) -> list[DataFrame]:
    """The terms in parts of about ``SCAN_TERMS``; a question is in one part."""
    parts = max(1, math.ceil(terms.count() / SCAN_TERMS))
    return [terms.filter(F.pmod(F.xxhash64(*keys), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [terms]


def _united(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def group_topk(corpus: DataFrame, group: str, text: str, terms: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Best ``k`` groups per question, each group indexed as one document.

    The counts of a group meet in one task, sorted by group, and are scored there
    row by row; pairs of question and group are not shuffled.
    """
    index = cut_lineage(group_postings(corpus, group, text, terms))
    return _united([_group_pass(index, part, k, keys) for part in question_parts(terms, keys)])


def _group_pass(index: DataFrame, terms: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    spark = index.sparkSession
    types, node_type = dict(terms.dtypes), dict(index.dtypes)["node_id"]
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", node_id {node_type}, score double"
    stats = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("length"))
    weights = Weights(terms.toArrow(), stats.toArrow(), keys)
    if not weights.names:
        return spark.createDataFrame([], schema + ", rank int")
    shipped = spark.sparkContext.broadcast(weights)
    name_types = [types[c] for c in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        best = LocalTopK(w.names, name_types, node_type, k)
        open_node, open_scores = None, None
        step = max(1, SCORE_BLOCK // len(w.names))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                nodes = part.column(0).to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], nodes[1:] != nodes[:-1]])
                row, heads = np.cumsum(new) - 1, nodes[new]
                term = pc.index_in(part.column(1), value_set=w.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
                block = w.by_question(row, term, part.column(2).to_numpy(), part.column(3).to_numpy(), len(heads))
                if open_node is not None:
                    if heads[0] == open_node:
                        block[0] += open_scores
                    else:
                        best.offer(open_scores[None, :], np.array([open_node], dtype=nodes.dtype), positive=True)
                # A group may go on in the next rows, so the last one stays open.
                open_node, open_scores = heads[-1], block[-1].copy()
                if len(heads) > 1:
                    best.offer(block[:-1], heads[:-1], positive=True)
        if open_node is not None:
            best.offer(open_scores[None, :], np.array([open_node]), positive=True)
        out = best.batch(list(keys))
        if out is not None:
            yield out

    counted = index.filter(F.col("term") != SENTINEL).select("node_id", "term", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"))
    found = counted.repartition("node_id").sortWithinPartitions("node_id").mapInArrow(task, schema)
    return top_k(found, list(keys), by_score("score", "node_id"), k)
