"""Retrieval for a known asker: own turns only, or own turns preferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.provenance import q_items
from colloquy.catalog.registry import query
from colloquy.catalog.sqlparts import hashed_sql
from colloquy.operators.bm25 import load_weights, question_terms
from colloquy.operators.dense import CHUNK_QUERIES, all_queries
from colloquy.functions.text import tokens
from colloquy.operators.fused_scan import DotScorer, RankList, fused_topk
from colloquy.sources.encoders import hashed_vectors
from colloquy.sources.tables import TURNS_SQL, bm25_sql, turns

PERSONS = 12


def fused_lists(spark: SparkSession, d: str, with_global: bool) -> DataFrame:
    """Fused lists of all questions, a bounded number of questions per pass."""
    t = turns(spark, d).select(F.col("ref").alias("node_id"), "text", "speaker_ref")
    words = t.select("node_id", tokens("text").alias("payload"), F.col("speaker_ref").alias("grp"))
    vectors = hashed_vectors(t, "node_id", "text").withColumnRenamed("vec", "payload").join(t.select("node_id", F.col("speaker_ref").alias("grp")), "node_id")
    questions = q_items(spark, d)
    passes = -(-questions.count() // CHUNK_QUERIES)
    out = None
    for c in range(passes):
        q = questions if passes == 1 else questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == c)
        weights = load_weights(t, question_terms(q), "text")
        names, block = all_queries(hashed_vectors(q, "query_id", "text"), "query_id", "vec")
        owner = {n: f"P{n % PERSONS:02d}" for n in names}
        lists = [RankList("profile.dense", vectors, DotScorer(names, block), owner), RankList("profile.bm25", words, weights, owner)]
        if with_global:
            lists += [RankList("global.dense", vectors, DotScorer(names, block)), RankList("global.bm25", words, weights)]
        part = fused_topk(lists, 30)
        out = part if out is None else out.unionByName(part)
    return out


_LISTS = (
    TURNS_SQL + "," + bm25_sql("rb", "turns", "ref", "text", "benchmark", "item_id", "text", 100000000) + ","
    + hashed_sql("th", "turns", "ref", "text") + "," + hashed_sql("qh", "benchmark", "item_id", "text")
    + """, ds AS (SELECT q.item_id AS qid, t.ref AS node, coalesce(s, 0e0) AS score FROM benchmark q CROSS JOIN turns t
  LEFT JOIN (SELECT q.node AS qid, d.node, sum(q.w * d.w) AS s FROM qh q JOIN th d USING (b) GROUP BY ALL) x ON x.qid = q.item_id AND x.node = t.ref),
own AS (SELECT ref FROM turns), mine AS (SELECT item_id AS qid, ref AS node FROM benchmark JOIN turns ON speaker_ref = format('P{:02d}', item_id % 12)),
pd AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS rank FROM ds JOIN mine USING (qid, node)),
pb AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM rb JOIN mine USING (qid, node)),
gd AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS rank FROM ds)"""
)


def _fused_sql(union: str) -> str:
    return f"""WITH {_LISTS}, u AS ({union}), f AS (SELECT qid, node, sum(1e0 / (60 + rank)) AS score FROM u GROUP BY qid, node)
SELECT * FROM (SELECT qid AS item_id, node AS ref, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank FROM f) WHERE rank <= 30"""


@query(_fused_sql("SELECT * FROM pd UNION ALL SELECT * FROM pb"))
def speaker_owned_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fused full lists restricted to the turns of the identified asker."""
    out = fused_lists(spark, d, False)
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("ref"), F.round("score", 9).alias("score"), "rank")


@query(_fused_sql("SELECT * FROM pd UNION ALL SELECT * FROM pb UNION ALL SELECT * FROM gd UNION ALL SELECT qid, node, rank FROM rb"))
def profile_prior_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The same lists joined by the unrestricted ones: own turns gain, others stay."""
    out = fused_lists(spark, d, True)
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("ref"), F.round("score", 9).alias("score"), "rank")
