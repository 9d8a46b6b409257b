"""Set ranking, keyword-era fusion, answer rendering, scope choice, boundary identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.personal import _LISTS, fused_lists
from colloquy.catalog.provenance import RAW_BM25_SQL, q_items, raw_hits
from colloquy.catalog.registry import query
from colloquy.catalog.retrieval import FACT_HYBRID_SQL, channel, fact_hybrid
from colloquy.catalog.sqlparts import hashed_sql, rrf_sql
from colloquy.operators import bm25, boundary, dense, fusion, speakers
from colloquy.operators.lookup import fetch
from colloquy.operators.ranking import by_score, top_k
from colloquy.plans.routes import TEMPORAL
from colloquy.sources.encoders import hashed_vectors
from colloquy.sources.tables import TURNS_SQL, bm25_sql, documents, fact_refs, facts, table, turn_vectors, turns

FACT_WEIGHT = 0.75


@query(
    f"""WITH mem AS (SELECT e.label, d.doc_id, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
sets AS (SELECT label, string_agg(text, ' ') AS text FROM mem GROUP BY label), {bm25_sql("tb", "sets", "label", "text", "benchmark", "item_id", "text", 1000000)},
{hashed_sql("mh", "mem", "doc_id", "text")}, {hashed_sql("qh", "benchmark", "item_id", "text")},
sv AS (SELECT label, b, sum(w) AS s FROM mh JOIN mem ON doc_id = node GROUP BY label, b), sn AS (SELECT label, sqrt(sum(s * s)) AS size FROM sv GROUP BY label),
sc AS (SELECT q.node AS qid, label AS node, sum(q.w * s / size) AS score FROM qh q JOIN sv USING (b) JOIN sn USING (label) GROUP BY 1, 2),
sd AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS rank FROM sc),
ch AS (SELECT qid, node, 0 AS ch, rank, 1e0 AS weight FROM sd UNION ALL SELECT qid, node, 1, rank, 1e0 FROM tb), {rrf_sql("f", "ch")}
SELECT qid AS item_id, node AS label, rank, round(score, 9) AS score FROM f"""
)
def visual_set_rank(spark: SparkSession, d: str) -> DataFrame:
    """Image sets ranked against each other by dense and BM25 lists of any depth."""
    q = q_items(spark, d)
    members = documents(spark, d).join(table(spark, d, "embeddings", "vec_id", "label"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "label", "text")
    vectors = hashed_vectors(members, "doc_id", "text").join(members.select("doc_id", "label"), "doc_id")
    # One winner per (question, set) is every set.
    every = dense.dense_topk(dense.mean_vectors(vectors, "label", "vec"), hashed_vectors(q, "query_id", "text"), 1, node="label", group="label").drop("rank", "grp")
    near = top_k(every, ["query_id"], by_score("score", "node_id"), None)
    terms = bm25.question_terms(q)
    sparse = top_k(bm25.score(bm25.group_postings(members, "label", "text", terms), terms), ["query_id"], by_score("score", "node_id"), None)
    fused = fusion.rrf(channel(near, "0.dense", 1.0).unionByName(channel(sparse, "1.bm25", 1.0)))
    return fused.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("label"), "rank", F.round("score", 9).alias("score"))


@query(
    f"""WITH {FACT_HYBRID_SQL}, {RAW_BM25_SQL},
mem AS (SELECT fr.qid, r.ref, sum(1e0 / (60 + fr.rank)) AS s, min(fr.rank) AS first FROM fr JOIN fact_refs r ON r.node_id = fr.node GROUP BY fr.qid, r.ref),
mr AS (SELECT qid, ref AS node, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, first, ref) AS rank FROM mem),
u AS (SELECT qid, node, rank, 0 AS ch, 1e0 AS weight FROM rb UNION ALL SELECT qid, node, rank, 1, 75e-2 FROM mr), {rrf_sql("f", "u", 30)},
j AS (SELECT f.*, t.conv_id, t.ordinal, f.node NOT IN (SELECT node FROM rb WHERE rb.qid = f.qid) AS injected FROM f JOIN turns t ON t.ref = f.node)
SELECT qid AS item_id, node AS ref, injected, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN qid % 2 = 0 THEN conv_id END, CASE WHEN qid % 2 = 0 THEN ordinal END, rank) AS INTEGER) AS slot FROM j"""
)
def keyword_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Turn ranking rescued by facts; questions about order are answered in time order."""
    asked = q_items(spark, d).select("query_id", F.concat("text", F.when(F.pmod("query_id", F.lit(2)) == 0, " what came first?").otherwise("")).rlike(TEMPORAL).alias("by_time"))
    base = raw_hits(spark, d).withColumnRenamed("ref", "node_id")
    hits = fact_hybrid(spark, d).join(fact_refs(facts(spark, d)), "node_id")
    summed = hits.groupBy("query_id", F.col("ref").alias("node_id")).agg(F.sum(F.lit(1.0) / (60 + F.col("rank"))).alias("score"), F.min("rank").alias("_first"))
    rescued = top_k(summed, ["query_id"], by_score("score", "_first", "node_id"), None)
    fused = fusion.rrf(channel(base, "0.base", 1.0).unionByName(channel(rescued, "1.fact", FACT_WEIGHT)), k=30)
    place = turns(spark, d).select(F.col("ref").alias("node_id"), "conv_id", "ordinal")
    rows = fused.join(place, "node_id").join(asked, "query_id").withColumnRenamed("rank", "_rank")
    order = [F.when(F.col("by_time"), F.col("conv_id")), F.when(F.col("by_time"), F.col("ordinal")), F.col("_rank")]
    out = top_k(rows, ["query_id"], order, 30, "slot")
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("ref"), (~F.contains("channels", F.lit("0.base"))).alias("injected"), F.round("score", 9).alias("score"), "slot")


@query(
    f"""WITH {TURNS_SQL}, {RAW_BM25_SQL} SELECT rb.qid AS item_id, count(*) AS n_rows,
  md5(string_agg('[' || t.speaker || '; ' || format('2024-01-{{:02d}}', 1 + t.conv_id % 5) || ']: ' || t.text, chr(10) ORDER BY rb.rank)) AS digest FROM rb JOIN turns t ON t.ref = rb.node GROUP BY rb.qid"""
)
def context_rendering(spark: SparkSession, d: str) -> DataFrame:
    """The answer prompt's evidence block, one line per retrieved turn."""
    t = turns(spark, d).select("ref", "speaker", F.format_string("2024-01-%02d", 1 + F.pmod("conv_id", F.lit(5))).alias("date"), "text")
    line = F.concat(F.lit("["), "speaker", F.lit("; "), "date", F.lit("]: "), "text")
    rows = fetch(raw_hits(spark, d), t, "ref")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda e: e["line"])
    return rows.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n_rows"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@query(
    f"""WITH {_LISTS}, own_u AS (SELECT * FROM pd UNION ALL SELECT * FROM pb), both_u AS (SELECT * FROM own_u UNION ALL SELECT * FROM gd UNION ALL SELECT qid, node, rank FROM rb),
f AS (SELECT 'asker_only' AS scope, qid, node, sum(1e0 / (60 + rank)) AS score FROM own_u WHERE qid % 3 = 0 GROUP BY qid, node UNION ALL SELECT 'global', qid, node, sum(1e0 / (60 + rank)) FROM both_u WHERE qid % 3 <> 0 GROUP BY qid, node)
SELECT * FROM (SELECT scope, qid AS item_id, node AS ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank FROM f) WHERE rank <= 30"""
)
def scope_freeze(spark: SparkSession, d: str) -> DataFrame:
    """Own turns for questions scoped to the asker, the shared context otherwise."""
    own = F.pmod("query_id", F.lit(3)) == 0
    narrow = fused_lists(spark, d, False).filter(own).withColumn("scope", F.lit("asker_only"))
    wide = fused_lists(spark, d, True).filter(~own).withColumn("scope", F.lit("global"))
    return narrow.unionByName(wide).select("scope", F.col("query_id").alias("item_id"), F.col("node_id").alias("ref"), "rank")


@query()
def boundary_identities(spark: SparkSession, d: str) -> DataFrame:
    """Online speakers merged and named from all sessions heard."""
    tv = turn_vectors(spark, d).withColumn("vec", F.col("embedding"))
    matched = speakers.online_match(tv, ["conv_id", "turn_idx"], ["case_id", "ref"]).select("case_id", "ref", F.col("speaker").alias("label"))
    spoken = turns(spark, d).select("ref", "text")
    heard = tv.select("case_id", "session_id", "turn_idx", "ref", "vec").join(matched, ["case_id", "ref"]).join(spoken, "ref").withColumnRenamed("ref", "node_id")
    return boundary.resolve_seen(heard)
