"""Provenance: flattening, projection, collections, profiles, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.retrieval import anchors
from colloquy.catalog.sqlparts import coverage_sql, informative_sql
from colloquy.functions.text import coverage
from colloquy.operators import bm25, collections, fusion, projection, relations
from colloquy.operators.lookup import fetch
from colloquy.operators.ranking import by_score, top_k
from colloquy.session import cut_lineage
from colloquy.sources.tables import FACTS_SQL, TURNS_SQL, bm25_sql, fact_refs, facts, questions, turns


def q_items(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).withColumnRenamed("item_id", "query_id")


def fact_hits(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    return bm25.bm25_topk(facts(spark, d).select("node_id", "text"), q_items(spark, d), k)


def raw_hits(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    return bm25.bm25_topk(turns(spark, d).select("ref", "text"), q_items(spark, d), k, node="ref").withColumnRenamed("node_id", "ref")


FACT_BM25_SQL = FACTS_SQL + "," + bm25_sql("fb", "facts", "node_id", "text", "benchmark", "item_id", "text", 30)
RAW_BM25_SQL = bm25_sql("rb", "turns", "ref", "text", "benchmark", "item_id", "text", 30)


@query(f"WITH {TURNS_SQL} SELECT ref, 'raw:' || ref AS node_id, session_id, ordinal, speaker, speaker_ref, coalesce(reply_to, '') AS reply_to, CAST(len(text) AS INTEGER) AS n_chars FROM turns")
def turns_flatten(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    return t.select("ref", "node_id", "session_id", "ordinal", "speaker", "speaker_ref", F.coalesce("reply_to", F.lit("")).alias("reply_to"), F.length("text").alias("n_chars"))


@query(f"WITH {TURNS_SQL} SELECT a.ref, CAST(b.ordinal - a.ordinal AS INTEGER) AS delta, b.ref AS other FROM turns a JOIN turns b USING (session_id) WHERE abs(b.ordinal - a.ordinal) = 1")
def neighbor_projection(spark: SparkSession, d: str) -> DataFrame:
    return projection.neighbors(turns(spark, d).select("ref", "session_id", "ordinal"))


PROJECTION_SQL = FACT_BM25_SQL + """,
cited AS (SELECT fb.qid, fb.rank, fb.node, r.ref, t.session_id, t.ordinal FROM fb JOIN fact_refs r ON r.node_id = fb.node JOIN turns t USING (ref)),
links AS (SELECT qid, rank, node, ref, 1e0 AS weight, 'direct' AS relation FROM cited
  UNION ALL SELECT c.qid, c.rank, c.node, t.ref, 35e-2, 'adjacent' FROM cited c JOIN turns t ON t.session_id = c.session_id AND abs(t.ordinal - c.ordinal) = 1),
best AS (SELECT qid, rank, node, ref, max(weight) AS weight, max_by(relation, weight) AS relation FROM links GROUP BY ALL),
proj_s AS (SELECT qid, ref, sum(weight / (60 + rank)) AS score, min(rank) AS first, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM best GROUP BY qid, ref),
proj AS (SELECT qid, ref, score, relations, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, ref) AS INTEGER) AS rank FROM proj_s)"""


def projected(spark: SparkSession, d: str) -> DataFrame:
    raw = turns(spark, d).select("ref", "session_id", "ordinal")
    links = projection.grounding(fact_hits(spark, d).select("query_id", "rank", "node_id"), fact_refs(facts(spark, d)), raw)
    return projection.project(links)


@query(f"WITH {PROJECTION_SQL} SELECT qid AS item_id, ref, rank, relations, round(score, 9) AS score FROM proj")
def fact_projection(spark: SparkSession, d: str) -> DataFrame:
    p = projected(spark, d)
    return p.select(F.col("query_id").alias("item_id"), "ref", "rank", "relations", F.round("score", 9).alias("score"))


@query(
    f"""WITH {FACTS_SQL}, r AS (SELECT session_id, count(DISTINCT ref) AS n_refs FROM (SELECT session_id, unnest(refer_ids) AS ref FROM facts) GROUP BY session_id)
SELECT session_id, count(DISTINCT node_id) AS n_members, n_refs, CAST(sum(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_tokens,
  string_agg(DISTINCT source_speaker_ref, ',' ORDER BY source_speaker_ref) AS participants FROM facts JOIN r USING (session_id) GROUP BY session_id, n_refs"""
)
def build_collections(spark: SparkSession, d: str) -> DataFrame:
    return collections.summary(facts(spark, d)).select("session_id", "n_members", "n_refs", "n_tokens", "participants")


@query(f"WITH {FACTS_SQL} SELECT session_id, node_id, row_number() OVER (PARTITION BY session_id ORDER BY node_id) - 1 AS pos FROM (SELECT DISTINCT session_id, node_id FROM facts)")
def collection_members(spark: SparkSession, d: str) -> DataFrame:
    return collections.members(facts(spark, d)).select("session_id", "node_id", "pos")


@query(
    f"""WITH {FACTS_SQL}, c AS (SELECT session_id, node_id, unnest(refer_ids) AS ref, generate_subscripts(refer_ids, 1) - 1 AS pos FROM facts)
SELECT session_id, ref, min(node_id) AS first_fact, CAST(arg_min(pos, (node_id, pos)) AS INTEGER) AS first_pos FROM c GROUP BY session_id, ref"""
)
def collection_references(spark: SparkSession, d: str) -> DataFrame:
    return collections.references(facts(spark, d))


@query(
    f"""WITH {TURNS_SQL} SELECT speaker_ref, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS aliases, count(*) AS n_refs, count(DISTINCT session_id) AS n_sessions,
  arg_min(ref, (case_id, conv_id, ordinal)) AS first_ref, arg_max(ref, (case_id, conv_id, ordinal)) AS last_ref FROM turns GROUP BY speaker_ref"""
)
def speaker_profiles(spark: SparkSession, d: str) -> DataFrame:
    return collections.profiles(turns(spark, d))


def session_collections(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    """Sessions ranked as collections of their facts."""
    terms = bm25.question_terms(q_items(spark, d))
    return bm25.group_topk(facts(spark, d).select("session_id", "text"), "session_id", "text", terms, k)


SESSION_BM25_SQL = "sess AS (SELECT session_id, string_agg(text, ' ') AS text FROM facts GROUP BY session_id), " + bm25_sql(
    "sb", "sess", "session_id", "text", "benchmark", "item_id", "text", 30
)


@query(
    f"""WITH {PROJECTION_SQL}, {SESSION_BM25_SQL},
sref AS (SELECT DISTINCT session_id, unnest(refer_ids) AS ref FROM facts),
base AS (SELECT qid, node, rank, 1e0 / (60 + rank) AS score FROM sb),
ov AS (SELECT DISTINCT b.qid, b.node, p.rank AS hit FROM base b JOIN sref s ON s.session_id = b.node JOIN proj p ON p.qid = b.qid AND p.ref = s.ref),
h AS (SELECT qid, node, hit FROM (SELECT *, row_number() OVER (PARTITION BY qid, node ORDER BY hit) AS n FROM ov) WHERE n <= 8),
sup AS (SELECT qid, node, sum(1e0 / (60 + hit)) AS support, count(*) AS hits FROM h GROUP BY qid, node),
j AS (SELECT b.qid, b.node, b.rank AS base_rank, coalesce(support, 0e0) AS support, coalesce(hits, 0) AS support_hits, b.score + 25e-2 * coalesce(support, 0e0) AS score
  FROM base b LEFT JOIN sup USING (qid, node))
SELECT qid AS item_id, node AS session_id, base_rank, support_hits, round(support, 9) AS support, round(score, 9) AS score,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, base_rank) AS INTEGER) AS rank FROM j"""
)
def collection_consensus(spark: SparkSession, d: str) -> DataFrame:
    found = session_collections(spark, d).select("query_id", "node_id", "rank", (F.lit(1.0) / (60 + F.col("rank"))).alias("score"))
    member_refs = collections.references(facts(spark, d)).select(F.col("session_id").alias("node_id"), "ref")
    out = fusion.consensus(found, member_refs, projected(spark, d))
    return out.select(
        F.col("query_id").alias("item_id"), F.col("node_id").alias("session_id"), "base_rank", "support_hits",
        F.round("support", 9).alias("support"), F.round("score", 9).alias("score"), "rank",
    )


ANCHOR_FLOOR = 0.1


def raw_anchors(spark: SparkSession, d: str) -> DataFrame:
    q = q_items(spark, d).withColumnRenamed("text", "question")
    t = turns(spark, d).select(F.col("ref").alias("node_id"), "text")
    hits = fetch(raw_hits(spark, d).withColumnRenamed("ref", "node_id").join(q, "query_id"), t, "node_id")
    return anchors(hits, floor=ANCHOR_FLOOR).withColumnRenamed("node_id", "ref")


_ANCHORS = f"""{FACTS_SQL}, {RAW_BM25_SQL},
cv AS (SELECT rb.qid, rb.node, rb.rank, {coverage_sql('b.text', 't.text')} AS cov FROM rb JOIN benchmark b ON b.item_id = rb.qid JOIN turns t ON t.ref = rb.node),
an AS (SELECT qid, node AS ref, anchor FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cov + 1e0 / (1000 + rank - 1), 9) DESC, rank, node) AS anchor
  FROM cv WHERE cov >= 1e-1) WHERE anchor <= 2)"""


@query(
    f"""WITH {_ANCHORS},
base AS (SELECT an.qid, an.ref AS anchor_ref, 1e0 / anchor AS w, t.session_id, t.ordinal, t.reply_to FROM an JOIN turns t USING (ref)),
steps(p, delta) AS (VALUES (0, 1), (1, -1), (2, 2), (3, -2)),
every AS (
  SELECT b.qid, anchor_ref, t.ref AS other, w, 'reply_to' AS reason, 5e0 + w AS priority FROM base b JOIN turns t ON t.ref = b.reply_to
  UNION ALL SELECT b.qid, anchor_ref, t.ref, w, 'replied_by', 48e-1 + w FROM base b JOIN turns t ON t.reply_to = b.anchor_ref
  UNION ALL SELECT b.qid, anchor_ref, y.ref, w, 'fact_sibling', 4e0 + w FROM base b JOIN fact_refs x ON x.ref = b.anchor_ref JOIN fact_refs y ON y.node_id = x.node_id
  UNION ALL SELECT b.qid, anchor_ref, t.ref, w, 'local_' || CASE WHEN delta > 0 THEN '+' ELSE '' END || delta, 2e0 - 15e-2 * p + w
    FROM base b, steps s JOIN turns t ON t.session_id = b.session_id AND t.ordinal = b.ordinal + s.delta),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, other ORDER BY round(priority, 9) DESC, w DESC, reason DESC, anchor_ref DESC) AS n FROM every WHERE other <> anchor_ref),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(priority, 9) DESC, anchor_ref, other) AS INTEGER) AS rank FROM o WHERE n = 1)
SELECT qid AS item_id, other AS ref, anchor_ref, reason, round(priority, 9) AS priority, rank FROM r WHERE rank <= 4"""
)
def relation_expansion(spark: SparkSession, d: str) -> DataFrame:
    raw = turns(spark, d).select("ref", "session_id", "ordinal", "reply_to")
    f = facts(spark, d).filter("addressee NOT IN ('', 'unknown', 'group') AND size(refer_ids) BETWEEN 1 AND 4")
    out = relations.expand(raw_anchors(spark, d), raw, fact_refs(f).select("node_id", "ref"))
    return out.select(F.col("query_id").alias("item_id"), F.col("other").alias("ref"), "anchor_ref", "reason", F.round("priority", 9).alias("priority"), "rank")


_COHERENCE = f"""{FACT_BM25_SQL}, {RAW_BM25_SQL},
places AS (SELECT fb.qid, fb.node, t.session_id, t.ordinal FROM fb JOIN fact_refs r ON r.node_id = fb.node JOIN turns t USING (ref)),
near AS (SELECT rb.qid, rb.rank, t.session_id, t.ordinal FROM rb JOIN turns t ON t.ref = rb.node WHERE rb.rank <= 12),
coh AS (SELECT qid, node, max(greatest(0e0, 1e0 - abs(p.ordinal - n.ordinal) / 8e0) * (1e0 / (1e0 + (n.rank - 1) / 6e0))) AS coherence
  FROM places p JOIN near n USING (qid, session_id) GROUP BY qid, node)"""


@query(f"WITH {_COHERENCE} SELECT qid AS item_id, node AS node_id, round(coherence, 9) AS coherence FROM coh")
def event_coherence(spark: SparkSession, d: str) -> DataFrame:
    raw = turns(spark, d).select("ref", "session_id", "ordinal")
    places = fact_hits(spark, d).select("query_id", "node_id").join(fact_refs(facts(spark, d)), "node_id").join(raw, "ref")
    near = raw_hits(spark, d, 12).join(raw, "ref")
    out = relations.coherence(places, near)
    return out.select(F.col("query_id").alias("item_id"), "node_id", F.round("coherence", 9).alias("coherence"))


@query(
    f"""WITH {FACT_BM25_SQL}, {RAW_BM25_SQL},
ask AS (SELECT item_id AS qid, text, format('P{{:02d}}', item_id % 12) AS stable FROM benchmark),
mine AS (SELECT a.qid, a.text AS question, f.node_id, f.text, f.source_speaker_ref = a.stable AS spoke FROM ask a JOIN facts f ON f.source_speaker_ref = a.stable OR f.addressee = a.stable),
wt AS (SELECT DISTINCT qid, {informative_sql('question')} AS w FROM mine),
ft AS (SELECT DISTINCT node_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM mine),
c AS (SELECT m.qid, m.node_id, m.spoke, CASE WHEN len(w) = 0 THEN 0e0 ELSE CAST(len(list_intersect(w, t)) AS DOUBLE) / len(w) END AS cov, coalesce(fb.rank - 1, 1000000) AS r0
  FROM mine m JOIN wt USING (qid) JOIN ft USING (node_id) LEFT JOIN fb ON fb.qid = m.qid AND fb.node = m.node_id),
kept AS (SELECT * FROM c WHERE cov >= 18e-2 OR r0 < 30),
places AS (SELECT k.qid, k.node_id, t.session_id, t.ordinal FROM kept k JOIN fact_refs r USING (node_id) JOIN turns t USING (ref)),
near AS (SELECT rb.qid, rb.rank, t.session_id, t.ordinal FROM rb JOIN turns t ON t.ref = rb.node WHERE rb.rank <= 12),
coh AS (SELECT qid, node_id, max(greatest(0e0, 1e0 - abs(p.ordinal - n.ordinal) / 8e0) * (1e0 / (1e0 + (n.rank - 1) / 6e0))) AS coherence
  FROM places p JOIN near n USING (qid, session_id) GROUP BY qid, node_id),
pr AS (SELECT k.qid, k.node_id, k.spoke, round(3e0 * cov + CASE WHEN spoke THEN 1e0 ELSE 75e-2 END + 6e-1 * coalesce(coherence, 0e0) + 1e0 / (60 + r0), 9) AS priority
  FROM kept k LEFT JOIN coh USING (qid, node_id)),
b AS (SELECT qid, ref, priority, CASE WHEN spoke THEN 'asker_spoke' ELSE 'assigned_to_asker' END AS reason,
  row_number() OVER (PARTITION BY qid, ref ORDER BY priority DESC, spoke DESC) AS n FROM pr JOIN fact_refs USING (node_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY priority DESC, ref) AS INTEGER) AS rank FROM b WHERE n = 1)
SELECT qid AS item_id, ref, reason, priority, rank FROM r WHERE rank <= 2"""
)
def profile_state_expansion(spark: SparkSession, d: str) -> DataFrame:
    """State of the identified asker: said by them or assigned to them."""
    q = q_items(spark, d).withColumn("stable", F.format_string("P%02d", F.pmod("query_id", F.lit(12))))
    f = facts(spark, d)
    roles = F.array(F.struct(F.col("source_speaker_ref").alias("stable"), F.lit(True).alias("spoke")), F.struct(F.col("addressee").alias("stable"), F.lit(False).alias("spoke")))
    owned = f.select("node_id", "text", F.explode(roles).alias("r")).select("node_id", "text", "r.stable", "r.spoke")
    # Facts enter by shared words or by their place in the fact ranking.
    entered = relations.covering(q, owned, 0.18, ("stable",)).select("query_id", "node_id")
    hits = fact_hits(spark, d).select("query_id", "node_id", (F.col("rank") - 1).alias("r0"))
    both = entered.withColumn("r0", F.lit(None).cast("int")).unionByName(hits.withColumn("r0", F.col("r0").cast("int")))
    listed = both.groupBy("query_id", "node_id").agg(F.min("r0").alias("r0")).join(q.select("query_id", "stable", F.col("text").alias("question")), "query_id")
    # Only what has entered is compared word by word.
    kept = fetch(listed, owned, "node_id", "stable").select("query_id", "node_id", "spoke", F.coalesce("r0", F.lit(10**6)).alias("r0"), coverage("question", "text").alias("coverage"))
    raw = turns(spark, d).select("ref", "session_id", "ordinal")
    refs = fact_refs(f).select("node_id", "ref")
    kept = cut_lineage(kept)
    places = kept.select("query_id", "node_id").join(refs, "node_id").join(raw, "ref")
    near = relations.coherence(places, raw_hits(spark, d, 12).join(raw, "ref"))
    p = kept.join(near, ["query_id", "node_id"], "left").fillna({"coherence": 0.0})
    priority = F.lit(3.0) * F.col("coverage") + F.when(F.col("spoke"), F.lit(1.0)).otherwise(F.lit(0.75)) + F.lit(0.6) * F.col("coherence") + F.lit(1.0) / (60 + F.col("r0"))
    rows = p.withColumn("priority", F.round(priority, 9)).join(refs, "node_id")
    best = rows.groupBy("query_id", "ref").agg(F.max(F.struct("priority", "spoke")).alias("b"))
    flat = best.select("query_id", "ref", F.when(F.col("b.spoke"), "asker_spoke").otherwise("assigned_to_asker").alias("reason"), F.col("b.priority").alias("priority"))
    return top_k(flat, ["query_id"], by_score("priority", "ref"), 2).select(F.col("query_id").alias("item_id"), "ref", "reason", "priority", "rank")
