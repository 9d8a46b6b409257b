"""Reranking, filtering, merging and packing of retrieved contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.provenance import (
    FACT_BM25_SQL, PROJECTION_SQL, RAW_BM25_SQL, SESSION_BM25_SQL, fact_hits, projected, q_items, raw_anchors, raw_hits, session_collections,
)
from colloquy.catalog.registry import query
from colloquy.catalog.retrieval import _BM25, _DENSE, _docs_bm25, _docs_dense, _variant_bm25, _IMG, _VARIANTS, _image_topk
from colloquy.functions.dates import session_number
from colloquy.catalog.sqlparts import coverage_sql
from colloquy.functions.text import coverage, natural_key
from colloquy.operators import collections, context, metrics, packing, relations
from colloquy.operators.ranking import by_score, top_k
from colloquy.plans.routes import asker_query, bundle_gate as gate
from colloquy.session import cut_lineage
from colloquy.sources.tables import FACTS_SQL, TURNS_SQL, documents, fact_refs, facts, questions, table, turns


@query(
    f"""WITH {_BM25}, r AS (SELECT b.qid, b.node, b.rank, CAST(CAST(e.ts AS DATE) AS VARCHAR) AS day FROM bm b JOIN events e ON e.event_id = b.node),
v AS (SELECT qid, CASE qid % 3 WHEN 0 THEN max(CASE WHEN rank = 5 THEN day END) WHEN 1 THEN '2031-01-01' ELSE 'some day' END AS asked FROM r GROUP BY qid),
j AS (SELECT r.*, asked, count(*) FILTER (WHERE day = asked) OVER (PARTITION BY qid) AS n FROM r JOIN v USING (qid))
SELECT qid AS item_id, node AS doc_id, day, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS rank FROM j WHERE len(asked) <> 10 OR asked IS NULL OR n = 0 OR day = asked"""
)
def fail_open_date_filter(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events", "event_id", "ts").select(F.col("event_id").alias("node_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    r = _docs_bm25(spark, d).join(days, "node_id")
    fifth = r.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 5, F.col("date"))).alias("_d"))
    m = F.pmod("query_id", F.lit(3))
    asked = F.when(m == 0, F.col("_d")).when(m == 1, "2031-01-01").otherwise("some day")
    out = context.fail_open_date(r.join(fifth, "query_id").withColumn("time_range", asked), ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), F.col("date").alias("day"), "rank")


_MIXED_SQL = f"""{FACTS_SQL}, {RAW_BM25_SQL}, {SESSION_BM25_SQL},
days AS (SELECT DISTINCT conv_id, session_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE format('2024-01-{{:02d}}', 1 + conv_id % 5) END AS day FROM turns),
mixed AS (SELECT qid, rank * 2 AS slot, TRUE AS is_raw, node AS node_id, t.session_id, t.ordinal FROM rb JOIN turns t ON t.ref = rb.node WHERE rank <= 15
  UNION ALL SELECT qid, rank * 2 - 1, FALSE, 'collection:' || node, node, 0 FROM sb WHERE rank <= 5)"""


def _mixed_context(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a few session nodes between them."""
    t = turns(spark, d).select("ref", "session_id", "ordinal", "conv_id")
    raw = raw_hits(spark, d, 15).join(t, "ref").select(
        "query_id", (F.col("rank") * 2).alias("slot"), F.lit(True).alias("is_raw"), F.col("ref").alias("node_id"), "session_id", "ordinal"
    )
    upper = session_collections(spark, d, 5).select(
        "query_id", (F.col("rank") * 2 - 1).alias("slot"), F.lit(False).alias("is_raw"), F.concat(F.lit("collection:"), "node_id").alias("node_id"),
        F.col("node_id").alias("session_id"), F.lit(0).alias("ordinal"),
    )
    conv = session_number("session_id")
    day = F.when(F.pmod(conv, F.lit(7)) != 0, F.format_string("2024-01-%02d", 1 + F.pmod(conv, F.lit(5))))
    return raw.unionByName(upper).withColumn("date", day)


@query(
    f"""WITH {_MIXED_SQL}, m AS (SELECT x.*, day FROM mixed x JOIN days USING (session_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, is_raw ORDER BY slot) AS place,
  row_number() OVER (PARTITION BY qid, is_raw ORDER BY CASE WHEN is_raw THEN (day IS NULL)::INT END, coalesce(CASE WHEN is_raw THEN day END, '9999-12-31'), CASE WHEN is_raw THEN CAST(substr(session_id, 2) AS BIGINT) END,
    CASE WHEN is_raw THEN ordinal END, slot) AS t FROM m)
SELECT a.qid AS item_id, a.node_id, CAST(b.slot AS INTEGER) AS slot FROM n a JOIN n b ON a.qid = b.qid AND a.is_raw = b.is_raw AND a.t = b.place"""
)
def slot_preserving_sort(spark: SparkSession, d: str) -> DataFrame:
    out = context.chronological_slots(_mixed_context(spark, d), ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), "node_id", F.col("new_slot").alias("slot"))


@query(
    f"WITH {TURNS_SQL}, s AS (SELECT DISTINCT case_id, session_id, conv_id FROM turns) "
    "SELECT case_id, session_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY conv_id) AS INTEGER) AS place FROM s"
)
def natural_session_sort(spark: SparkSession, d: str) -> DataFrame:
    s = turns(spark, d).select("case_id", "session_id").distinct()
    return top_k(s, ["case_id"], [natural_key("session_id")], None, "place")


@query(
    f"""WITH {_BM25}, {_IMG}, c AS (SELECT qid, node, rank AS slot FROM bm WHERE node IN (SELECT vec_id FROM embeddings)),
j AS (SELECT c.*, im.rank AS v FROM c LEFT JOIN im USING (qid, node))
SELECT qid AS item_id, node AS doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY v IS NULL, coalesce(v, slot), slot) AS INTEGER) AS place FROM j"""
)
def visual_budget(spark: SparkSession, d: str) -> DataFrame:
    """Context images in visual order; documents with a vector have an image."""
    images = table(spark, d, "embeddings", "vec_id").withColumnRenamed("vec_id", "node_id")
    ctx = _docs_bm25(spark, d).withColumnRenamed("rank", "slot").join(images, "node_id", "left_semi").withColumn("has_image", F.lit(True))
    out = context.visual_budget(ctx, _image_topk(spark, d), ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), "place")


_ROUNDS = f"""{_VARIANTS}, {_DENSE},
r0 AS (SELECT qid, node, rank FROM bm WHERE rank <= 30), r1 AS (SELECT qid, node, rank FROM de WHERE rank <= 8), r2 AS (SELECT qid, node, rank FROM bl WHERE rank <= 5),
n1 AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM r1 WHERE (qid, node) NOT IN (SELECT qid, node FROM r0)),
n2 AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM r2 WHERE (qid, node) NOT IN (SELECT qid, node FROM r0) AND (qid, node) NOT IN (SELECT qid, node FROM r1)),
c AS (SELECT b.item_id AS qid, (SELECT count(*) FROM n1 WHERE n1.qid = b.item_id) AS k1, (SELECT count(*) FROM n2 WHERE n2.qid = b.item_id) AS k2 FROM benchmark b),
p0 AS (SELECT qid, node, rank AS slot FROM r0),
p1 AS (SELECT p0.qid, node, slot FROM p0 JOIN c USING (qid) WHERE slot <= 30 - k1
  UNION ALL SELECT n1.qid, n1.node, least((SELECT count(*) FROM p0 WHERE p0.qid = n1.qid), 30 - k1) + i FROM n1 JOIN c USING (qid)),
p2 AS (SELECT p1.qid, node, slot FROM p1 JOIN c USING (qid) WHERE slot <= 30 - k2
  UNION ALL SELECT n2.qid, n2.node, least((SELECT count(*) FROM p1 WHERE p1.qid = n2.qid), 30 - k2) + i FROM n2 JOIN c USING (qid))"""


def _round_contexts(spark: SparkSession, d: str) -> DataFrame:
    def ids(hits: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda e: e["node_id"].cast("string"))
        return hits.groupBy("query_id").agg(ordered.alias(name))

    q = questions(spark, d).select(F.col("item_id").alias("query_id"))
    long_form = _variant_bm25(spark, d).filter("variant = 1")
    out = q.join(ids(_docs_bm25(spark, d), "c0"), "query_id", "left").join(ids(_docs_dense(spark, d), "c1"), "query_id", "left")
    return out.join(ids(long_form, "c2"), "query_id", "left")


@query(f"WITH {_ROUNDS} SELECT qid AS item_id, node AS doc_id, CAST(slot AS INTEGER) AS slot FROM p2")
def round_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds with shrinking budgets packed into thirty slots."""
    merged = context.merge_rounds(_round_contexts(spark, d), ["c0", "c1", "c2"], (30, 8, 5), 30)
    flat = merged.select("query_id", F.posexplode("packed").alias("i", "node_id"))
    return flat.select(F.col("query_id").alias("item_id"), F.col("node_id").cast("bigint").alias("doc_id"), (F.col("i") + 1).alias("slot"))


@query(
    f"""WITH {_ROUNDS} SELECT c.qid AS item_id, (SELECT CAST(count(*) AS INTEGER) FROM r0 WHERE r0.qid = c.qid) AS considered_0, (SELECT CAST(count(*) AS INTEGER) FROM r1 WHERE r1.qid = c.qid) AS considered_1,
  (SELECT CAST(count(*) AS INTEGER) FROM r2 WHERE r2.qid = c.qid) AS considered_2, CAST(k1 AS INTEGER) AS admitted_1, CAST(k2 AS INTEGER) AS admitted_2 FROM c"""
)
def round_stats(spark: SparkSession, d: str) -> DataFrame:
    merged = context.merge_rounds(_round_contexts(spark, d), ["c0", "c1", "c2"], (30, 8, 5), 30)
    return merged.select(F.col("query_id").alias("item_id"), "considered_0", "considered_1", "considered_2", "admitted_1", "admitted_2")


def fact_roles(spark: SparkSession, d: str) -> DataFrame:
    """``(ref, stable, spoke)``: who said a turn's facts and to whom."""
    f = facts(spark, d)
    roles = F.array(F.struct(F.col("source_speaker_ref").alias("stable"), F.lit(True).alias("spoke")), F.struct(F.upper("addressee").alias("stable"), F.lit(False).alias("spoke")))
    return f.select(F.explode("refer_ids").alias("ref"), F.explode(roles).alias("r")).select("ref", "r.stable", "r.spoke").distinct()


def asker(col: str = "query_id") -> F.Column:
    return F.format_string("P%02d", F.pmod(col, F.lit(12)))


_ROLES_SQL = """roles AS (SELECT DISTINCT ref, source_speaker_ref AS stable, TRUE AS spoke FROM (SELECT unnest(refer_ids) AS ref, source_speaker_ref FROM facts)
  UNION SELECT DISTINCT ref, upper(addressee), FALSE FROM (SELECT unnest(refer_ids) AS ref, addressee FROM facts))"""


@query(
    f"""WITH {FACTS_SQL}, {RAW_BM25_SQL}, {_ROLES_SQL},
hit AS (SELECT rb.qid, rb.node, bool_or(spoke) AS s, bool_or(NOT spoke) AS a FROM rb JOIN roles r ON r.ref = rb.node AND r.stable = format('P{{:02d}}', rb.qid % 12) GROUP BY rb.qid, rb.node),
j AS (SELECT rb.qid, rb.node, rb.rank, least(25e-3, 2e-2 * coalesce(s, FALSE)::INT + 1e-2 * coalesce(a, FALSE)::INT) AS boost, count(*) OVER (PARTITION BY rb.qid) AS n FROM rb LEFT JOIN hit USING (qid, node))
SELECT qid AS item_id, node AS ref, round(boost, 9) AS boost, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(1e0 - (rank - 1) / (4e0 * n) + boost, 9) DESC, rank) AS INTEGER) AS slot FROM j"""
)
def soft_identity_rerank(spark: SparkSession, d: str) -> DataFrame:
    ctx = raw_hits(spark, d).select("query_id", F.col("rank").alias("slot"), "ref")
    targets = q_items(spark, d).select("query_id", asker().alias("stable"))
    out = context.identity_rerank(ctx, fact_roles(spark, d), ["query_id"], targets)
    return out.select(F.col("query_id").alias("item_id"), "ref", F.round("boost", 9).alias("boost"), F.col("new_slot").alias("slot"))


@query(
    f"""WITH {FACTS_SQL}, {RAW_BM25_SQL}, ask AS (SELECT item_id AS qid, text, format('P{{:02d}}', item_id % 12) AS stable FROM benchmark),
rel AS (SELECT DISTINCT qid, unnest(f.refer_ids) AS ref FROM ask a JOIN facts f ON (f.source_speaker_ref = a.stable OR f.addressee = a.stable) WHERE {coverage_sql('a.text', 'f.text')} >= 18e-2),
j AS (SELECT rb.qid, rb.node, rb.rank, (t.speaker_ref = a.stable)::INT AS direct, (rel.ref IS NOT NULL)::INT AS related, {coverage_sql('a.text', 't.text')} AS lex, count(*) OVER (PARTITION BY rb.qid) AS n
  FROM rb JOIN ask a ON a.qid = rb.qid JOIN turns t ON t.ref = rb.node LEFT JOIN rel ON rel.qid = rb.qid AND rel.ref = rb.node),
s AS (SELECT *, least(18e-3, (1e-2 * direct + 8e-3 * related) * least(1e0, lex / 2e-1)) AS boost FROM j)
SELECT qid AS item_id, node AS ref, round(boost, 9) AS boost, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(1e0 - (rank - 1) / (4e0 * n) + boost, 9) DESC, rank) AS INTEGER) AS slot FROM s"""
)
def low_confidence_reorder(spark: SparkSession, d: str) -> DataFrame:
    q = q_items(spark, d).withColumn("stable", asker())
    f = facts(spark, d)
    owners = f.select("node_id", F.col("text").alias("fact_text"), F.explode(F.array("source_speaker_ref", "addressee")).alias("stable"))
    # Only facts that cite a turn of the context can matter, so the pairs start there.
    hits = cut_lineage(raw_hits(spark, d).join(q, "query_id"))
    cited = hits.join(fact_refs(f).select("node_id", "ref"), "ref").join(owners, ["node_id", "stable"])
    related = cited.filter(coverage("text", "fact_text") >= 0.18).select("query_id", "ref").distinct().withColumn("related", F.lit(True))
    t = turns(spark, d).select("ref", "speaker_ref", F.col("text").alias("body"))
    ctx = hits.join(t, "ref").join(related, ["query_id", "ref"], "left").fillna(False, ["related"])
    ctx = ctx.select("query_id", F.col("rank").alias("slot"), "ref", (F.col("speaker_ref") == F.col("stable")).alias("direct"), "related", coverage("text", "body").alias("lexical"))
    out = context.low_confidence_reorder(ctx, ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), "ref", F.round("boost", 9).alias("boost"), F.col("new_slot").alias("slot"))


@query(
    f"""WITH {FACTS_SQL}, v AS (SELECT unnest(refer_ids) AS ref, source_speaker_ref AS speaker_ref, addressee FROM facts),
g AS (SELECT ref, speaker_ref, min(addressee) AS a, max(addressee) AS b FROM v GROUP BY ALL)
SELECT t.ref, CASE WHEN a = b THEN a ELSE 'unknown' END AS addressee, CASE WHEN a IS NULL THEN 'no_grounded_fact' WHEN a = b THEN 'grounded_fact_source_speaker_unanimous' ELSE 'grounded_fact_ambiguous' END AS label_source
FROM turns t LEFT JOIN g USING (ref, speaker_ref)"""
)
def unanimous_addressee(spark: SparkSession, d: str) -> DataFrame:
    votes = facts(spark, d).select(F.explode("refer_ids").alias("ref"), "source_speaker_ref", "addressee")
    return context.unanimous_addressee(turns(spark, d).select("ref", "speaker_ref"), votes).select("ref", "addressee", "label_source")


@query(
    f"""WITH {FACT_BM25_SQL}, m AS (SELECT fb.qid, r.ref, count(*) AS c FROM fb JOIN fact_refs r ON r.node_id = fb.node GROUP BY fb.qid, r.ref),
t AS (SELECT qid, sum(c) AS n FROM m GROUP BY qid), e AS (SELECT qid, count(*) AS u, max(n) AS n, -sum(c / n * ln(c / n)) AS h FROM m JOIN t USING (qid) GROUP BY qid)
SELECT qid AS item_id, u AS unique_refs, CAST(n AS BIGINT) AS mentions, round(1e0 - u / n, 9) AS redundancy, round(h, 9) AS entropy, round(exp(h), 6) AS effective_support FROM e"""
)
def context_diversity_stats(spark: SparkSession, d: str) -> DataFrame:
    refs = fact_hits(spark, d).join(fact_refs(facts(spark, d)), "node_id").select("query_id", "ref")
    s = metrics.diversity(refs)
    return s.select(
        F.col("query_id").alias("item_id"), "unique_refs", "mentions", F.round("redundancy", 9).alias("redundancy"), F.round("entropy", 9).alias("entropy"),
        F.round("effective_support", 6).alias("effective_support"),
    )


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'global_temporal_order_preserved' WHEN event_id % 4 >= 2 AND value > 10 THEN 'model_cross_turn_decomposition' ELSE 'model_gate_rejected' END AS reason,
  event_id % 3 <> 0 AND event_id % 4 >= 2 AND value > 10 AS active FROM events"""
)
def bundle_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether evidence is grouped, from plan fields carried by events."""
    e = table(spark, d, "events", "event_id", "value")
    plan = F.struct(
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.pmod("event_id", F.lit(4)).cast("int")).alias("sub_questions"),
        (F.col("value") > 10).alias("model_needs_event_scope"), (F.pmod("event_id", F.lit(3)) == 0).alias("model_needs_temporal_reasoning"),
    )
    return e.select("event_id", gate(plan).alias("g")).select("event_id", "g.active", "g.reason")


@query(
    """WITH t AS (SELECT doc_id, 'i ' || text AS q, doc_id % 3 AS m FROM documents)
SELECT doc_id, m = 0 AND regexp_matches(lower(CASE WHEN doc_id % 2 = 0 THEN q ELSE text END), '(^|[^\\p{L}\\p{N}_])(i|me|my|mine|myself)($|[^\\p{L}\\p{N}_])') AS by_asker FROM t JOIN documents USING (doc_id)"""
)
def asker_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    text = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("I "), "text")).otherwise(F.col("text"))
    tier = F.when(F.pmod("doc_id", F.lit(3)) == 0, "high").otherwise("low")
    return docs.select("doc_id", asker_query(text, tier, F.lit("P01")).alias("by_asker"))


@query(
    f"""WITH {FACTS_SQL}, {RAW_BM25_SQL}, w AS (SELECT qid, list(node ORDER BY rank DESC)[1:3] AS ids FROM rb GROUP BY qid),
j AS (SELECT rb.*, list_position(ids, node) AS p FROM rb JOIN w USING (qid))
SELECT qid AS item_id, node AS ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY p IS NULL, p, rank) AS INTEGER) AS slot FROM j"""
)
def selected_evidence_first(spark: SparkSession, d: str) -> DataFrame:
    """The three rows a reader picked (here the last ones) move to the front."""
    hits = raw_hits(spark, d)
    picks = hits.groupBy("query_id").agg(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("rank", "ref")))), lambda e: e["ref"]), 1, 3).alias("memory_ids"))
    empty = F.array().cast("array<string>")
    ctx = hits.join(picks, "query_id").select("query_id", F.col("rank").alias("slot"), F.col("ref").alias("node_id"), "memory_ids", empty.alias("wanted_images"), empty.alias("image_ids"))
    out = context.selected_first(ctx, ["query_id"])
    return out.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("ref"), F.col("new_slot").alias("slot"))


@query(
    f"""WITH {FACTS_SQL}, {RAW_BM25_SQL}, {_ROLES_SQL}, before_ids AS (SELECT qid, node FROM rb)
SELECT count(*) AS n, (SELECT count(*) FROM (SELECT * FROM before_ids EXCEPT ALL SELECT qid, node FROM rb)) AS lost, (SELECT count(*) FROM (SELECT qid, node FROM rb EXCEPT ALL SELECT * FROM before_ids)) AS gained FROM rb"""
)
def membership_audit(spark: SparkSession, d: str) -> DataFrame:
    """A rerank changes order and nothing else."""
    from colloquy.operators.audits import difference

    before = raw_hits(spark, d).select("query_id", "ref", F.col("rank").alias("slot"))
    targets = q_items(spark, d).select("query_id", asker().alias("stable"))
    after = context.identity_rerank(before, fact_roles(spark, d), ["query_id"], targets)
    diff = difference(before.select("query_id", "ref"), after.select("query_id", "ref"))
    return diff.withColumn("n", before.agg(F.count("*")).scalar()).select("n", "lost", "gained")


# Sequential algorithms: checked in tests against plain enumeration.


def context_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Collection node, its promoted turns, then projected turns, with references."""
    best = cut_lineage(session_collections(spark, d, 1).select("query_id", F.col("node_id").alias("session_id")))
    raw = cut_lineage(projected(spark, d))
    member = collections.references(facts(spark, d)).select("session_id", "ref")
    # The promoted turns feed the node, its references and the rest.
    near = raw.join(best, "query_id").join(member, ["session_id", "ref"], "left_semi").select("query_id", "ref", F.lit(1).alias("part"), "rank")
    rest = raw.join(near, ["query_id", "ref"], "left_anti").select("query_id", "ref", F.lit(2).alias("part"), "rank")
    rows = near.unionByName(rest).select("query_id", F.concat(F.lit("raw:"), "ref").alias("node_id"), F.lit(False).alias("is_upper"), F.array("ref").alias("refs"), "part", "rank")
    # The node cites the turns it promotes, which are bounded by the projection depth.
    cited = near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda e: e["ref"]).alias("refs"))
    node = best.join(cited, "query_id").select(
        "query_id", F.concat(F.lit("collection:"), "session_id").alias("node_id"), F.lit(True).alias("is_upper"), "refs", F.lit(0).alias("part"), F.lit(0).alias("rank")
    )
    node = cut_lineage(node)
    every = top_k(rows.unionByName(node), ["query_id"], [F.col("part"), F.col("rank"), F.col("node_id")], None, "idx")
    quota = F.least(F.lit(8), F.greatest(F.lit(2), F.size("refs")))
    quotas = node.select("query_id", quota.alias("quota"))
    return every.join(quotas, "query_id", "left").fillna({"quota": 2})


@query()
def pack_context(spark: SparkSession, d: str) -> DataFrame:
    out = packing.pack_context(context_candidates(spark, d), 30)
    return out.select(F.col("query_id").alias("item_id"), "slot", "node_id")


@query()
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Turns of one multi-turn fact made adjacent."""
    ctx = raw_hits(spark, d).join(turns(spark, d).select("ref", "session_id", "ordinal"), "ref")
    multi = fact_hits(spark, d).select("query_id", F.col("node_id").alias("group_id"), F.col("rank").alias("source_rank"))
    links = multi.join(facts(spark, d).filter("size(refer_ids) BETWEEN 2 AND 6").select(F.col("node_id").alias("group_id"), F.explode("refer_ids").alias("ref")), "group_id")
    groups = links.groupBy("query_id", "ref").agg(F.array_sort(F.collect_set(F.struct("group_id", "source_rank"))).alias("groups"))
    none = F.array().cast("array<struct<group_id:string,source_rank:int>>")
    rows = ctx.join(groups, ["query_id", "ref"], "left").select(
        "query_id", F.col("rank").alias("slot"), F.col("ref").alias("node_id"),
        F.concat_ws("\x01", F.lit("1"), F.lit("9999-12-31"), "session_id", F.lpad(F.col("ordinal").cast("string"), 10, "0")).alias("date_key"),
        F.coalesce("groups", none).alias("groups"),
    )
    return packing.evidence_bundles(rows).select(F.col("query_id").alias("item_id"), F.col("new_slot").alias("slot"), F.col("node_id").alias("ref"), "bundle")


@query()
def anchor_pack(spark: SparkSession, d: str) -> DataFrame:
    """Relevance prefix, anchors with their related turns, then filler."""
    base = raw_hits(spark, d).select("query_id", F.lit("base").alias("part"), F.col("rank").alias("pos"), F.col("ref").alias("node_id"), F.lit("").alias("owner"))
    anchors = cut_lineage(raw_anchors(spark, d))
    heads = anchors.select("query_id", F.lit("anchor").alias("part"), F.col("anchor").alias("pos"), F.col("ref").alias("node_id"), F.lit("").alias("owner"))
    raw = turns(spark, d).select("ref", "session_id", "ordinal", "reply_to")
    addressed = fact_refs(facts(spark, d)).select("node_id", "ref")
    related = relations.expand(anchors, raw, addressed).select(
        "query_id", F.lit("related").alias("part"), F.col("rank").alias("pos"), F.col("other").alias("node_id"), F.col("anchor_ref").alias("owner")
    )
    out = packing.anchor_pack(base.unionByName(heads).unionByName(related))
    return out.select(F.col("query_id").alias("item_id"), "slot", F.col("node_id").alias("ref"))
