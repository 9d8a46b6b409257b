"""Evaluation summaries and integrity audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.provenance import PROJECTION_SQL, fact_hits, projected
from colloquy.catalog.registry import query
from colloquy.operators import audits, metrics
from colloquy.sources.tables import FACTS_SQL, TURNS_SQL, documents, fact_refs, facts, table, turns

_RESULTS = """res AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS DOUBLE) AS control, (l.quality + 1 - l.toxic) / 2e0 AS blended, 1e0 - l.toxic AS clean
  FROM documents d JOIN labels l USING (doc_id))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as scored questions of three arms."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    return docs.select("doc_id", "lang", "source", q.alias("control"), ((q + 1.0 - t) / 2.0).alias("blended"), (F.lit(1.0) - t).alias("clean"))


@query(f"WITH {_RESULTS} SELECT lang, count(DISTINCT source) AS topics, count(*) AS qa, round(avg(control), 9) AS mean_score FROM res GROUP BY lang")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(results(spark, d), "lang", "source", "control")
    return s.withColumn("mean_score", F.round("mean_score", 9))


@query(
    f"""WITH {_RESULTS}, lv AS (SELECT coalesce(source, '*') AS case_id, coalesce(lang, '*') AS point, count(*) AS n, avg(blended) AS a, avg(CAST(blended >= 75e-2 AS INTEGER)) AS c FROM res GROUP BY ROLLUP (source, lang)),
cs AS (SELECT source, avg(blended) AS a, avg(CAST(blended >= 75e-2 AS INTEGER)) AS c FROM res GROUP BY source)
SELECT case_id, point, n, round(a, 9) AS avg_score, round(c, 9) AS acc FROM lv UNION ALL SELECT 'macro', '*', count(*), round(avg(a), 9), round(avg(c), 9) FROM cs"""
)
def acc_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    levels = metrics.by_level(r, "source", "lang", "blended").select(
        F.coalesce("source", F.lit("*")).alias("case_id"), F.coalesce("lang", F.lit("*")).alias("point"), "n", "avg_score", "acc"
    )
    overall = metrics.macro(r, "source", "blended").select(F.lit("macro").alias("case_id"), F.lit("*").alias("point"), "n", "avg_score", "acc")
    return levels.unionByName(overall).withColumn("avg_score", F.round("avg_score", 9)).withColumn("acc", F.round("acc", 9))


@query(
    f"""WITH {PROJECTION_SQL}, gold AS (SELECT DISTINCT fb.qid, r.ref FROM fb JOIN fact_refs r ON r.node_id = fb.node WHERE fb.rank <= 3),
got AS (SELECT qid, ref FROM proj WHERE rank <= 5)
SELECT g.qid AS item_id, count(*) AS n_gold, count(got.ref) AS matched, round(count(got.ref) / CAST(count(*) AS DOUBLE), 9) AS recall FROM gold g LEFT JOIN got USING (qid, ref) GROUP BY g.qid"""
)
def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at five of the turns behind each question's three best facts."""
    gold = fact_hits(spark, d, 3).join(fact_refs(facts(spark, d)), "node_id").select("query_id", "ref")
    out = metrics.evidence_recall(gold, projected(spark, d).filter("rank <= 5"))
    return out.select(F.col("query_id").alias("item_id"), "n_gold", "matched", F.round("recall", 9).alias("recall"))


@query(
    f"""WITH {_RESULTS} SELECT source, count(*) FILTER (WHERE blended > control) AS wins, count(*) FILTER (WHERE blended = control) AS ties, count(*) FILTER (WHERE blended < control) AS losses,
  round(avg(blended - control), 9) AS mean_gain FROM res GROUP BY source"""
)
def paired_wtl(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    arms = F.array(F.struct(F.lit("new").alias("arm"), F.col("blended").alias("score")), F.struct(F.lit("old").alias("arm"), F.col("control").alias("score")))
    long = r.select(F.col("source").alias("case_id"), F.col("doc_id").alias("qa_id"), F.explode(arms).alias("a")).select("case_id", "qa_id", "a.arm", "a.score")
    pairs = metrics.paired(long, "new", "old")
    out = metrics.win_tie_loss(pairs, "new", "old", ("case_id",))
    return out.withColumnRenamed("case_id", "source").withColumn("mean_gain", F.round("mean_gain", 9))


@query(
    f"""WITH {_RESULTS}, long AS (SELECT lang, 'control' AS arm, control AS s FROM res UNION ALL SELECT lang, 'blended', blended FROM res UNION ALL SELECT lang, 'clean', clean FROM res)
SELECT coalesce(lang, 'ALL') AS cohort, arm, count(*) AS n, round(avg(s), 9) AS mean_score, avg(s) >= 75e-2 AS passes FROM long GROUP BY GROUPING SETS ((lang, arm), (arm))"""
)
def cohort_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every cohort and the whole, per arm, with an acceptance gate."""
    long = results(spark, d).unpivot(["lang"], ["control", "blended", "clean"], "arm", "s")
    out = long.groupingSets([["lang", "arm"], ["arm"]], "lang", "arm").agg(F.count("*").alias("n"), F.avg("s").alias("m"))
    return out.select(F.coalesce("lang", F.lit("ALL")).alias("cohort"), "arm", "n", F.round("m", 9).alias("mean_score"), (F.col("m") >= metrics.CORRECT).alias("passes"))


EVENT_FINE = {"click": "personalized_qa", "view": "retrieval_reasoning", "purchase": "memory_evolution_conflict"}
EVENT_PREFIX = {"ERROR": "interaction_attribution", "VIEW": "retrieval_reasoning"}


@query(
    """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 4 = 0 THEN 'personalized_qa' END AS formal, CASE WHEN event_id % 4 IN (1, 2) THEN event_type END AS fine,
  upper(event_type) || '_' || event_id AS qa_id FROM events),
f AS (SELECT *, CASE fine WHEN 'click' THEN 'personalized_qa' WHEN 'view' THEN 'retrieval_reasoning' WHEN 'purchase' THEN 'memory_evolution_conflict' END AS by_fine,
  CASE WHEN starts_with(qa_id, 'ERROR_') THEN 'interaction_attribution' WHEN starts_with(qa_id, 'VIEW_') THEN 'retrieval_reasoning' END AS by_prefix FROM e)
SELECT coalesce(formal, by_fine, by_prefix, 'unmapped') AS category,
  CASE WHEN formal IS NOT NULL THEN 'formal_four_way_category' WHEN by_fine IS NOT NULL THEN 'legacy_fine_category' WHEN by_prefix IS NOT NULL THEN 'qa_id_prefix' ELSE 'unmapped' END AS label_source,
  count(*) AS n, round(avg(value), 6) AS mean_value FROM f GROUP BY ALL"""
)
def four_way_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type", "value")
    m = F.pmod("event_id", F.lit(4))
    qa_id = F.concat_ws("_", F.upper("event_type"), F.col("event_id").cast("string"))
    label = metrics.category(F.when(m == 0, "personalized_qa"), F.when(m.isin(1, 2), F.col("event_type")), qa_id, EVENT_FINE, EVENT_PREFIX)
    out = e.select(label.alias("l"), "value").groupBy(F.col("l.category").alias("category"), F.col("l.source").alias("label_source"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT * FROM (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 5")
def first_n_per_type(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_per_type(table(spark, d, "orders", "o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 5)


@query(
    """SELECT * FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('panel-v1|' || c_mktsegment || '|' || c_custkey), c_custkey) AS INTEGER) AS place FROM customer) WHERE place <= 25"""
)
def hash_panel(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hash_panel(table(spark, d, "customer", "c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 25, "panel-v1").drop("digest")


@query(
    f"""WITH {_RESULTS} SELECT lang, count(*) AS n, round(avg(blended), 9) AS mean_score, count(*) FILTER (WHERE doc_id % 3 = 0) AS asker_only, count(*) FILTER (WHERE doc_id % 3 <> 0) AS global_scope, count(*) FILTER (WHERE doc_id % 3 <> 0 AND blended = control) AS reused FROM res GROUP BY lang"""
)
def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("scope", F.when(F.pmod("doc_id", F.lit(3)) == 0, "asker_only").otherwise("global"))
    r = r.withColumn("kept", (F.col("scope") == "global") & (F.col("blended") == F.col("control")))
    return metrics.scope_summary(r, "lang", "scope", "blended", "kept").withColumn("mean_score", F.round("mean_score", 9))


@query(
    """WITH l AS (SELECT 'run ' || o_orderkey || ' [LLM usage]  calls=' || (o_custkey % 7) || ' prompt=' || o_custkey || ' completion=' || (o_orderkey % 100) || ' total_tokens=' || (o_custkey + o_orderkey % 100 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS t, * FROM orders)
SELECT count(*) AS footers, CAST(sum(o_custkey % 7) AS BIGINT) AS calls, CAST(sum(o_custkey + o_orderkey % 100 + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total_tokens, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS inconsistent FROM l"""
)
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    o, c, hundred = F.col("o_orderkey"), F.col("o_custkey"), F.pmod("o_orderkey", F.lit(100))
    total = c + hundred + F.when(F.pmod("o_orderkey", F.lit(10)) == 0, 1).otherwise(0)
    line = F.concat(
        F.lit("run "), o.cast("string"), F.lit(" [LLM usage]  calls="), F.pmod("o_custkey", F.lit(7)).cast("string"), F.lit(" prompt="), c.cast("string"),
        F.lit(" completion="), hundred.cast("string"), F.lit(" total_tokens="), total.cast("string"),
    )
    return metrics.usage(table(spark, d, "orders", "o_orderkey", "o_custkey").select(line.alias("t")), "t")


@query(
    f"""WITH {FACTS_SQL}, cited AS (SELECT DISTINCT ref FROM fact_refs)
SELECT (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT session_id) FROM turns) AS sessions, (SELECT count(reply_to) FROM turns) AS reply_edges,
  (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM facts WHERE len(refer_ids) > 1) AS cross_turn, (SELECT count(*) FROM cited WHERE ref NOT IN (SELECT ref FROM turns)) AS missing_refs,
  (SELECT count(*) FROM turns WHERE ref NOT IN (SELECT ref FROM cited)) AS uncited_turns"""
)
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    t, f = turns(spark, d).select("ref", "session_id", "reply_to"), facts(spark, d)
    cited = fact_refs(f).select("ref").distinct()
    sizes = t.agg(F.count("*").alias("turns"), F.countDistinct("session_id").alias("sessions"), F.count("reply_to").alias("reply_edges"))
    fact_sizes = f.agg(F.struct(F.count("*").alias("facts"), F.count_if(F.size("refer_ids") > 1).alias("cross_turn"))).scalar()
    missing = cited.join(t.select("ref"), "ref", "left_anti").agg(F.count("*")).scalar()
    uncited = t.select("ref").join(cited, "ref", "left_anti").agg(F.count("*")).scalar()
    out = sizes.withColumn("_f", fact_sizes).withColumn("missing_refs", missing).withColumn("uncited_turns", uncited)
    return out.select("turns", "sessions", "reply_edges", "_f.facts", "_f.cross_turn", "missing_refs", "uncited_turns")


@query(
    f"""WITH {FACTS_SQL}
SELECT 'lineitem_order' AS check_name, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'reply_turn', count(*) FROM turns WHERE reply_to IS NOT NULL AND reply_to NOT IN (SELECT ref FROM turns)
UNION ALL SELECT 'fact_turn', count(*) FROM fact_refs WHERE ref NOT IN (SELECT ref FROM turns)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate_turn', count(*) FROM (SELECT ref FROM turns GROUP BY ref HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'document_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def referential_closure(spark: SparkSession, d: str) -> DataFrame:
    tab = lambda name, *c: table(spark, d, name, *c)
    line, orders, t = tab("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), tab("orders", "o_orderkey", "o_custkey"), turns(spark, d).select("ref", "reply_to")
    docs, labels = tab("documents", "doc_id"), tab("labels", "doc_id")
    checks = {
        "lineitem_order": audits.dangling(line, "l_orderkey", orders, "o_orderkey"),
        "lineitem_part": audits.dangling(line, "l_partkey", tab("part", "p_partkey"), "p_partkey"),
        "lineitem_supplier": audits.dangling(line, "l_suppkey", tab("supplier", "s_suppkey"), "s_suppkey"),
        "order_customer": audits.dangling(orders, "o_custkey", tab("customer", "c_custkey"), "c_custkey"),
        "reply_turn": audits.dangling(t, "reply_to", t, "ref"),
        "fact_turn": audits.dangling(fact_refs(facts(spark, d)), "ref", t, "ref"),
        "label_document": audits.dangling(labels, "doc_id", docs, "doc_id"),
        "duplicate_turn": audits.duplicates(t, "ref"),
        "duplicate_line": audits.duplicates(line, "l_orderkey", "l_linenumber"),
        "document_without_label": audits.dangling(docs, "doc_id", labels, "doc_id"),
    }
    out = None
    for name, bad in checks.items():
        row = audits.count_as(bad, name)
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'matched' END AS status, count(*) AS n
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL OUTER JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k GROUP BY 1"""
)
def coordinate_join_audit(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "k")
    lines = table(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "k")
    return audits.coverage(orders, lines, ["k"])


@query(
    f"""WITH {TURNS_SQL}, b AS (SELECT * EXCLUDE (reply_to) FROM turns), a AS (SELECT * EXCLUDE (reply_to) REPLACE (CASE WHEN conv_id % 50 = 3 AND turn_idx = 1 THEN text || '!' ELSE text END AS text) FROM turns WHERE NOT (conv_id % 70 = 5 AND turn_idx = 0))
SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS lost, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS gained, (SELECT count(reply_to) FROM turns) AS reply_edges, (SELECT count(*) FROM turns) AS turns"""
)
def migration_diff(spark: SparkSession, d: str) -> DataFrame:
    """A migration that adds reply edges, but also changes some texts and loses some turns."""
    new = turns(spark, d)
    changed = F.when((F.pmod("conv_id", F.lit(50)) == 3) & (F.col("turn_idx") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = new.drop("reply_to").filter(~((F.pmod("conv_id", F.lit(70)) == 5) & (F.col("turn_idx") == 0))).withColumn("text", F.sha2(changed, 256))
    diff = audits.difference(new.drop("reply_to").withColumn("text", F.sha2("text", 256)), after)
    sizes = new.agg(F.struct(F.count("reply_to").alias("reply_edges"), F.count("*").alias("turns"))).scalar()
    return diff.withColumn("_s", sizes).select("lost", "gained", "_s.reply_edges", "_s.turns")


@query("SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id)")
def whitelist_projection(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval sees whitelisted fields only; labels are not among them."""
    labelled = documents(spark, d, "doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return audits.safe_projection(labelled, ("doc_id", "lang", "source"))
