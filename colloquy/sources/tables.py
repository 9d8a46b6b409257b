"""The memory model read from the star-schema tables.

Conversations are raw turns (one conversation is one session, sixteen sessions
are one case), their user and assistant turns yield one grounded fact each,
documents are a text corpus grouped by source, benchmark items are questions and
embeddings are acoustic or image vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.dates import unified_turn_id
from colloquy.functions.ids import fact_id
from colloquy.functions.text import collapse, text_key

SESSIONS_PER_CASE = 16
PERSONS = 12
TURN_SLOTS = 8


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark", "item_id", "text")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents", *(columns or ("doc_id", "text")))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns_of(table(spark, folder, "conversations"))


def turns_of(c: DataFrame) -> DataFrame:
    """Raw turns from conversation rows, batch or stream."""
    session = F.concat(F.lit("S"), F.col("conv_id").cast("string"))
    person = F.format_string("P%02d", F.pmod("conv_id", F.lit(PERSONS)))
    ref = unified_turn_id(session, F.col("turn"))
    return c.select(
        "conv_id",
        F.format_string("C%04d", F.floor(F.col("conv_id") / SESSIONS_PER_CASE)).alias("case_id"),
        session.alias("session_id"),
        F.col("turn").cast("int").alias("turn_idx"),
        (F.col("turn") + 1).cast("int").alias("ordinal"),
        ref.alias("ref"),
        F.concat(F.lit("raw:"), ref).alias("node_id"),
        F.col("role").alias("speaker"),
        F.when(F.col("role") == "user", person).otherwise(F.upper("role")).alias("speaker_ref"),
        "text",
        F.when((F.col("role") == "assistant") & (F.col("turn") > 0), unified_turn_id(session, F.col("turn") - 1)).alias("reply_to"),
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """One fact per user or assistant turn; an answer also cites what it answers."""
    t = turns(spark, folder).filter(F.col("speaker").isin("user", "assistant"))
    person = F.format_string("P%02d", F.pmod("conv_id", F.lit(PERSONS)))
    answered = F.col("reply_to").isNotNull()
    refs = F.when(answered, F.array("reply_to", "ref")).otherwise(F.array("ref"))
    f = t.select(
        "case_id",
        "session_id",
        "ordinal",
        "ref",
        collapse("text").alias("text"),
        F.when(F.col("speaker") == "user", person).otherwise("assistant").alias("speaker"),
        F.when(F.col("speaker") == "user", F.lit("assistant")).otherwise(person).alias("addressee"),
        F.col("speaker_ref").alias("source_speaker_ref"),
        refs.alias("refer_ids"),
        F.when(answered, F.array(F.lit("reply_resolution"))).otherwise(F.array().cast("array<string>")).alias("context_operations"),
    )
    key = text_key("text")
    return f.withColumn("node_id", fact_id("speaker", key, "refer_ids")).withColumn(
        "retrieval_text", F.concat(F.lit("speaker="), "speaker", F.lit("; addressee="), "addressee", F.lit("; "), "text")
    )


def fact_refs(f: DataFrame) -> DataFrame:
    return f.select("node_id", F.posexplode("refer_ids").alias("pos", "ref"))


def turn_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with its acoustic vector; the vector table is reused in id order."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    n = e.agg(F.count("*")).scalar()
    slot = F.pmod(F.col("conv_id") * TURN_SLOTS + F.col("turn_idx"), n)
    t = turns(spark, folder).select("case_id", "conv_id", "session_id", "turn_idx", "ordinal", "ref", "speaker_ref")
    return t.withColumn("vec_id", slot).join(e, "vec_id")


# The same views for the checking engine.
TURNS_SQL = """turns AS (
  SELECT conv_id, format('C{:04d}', conv_id // 16) AS case_id, 'S' || conv_id AS session_id,
         CAST(turn AS INTEGER) AS turn_idx, CAST(turn + 1 AS INTEGER) AS ordinal,
         format('S{}_T{:03d}', conv_id, turn + 1) AS ref, role AS speaker,
         CASE WHEN role = 'user' THEN format('P{:02d}', conv_id % 12) ELSE upper(role) END AS speaker_ref,
         format('P{:02d}', conv_id % 12) AS person, text,
         CASE WHEN role = 'assistant' AND turn > 0 THEN format('S{}_T{:03d}', conv_id, turn) END AS reply_to
  FROM conversations)"""

FACTS_SQL = TURNS_SQL + r""",
facts_k AS (
  SELECT case_id, session_id, ordinal, ref, reply_to, speaker_ref AS source_speaker_ref,
         trim(regexp_replace(text, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS text,
         CASE WHEN speaker = 'user' THEN person ELSE 'assistant' END AS speaker,
         CASE WHEN speaker = 'user' THEN 'assistant' ELSE person END AS addressee,
         CASE WHEN reply_to IS NOT NULL THEN [reply_to, ref] ELSE [ref] END AS refer_ids,
         CASE WHEN reply_to IS NOT NULL THEN 1 ELSE 0 END AS n_ops
  FROM turns WHERE speaker IN ('user', 'assistant')),
facts AS (
  SELECT *, 'speaker=' || speaker || '; addressee=' || addressee || '; ' || text AS retrieval_text,
         'fact:' || substr(sha1('{"refer_ids": [' ||
           list_aggregate(list_transform(refer_ids, lambda r: '"' || r || '"'), 'string_agg', ', ') || '], "speaker": "' || speaker || '", "text": "' ||
           trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) || '"}'), 1, 16) AS node_id
  FROM facts_k),
fact_refs AS (SELECT node_id, unnest(refer_ids) AS ref, generate_subscripts(refer_ids, 1) - 1 AS pos FROM facts)"""

TURN_VECTORS_SQL = TURNS_SQL + """,
turn_vectors AS (
  SELECT t.case_id, t.conv_id, t.session_id, t.turn_idx, t.ordinal, t.ref, t.speaker_ref, e.vec_id,
         CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM turns t JOIN embeddings e ON e.vec_id = (t.conv_id * 8 + t.turn_idx) % (SELECT count(*) FROM embeddings))"""


def bm25_sql(name: str, corpus: str, node: str, text: str, queries: str, qid: str, qtext: str, k: int, terms_filter: str = "") -> str:
    """CTEs ending in ``name(qid, node, score, rank)``."""
    return f"""
{name}_tok AS (SELECT {node} AS node, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {corpus}),
{name}_len AS (SELECT {node} AS node, len(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS dl FROM {corpus}),
{name}_tf AS (SELECT node, term, count(*) AS tf FROM {name}_tok GROUP BY node, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len),
{name}_qt AS (SELECT DISTINCT {qid} AS qid, term FROM (SELECT {qid}, unnest(regexp_extract_all(lower({qtext}), '[a-z0-9]+')) AS term FROM {queries}) {terms_filter}),
{name}_sc AS (
  SELECT q.qid, t.node, sum(ln(1e0 + (s.n - d.df + 5e-1) / (d.df + 5e-1)) * t.tf * 2.5e0
         / (t.tf + 1.5e0 * (2.5e-1 + 7.5e-1 * l.dl / greatest(s.avgdl, 1e-6)))) AS score
  FROM {name}_qt q JOIN {name}_tf t USING (term) JOIN {name}_df d USING (term) JOIN {name}_len l USING (node), {name}_st s
  GROUP BY q.qid, t.node),
{name} AS (SELECT * FROM (
  SELECT qid, node, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank
  FROM {name}_sc WHERE score > 0) WHERE rank <= {k})"""
