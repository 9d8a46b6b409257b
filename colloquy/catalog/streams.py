"""Streaming twins of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.build import _WINDOWS, SHORT
from colloquy.catalog.registry import query
from colloquy.sources.tables import TURN_SLOTS, TURNS_SQL, table, turns, turns_of
from colloquy.operators.ranking import top_k
from colloquy.streaming import boundaries, changelog
from colloquy.streaming.jobs import drain, fresh_location, table_stream
from colloquy.streaming.speakers import match_stream
from colloquy.streaming.windows import closing_windows, window_stream


@query()
def stream_speaker_match(spark: SparkSession, d: str) -> DataFrame:
    """Prototype matching over a stream of turns joined with their voices."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    slot = F.pmod(F.col("conv_id") * TURN_SLOTS + F.col("turn_idx"), F.lit(e.count()))
    t = turns_of(table_stream(spark, d, "conversations")).withColumn("vec_id", slot).join(e, "vec_id")
    out = match_stream(t.withColumn("vec", F.col("embedding")), ["conv_id", "turn_idx"], ["case_id", "ref"])
    decided = drain(out, fresh_location(spark, "speakers"))
    return decided.select("case_id", "ref", "speaker", "created", F.round("top_cosine", 9).alias("top_cosine"), "updated")


@query(
    f"""WITH {_WINDOWS} SELECT session_id, CAST(start AS BIGINT) AS start, CAST(count(*) AS INTEGER) AS n_turns, arg_min(ref, off) AS first_ref, arg_max(ref, off) AS last_ref
FROM member WHERE form = 'short' GROUP BY session_id, start"""
)
def stream_turn_windows(spark: SparkSession, d: str) -> DataFrame:
    """Stride windows emitted while the stream runs, and the last window of each session after its end."""
    streamed = drain(window_stream(turns_of(table_stream(spark, d, "conversations")), **SHORT), fresh_location(spark, "windows"))
    return streamed.unionByName(closing_windows(turns(spark, d), **SHORT))


def modal_names(turns: DataFrame) -> DataFrame:
    """``(case_id, ref, label)``: every turn under the first word that its speaker uses most often to begin with."""
    first = turns.withColumn("word", F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0)).groupBy("case_id", "speaker_ref", "word").agg(F.count("*").alias("n"))
    best = top_k(first, ["case_id", "speaker_ref"], [F.col("n").desc(), F.length("word").desc(), F.col("word").asc()], 1)
    return turns.join(best.select("case_id", "speaker_ref", F.col("word").alias("label")), ["case_id", "speaker_ref"]).select("case_id", "ref", "label")


def _dealt(spark: SparkSession, d: str, location: str, files: int = 4) -> DataFrame:
    """The turns as a stream of several batches: early turns of all cases first."""
    t = turns(spark, d).select("case_id", "conv_id", "session_id", "turn_idx", "ref", "speaker_ref", "text")
    t.repartitionByRange(files, "turn_idx").write.parquet(f"{location}/turns")
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{location}/turns")


@query(
    f"""WITH {TURNS_SQL}, w AS (SELECT case_id, speaker_ref, regexp_extract(lower(text), '[a-z0-9]+') AS word, count(*) AS n FROM turns GROUP BY ALL),
b AS (SELECT case_id, speaker_ref, word FROM w QUALIFY row_number() OVER (PARTITION BY case_id, speaker_ref ORDER BY n DESC, length(word) DESC, word) = 1)
SELECT case_id, ref, word AS label FROM turns JOIN b USING (case_id, speaker_ref)"""
)
def relabelled_turns(spark: SparkSession, d: str) -> DataFrame:
    """Last version of a change log to which four batches of turns were added one after another."""
    location = fresh_location(spark, "relabelled")
    changelog.run(_dealt(spark, d, location), modal_names, location, buckets=4)
    return changelog.as_of(spark, location)


_BOUNDARIES = TURNS_SQL + """,
c AS (SELECT case_id, conv_id, session_id, ref, speaker_ref AS label, regexp_extract(lower(text), '[a-z0-9]+') AS claim FROM turns),
s AS (SELECT case_id, conv_id, session_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY conv_id) AS INTEGER) AS version, count(*) OVER (PARTITION BY case_id) AS last
  FROM (SELECT DISTINCT case_id, conv_id, session_id FROM c)),
b AS (SELECT s.case_id, s.version, s.session_id, c.label, c.claim FROM s JOIN c ON c.case_id = s.case_id AND c.conv_id <= s.conv_id WHERE s.version < s.last),
l AS (SELECT case_id, version, session_id, label, count(*) AS n_turns FROM b GROUP BY ALL),
k AS (SELECT case_id, version, label, claim, count(*) AS n FROM b WHERE claim <> '' GROUP BY case_id, version, label, claim QUALIFY row_number() OVER (PARTITION BY case_id, version, label ORDER BY n DESC, length(claim) DESC, claim) = 1),
t AS (SELECT l.*, coalesce(claim, '') AS name, coalesce(n, 0) AS claims, CASE WHEN claim IS NULL THEN label ELSE min(label) OVER (PARTITION BY case_id, version, claim) END AS stable FROM l LEFT JOIN k USING (case_id, version, label))"""


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """Identity tables at all session boundaries, from one stateful stream."""
    boundaries.use_rocksdb(spark)
    stream = turns_of(table_stream(spark, d, "conversations")).select(
        "case_id", F.col("conv_id").alias("session_no"), "turn_idx", "session_id", F.col("speaker_ref").alias("label"), F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0).alias("claim")
    )
    return drain(boundaries.boundary_stream(stream), fresh_location(spark, "boundaries"))


@query(f"WITH {_BOUNDARIES} SELECT case_id, version, session_id, label, name, stable, n_turns, claims FROM t")
def boundary_tables(spark: SparkSession, d: str) -> DataFrame:
    """One identity table per finished session, each carried on from the one before."""
    return _tables(spark, d).fillna("", ["name"])


@query(f"WITH {_BOUNDARIES} SELECT c.ref, t.version, t.name, t.stable FROM c JOIN t ON t.case_id = c.case_id AND t.session_id = c.session_id AND t.label = c.label")
def boundary_payload(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with the identity of its speaker at the end of the session."""
    t = turns(spark, d).select("case_id", "session_id", F.col("speaker_ref").alias("label"), "ref")
    return boundaries.payload(t, _tables(spark, d)).fillna("", ["name"]).select("ref", "version", "name", "stable")
