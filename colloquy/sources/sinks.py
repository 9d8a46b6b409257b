"""Write-once outputs, resumable work and external calls with an exact cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.errors import ContractViolation
from colloquy.session import cut_lineage


def write_once(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a new table; an existing output is never replaced."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table that may not exist yet."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a stored result for the same keys (and fingerprint, if among them)."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(*parts: str) -> F.Column:
    """Digest of the inputs that make a stored result reusable."""
    return F.sha2(F.to_json(F.struct(*[F.lit(p).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def call_external(rows: DataFrame, message: str, make_client: Callable[[], Callable[[str], str]], attempts: int = 4) -> DataFrame:
    """``rows`` plus ``response`` and ``attempt`` from a service opened once per task.

    A call that fails every attempt gives a NULL response; nothing is invented.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("attempt", T.IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(text: str) -> tuple[str | None, int]:
            for attempt in range(1, attempts + 1):
                try:
                    return client(text), attempt
                except Exception:  # the service decides what it raises
                    continue
            return None, attempts

        for pdf in frames:
            answers = [one(text) for text in pdf[message]]
            yield pdf.assign(response=[a for a, _ in answers], attempt=pd.Series([n for _, n in answers], index=pdf.index, dtype="int32"))

    return rows.mapInPandas(run, schema)


def cached_calls(rows: DataFrame, cache: DataFrame, message: str, make_client: Callable[[], Callable[[str], str]], contract: str = "") -> tuple[DataFrame, DataFrame]:
    """Answered rows and the new cache rows to append; equal messages are called once.

    The answers are written to the shared folder before anything reads them, so both
    results hold the same ones and the service is not asked again.
    """
    keyed = rows.withColumn("contract_sha256", F.sha2(F.concat_ws("\x01", F.lit(contract), F.col(message)), 256))
    misses = keyed.select("contract_sha256", message).dropDuplicates(["contract_sha256"]).join(cache.select("contract_sha256"), "contract_sha256", "left_anti")
    fresh = cut_lineage(call_external(misses, message, make_client).select("contract_sha256", "response", "attempt").filter("response IS NOT NULL"))
    known = cache.select("contract_sha256", "response").unionByName(fresh.select("contract_sha256", "response"))
    return keyed.join(known, "contract_sha256", "left"), fresh


def judge_scores(answers: DataFrame, raw: str = "response") -> DataFrame:
    """Scores in [0, 1] from judge output; anything else is left for another attempt."""
    from colloquy.functions.jsonish import object_text

    score = F.get_json_object(object_text(raw), "$.score").try_cast("double")
    return answers.withColumn("score", F.when(score.between(0.0, 1.0), score))


def event_cards(facts: DataFrame, case: str, view: str) -> DataFrame:
    """Facts in the event-card layout, numbered per session; a fact cites one session."""
    from colloquy.operators.audits import require_empty
    from colloquy.operators.ranking import positions_by_hash

    homes = F.array_distinct(F.transform("refer_ids", lambda r: F.split_part(r, F.lit(":"), F.lit(1))))
    require_empty(facts.filter(F.size(homes) != 1).select("node_id"), "fact cites several sessions")
    placed = positions_by_hash(facts.withColumn("session_id", F.get(homes, F.lit(0))), ["session_id"], "node_id", 6)
    atomic = F.struct("retrieval_text", F.col("text").alias("display_text"), "speaker", "addressee", "context_operations", F.col("refer_ids").alias("source_turn_ids"), "refer_ids")
    return placed.select(
        F.lit(case).alias("case_name"), F.lit(view).alias("view_name"), "session_id", F.format_string("CF%04d", (F.col("pos") + 1).cast("int")).alias("event_id"),
        F.col("node_id").alias("card_id"), F.array(atomic).alias("atomic_facts"), F.col("text").alias("summary"), "retrieval_text", F.lit(1.0).alias("confidence"),
    )


def read_event_cards(cards: DataFrame) -> DataFrame:
    """Facts back from event cards; empty texts and facts without references are dropped."""
    facts = cards.select("session_id", F.explode("atomic_facts").alias("f"))
    return facts.select("session_id", F.trim("f.retrieval_text").alias("text"), "f.refer_ids").filter("text <> '' AND size(refer_ids) > 0")


def require_new(spark: SparkSession, *paths: str) -> None:
    """Stop before any work if an output is already there."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            raise ContractViolation(f"refusing to overwrite {path}")
