"""Identity labels as a change log: later evidence takes back and re-labels earlier turns.

Every micro-batch of turns adds to what its cases have heard, resolves those cases anew
and writes only the differences: a retraction of each label that no longer holds and
an assertion of each new one, under the next version of the case.  A batch that is
replayed overwrites its own folder and reads only those before it, so its number makes it
idempotent.  Cases are dealt to buckets, and a batch reads the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from colloquy.sources.sinks import read_or_empty

BUCKETS = 64
CHANGE = "case_id string, case_version int, ref string, label string, kind string, batch bigint, bucket int"
Resolver = Callable[[DataFrame], DataFrame]


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")


def apply_batch(incoming: DataFrame, batch: int, resolve: Resolver, location: str, buckets: int = BUCKETS) -> None:
    """Add one batch of turns and log what it changes.

    ``resolve`` maps the turns of whole cases to ``(case_id, ref, label)``, one row a
    turn.  The batch may hold any cases in any order.
    """
    spark = incoming.sparkSession
    dealt = incoming.withColumn("bucket", _bucket(buckets))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{location}/heard/batch={batch}")
    mine = spark.read.schema(dealt.schema).parquet(f"{location}/heard/batch={batch}")
    # At most ``buckets`` numbers.
    touched = [r[0] for r in mine.select("bucket").distinct().collect()]
    cases = mine.select("case_id").distinct()
    told = spark.read.option("basePath", f"{location}/heard").schema(T.StructType([*dealt.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{location}/heard")
    heard = told.filter((F.col("batch") <= batch) & F.col("bucket").isin(touched)).join(cases, "case_id", "left_semi")
    now = resolve(heard.drop("batch", "bucket")).select("case_id", "ref", F.col("label").alias("new"))
    log = read_log(spark, location).filter((F.col("batch") < batch) & F.col("bucket").isin(touched)).join(cases, "case_id", "left_semi")
    before = _latest(log).select("case_id", "ref", F.col("label").alias("old"))
    version = log.groupBy("case_id").agg(F.max("case_version").alias("_v"))
    both = now.withColumn("_n", F.lit(True)).join(before.withColumn("_o", F.lit(True)), ["case_id", "ref"], "full").filter("_n IS NULL OR _o IS NULL OR NOT (new <=> old)")
    kinds = F.array(
        F.when(F.col("_o"), F.struct(F.lit("retract").alias("kind"), F.col("old").alias("label"))),
        F.when(F.col("_n"), F.struct(F.lit("assert").alias("kind"), F.col("new").alias("label"))),
    )
    changes = both.select("case_id", "ref", F.explode(F.array_compact(kinds)).alias("c")).join(version, "case_id", "left")
    out = changes.select("case_id", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("case_version"), "ref", "c.label", "c.kind").withColumn("bucket", _bucket(buckets))
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{location}/changes/batch={batch}")


def read_log(spark: SparkSession, location: str) -> DataFrame:
    """Every change ever made: ``case_id, case_version, ref, label, kind, batch, bucket``."""
    return read_or_empty(spark, f"{location}/changes", CHANGE)


def _latest(log: DataFrame) -> DataFrame:
    """Labels that hold after all changes of ``log``: per turn the last assertion, unless it was taken back."""
    last = log.groupBy("case_id", "ref").agg(F.max_by(F.struct("kind", "label"), F.struct("batch", F.col("kind") == "assert")).alias("c"))
    return last.filter("c.kind = 'assert'").select("case_id", "ref", "c.label")


def as_of(spark: SparkSession, location: str, batch: int | None = None) -> DataFrame:
    """``(case_id, ref, label)`` as it stood after a batch, or now."""
    log = read_log(spark, location)
    return _latest(log if batch is None else log.filter(F.col("batch") <= batch))


def as_of_version(spark: SparkSession, location: str, versions: DataFrame) -> DataFrame:
    """``(case_id, ref, label)`` of the cases in ``versions(case_id, case_version)``, each as it stood then."""
    wanted = versions.select("case_id", F.col("case_version").alias("_v"))
    return _latest(read_log(spark, location).join(wanted, "case_id").filter("case_version <= _v").drop("_v"))


def run(turns: DataFrame, resolve: Resolver, location: str, buckets: int = BUCKETS) -> None:
    """Log a stream of turns to its present end; a run at the same location goes on after the last batch."""
    query = (
        turns.writeStream.foreachBatch(lambda df, number: apply_batch(df, number, resolve, location, buckets))
        .option("checkpointLocation", f"{location}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
