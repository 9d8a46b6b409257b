"""Runs a bounded stream to its end and reads the sink back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colloquy.session import shared_dir


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table as a file stream with its own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def fresh_location(spark: SparkSession, name: str) -> str:
    """A new folder of the shared directory, for a run that nothing will take up again."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(out: DataFrame, location: str) -> DataFrame:
    """Process everything available into ``location`` and read it back.

    Offsets, state and committed files live there.  A driver that starts again with
    the same location goes on after the last committed batch and repeats no output.
    """
    spark = out.sparkSession
    base = location.rstrip("/")
    q = (
        out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")
