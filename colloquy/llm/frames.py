"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.session import shared_dir


# Bytes of one Arrow batch that is handed to a Python task.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes: a row may hold a long text or a packed block."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy is columnar and compressed, survives the loss of any executor, and
    later passes read only the columns they need.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_of(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def fold_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


# Keys up to which a list is broadcast: 16 bytes each and the table around them stay under 64 MB.
BROADCAST_KEYS = 500_000


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among ``keys``; null is never among them.

    The list is counted first.  A short one is broadcast, so ``df`` does not move; a
    longer one is joined by shuffle.
    """
    listed = stored(keys.select(column).distinct(), "keys")
    return df.join(F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed, column, "left_anti")
