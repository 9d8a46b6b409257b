"""Content-addressed vectors: an encoder sees every distinct text once, whatever asks for it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.sources.encoders import missing_vectors
from colloquy.sources.sinks import read_or_empty

Encode = Callable[[DataFrame, str, str], DataFrame]


class VectorCache:
    """Vectors in a table keyed by the signature of their text.

    ``encode(df, id, text) -> (id, vec)`` asks the wrapped encoder for the texts that the
    table lacks, appends them under a part of their own and answers from the table.  A
    part counts once its write has succeeded, and the same signature in two parts, as
    two runs at once may leave it, is read as one.  Different encoders need different
    locations.
    """

    def __init__(self, spark: SparkSession, location: str, encoder: Encode):
        self.spark, self.location, self.encoder = spark, location.rstrip("/"), encoder

    def table(self) -> DataFrame:
        """``(signature, vec)`` of everything encoded so far."""
        stored = read_or_empty(self.spark, f"{self.location}/vectors", "signature string, vec array<double>, part string")
        return stored.select("signature", "vec").dropDuplicates(["signature"])

    def __call__(self, df: DataFrame, node: str, text: str) -> DataFrame:
        signed = df.select(node, text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("signature"))
        # A null text is encoded as an empty one.
        asked = signed.select(F.coalesce(text, F.lit("")).alias("text"))
        wanted = missing_vectors(asked, self.table())
        fresh = self.encoder(wanted, "signature", "text")
        path = f"{self.location}/vectors/part={uuid.uuid4().hex}"
        fresh.select("signature", "vec").write.parquet(path)
        return signed.select(node, "signature").join(self.table(), "signature").select(node, "vec")

    def warm(self, *texts: tuple[DataFrame, str]) -> None:
        """Encode several columns in one pass, so that later requests find them all."""
        every = None
        for df, text in texts:
            one = df.select(F.coalesce(text, F.lit("")).alias("text"))
            every = one if every is None else every.unionByName(one)
        if every is not None:
            self(every.withColumn("n", F.lit(0)), "n", "text")
