"""Text encoders.

A real encoder is an external service and is passed in as a function from texts
to a matrix.  The offline stand-in hashes tokens into a short count vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import tokens
from colloquy.operators.dense import unit_rows
from colloquy.operators.local_topk import row_runs

BUCKETS = 64
TEXT_BATCH = 32
# Tokens a task unrolls at once.
TOKEN_BLOCK = 1 << 20
Encoder = Callable[[list[str]], np.ndarray]


def token_buckets(text: str) -> Column:
    """One small integer per token from its first letter, last letter and length."""
    return F.transform(tokens(text), lambda t: ((F.ascii(t) * 31 + F.ascii(F.right(t, F.lit(1))) * 7 + F.length(t)) % BUCKETS).cast("int"))


def _count_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        counts = np.zeros((len(lists), BUCKETS))
        for lo, hi in row_runs(lengths, TOKEN_BLOCK):
            rows = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            cells = rows * BUCKETS + lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
            counts[lo:hi] = np.bincount(cells, minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
        yield _with_vectors(batch, unit_rows(counts))


def _with_vectors(batch: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    vectors = pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[batch.schema.names[0], "vec"])


def hashed_vectors(df: DataFrame, node: str, text: str) -> DataFrame:
    """``(node, vec)`` from the offline stand-in."""
    source = df.select(node, token_buckets(text).alias("b"))
    return source.mapInArrow(_count_vectors, f"{node} {dict(df.dtypes)[node]}, vec array<double>")


def encode_texts(df: DataFrame, node: str, text: str, make_encoder: Callable[[], Encoder], batch: int = TEXT_BATCH) -> DataFrame:
    """``(node, vec)`` from an external encoder opened once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for full in batches:
            for start in range(0, full.num_rows, batch):
                part = full.slice(start, batch)
                yield _with_vectors(part, unit_rows(np.asarray(encode(part.column(1).to_pylist()), dtype=np.float64)))

    return df.select(node, text).mapInArrow(run, f"{node} {dict(df.dtypes)[node]}, vec array<double>")


def missing_vectors(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts without a cached vector, keyed by their signature."""
    signed = texts.select(F.sha2(text, 256).alias("signature"), text).dropDuplicates(["signature"])
    return signed.join(cache.select("signature"), "signature", "left_anti")
