"""Exact dot-product retrieval as a block matrix product inside Arrow batches.

Question vectors travel to the tasks in chunks of a fixed byte size; a larger
question set takes more passes.  Each task keeps a running top-k, so scored
pairs are never written out or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.local_topk import ARROW, SCORE_BLOCK, LocalTopK
from colloquy.operators.ranking import SCORE_DIGITS, by_score, top_k

CHUNK_BYTES = 64 << 20
CHUNK_QUERIES = 4096


# Keys whose partial sums a task holds.
MEAN_KEYS = 4096


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def unit_rows(m: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), floor)


def _scan(queries: np.ndarray, best: LocalTopK):
    """Task function: batches of (node_id, vec[, grp]) to local winners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORE_BLOCK // len(queries))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                groups = part.column(2).to_numpy(zero_copy_only=False) if best.group_type else None
                best.offer(matrix(part.column(1)) @ queries.T, part.column(0).to_numpy(zero_copy_only=False), groups)
        out = best.batch(["query_id"])
        if out is not None:
            yield out

    return run


def query_chunks(queries: DataFrame, qid: str, vec: str) -> Iterator[tuple[list, np.ndarray]]:
    """Question vectors in driver-side chunks of bounded size and count."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    total = (size["n"] or 0) * (size["d"] or 0) * 8
    chunks = max(1, -(-total // CHUNK_BYTES), -(-(size["n"] or 0) // CHUNK_QUERIES))
    for c in range(chunks):
        part = queries if chunks == 1 else queries.filter(F.pmod(F.xxhash64(qid), F.lit(chunks)) == c)
        table = part.select(F.col(qid).alias("q"), F.col(vec).alias("v")).toArrow()
        if table.num_rows:
            yield table.column("q").to_pylist(), matrix(table.column("v"))


def all_queries(queries: DataFrame, qid: str, vec: str) -> tuple[list, np.ndarray]:
    """Every question vector at once, for callers that already bound their number."""
    parts = list(query_chunks(queries, qid, vec))
    return [n for names, _ in parts for n in names], np.concatenate([b for _, b in parts])


def dense_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 30,
    node: str = "node_id",
    vec: str = "vec",
    qid: str = "query_id",
    query_vec: str = "vec",
    group: str | None = None,
) -> DataFrame:
    """Best ``k`` corpus rows per question, or per (question, group)."""
    spark = corpus.sparkSession
    columns = [F.col(node).alias("node_id"), F.col(vec).alias("vec")] + ([F.col(group).alias("grp")] if group else [])
    source = corpus.select(*columns)
    types = dict(source.dtypes)
    qtype = dict(queries.dtypes)[qid]
    schema = f"query_id {qtype}, node_id {types['node_id']}, score double" + (f", grp {types['grp']}" if group else "")
    passes = []
    for names, block in query_chunks(queries, qid, query_vec):
        shipped = spark.sparkContext.broadcast((names, block))

        def task(batches, shipped=shipped):
            names, block = shipped.value
            best = LocalTopK([(n,) for n in names], [qtype], types["node_id"], k, types.get("grp"))
            return _scan(block, best)(batches)

        passes.append(source.mapInArrow(task, schema))
    if not passes:
        return spark.createDataFrame([], schema + ", rank int")
    merged = passes[0]
    for extra in passes[1:]:
        merged = merged.unionAll(extra)
    keys = ["query_id"] + (["grp"] if group else [])
    return top_k(merged, keys, by_score("score", "node_id"), k)


def nearest_queries(
    corpus: DataFrame, queries: DataFrame, k: int, node: str = "node_id", vec: str = "vec", qid: str = "query_id", query_vec: str = "vec"
) -> DataFrame:
    """The ``k`` nearest question vectors of every corpus row, without a shuffle.

    With several question chunks the per-chunk winners are merged per row.
    """
    spark = corpus.sparkSession
    source = corpus.select(F.col(node).alias("node_id"), F.col(vec).alias("vec"))
    ntype, qtype = dict(source.dtypes)["node_id"], dict(queries.dtypes)[qid]
    schema = f"node_id {ntype}, query_id {qtype}, score double, rank int"
    passes = []
    for names, block in query_chunks(queries, qid, query_vec):
        order = np.argsort(np.array(names))
        shipped = spark.sparkContext.broadcast(([names[j] for j in order], block[order]))

        def task(batches, shipped=shipped):
            names, block = shipped.value
            wanted = min(k, len(names))
            for batch in batches:
                step = max(1, SCORE_BLOCK // len(names))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    scores = matrix(part.column(1)) @ block.T
                    # Names are sorted, so a stable sort settles ties by name.
                    best = np.argsort(-np.round(scores, SCORE_DIGITS), axis=1, kind="stable")[:, :wanted]
                    rows = np.repeat(np.arange(len(scores)), wanted)
                    cols = best.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows)), pa.array([names[j] for j in cols], ARROW[qtype]), pa.array(scores[rows, cols]),
                         pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(scores)))],
                        names=["node_id", "query_id", "score", "rank"],
                    )

        passes.append(source.mapInArrow(task, schema))
    if not passes:
        return spark.createDataFrame([], schema)
    if len(passes) == 1:
        return passes[0]
    merged = passes[0]
    for extra in passes[1:]:
        merged = merged.unionAll(extra)
    return top_k(merged.drop("rank"), ["node_id"], by_score("score", "query_id"), k)


def mean_vectors(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Normalised mean vector per key.

    Each task adds up its own rows first, so one key holding most rows costs a few
    partial sums per task; of many keys a task holds ``MEAN_KEYS`` at a time.
    """
    ktype = dict(vectors.dtypes)[key]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), ARROW[ktype]), pa.array([t.tolist() for t, _ in sums.values()]), pa.array([n for _, n in sums.values()])],
                names=[key, "total", "n"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            block = matrix(batch.column(1))
            codes = pc.dictionary_encode(batch.column(0))
            inverse = codes.indices.to_numpy()
            totals = np.zeros((len(codes.dictionary), block.shape[1]))
            np.add.at(totals, inverse, block)
            for value, total, n in zip(codes.dictionary.to_pylist(), totals, np.bincount(inverse, minlength=len(totals)).tolist()):
                old, m = sums.get(value, (0.0, 0))
                sums[value] = (old + total, m + n)
            if len(sums) > MEAN_KEYS:
                yield flush()
                sums.clear()
        if sums:
            yield flush()

    parts = vectors.select(key, vec).mapInArrow(partial, f"{key} {ktype}, total array<double>, n bigint")
    dims = (
        parts.select(key, "n", F.posexplode("total").alias("pos", "part"))
        .groupBy(key, "pos")
        .agg((F.sum("part") / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    )
    # One entry per vector dimension, so the list is as long as the vector.
    packed = dims.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda e: e["value"]).alias("vec"), F.max("n").alias("n")
    )
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)) + F.lit(1e-12)
    return packed.select(key, F.transform("vec", lambda v: v / size).alias("vec"), "n")
