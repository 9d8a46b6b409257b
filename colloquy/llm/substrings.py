"""Removal of repeated word sequences by difference-cover anchors.

Every window of ``WINDOW`` words that also starts earlier in the corpus is a
repeat, and the words it covers are removed.  Documents are packed into *chunks*
of a few megabytes.

1. Anchors of ``ANCHOR`` words are hashed only at positions whose residue modulo
   ``PERIOD`` is in a difference cover.  Two equal windows, wherever they start,
   share an aligned anchor, because for every pair of residues some shift puts
   both into the cover.
2. A chunk sends each distinct anchor once; the reducer answers with one bit:
   does another chunk hold it too.
3. Windows around repeated anchors are compared whole, by 96 bits of hash.  Again
   a chunk sends each distinct window once, with the document in which it starts
   first, and gets one bit back: is this the first start of all.

However often a passage occurs, it is sent once per chunk, so no key is hot, and
the answers are a bit per value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from colloquy.llm.frames import long_of, stored
from colloquy.llm.tokens import BLANK_SEPARATED, string_buffers, window_hashes, word_hashes, words

WINDOW = 20
PERIOD = 13
# Perfect difference set modulo 13: every residue is a difference of two members.
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_TEXT = 2 << 20
# Text whose hashes meet in one reduce group, and the least number of groups as a power of two.
BUCKET_TEXT = 32 << 20
BUCKET_BITS = 8
LAST = np.iinfo(np.int64).max


def chunked(docs: DataFrame, id_col: str, text_col: str, carry: list[str], chunk_text: int) -> DataFrame:
    """``chunk, size, ids, texts, rest``: packed rows, sorted by id inside a chunk."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_none"))
    chosen = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[pa.Table] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            rows = pa.concat_tables(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end"))
            ids, texts, others = (rows.column(c).combine_chunks() for c in range(3))
            whole = [0, len(rows)]
            packed = pa.ListArray.from_arrays(pa.array(whole, type=pa.int32()), texts)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 33) + number], type=pa.int64()),
                    pa.array([size], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(whole, type=pa.int32()), ids),
                    packed,
                    pa.ListArray.from_arrays(pa.array(whole, type=pa.int32()), others),
                ],
                names=["chunk", "size", "ids", "texts", "rest"],
            )
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
            low = 0
            while low < len(lengths):
                total = np.cumsum(lengths[low:])
                high = low + max(1, int(np.searchsorted(total, chunk_text - size, side="left")) + 1)
                high = min(high, len(lengths))
                held.append(whole.slice(low, high - low))
                size += int(lengths[low:high].sum())
                low = high
                if size >= chunk_text:
                    yield close()
        if held:
            yield close()

    kind = chosen.schema["rest"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("rest", T.ArrayType(kind))])
    return chosen.mapInArrow(build, schema)


class _Chunk:
    """Word hashes, anchors and candidate windows of one chunk."""

    def __init__(self, texts: pa.Array):
        buf, offs = string_buffers(texts)
        self.words = words(buf[offs[0] : offs[-1]], offs - offs[0], BLANK_SEPARATED)
        self.first = self.words.first
        self.total = len(self.words.starts)
        self.hashes = word_hashes(self.words)
        self.doc = self.words.doc()
        self.place = np.arange(self.total) - self.first[self.doc]
        self.left = self.first[self.doc + 1] - np.arange(self.total) if self.total else np.zeros(0, dtype=np.int64)

    def anchors(self) -> None:
        cover = np.isin(np.arange(PERIOD), COVER)
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR))
        self.anchor_at = at
        values = window_hashes(self.hashes, ANCHOR)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        self.anchor, self.anchor_of, self.anchor_n = np.unique(values, return_inverse=True, return_counts=True)

    def windows(self, elsewhere: np.ndarray) -> None:
        """Distinct windows near repeated anchors, with the first start of each."""
        again = (elsewhere | (self.anchor_n > 1))[self.anchor_of] if len(self.anchor_at) else np.zeros(0, dtype=bool)
        at = self.anchor_at[again]
        edge = np.zeros(self.total + 1, dtype=np.int32)
        low = np.maximum(at - (PERIOD - 1), self.first[self.doc[at]]) if len(at) else at
        np.add.at(edge, low, 1)
        np.add.at(edge, at + 1, -1)
        start = np.flatnonzero((np.cumsum(edge[: self.total]) > 0) & (self.left >= WINDOW))
        if len(start):
            head = window_hashes(self.hashes, WINDOW)[start]
            tail = (window_hashes(word_hashes(self.words, 1), WINDOW)[start] >> np.uint64(32)).astype(np.uint32)
        else:
            head, tail = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        new = np.ones(len(head), dtype=bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        self.start = start[order]
        self.window_first = np.flatnonzero(new)
        self.head, self.tail = head[self.window_first], tail[self.window_first]

    def removed(self, owned: np.ndarray) -> np.ndarray:
        """Words that a repeated window covers; ``owned`` tells which distinct windows start first here."""
        repeat = np.ones(len(self.start), dtype=bool)
        repeat[self.window_first[owned]] = False
        edge = np.zeros(self.total + WINDOW + 1, dtype=np.int32)
        np.add.at(edge, self.start[repeat], 1)
        np.add.at(edge, self.start[repeat] + WINDOW, -1)
        return np.cumsum(edge[: self.total]) > 0


def _split(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """``(bucket, from, to)`` by the leading bits."""
    if not len(sorted_hashes):
        return
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for low, high in zip(heads, [*heads[1:], len(bucket)]):
        yield int(bucket[low]), int(low), int(high)


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :width].tobytes()


def _widened(packed: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :width] = raw
    return out.view(np.uint64).ravel()


def _bits_of(answers: dict[int, bytes], sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(sorted_hashes), dtype=bool)
    for bucket, low, high in _split(sorted_hashes, bits):
        if bucket in answers:
            out[low:high] = np.unpackbits(np.frombuffer(answers[bucket], dtype=np.uint8), count=high - low).astype(bool)
    return out


def _answers(column: pa.Array, row: int) -> dict[int, bytes]:
    value = column[row].as_py()
    return {x["bucket"]: x["bits"] for x in value} if value else {}


def _anchors_elsewhere(chunks: DataFrame, bits: int) -> DataFrame:
    """``chunk, answers``: which distinct anchors another chunk holds too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = _Chunk(batch.column(1)[row].values)
                own.anchors()
                parts = list(_split(own.anchor, bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in parts], type=pa.int64()),
                        pa.array([batch.column(0)[row].as_py()] * len(parts), type=pa.int64()),
                        pa.array([_low_bytes(own.anchor[a:b], 7) for _, a, b in parts], type=pa.binary()),
                    ],
                    names=["bucket", "chunk", "hashes"],
                )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        values = [_widened(x, 7) for x in group["hashes"]]
        _, inverse, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        flags = np.split((n > 1)[inverse], np.cumsum([len(v) for v in values])[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "bits": [np.packbits(f).tobytes() for f in flags]})

    sent = chunks.select("chunk", "texts").mapInArrow(send, "bucket bigint, chunk bigint, hashes binary")
    return _gathered(sent.groupBy("bucket").applyInPandas(meet, "chunk bigint, bucket bigint, bits binary"))


def _gathered(bits: DataFrame) -> DataFrame:
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _windows_owned(chunks: DataFrame, elsewhere: DataFrame, bits: int) -> DataFrame:
    """``chunk, answers, owned``: which distinct windows start first in this chunk."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(1)[row].values.fill_null(LAST).to_numpy(zero_copy_only=False)
                own = _Chunk(batch.column(2)[row].values)
                own.anchors()
                own.windows(_bits_of(_answers(batch.column(3), row), own.anchor, bits))
                doc = ids[own.doc[own.start[own.window_first]]] if len(own.head) else np.zeros(0, dtype=np.int64)
                parts = list(_split(own.head, bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in parts], type=pa.int64()),
                        pa.array([batch.column(0)[row].as_py()] * len(parts), type=pa.int64()),
                        pa.array([_low_bytes(own.head[a:b], 7) for _, a, b in parts], type=pa.binary()),
                        pa.array([own.tail[a:b].tobytes() for _, a, b in parts], type=pa.binary()),
                        pa.array([_docs_packed(doc[a:b]) for _, a, b in parts], type=pa.binary()),
                    ],
                    names=["bucket", "chunk", "head", "tail", "doc"],
                )

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        heads = [_widened(x, 7) for x in group["head"]]
        sizes = [len(h) for h in heads]
        head = np.concatenate(heads)
        tail = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["tail"]])
        doc = np.concatenate([_docs_unpacked(x, n) for x, n in zip(group["doc"], sizes)])
        chunk = np.repeat(group["chunk"].to_numpy(), sizes)
        order = np.lexsort((chunk, doc, tail, head))
        new = np.ones(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        new[1:] = (head[a] != head[b]) | (tail[a] != tail[b])
        owned = np.zeros(len(order), dtype=bool)
        owned[order[new]] = True
        flags = np.split(owned, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "bits": [np.packbits(f).tobytes() for f in flags]})

    joined = chunks.select("chunk", "ids", "texts").join(elsewhere, "chunk", "left").select("chunk", "ids", "texts", "answers")
    sent = joined.mapInArrow(send, "bucket bigint, chunk bigint, head binary, tail binary, doc binary")
    owned = _gathered(sent.groupBy("bucket").applyInPandas(meet, "chunk bigint, bucket bigint, bits binary"))
    return elsewhere.join(owned.withColumnRenamed("answers", "owned"), "chunk", "left")


def _docs_packed(doc: np.ndarray) -> bytes:
    """Ids as their distinct values and a number of one, two or four bytes each."""
    values, code = np.unique(doc, return_inverse=True)
    width = np.uint8 if len(values) <= 1 << 8 else np.uint16 if len(values) <= 1 << 16 else np.uint32
    return values.astype(np.int64).tobytes() + code.astype(width).tobytes() + bytes([np.dtype(width).itemsize])


def _docs_unpacked(packed: bytes, n: int) -> np.ndarray:
    width = packed[-1]
    cut = len(packed) - 1 - n * width
    values = np.frombuffer(packed[:cut], dtype=np.int64)
    return values[np.frombuffer(packed[cut:-1], dtype=f"u{width}")]


def _kept(found, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Kept words of every document joined by one space, and the number of them."""
    index = np.flatnonzero(keep)
    first = np.searchsorted(index, found.first)
    lengths = (found.ends - found.starts)[index] + 1
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.full(total, 0x20, dtype=np.uint8)
    if total:
        where = np.arange(total) + np.repeat(found.starts[index] - (ends - lengths), lengths)
        gap = np.zeros(total, dtype=bool)
        gap[ends - 1] = True
        out[~gap] = found.buf[where[~gap]]
    bounds = np.concatenate([[0], ends])[first]
    # The space after a document's last word is dropped by cutting the bytes apart.
    kept = np.diff(first)
    tail = bounds[1:][kept > 0] - 1
    mask = np.ones(total, dtype=bool)
    mask[tail] = False
    offsets = bounds - np.concatenate([[0], np.cumsum(kept > 0)])
    return pa.StringArray.from_buffers(found.docs, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out[mask].tobytes())), kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_layout: bool = False, chunk_text: int = CHUNK_TEXT, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """``id, n_words, n_removed, kept`` and the ``carry`` columns, one row per row of ``docs``.

    ``kept`` is the text without the removed words, joined by single spaces; with
    ``keep_layout`` a text that loses nothing stays as it is.  Order is by id, then
    by place in the text; null ids come last, and of rows with equal ids one,
    always the same, counts as earlier.  Null and empty texts have no words.  Text
    shorter than a window loses nothing.
    """
    carry = carry or []
    chunks = stored(chunked(docs, id_col, text_col, carry, chunk_text), "chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(int(size), 1) / bucket_text))) if size else BUCKET_BITS
    elsewhere = stored(_anchors_elsewhere(chunks, bits), "anchors")
    answers = stored(_windows_owned(chunks, elsewhere, bits), "windows")
    rest_type = chunks.schema["rest"].dataType

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = batch.column(1)[row].values
                own = _Chunk(texts)
                own.anchors()
                own.windows(_bits_of(_answers(batch.column(3), row), own.anchor, bits))
                gone = own.removed(_bits_of(_answers(batch.column(4), row), own.head, bits))
                kept, n_kept = _kept(own.words, ~gone)
                n_words = np.diff(own.first)
                if keep_layout:
                    kept = pc.if_else(pa.array(n_kept == n_words), texts, kept)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), kept, batch.column(2)[row].values],
                    names=["id", "n_words", "n_removed", "kept", "rest"],
                )

    joined = chunks.join(answers, "chunk", "left").select("ids", "texts", "rest", "answers", "owned")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("rest", rest_type.elementType)])
    done = joined.mapInArrow(finish, schema)
    return done.select("id", "n_words", "n_removed", "kept", *[F.col("rest")[c].alias(c) for c in carry])


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`remove_repeats`."""
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
