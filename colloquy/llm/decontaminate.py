"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is partitioned by documents: a *shard* holds a few hundred thousand
consecutive tokens of whole documents, as distinct term hashes with their sorted
positions.  A batch of test windows is matched in every shard by itself: the
positions of the rarest term of a window, moved by its offset, are the candidate
starts, and each further term, from rare to frequent, keeps the candidates
that its own moved list contains.  No posting list leaves its shard, so no
term, however frequent, becomes a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.frames import stored
from colloquy.llm.tokens import ALPHANUMERIC, LOWER, slices, string_buffers, word_hashes, words

WINDOW = 13
# Tokens after which a shard is closed, and test text that is matched at once.
SHARD_TOKENS = 1 << 18
BLOCK_BYTES = 8 << 20
# Candidate starts that are held at once.
CANDIDATES = 1 << 20


@dataclass
class Phrases:
    """Test windows of one block; a phrase shorter than ``width`` has term -1 behind its end."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    items: list


def _pack(values: np.ndarray) -> bytes:
    return values.tobytes()


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard: ``shard, ids, n_words, terms, counts, positions``.

    ``ids`` and ``n_words`` list the shard's documents in order; ``terms`` are the
    sorted distinct 64-bit word hashes, ``counts`` their frequencies and
    ``positions`` the token numbers inside the shard, ascending per term (packed
    little-endian).  Null and empty texts are documents of no words; a document
    longer than ``shard_tokens`` is a shard of its own; rows with equal ids stay
    separate documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = pa.int64() if kind == "bigint" else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            ids = [x for part in held for x in part[0]]
            counts = np.concatenate([part[1] for part in held])
            hashes = np.concatenate([part[2] for part in held])
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
            sizes = np.diff(np.concatenate([heads, [len(ordered)]]))
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{number}"]),
                    pa.array([ids], type=pa.list_(id_type) if id_type else None),
                    pa.array([counts.tolist()], type=pa.list_(pa.int64())),
                    pa.array([_pack(ordered[heads])], type=pa.binary()),
                    pa.array([_pack(sizes.astype(np.int32))], type=pa.binary()),
                    pa.array([_pack(order.astype(np.int32))], type=pa.binary()),
                ],
                names=["shard", "ids", "n_words", "terms", "counts", "positions"],
            )
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high, buf, offs in slices(texts):
                found = words(buf, offs, ALPHANUMERIC, LOWER)
                held.append((ids.slice(low, high - low).to_pylist(), np.diff(found.first), word_hashes(found)))
                size += len(found.starts)
                if size >= shard_tokens or sum(len(h[0]) for h in held) >= shard_tokens:
                    yield close()
        if held:
            yield close()

    schema = f"shard string, ids array<{kind}>, n_words array<bigint>, terms binary, counts binary, positions binary"
    return chosen.mapInArrow(build, schema)


def phrases_of(rows: list[tuple[object, str | None]], width: int = WINDOW) -> Phrases:
    """Windows of the items of one block, each distinct (item, word sequence) once."""
    texts = pa.array([r[1] or "" for r in rows], type=pa.string())
    buf, offs = string_buffers(texts)
    found = words(buf[offs[0] : offs[-1]], offs - offs[0], ALPHANUMERIC, LOWER)
    hashes = word_hashes(found)
    terms, lengths, item = [], [], []
    for i in range(len(rows)):
        own = hashes[found.first[i] : found.first[i + 1]]
        if not len(own):
            continue
        if len(own) < width:
            window = np.zeros((1, width), dtype=np.uint64)
            window[0, : len(own)] = own
            size = len(own)
        else:
            window = np.unique(np.lib.stride_tricks.sliding_window_view(own, width), axis=0)
            size = width
        terms.append(window)
        lengths.append(np.full(len(window), size))
        item.append(np.full(len(window), i))
    if not terms:
        return Phrases(np.zeros(0, np.uint64), np.zeros((0, width), np.int32), np.zeros(0, int), np.zeros(0, int), [r[0] for r in rows])
    stacked, size = np.concatenate(terms), np.concatenate(lengths)
    real = np.arange(width)[None, :] < size[:, None]
    vocabulary = np.unique(stacked[real])
    codes = np.where(real, np.searchsorted(vocabulary, stacked), -1).astype(np.int32)
    return Phrases(vocabulary, codes, size, np.concatenate(item), [r[0] for r in rows])


def _match(phrases: Phrases, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, total: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, start)`` of every place in a shard where all terms meet within ``slop``."""
    at = np.searchsorted(terms, phrases.vocabulary)
    at_safe = np.minimum(at, max(len(terms) - 1, 0))
    present = (terms[at_safe] == phrases.vocabulary) if len(terms) else np.zeros(len(at), dtype=bool)
    ends = np.cumsum(counts.astype(np.int64))
    size = np.where(present, counts[at_safe] if len(terms) else 0, 0)
    begin = np.where(present, (ends - counts)[at_safe] if len(terms) else 0, 0)
    real = phrases.terms >= 0
    sizes = np.where(real, size[phrases.terms], np.iinfo(np.int64).max)
    alive = np.flatnonzero(sizes.min(axis=1) > 0)
    if not len(alive):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(sizes[alive], axis=1, kind="stable")
    rare = order[:, 0]
    rare_term = phrases.terms[alive, rare]
    work = size[rare_term]
    key_of_position = None
    out_p, out_s = [], []
    low = 0
    total_work = np.cumsum(work)
    # Sorted (term, position) keys of the test terms that occur here.
    used = np.unique(phrases.terms[alive][real[alive]])
    spans = size[used]
    flat = np.repeat(begin[used] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    key_of_position = np.repeat(used.astype(np.int64), spans) << 32 | positions[flat].astype(np.int64)
    while low < len(alive):
        high = int(np.searchsorted(total_work, (total_work[low - 1] if low else 0) + CANDIDATES, side="right"))
        high = max(high, low + 1)
        number = np.repeat(np.arange(low, high), work[low:high])
        base = np.cumsum(work[low:high]) - work[low:high]
        offset = np.arange(len(number)) - np.repeat(base, work[low:high])
        start = positions[begin[rare_term[number]] + offset].astype(np.int64) - rare[number]
        length = phrases.lengths[alive[number]]
        ok = (start >= 0) & (start + length <= total)
        number, start = number[ok], start[ok]
        for step in range(1, phrases.terms.shape[1]):
            if not len(number):
                break
            column = order[number, step]
            term = phrases.terms[alive[number], column]
            want = term >= 0
            key = term.astype(np.int64) << 32 | np.maximum(start + column - slop, 0)
            spot = np.searchsorted(key_of_position, key)
            got = key_of_position[np.minimum(spot, len(key_of_position) - 1)]
            near = (spot < len(key_of_position)) & (got <= (term.astype(np.int64) << 32 | (start + column + slop)))
            keep = near | ~want
            number, start = number[keep], start[keep]
        out_p.append(alive[number])
        out_s.append(start)
        low = high
    return np.concatenate(out_p), np.concatenate(out_s)


def match_index(index: DataFrame, phrases: Phrases, slop: int = 0, id_kind: str = "bigint", item_kind: str = "bigint") -> DataFrame:
    """One row per indexed document: ``shard, place, id, n_words, spans, items``.

    ``spans`` are the merged half-open word ranges that a test window covers,
    ``items`` the distinct ids of the items matched.  With ``slop`` 0 a match is
    the exact phrase; otherwise every term may stand up to ``slop`` words away
    from its place in the phrase (proximity match).
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.asarray(batch.column(2)[row].values.to_numpy(zero_copy_only=False), dtype=np.int64)
                terms = np.frombuffer(batch.column(3)[row].as_py(), dtype=np.uint64)
                counts = np.frombuffer(batch.column(4)[row].as_py(), dtype=np.int32).astype(np.int64)
                positions = np.frombuffer(batch.column(5)[row].as_py(), dtype=np.int32)
                total = int(lengths.sum())
                which, start = _match(tests, terms, counts, positions, total, slop)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, start, side="right")
                stop = start + tests.lengths[which]
                inside = stop <= ends[doc] if len(doc) else np.zeros(0, dtype=bool)
                which, start, stop, doc = which[inside], start[inside], stop[inside], doc[inside]
                edge = np.zeros(total + 1, dtype=np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                hit = np.cumsum(edge[:total]) > 0
                step = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                # Neighbouring documents may both be hit at their common border.
                firsts = np.flatnonzero(step == 1)
                lasts = np.flatnonzero(step == -1)
                cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < total)]
                cuts = np.unique(cuts[hit[cuts] & hit[cuts - 1]]) if len(cuts) else cuts
                firsts, lasts = np.sort(np.concatenate([firsts, cuts])), np.sort(np.concatenate([lasts, cuts]))
                owner = np.searchsorted(ends, firsts, side="right")
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for d, a, b in zip(owner.tolist(), firsts.tolist(), lasts.tolist()):
                    base = int(ends[d] - lengths[d])
                    spans.setdefault(d, []).append({"start": a - base, "stop": b - base})
                pairs = np.unique(np.stack([doc, tests.item[which]], axis=1), axis=0) if len(doc) else np.zeros((0, 2), dtype=np.int64)
                for d, i in pairs.tolist():
                    if tests.items[i] is not None:
                        items.setdefault(d, set()).add(tests.items[i])
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * n, type=pa.string()),
                        pa.array(np.arange(n, dtype=np.int64)),
                        batch.column(1)[row].values,
                        pa.array(lengths),
                        pa.array([spans.get(d, []) for d in range(n)], type=pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([list(items.get(d, ())) for d in range(n)], type=pa.list_(item_type)),
                    ],
                    names=["shard", "place", "id", "n_words", "spans", "items"],
                )

    item_type = pa.int64() if item_kind in ("bigint", "int") else pa.string()
    kind = "bigint" if item_kind in ("bigint", "int") else "string"
    schema = f"shard string, place bigint, id {id_kind}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<{kind}>"
    return index.mapInArrow(run, schema)


def _merged(spans: list) -> list:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [{"start": a, "stop": b} for a, b in out]


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_col: str = "text", width: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``id, n_words, spans, items`` for every row of ``docs``.

    The test set is matched in blocks of about ``block_bytes`` of text, each a
    bounded broadcast; the index is written once and read once per block.  Null
    and empty texts have no words, items without words match nothing, repeated
    items count once and an item with a null id marks words but is not listed.
    Columns beyond those named are ignored.
    """
    id_kind = docs.schema[id_col].dataType.simpleString()
    item_kind = tests.schema[item_col].dataType.simpleString()
    if item_kind not in ("bigint", "int", "string"):
        tests, item_kind = tests.withColumn(item_col, F.col(item_col).cast("string")), "string"
    chosen = tests.select(F.col(item_col).alias("item"), F.col(test_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    index = stored(positional_index(docs, id_col, text_col, shard_tokens), "postings")
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    answers = []
    for number in range(blocks):
        rows = [(r["item"], r["text"]) for r in chosen.filter(part == number).collect()]
        answers.append(match_index(index, phrases_of(rows, width), slop, id_kind, item_kind))
    if blocks == 1:
        return answers[0].select("id", "n_words", "spans", "items")
    merge = F.udf(_merged, "array<struct<start:bigint,stop:bigint>>")
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    return (
        every.groupBy("shard", "place")
        .agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        .select("id", "n_words", merge("spans").alias("spans"), "items")
    )


def hits(found: DataFrame) -> DataFrame:
    """Digest of :func:`contamination`: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


