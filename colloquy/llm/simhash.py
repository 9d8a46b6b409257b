"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has two 32-bit segments.  Two fingerprints that differ in at most two
bits differ in at most one bit of the first segment, or agree in the second.  So a
table per segment is enough: every fingerprint enters both tables, and probes the
first one with the Hamming ball of radius one around its segment.  Of two segments one
bit apart exactly one has that bit set, so only set bits are cleared and each pair is
met from one side.

Entries with one key form a bucket; a task verifies complete distances inside the
buckets of its cell and passes on a spanning forest of the links, never the pairs.  A
bucket of more than ``BUCKET`` entries is dealt anew by the same rule to the two
16-bit quarters of the other segment: a key then fixes 48 bits, so no bucket
exceeds 65,536 members whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.frames import BROADCAST_KEYS, long_of, stored
from colloquy.llm.stars import components
from colloquy.llm.tokens import slices

WIDTH = 3
SEED = 42
DISTANCE = 2
# Entries of one key beyond which its bucket is dealt anew.
BUCKET = 4096
# Entries that one task verifies at a time, in whole buckets.
CELL = 50_000
# A fingerprint of at least this share of all rows is joined by broadcast: there are at most as many as its inverse.
HOT_SHARE = 1 / 500


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of every ``width``-word shingle of a text, repeats included; a shorter text is one shingle."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return []
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < width:
        return [digest(joined, SEED)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` per row: the 64-bit fingerprint as a signed long, zero for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in slices(batch.column(1)):
                raw = buf.tobytes()
                found: list[int] = []
                first = [0]
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    found += shingle_hashes(raw[a:b], width)
                    first.append(len(found))
                n = np.diff(first)
                out = np.zeros(high - low, dtype=np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    bits = np.unpackbits(np.array(found, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    counts = np.add.reduceat(bits, np.array(first[:-1])[some], axis=0, dtype=np.int64)
                    majority = np.packbits(2 * counts > n[some, None], axis=1, bitorder="little")
                    out[some] = np.ascontiguousarray(majority).view("<u8").ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(out.view(np.int64))], names=["id", "fp"])

    chosen = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id bigint, fp bigint")


def _set_bits(column: str, bits: int) -> Column:
    """The places of the set bits of a ``bits``-wide segment."""
    return F.expr(f"filter(sequence(0, {bits - 1}), b -> shiftright({column}, b) & 1 = 1)")


def _entries(nodes: DataFrame) -> DataFrame:
    """``fp, id, key, visitor``: both tables' entries and the probes of the first."""
    cut = nodes.select("fp", "id", F.expr("shiftrightunsigned(fp, 32)").alias("high"), F.expr("fp & 4294967295").alias("low"))
    probes = F.transform(_set_bits("high", 32), lambda b: F.struct((F.col("high") - F.pow(F.lit(2.0), b).cast("bigint")).alias("key"), F.lit(True).alias("visitor")))
    own = F.array(
        F.struct(F.col("high").alias("key"), F.lit(False).alias("visitor")),
        F.struct((F.col("low") + (1 << 32)).alias("key"), F.lit(False).alias("visitor")),
    )
    return cut.select("fp", "id", F.explode(F.concat(own, probes)).alias("e")).select("fp", "id", "e.key", "e.visitor")


def _redealt(entries: DataFrame) -> DataFrame:
    """Entries of oversized buckets, dealt to the quarters of the segment that their key leaves open.

    Members need partners within two bits there, so they also probe the first quarter
    with one bit cleared; visitors already differ in one bit and need a common quarter.
    """
    rest = F.when(F.col("key") < (1 << 32), F.expr("fp & 4294967295")).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    cut = entries.withColumn("rest", rest).withColumns({"q0": F.expr("shiftrightunsigned(rest, 16)"), "q1": F.expr("rest & 65535")})
    own = F.array(
        F.struct(F.col("q0").alias("quarter"), F.col("visitor").alias("visitor")),
        F.struct((F.col("q1") + (1 << 16)).alias("quarter"), F.col("visitor").alias("visitor")),
    )
    probes = F.transform(_set_bits("q0", 16), lambda b: F.struct((F.col("q0") - F.pow(F.lit(2.0), b).cast("bigint")).alias("quarter"), F.lit(True).alias("visitor")))
    every = F.when(F.col("visitor"), own).otherwise(F.concat(own, probes))
    # 33 bits of key and 17 of quarter.
    return cut.select("fp", "id", "key", F.explode(every).alias("e")).select("fp", "id", (F.col("key") * (1 << 17) + F.col("e.quarter")).alias("key"), "e.visitor")


def forest(key: np.ndarray, fp: np.ndarray, ids: np.ndarray, visitor: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is connected inside each bucket: fewer than it has rows."""
    order = np.lexsort((visitor, key))
    key, fp, ids, visitor = key[order], fp[order], ids[order], visitor[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    tails = np.append(heads[1:], len(key))
    # Members stand before visitors, so a bucket with a member begins with one.
    worth = (tails - heads > 1) & ~visitor[heads]
    out = []
    for low, high in zip(heads[worth].tolist(), tails[worth].tolist()):
        prints, label = fp[low:high], np.arange(high - low)
        members = int(np.count_nonzero(~visitor[low:high]))
        for i in range(members):
            near = label[np.bitwise_count(prints ^ prints[i]) <= distance]
            if (near == near[0]).all():
                continue
            parts = np.unique(near)
            label[np.isin(label, parts)] = parts[0]
            out += [(int(ids[low + p]), int(ids[low + parts[0]])) for p in parts[1:].tolist()]
    return out


def _links(entries: DataFrame, total: int, distance: int) -> DataFrame:
    """``u, v``: verified links of all buckets, cell by cell."""

    def run(cell: pa.Table) -> pa.Table:
        fp = cell["fp"].to_numpy().view(np.uint64)
        found = np.array(forest(cell["key"].to_numpy(), fp, cell["id"].to_numpy(), cell["visitor"].to_numpy(), distance), dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    cells = entries.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(total // CELL + 1)))
    return cells.groupBy("cell").applyInArrow(run, "u bigint, v bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links that connect the ids of distinct fingerprints ``fp, id`` just as all pairs within ``distance`` do."""
    if not 0 <= distance <= 2:
        raise ValueError("two segments and balls of radius one find distances of two bits at most")
    entries = _entries(nodes)
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > bucket), "large")
    totals = large.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total = nodes.count() * 18
    if not totals[0]:
        return stored(_links(entries, total, distance), "links")
    keys = large.select("key")
    keys = F.broadcast(keys) if totals[0] <= BROADCAST_KEYS else keys
    even = _links(entries.join(keys, "key", "left_anti").select("fp", "id", "key", "visitor"), total, distance)
    dealt = _redealt(entries.join(keys, "key", "left_semi").select("fp", "id", "key", "visitor"))
    return stored(even.union(_links(dealt, totals[1] * 6, distance)), "links")


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component`` per row of ``docs``: fingerprint and smallest linked id.

    Words are runs without blanks, lower-cased A-Z.  Null, empty and blank texts have the
    fingerprint zero, which links like any other.  A row with a null id has a fingerprint
    but links with nothing and has no component.  Rows with equal ids stand for
    themselves: each gets the component of its own fingerprint.
    """
    marks = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stored(marks.filter("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes.select("fp", "id"), distance))
    known = stored(nodes.join(labels, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("component")), "components")
    # Copies of a hot fingerprint stay where they are; all others meet their component by shuffle.
    share = max(1, int(marks.count() * HOT_SHARE))
    hot = F.broadcast(known.filter(F.col("n") > share).select("fp", "component"))
    rest = known.filter(F.col("n") <= share).select("fp", "component")
    solid = marks.filter("id is not null")
    found = solid.join(hot, "fp").unionByName(solid.join(hot, "fp", "left_anti").join(rest, "fp", "left"))
    return found.unionByName(marks.filter("id is null").withColumn("component", F.lit(None).cast("bigint"))).select("id", "fp", "component")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of :func:`near_duplicates`, the fingerprint as 16 hexadecimal digits."""
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
