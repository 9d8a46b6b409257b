"""Near-duplicate documents by MinHash.

Signatures are minima of many universal hashes over a document's shingles; bands
of them name candidates.  Documents with equal shingle sets are one node.  In a
band's bucket every node is first compared with the bucket's smallest id.  What is
then still in different components meets in a grid of blocks: signatures first tell which
nodes have a hopeful partner in a place, then their full sets are compared inside the
task, which passes on a spanning forest of the links.  A bucket of near copies
therefore costs a star; a bucket of texts just below the threshold costs its comparisons,
in bounded tasks, but no pair is ever written and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, functions as F

from colloquy.llm.frames import long_of, stored
from colloquy.llm.stars import components
from colloquy.llm.tokens import BLANK_SEPARATED, LOWER, mix, slices, window_hashes, word_hashes, words

WIDTH = 5
SIMILARITY = 80
# 40 bands of 5: a pair of similarity 0.8 shares no band with probability 1e-7.
BANDS, ROWS = 40, 5
# Signature agreement below which a pair cannot reach the similarity: five standard deviations under it.
AGREEMENT = 0.64
# Nodes of a bucket that meet as many nodes outside its main component in one place.
BLOCK = 1024

_SEED = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEED[: BANDS * ROWS] | np.uint64(1), _SEED[BANDS * ROWS :]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin."""
    found = words(buf, offs, BLANK_SEPARATED, LOWER)
    hashes = word_hashes(found)
    n_words = np.diff(found.first)
    pieces = np.zeros(0, dtype=np.uint64)
    if len(hashes) >= width:
        doc = found.doc()
        whole = window_hashes(hashes, width)
        good = doc[: len(whole)] == doc[width - 1 :]
        pieces = whole[good]
    counts = np.maximum(n_words - width + 1, 0)
    short = (n_words > 0) & (n_words < width)
    if short.any():
        counts = counts + short
        first = np.concatenate([[0], np.cumsum(counts)])
        full = np.zeros(int(first[-1]), dtype=np.uint64)
        mine = np.zeros(len(full), dtype=bool)
        mine[first[:-1][short]] = True
        full[~mine] = pieces
        for size in range(1, width):
            some = np.flatnonzero(n_words == size)
            if len(some):
                full[first[some]] = mix(window_hashes(hashes, size)[found.first[some]] + np.uint64(size))
        pieces = full
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    for d in np.flatnonzero(counts > 1):
        pieces[first[d] : first[d + 1]].sort()
    new = np.ones(len(pieces), dtype=bool)
    new[1:] = pieces[1:] != pieces[:-1]
    new[first[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return pieces[new], kept[first]


def signatures(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, d1, d2, sig, bands`` per row: set size, digest of the set, signature bytes and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in slices(batch.column(1)):
                sets, first = shingle_sets(buf, offs, width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                rows = high - low
                d = np.zeros((2, rows), dtype=np.uint64)
                sig = np.zeros((rows, BANDS * ROWS), dtype=np.uint8)
                keys = np.zeros((rows, BANDS), dtype=np.uint64)
                if len(some):
                    at = first[:-1][some]
                    d[0, some] = np.add.reduceat(mix(sets), at)
                    d[1, some] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
                    minima = np.empty((BANDS * ROWS, len(some)), dtype=np.uint64)
                    moved = np.empty_like(sets)
                    for k in range(BANDS * ROWS):
                        np.multiply(sets, _A[k], out=moved)
                        np.add(moved, _B[k], out=moved)
                        minima[k] = np.minimum.reduceat(moved, at)
                    minima = mix(minima)
                    sig[some] = minima.T.astype(np.uint8)
                    for b in range(BANDS):
                        key = np.full(len(some), b, dtype=np.uint64)
                        for r in range(ROWS):
                            key = key * np.uint64(0xD1342543DE82EF95) + minima[b * ROWS + r]
                        keys[some, b] = mix(key)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BANDS * ROWS), rows, [None, pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, rows), pa.array(n.astype(np.int64)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), whole.cast(pa.binary()), bands],
                    names=["id", "n", "d1", "d2", "sig", "bands"],
                )

    chosen = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, sig binary, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, shingles``: the packed sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in slices(batch.column(1)):
                sets, first = shingle_sets(buf, offs, width)
                packed = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(packed, type=pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``u, v, ok``: the pairs, and whether their full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint64)
                b = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                if 100 * len(small) < similarity * len(large):
                    continue
                spot = np.searchsorted(large, small)
                spot[spot == len(large)] = 0
                both = int(np.count_nonzero(large[spot] == small))
                good[i] = 100 * both >= similarity * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], names=["u", "v", "ok"])

    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u bigint, v bigint, ok boolean")


def _fits(a: str, b: str, similarity: int):
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _grid(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, down, over, stray, apart, id, component``: who meets whom in buckets that span several components.

    The nodes outside a bucket's main component (``apart``) and all its nodes are cut
    into blocks, and each block of strays meets each block of members in one place.
    """
    placed = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
    shape = sizes.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("every"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("bigint")
    shape = shape.select("key", F.col("top.component").alias("main"), blocks(F.col("every")).alias("blocks"), blocks(F.col("every") - F.col("top.m")).alias("across"))
    rows = stored(placed.join(shape, "key").withColumn("apart", F.col("component") != F.col("main")), "open")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    fields = ["key", "down", "over", "stray", "apart", "id", "component"]
    member = rows.withColumns({"down": of("blocks"), "over": each("across"), "stray": F.lit(False)}).select(fields)
    stray = rows.filter("apart").withColumns({"down": each("blocks"), "over": of("across"), "stray": F.lit(True)}).select(fields)
    return member.unionByName(stray)


def _by_cell(rows: DataFrame, total: int) -> GroupedData:
    """Places of a grid, several to a cell of about ``BLOCK`` rows."""
    return rows.withColumn("cell", F.pmod(F.xxhash64("key", "down", "over"), F.lit(total // BLOCK + 1))).groupBy("cell")


def _places(cell: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the strays and of the members of each place in a cell."""
    key, down, over, stray = (cell[c].to_numpy() for c in ("key", "down", "over", "stray"))
    order = np.lexsort((over, down, key))
    cut = np.flatnonzero((key[order][1:] != key[order][:-1]) | (down[order][1:] != down[order][:-1]) | (over[order][1:] != over[order][:-1])) + 1
    for rows in np.split(order, cut):
        yield rows[stray[rows]], rows[~stray[rows]]


def _hopeful(cell: pa.Table, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each stray with the members of other components that nearly agree with it in signature, best first.

    Of two strays, which are members too, the larger id is held against the smaller one,
    and nodes that share several buckets meet in the one of their first common band.
    """
    ids, n, part, apart, key = (cell[c].to_numpy() for c in ("id", "n", "component", "apart", "key"))
    sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), dtype=np.uint8).reshape(cell.num_rows, -1)
    bands = cell["bands"].combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)
    for strays, members in _places(cell):
        if not len(strays) or not len(members):
            continue
        earlier = bands[:, : int(np.flatnonzero(bands[strays[0]] == key[strays[0]])[0])]
        for i in strays.tolist():
            small, large = np.minimum(n[i], n[members]), np.maximum(n[i], n[members])
            fits = members[(part[members] != part[i]) & (~apart[members] | (ids[members] < ids[i])) & (100 * small >= similarity * large)]
            fits = fits[~(earlier[fits] == earlier[i]).any(axis=1)]
            if len(fits):
                agree = (sig[fits] == sig[i]).mean(axis=1)
                order = np.argsort(-agree, kind="stable")
                near = fits[order][agree[order] >= AGREEMENT]
                if len(near):
                    yield i, near


def _candidates(grid: DataFrame, nodes: DataFrame, total: int, similarity: int) -> DataFrame:
    """The rows of ``grid`` that have a hopeful partner in their place; their full sets are worth a look."""
    fields = "key bigint, down bigint, over bigint, stray boolean, apart boolean, id bigint, component bigint"

    def run(cell: pa.Table) -> pa.Table:
        kept = np.zeros(cell.num_rows, dtype=bool)
        for i, near in _hopeful(cell, similarity):
            kept[i] = True
            kept[near] = True
        return cell.select(["key", "down", "over", "stray", "apart", "id", "component"]).filter(pa.array(kept))

    return _by_cell(grid.join(nodes.select("id", "n", "sig", "bands"), "id"), total).applyInArrow(run, fields)


def _late_links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, total: int, similarity: int) -> DataFrame:
    """``u, v``: links confirmed on the full sets that join components within a place, a spanning forest of them."""

    def run(cell: pa.Table) -> pa.Table:
        ids, n, part = (cell[c].to_numpy() for c in ("id", "n", "component"))
        packed = cell["shingles"].combine_chunks()
        shingles = lambda i: np.frombuffer(packed[int(i)].as_buffer(), dtype=np.uint64)
        label: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := label.get(c, c)) != c:
                label[c] = label.get(up, up)
                c = up
            return c

        out = []
        for i, near in _hopeful(cell, similarity):
            mine = shingles(i)
            for low in range(0, len(near), 32):
                some = [j for j in near[low : low + 32].tolist() if root(int(part[j])) != root(int(part[i]))]
                if not some:
                    continue
                every, lengths = np.concatenate([shingles(j) for j in some]), n[some]
                spot = np.searchsorted(mine, every)
                spot[spot == n[i]] = 0
                both = np.add.reduceat((mine[spot] == every).astype(np.int64), np.cumsum(lengths) - lengths)
                for j in np.array(some)[100 * both >= similarity * (n[i] + lengths - both)].tolist():
                    a, b = root(int(part[i])), root(int(part[j]))
                    if a != b:
                        label[max(a, b)] = min(a, b)
                        out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    return _by_cell(rows.join(nodes.select("id", "n", "sig", "bands"), "id").join(sets, "id"), total).applyInArrow(run, "u bigint, v bigint")


def late_links(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between the components ``labels`` of nodes that share a bucket ``key, id``; fewer than the rows that meet."""
    grid = stored(_grid(buckets, labels), "grid")
    rows = stored(_candidates(grid, nodes, grid.count(), similarity), "candidates")
    return stored(_late_links(rows, nodes, sets, rows.count(), similarity), "late")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, component`` per row of ``docs``: shingle count and smallest linked id.

    Two documents are linked if 100 * |intersection| >= ``similarity`` * |union| of
    their sets of ``width``-word shingles (lower-cased A-Z, split at blanks; a
    shorter text is one shingle).  Null, empty and blank texts have no shingles and
    link with nothing, and so do rows with a null id.  Rows with equal ids are the
    same node.
    """
    chosen = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(signatures(chosen, width, "id", "text"), "signatures")
    solid = marks.filter("n > 0 and id is not null")
    equal = solid.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    copies = stored(solid.select("id", "d1", "d2", "n").join(equal, ["d1", "d2", "n"]).select("id", "rep").distinct(), "copies")
    nodes = stored(solid.join(equal.select(F.col("rep").alias("id"), "d1", "d2", "n"), ["id", "d1", "d2", "n"]).select("id", "n", "sig", "bands").dropDuplicates(["id"]), "nodes")
    exploded = nodes.select(F.explode("bands").alias("key"), "id", "n")
    pivots = exploded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("other")).filter("pivot.id < other").drop("other")
    buckets = stored(exploded.join(pivots, "key").select("key", "id", "n", F.col("pivot.id").alias("v"), F.col("pivot.n").alias("v_n")), "buckets")
    star = buckets.filter("id <> v").filter(_fits("n", "v_n", similarity)).select(F.col("id").alias("u"), "v").distinct()
    wanted = buckets.select("id").distinct()
    sets = stored(_sets(chosen.join(wanted, "id", "left_semi"), width), "sets").dropDuplicates(["id"])
    tried = stored(_confirmed(star, sets, similarity), "confirmed")
    same = copies.filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    links = tried.filter("ok").select("u", "v").union(same)
    labels = components(links)
    late = late_links(buckets.select("key", "id"), nodes, labels, sets, similarity)
    labels = components(links.union(late))
    return marks.select("id", "n").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of :func:`near_duplicates`; a null id is kept."""
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
