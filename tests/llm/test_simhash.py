import random

import numpy as np
import pytest
import xxhash

from colloquy.llm import simhash
from colloquy.llm.simhash import digest, forest, links, near_duplicates
from colloquy.llm.stars import components
from tests.llm.helpers import awkward, blank_words, frame, prose


def brute_print(text):
    ws = blank_words(text, True)
    shingles = [" ".join(ws[p : p + 3]) for p in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest linked id of ``{id: fingerprint}`` over all pairs."""
    low = {i: i for i in prints}
    changed = True
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def found(docs):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in digest(near_duplicates(docs)).collect()}


def test_awkward_documents(spark):
    docs = awkward(spark)
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    low = brute_components(prints)
    assert found(docs) == {i: (f"{prints[i]:016x}", low[i]) for i in prints}
    assert {low[i] for i in (3, 4, 5)} == {3}


def test_small_edits_of_long_texts(spark):
    pick = random.Random(5)
    rows = []
    for family in range(4):
        base = prose(family, 900).split()
        for copy in range(12):
            ws = list(base)
            for _ in range(copy // 3):
                ws[pick.randrange(len(ws))] = f"new{pick.randrange(9)}"
            rows.append((family * 100 + copy, " ".join(ws), "en", "a"))
    prints = {r[0]: brute_print(r[1]) for r in rows}
    low = brute_components(prints)
    assert len(set(low.values())) < len(rows)
    assert found(frame(spark, rows)) == {i: (f"{prints[i]:016x}", low[i]) for i in prints}


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_of_close_fingerprints(spark, bucket):
    """Families within few bits of a centre, in plain buckets and in ones that are dealt anew."""
    pick = random.Random(7)
    prints = {}
    for family in range(6):
        centre = pick.getrandbits(64)
        for member in range(60):
            value = centre
            for _ in range(pick.randrange(7)):
                value ^= 1 << pick.randrange(64)
            prints[family * 1000 + member] = value
    by_value = {}
    for i, value in prints.items():
        by_value[value] = min(i, by_value.get(value, i))
    nodes = {i: value for value, i in by_value.items()}
    data = [(int(np.uint64(value).astype(np.int64)), i) for i, value in nodes.items()]
    got = components(links(spark.createDataFrame(data, "fp bigint, id bigint"), bucket=bucket))
    low = brute_components(nodes)
    assert {r.id: r.component for r in got.collect()} == {i: c for i, c in low.items() if list(low.values()).count(c) > 1}


def test_links_grow_with_rows_not_pairs(spark):
    """A family that shares a segment and is linked densely emits fewer links than entries."""
    for size in (400, 800):
        pick = random.Random(size)
        values = {(0x1234ABCD << 32) | sum(1 << b for b in pick.sample(range(12), pick.randrange(7))) for _ in range(3 * size)}
        values = sorted(values)[:size]
        data = [(value, i) for i, value in enumerate(values)]
        for bucket in (4096, 50):
            assert links(spark.createDataFrame(data, "fp bigint, id bigint"), bucket=bucket).count() < 40 * len(values)


def test_forest_spans_and_verifies():
    key = np.array([1, 1, 1, 1, 2, 2])
    fp = np.array([0, 3, 12, 0xFF00, 5, 5 ^ 7], dtype=np.uint64)
    got = forest(key, fp, np.arange(10, 16), np.array([False, False, True, True, True, True]), 2)
    assert got == [(11, 10), (12, 10)]


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, [(5, "a b c d", "en", "a"), (5, "a b c d", "en", "a"), (2, "A b  c d", "en", "a"), (None, "a b c d", None, None)])
    got = digest(near_duplicates(docs)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (2, 2), (5, 2), (5, 2)]
    assert len({r.fingerprint for r in got}) == 1


def test_empty_table(spark):
    assert digest(near_duplicates(awkward(spark).limit(0))).count() == 0


def test_hot_fingerprint_and_rest_agree(spark, monkeypatch):
    docs = frame(spark, [(i, "same text here" if i % 3 else prose(i, 30), "en", "a") for i in range(60)])
    plain = found(docs)
    monkeypatch.setattr(simhash, "HOT_SHARE", 2.0)
    assert found(docs) == plain
