import hashlib

import pytest

from colloquy.llm.decontaminate import WINDOW, contamination, hits
from tests.llm.helpers import alnum_words, awkward, frame, prose


def brute(rows, items):
    windows = []
    for item, text in items:
        ws = alnum_words(text)
        if ws:
            n = min(len(ws), WINDOW)
            windows += [(item, ws[p : p + n]) for p in range(len(ws) - n + 1)]
    out = {}
    for i, text in rows:
        ws = alnum_words(text)
        hit, named = [False] * len(ws), set()
        for item, w in windows:
            for p in range(len(ws) - len(w) + 1):
                if ws[p : p + len(w)] == w:
                    hit[p : p + len(w)] = [True] * len(w)
                    named.add(str(item))
        n = sum(hit)
        out[i] = (len(ws), n, len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), n > 0 and 20 * n >= len(ws))
    return out


def items_of(spark):
    return spark.createDataFrame(
        [(1, prose(2, 60)), (2, "One"), (3, None), (4, ""), (10, prose(2, 60)[:200]), (5, "same same same"), (6, prose(3, 20)), (6, prose(3, 20)), (7, "été, À LA mode"), (8, "!!")],
        "item_id bigint, text string",
    )


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 18), (64, 50)])
def test_awkward_documents(spark, block, shard):
    docs, items = awkward(spark), items_of(spark)
    small = docs.filter("doc_id not in (6, 16)")
    got = hits(contamination(small, items, block_bytes=block, shard_tokens=shard)).collect()
    want = brute([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert len(got) == len(want)


def test_passages_next_to_each_other_and_long_texts(spark):
    a, b = prose(21, 15), prose(22, 15)
    docs = frame(spark, [(1, f"{a} {b}", "en", "a"), (2, f"{prose(23, 900)} {a}", "en", "a"), (3, a, "en", "a"), (4, b, "en", "a"), (3, a, "en", "a")])
    items = spark.createDataFrame([("q1", a), ("q2", b)], "item_id string, text string")
    got = hits(contamination(docs, items, shard_tokens=40)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got) == [(1, 30, 2, True), (2, 15, 1, False), (3, 15, 1, True), (3, 15, 1, True), (4, 15, 1, True)]


def test_proximity_allows_slipped_words(spark):
    docs = frame(spark, [(1, "alpha beta x gamma delta", "en", "a"), (2, "alpha beta x y z w gamma delta", "en", "a")])
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    exact = {r.id: r["items"] for r in contamination(docs, items).collect()}
    near = {r.id: r["items"] for r in contamination(docs, items, slop=1).collect()}
    assert exact == {1: [], 2: []} and near == {1: [1], 2: []}


def test_empty_tables(spark):
    docs, items = awkward(spark), items_of(spark)
    assert hits(contamination(docs.limit(0), items)).count() == 0
    assert {r.n_hit for r in hits(contamination(docs, items.limit(0))).collect()} == {0}
