import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.operators import bm25, dense
from colloquy.operators.ranking import full_ranks, positions


def brute(docs, question, k):
    toks = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    scores = {}
    for i, ts in toks.items():
        tf, s = Counter(ts), 0.0
        for q in set(re.findall(r"[a-z0-9]+", question.lower())):
            df = sum(q in set(x) for x in toks.values())
            if tf[q]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            scores[i] = s
    return sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = "red blue cat dog sun moon tea cup sea".split()
    return {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(60)} | {60: "red cat", 61: "red cat"}


def test_bm25_in_one_or_more_passes_matches_enumeration(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(list(corpus.items()), "node_id int, text string")
    asked = spark.createDataFrame([(1, "red cat"), (2, "Sun, sun & moon"), (3, "zebra")], "query_id int, text string")
    want = {1: brute(corpus, "red cat", 7), 2: brute(corpus, "sun moon", 7)}
    for limit in (bm25.SCAN_TERMS, 2):
        monkeypatch.setattr(bm25, "SCAN_TERMS", limit)
        got = {}
        for r in bm25.bm25_topk(docs, asked, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.node_id)
        assert got == want


def test_scoped_statistics_are_per_case(spark):
    docs = spark.createDataFrame([("a", 1, "red cat"), ("a", 2, "red"), ("b", 1, "cat"), ("b", 2, "cat cat")], "case_id string, node_id int, text string")
    asked = spark.createDataFrame([("a", 9, "cat"), ("b", 9, "cat")], "case_id string, query_id int, text string")
    out = bm25.bm25_topk(docs, asked, 5, scope=("case_id",)).collect()
    assert sorted((r.case_id, r.node_id) for r in out) == [("a", 1), ("b", 1), ("b", 2)]
    assert brute({1: "red cat", 2: "red"}, "cat", 5) == [1]


def test_group_postings_equal_concatenated_text(spark):
    rows = [("g", "red cat"), ("g", "cat"), ("h", "red")]
    docs = spark.createDataFrame(rows, "grp string, text string")
    terms = bm25.question_terms(spark.createDataFrame([(1, "cat red")], "query_id int, text string"))
    got = {r.node_id: r.score for r in bm25.score(bm25.group_postings(docs, "grp", "text", terms), terms).collect()}
    joined = spark.createDataFrame([("g", "red cat cat"), ("h", "red")], "node_id string, text string")
    want = {r.node_id: r.score for r in bm25.bm25_topk(joined, spark.createDataFrame([(1, "cat red")], "query_id int, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_dense_topk_over_several_query_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 8))
    base[70:] = base[0]  # copies tie and fall back to the id
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "node_id int, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(i, base[i].tolist()) for i in range(6)], "query_id int, vec array<double>")
    want = {i: sorted(range(80), key=lambda j: (-round(float(base[i] @ base[j]), 9), j))[:5] for i in range(6)}
    for size in (dense.CHUNK_QUERIES, 2):
        monkeypatch.setattr(dense, "CHUNK_QUERIES", size)
        got = {}
        for r in dense.dense_topk(docs, asked, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.node_id)
        assert got == want
        near = dense.nearest_queries(docs, asked, 2).filter("rank = 1").collect()
        assert all(r.query_id == int(np.argmax(np.round(base[:6] @ base[r.node_id], 9))) for r in near)


def test_positions_and_ranks_survive_one_hot_key(spark):
    rows = [("hot", i * 3) for i in range(5000)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    out = positions(df, ["k"], "o", total="n").collect()
    assert all(r.pos == (r.o // 3 if r.k == "hot" else r.o) and r.n == (5000 if r.k == "hot" else 5) for r in out)
    same = spark.createDataFrame([("hot", i, 1.0) for i in range(3000)], "k string, id int, s double").repartition(6)
    assert all(r["rank"] == r.id + 1 for r in full_ranks(same, ["k"], "s", "id").collect())


def test_group_topk_carries_groups_across_blocks(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i % 7, t) for i, t in corpus.items()], "grp int, text string").repartition(3)
    joined = {g: " ".join(t for i, t in corpus.items() if i % 7 == g) for g in range(7)}
    asked = spark.createDataFrame([(1, "red cat"), (2, "sun moon tea")], "query_id int, text string")
    terms = bm25.question_terms(asked)
    want = {1: brute(joined, "red cat", 4), 2: brute(joined, "sun moon tea", 4)}
    for block, limit in ((bm25.SCORE_BLOCK, bm25.SCAN_TERMS), (2, bm25.SCAN_TERMS), (2, 2)):
        monkeypatch.setattr(bm25, "SCORE_BLOCK", block)
        monkeypatch.setattr(bm25, "SCAN_TERMS", limit)
        got = {}
        for r in bm25.group_topk(docs, "grp", "text", terms, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.node_id)
        assert got == want
