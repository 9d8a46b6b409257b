import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm.resampling import digest, drawn, features, nth_largest, resample
from tests.llm.helpers import alnum_words, awkward, frame, prose


def runs(text):
    ws = alnum_words(text)
    return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, items):
    """Rows of the contract: ``id -> (features, weight, score, rank)``."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for text in texts:
            for f in runs(text):
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    out, able = {}, []
    for i, text in docs:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, runs(text)))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(runs(text)), weight, score, None]
        if len(alnum_words(text)) >= 20:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(row) for i, row in out.items()}


def found(docs, target, **more):
    return {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in digest(resample(docs, target, **more)).collect()}


def test_documents_with_the_awkward_ones(spark):
    more = frame(spark, [(100 + i, prose(i, 10 + 3 * i, 40), "en", "a") for i in range(60)])
    docs = awkward(spark).unionByName(more)
    items = [prose(70, 100, 40), "One two THREE", None, ""]
    target = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(items)], "item_id string, text string, weight int")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert found(docs, target) == want
    assert sum(row[3] is not None for row in want.values()) == 3


def test_pieces_of_long_texts_carry_their_runs():
    text = ("Été " + prose(4, 300)).encode()
    whole = sorted(zlib.crc32(f.encode()) % 10_000 for f in runs(text.decode()))
    for piece in (1, 7, 50, 1 << 20):
        parts = list(features(text, piece))
        assert sum(n for n, _ in parts) == len(alnum_words(text.decode()))
        assert sorted(b for _, found in parts for b in found.tolist()) == whole


@pytest.mark.parametrize("values", ["spread", "ties", "one", "steps"])
def test_cutoff_by_brackets(spark, values):
    """Brackets that hit, miss, hold ties only or cannot be told apart by the sketch."""
    pick = random.Random(9)
    make = {"spread": lambda: pick.randrange(-(10**9), 10**9), "ties": lambda: pick.randrange(3), "one": lambda: 7, "steps": lambda: pick.choice([0, 1, 2, 10**6]) + pick.randrange(2)}[values]
    data = [make() for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in data], "x bigint")
    order = sorted(data, reverse=True)
    for k, slack in ((1, 0.02), (37, 0.0), (1000, 0.02), (1000, 0.0), (2000, 0.02)):
        assert nth_largest(rows, "x", k, slack, limit=50) == (order[k - 1], sum(x > order[k - 1] for x in data))


def test_ties_go_to_smaller_ids_and_null_last(spark):
    rows = [(i, 5) for i in range(40)] + [(None, 5), (50, 9), (-3, 5)]
    data = spark.createDataFrame(rows, "id bigint, score bigint")
    got = [(r.id, r["rank"]) for r in drawn(data, 4, limit=3).orderBy("rank").collect()]
    assert got == [(50, 1), (-3, 2), (0, 3), (1, 4)]
    assert drawn(data, 43, limit=3).orderBy(F.desc("rank")).first().id is None


def test_repeated_rows_are_all_returned(spark):
    rows = [(1, prose(1, 30), "en", "a")] * 30 + [(None, prose(2, 30), None, None)] * 10
    got = resample(frame(spark, rows), frame(spark, [(9, prose(1, 50), "en", "a")])).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_empty_tables(spark):
    docs = awkward(spark)
    assert digest(resample(docs.limit(0), docs)).count() == 0
    assert found(docs, docs.limit(0)) == brute([(r.doc_id, r.text) for r in docs.collect()], [])
