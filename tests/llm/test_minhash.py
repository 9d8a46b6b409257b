import random

import pytest

from colloquy.llm import minhash
from colloquy.llm.minhash import digest, near_duplicates
from colloquy.llm.stars import components
from tests.llm.helpers import awkward, blank_words, frame, prose


def brute(rows, width):
    sets = {}
    for i, text in rows:
        ws = blank_words(text, True)
        sets[i] = {tuple(ws[p : p + width]) for p in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= 80 * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(docs, width):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in digest(near_duplicates(docs, width)).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_awkward_documents(spark, width):
    docs = awkward(spark)
    assert found(docs, width) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_groups_around_the_threshold(spark):
    """Edits of one text: some link only through others, and none may be lost."""
    pick = random.Random(3)
    base = prose(11, 60).split()
    rows = []
    for i in range(120):
        ws = list(base)
        for _ in range(pick.randrange(6)):
            ws[pick.randrange(len(ws))] = f"new{pick.randrange(50)}"
        rows.append((i, " ".join(ws), "en", "a"))
    assert found(frame(spark, rows), 2) == brute([(r[0], r[1]) for r in rows], 2)


def test_family_below_the_threshold_writes_no_pairs(spark, monkeypatch):
    """Texts of one family of similarity 0.7: what tasks emit grows with the texts, not with their pairs."""
    emitted = {}
    for size in (400, 800):
        pick = random.Random(1)
        base = prose(21, 120).split()
        rows = []
        for i in range(size):
            ws = list(base)
            for p in pick.sample(range(120), 10):
                ws[p] = f"n{i}x{p}"
            rows.append((i, " ".join(ws), "en", "a"))
        # Two texts that do link, far from each other.
        rows[size - 1] = (size - 1, rows[3][1] + " end", "en", "a")
        counts = []
        plain = minhash.stored
        monkeypatch.setattr(minhash, "stored", lambda df, name: _counted(plain(df, name), name, counts))
        got = found(frame(spark, rows), 2)
        monkeypatch.setattr(minhash, "stored", plain)
        assert {i: c for i, (_, c) in got.items() if i != c} == {size - 1: 3}
        emitted[size] = dict(counts)
    for name in ("late", "confirmed", "grid"):
        assert emitted[800][name] <= 2.6 * max(emitted[400][name], 10), name
    # Hopeful rows are a part of the rows that meet, however many partners each has.
    assert emitted[400]["candidates"] <= emitted[400]["grid"] and emitted[800]["candidates"] <= emitted[800]["grid"]


def _counted(df, name, counts):
    counts.append((name, df.count()))
    return df


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    """Small blocks: every pair of blocks meets once."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    test_groups_around_the_threshold(spark)


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, [(5, "a b c d", "en", "a"), (5, "a b c d", "en", "a"), (2, "A b c d", "en", "a"), (None, "a b c d", None, None)])
    got = digest(near_duplicates(docs, 2)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False)]


def test_empty_table(spark):
    assert digest(near_duplicates(awkward(spark).limit(0))).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u bigint, v bigint")
    got = {r.id: r.component for r in components(edges).collect()}
    assert {got[i] for i in range(301)} == {0} and got[901] == 900
