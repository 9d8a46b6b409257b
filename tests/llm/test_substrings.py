import hashlib

import pytest

from colloquy.llm.substrings import COVER, PERIOD, WINDOW, digest, remove_repeats
from tests.llm.helpers import awkward, blank_words, frame, prose


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        ws = blank_words(text)
        gone = [False] * len(ws)
        for p in range(len(ws) - WINDOW + 1):
            window = tuple(ws[p : p + WINDOW])
            if window in seen:
                gone[p : p + WINDOW] = [True] * WINDOW
            seen.add(window)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_cover_has_an_aligned_shift_for_all_residues():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))


@pytest.mark.parametrize("chunk", [1, 3_000, 1 << 21])
def test_awkward_documents(spark, chunk):
    docs = awkward(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = digest(remove_repeats(docs, chunk_text=chunk))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == want


def test_every_alignment_of_a_shared_passage(spark):
    passage = prose(9, 27)
    rows = [(i, f"{prose(100 + i, i % 29)} {passage} {prose(300 + i, 5)}", "en", "a") for i in range(60)]
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digest(remove_repeats(docs, chunk_text=2_000)).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_repeated_rows_nulls_and_layout(spark):
    text = prose(4, 50).replace(" ", "\n", 3)
    docs = frame(spark, [(1, text, "en", "a"), (1, text, "en", "a"), (None, text, None, None), (2, "short\ntext", "en", "b")])
    got = remove_repeats(docs, carry=["lang", "source"], keep_layout=True).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 50, 50]
    assert [r.n_removed for r in got if r.id is None] == [50]
    assert {r.kept for r in got if r.n_removed == 0} == {text, "short\ntext"}


def test_empty_table(spark):
    assert digest(remove_repeats(awkward(spark).limit(0))).count() == 0
