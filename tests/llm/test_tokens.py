import pyarrow as pa

from colloquy.llm.tokens import ALPHANUMERIC, BLANK_SEPARATED, LOWER, slices, string_buffers, window_hashes, word_hashes, words
from tests.llm.helpers import alnum_words, blank_words, prose

TEXTS = ["Hello World  x", "", None, "é à\tB9\x0bz", " lead", "a" * 300 + " b", "tail ", "b", "Über-Maß 9x", prose(5, 500)]


def _split(texts, table, fold):
    buf, offs = string_buffers(pa.array(texts, type=pa.string()))
    found = words(buf, offs, table, fold)
    spelled = [bytes(found.buf[a:b]).decode() for a, b in zip(found.starts, found.ends)]
    return [spelled[a:b] for a, b in zip(found.first[:-1], found.first[1:])], word_hashes(found)


def test_words_are_those_of_the_patterns():
    got, _ = _split(TEXTS, ALPHANUMERIC, LOWER)
    assert got == [alnum_words(t) for t in TEXTS]
    got, _ = _split(TEXTS, BLANK_SEPARATED, LOWER)
    assert got == [blank_words(t, True) for t in TEXTS]


def test_hashes_depend_on_the_word_alone():
    got, hashes = _split(TEXTS, BLANK_SEPARATED, LOWER)
    flat = [w for ws in got for w in ws]
    seen = {}
    for w, h in zip(flat, hashes):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_equal_only_for_equal_words():
    hashes = word_hashes(words(*string_buffers(pa.array(["a b c a b c a"])), BLANK_SEPARATED))
    pairs = window_hashes(hashes, 2)
    assert pairs[0] == pairs[3] and pairs[1] == pairs[4] and len(set(pairs.tolist())) == 3
    assert len(window_hashes(hashes, 8)) == 0


def test_slices_cover_every_row_once():
    column = pa.array([None, "x" * 10, "", "y" * 100, "zé"] * 7).slice(3, 30)
    texts = []
    for low, high, buf, offs in slices(column, 32):
        texts += [bytes(buf[a:b]).decode() for a, b in zip(offs[:-1], offs[1:])]
        assert high > low
    assert texts == [t or "" for t in column.to_pylist()]
