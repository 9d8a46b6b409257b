"""Small frames with the cases every operator must stand, and brute-force words."""

from __future__ import annotations

import random
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, n bigint, score string, component string"


def blank_words(text: str | None, fold: bool = False) -> list[str]:
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if fold else text)


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def prose(seed: int, n: int, size: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    full = [(i, t, lang, source, None if t is None else len(t), "x", 7, None, "y") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    shared = prose(2, 60)
    rows = [
        (1, prose(3, 80), "en", "a"), (2, prose(3, 80), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "de", "b"),
        (6, long, "en", "a"), (7, shared + " Tail one", "fr", "c"), (8, "Head two " + shared, "fr", None), (9, "One", None, "c"), (10, "one", "en", "c"),
        (11, "été À la  mode\nÉTÉ", "fr", "c"), (12, "a" * 5_000, "en", "a"), (13, "same " * 200, "en", "a"), (14, prose(3, 79) + " changed", "en", "b"),
        (15, "12 34 !! ??", None, "b"), (16, long + " end", "en", "a"),
    ]
    return frame(spark, rows)
