"""Fetch corpus rows for a ranked list without moving the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.session import cut_lineage

# Listed rows up to which the list is sent to the corpus (some hundred bytes each).
BROADCAST_ROWS = 200_000


def fetch(listed: DataFrame, corpus: DataFrame, *keys: str) -> DataFrame:
    """``listed`` joined to ``corpus`` on ``keys``.

    The list is written and counted.  A short one is broadcast, so the texts are
    only read; for a longer one the distinct keys first reduce the corpus to the
    rows that are needed, and those are shuffled.
    """
    return lookup(cut_lineage(listed), corpus, *keys)


def lookup(held: DataFrame, corpus: DataFrame, *keys: str) -> DataFrame:
    """``fetch`` for a list that is already written."""
    if held.count() <= BROADCAST_ROWS:
        return corpus.join(F.broadcast(held), list(keys))
    return held.join(corpus.join(held.select(*keys).distinct(), list(keys), "left_semi"), list(keys))
