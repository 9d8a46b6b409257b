"""Session collections and speaker profiles as relations.

Membership stays one row per edge: a session or speaker may own any share of the
turns, so nothing here gathers a group into one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.functions.text import tokens
from colloquy.operators.ranking import positions_by_hash

HASH_START = len("fact:") + 1


def members(facts: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``(keys, pos, node_id)`` in content-id order."""
    unique = facts.select(*keys, "node_id").distinct()
    return positions_by_hash(unique, list(keys), "node_id", HASH_START)


def references(facts: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """``(keys, ref, first_fact, first_pos)``: distinct references by first citation."""
    cited = facts.select(*keys, "node_id", F.posexplode("refer_ids").alias("pos", "ref"))
    first = F.min(F.struct("node_id", "pos"))
    return cited.groupBy(*keys, "ref").agg(first.alias("f")).select(*keys, "ref", F.col("f.node_id").alias("first_fact"), F.col("f.pos").alias("first_pos"))


def summary(facts: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row per collection: sizes and participants."""
    base = facts.groupBy(*keys).agg(
        F.countDistinct("node_id").alias("n_members"),
        F.sum(F.size(tokens("text"))).alias("n_tokens"),
        F.array_join(F.array_sort(F.collect_set("source_speaker_ref")), ",").alias("participants"),
    )
    refs = references(facts, keys).groupBy(*keys).agg(F.count("*").alias("n_refs"))
    return base.join(refs, list(keys))


def profiles(turns: DataFrame, keys: tuple[str, ...] = ("speaker_ref",)) -> DataFrame:
    """One row per speaker: spellings, coverage and the first turn cited."""
    order = F.struct("case_id", "conv_id", "ordinal")
    return turns.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("aliases"),
        F.count("*").alias("n_refs"),
        F.countDistinct("session_id").alias("n_sessions"),
        F.min_by("ref", order).alias("first_ref"),
        F.max_by("ref", order).alias("last_ref"),
    )
