"""Rank fusion on the common ranked relation.

``ranked(query keys, channel, weight, variant, rank, node_id)``; a list holds at
most a channel's depth per question, so per-question groups are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.config import RRF_K
from colloquy.operators.lookup import fetch
from colloquy.operators.ranking import by_score, top_k
from colloquy.session import cut_lineage


def _ordered_sum(position: list[str], value) -> F.Column:
    """Sum in list order: equal lists give bit-equal scores."""
    terms = F.array_sort(F.collect_list(F.struct(*position, value.alias("w"))))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"])


def collapse_variants(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), node: str = "node_id") -> DataFrame:
    """Several lists of one channel become one list with one vote.

    A channel with a single list passes unchanged; otherwise its lists are fused
    with unit weights and re-ranked.
    """
    channel = [*keys, "channel"]
    # Lists are as long as a channel's depth and are read three times: written once.
    ranked = cut_lineage(ranked)
    lists = ranked.groupBy(*channel).agg(F.countDistinct("variant").alias("_lists"), F.max("weight").alias("_w"))
    tagged = ranked.join(lists, channel)
    single = tagged.filter("_lists = 1").select(*channel, F.col("_w").alias("weight"), F.lit(0).alias("variant"), "rank", node)
    fused = (
        tagged.filter("_lists > 1")
        .groupBy(*channel, "_w", node)
        .agg(
            _ordered_sum(["variant", "rank"], F.lit(1.0) / (RRF_K + F.col("rank"))).alias("_s"),
            F.min(F.struct("variant", "rank")).alias("_first"),
        )
    )
    order = Window.partitionBy(*channel).orderBy(*by_score("_s"), "_first", node)
    many = fused.select(*channel, F.col("_w").alias("weight"), F.lit(0).alias("variant"), F.row_number().over(order).alias("rank"), node)
    return single.unionByName(many)


def rrf(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), node: str = "node_id", k: int | None = None, channel_order: str = "channel") -> DataFrame:
    """Weighted reciprocal-rank fusion; ties go to the node seen first."""
    votes = F.array_sort(F.collect_list(F.struct(F.col(channel_order).alias("o"), "rank", F.col("channel").alias("name"))))
    fused = ranked.groupBy(*keys, node).agg(
        _ordered_sum([channel_order, "rank"], F.col("weight") / (RRF_K + F.col("rank"))).alias("score"),
        F.min(F.struct(channel_order, "rank")).alias("first_seen"),
        F.array_join(F.array_distinct(F.transform(votes, lambda c: c["name"])), ",").alias("channels"),
    )
    order = [*by_score("score"), F.col("first_seen"), F.col(node)]
    if k is not None:
        return top_k(fused, list(keys), order, k).drop("first_seen")
    window = Window.partitionBy(*keys).orderBy(*order)
    return fused.withColumn("rank", F.row_number().over(window)).drop("first_seen")


def rrf_dedup(ranked: DataFrame, keys: tuple[str, ...] = ("query_id",), node: str = "node_id", k: int = 30) -> DataFrame:
    """Unit-weight fusion in which a node counts once per channel; ties by id."""
    best = ranked.groupBy(*keys, "channel", node).agg(F.min("rank").alias("rank"))
    fused = best.groupBy(*keys, node).agg(
        _ordered_sum(["channel"], F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.count("*").alias("n_channels")
    )
    return top_k(fused, list(keys), by_score("score", node), k)


def consensus(
    collections: DataFrame, members: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("query_id",), weight: float = 0.25, max_hits: int = 8
) -> DataFrame:
    """Re-rank collections by the lower-layer rows that cite the same turns.

    ``collections(keys, node_id, rank, score)``, ``members(node_id, ref)`` and
    ``evidence(keys, rank, ref)``.  Overlap starts from the evidence, which is
    short, so a collection with very many turns is never unrolled per question.
    """
    collections = cut_lineage(collections)
    overlap = (
        fetch(evidence.select(*keys, F.col("rank").alias("hit"), "ref"), members.select("node_id", "ref"), "ref")
        .join(collections.select(*keys, "node_id"), [*keys, "node_id"], "left_semi")
        .select(*keys, "node_id", "hit")
        .distinct()
    )
    hits = top_k(overlap, [*keys, "node_id"], [F.col("hit")], max_hits, "_n")
    support = hits.groupBy(*keys, "node_id").agg(
        F.aggregate(F.array_sort(F.collect_list("hit")), F.lit(0.0), lambda s, h: s + F.lit(1.0) / (RRF_K + h)).alias("support"),
        F.count("*").alias("support_hits"),
    )
    base = collections.select(*keys, "node_id", F.col("rank").alias("base_rank"), F.col("score").alias("base_score"))
    scored = base.join(support, [*keys, "node_id"], "left").fillna({"support": 0.0, "support_hits": 0})
    scored = scored.withColumn("score", F.col("base_score") + F.lit(weight) * F.col("support"))
    order = Window.partitionBy(*keys).orderBy(*by_score("score", "base_rank"))
    return scored.withColumn("rank", F.row_number().over(order))
