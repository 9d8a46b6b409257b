"""Upper-layer hits projected onto the raw turns that ground them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.config import RRF_K
from colloquy.operators.lookup import fetch, lookup
from colloquy.operators.ranking import by_score, top_k
from colloquy.session import cut_lineage


def grounding(
    upper: DataFrame,
    refs: DataFrame,
    raw: DataFrame,
    media: DataFrame | None = None,
    radius: int = 1,
    adjacent: float = 0.35,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """``(keys, rank, node_id, ref, weight, relation)``; strongest relation per turn.

    ``upper(keys, rank, node_id)``; ``refs(node_id, pos, ref)``; ``raw(ref,
    session_id, ordinal)``; ``media(node_id, ref)``.  Neighbours are an equi-join
    on the shifted ordinal.  The lists look up the memory, which is never shuffled
    for them.
    """
    upper = cut_lineage(upper)
    # Depth times references per question, read by both branches: written once.
    cited = cut_lineage(fetch(lookup(upper, refs, "node_id"), raw, "ref").select(*keys, "rank", "node_id", "ref", "session_id", "ordinal"))
    direct = cited.select(*keys, "rank", "node_id", "ref", F.lit(1.0).alias("weight"), F.lit(0).alias("_r"), F.lit("direct").alias("relation"))
    found = direct
    if media is not None:
        linked = upper.join(media, "node_id").select(
            *keys, "rank", "node_id", "ref", F.lit(1.0).alias("weight"), F.lit(1).alias("_r"), F.lit("media").alias("relation")
        )
        found = found.unionByName(linked)
    if radius > 0:
        shifts = [d for d in range(-radius, radius + 1) if d]
        beside = cited.select(*keys, "rank", "node_id", "session_id", F.explode(F.array(*[F.col("ordinal") + d for d in shifts])).alias("ordinal"))
        near = (
            fetch(beside, raw, "session_id", "ordinal")
            .select(*keys, "rank", "node_id", "ref", F.lit(float(adjacent)).alias("weight"), F.lit(2).alias("_r"), F.lit("adjacent").alias("relation"))
        )
        found = found.unionByName(near)
    best = F.max(F.struct(F.col("weight"), (-F.col("_r")).alias("first"), F.col("relation")))
    return found.groupBy(*keys, "rank", "node_id", "ref").agg(best.alias("_b")).select(
        *keys, "rank", "node_id", "ref", F.col("_b.weight").alias("weight"), F.col("_b.relation").alias("relation")
    )


def project(grounded: DataFrame, keys: tuple[str, ...] = ("query_id",), k: int | None = None) -> DataFrame:
    """Raw turns ranked by their summed discounted support."""
    summed = grounded.groupBy(*keys, "ref").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("rank", "weight"))), F.lit(0.0), lambda s, t: s + t["weight"] / (RRF_K + t["rank"])
        ).alias("score"),
        F.min("rank").alias("first_rank"),
        F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"),
    )
    order = [*by_score("score"), F.col("first_rank"), F.col("ref")]
    return top_k(summed, list(keys), order, k)


def neighbors(raw: DataFrame, radius: int = 1) -> DataFrame:
    """``(ref, delta, other)`` for turns within ``radius`` in the same session."""
    shifts = F.array(*[F.struct(F.lit(d).alias("delta"), (F.col("ordinal") + d).alias("ordinal")) for d in range(-radius, radius + 1) if d])
    left = raw.select("ref", "session_id", F.explode(shifts).alias("s")).select("ref", "session_id", "s.delta", "s.ordinal")
    return left.join(raw.select("session_id", "ordinal", F.col("ref").alias("other")), ["session_id", "ordinal"]).select("ref", "delta", "other")
