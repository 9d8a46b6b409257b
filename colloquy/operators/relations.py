"""Local completion around anchors: replies, shared facts, neighbours, asker state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import informative, tokens
from colloquy.operators.lookup import fetch
from colloquy.operators.overlap import overlap_join
from colloquy.operators.ranking import by_score, top_k
from colloquy.session import cut_lineage

# Priority per relation.
REPLY_TO, REPLIED_BY, SIBLING, LOCAL, LOCAL_STEP = 5.0, 4.8, 4.0, 2.0, 0.15
LOCAL_ORDER = (1, -1, 2, -2)


def expand(anchors: DataFrame, raw: DataFrame, addressed_refs: DataFrame, keys: tuple[str, ...] = ("query_id",), max_rows: int = 4) -> DataFrame:
    """Best related turns per question.

    ``anchors(keys, ref, anchor)``; ``raw(ref, session_id, ordinal, reply_to)``;
    ``addressed_refs(node_id, ref)`` holds facts with a known addressee and at
    most four references.
    """
    # A few anchors per question, read by five branches: written once.
    a = cut_lineage(fetch(anchors, raw, "ref").withColumn("w", F.lit(1.0) / F.col("anchor")))
    head = [*keys, F.col("ref").alias("anchor_ref"), "w"]

    def found(df: DataFrame, reason: Column, priority: Column) -> DataFrame:
        return df.select(*keys, "anchor_ref", "other", "w", reason.alias("reason"), (priority + F.col("w")).alias("priority"))

    base = a.select(*head, "session_id", "ordinal", "reply_to")
    turns = raw.select(F.col("ref").alias("other"), "session_id", "ordinal", "reply_to")
    parent = found(base.withColumnRenamed("reply_to", "other").filter("other IS NOT NULL").join(raw.select(F.col("ref").alias("other")), "other", "left_semi"),
                   F.lit("reply_to"), F.lit(REPLY_TO))
    child = found(base.select(*keys, "anchor_ref", "w").join(turns.select("other", F.col("reply_to").alias("anchor_ref")), "anchor_ref"),
                  F.lit("replied_by"), F.lit(REPLIED_BY))
    shared = (
        base.select(*keys, "anchor_ref", "w").join(addressed_refs.withColumnRenamed("ref", "anchor_ref"), "anchor_ref")
        .select(*keys, "anchor_ref", "w", "node_id")
        .join(addressed_refs.withColumnRenamed("ref", "other"), "node_id")
    )
    sibling = found(shared, F.lit("fact_sibling"), F.lit(SIBLING))
    steps = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(dlt).alias("delta")) for p, dlt in enumerate(LOCAL_ORDER)])
    near = (
        base.withColumn("s", F.explode(steps))
        .select(*keys, "anchor_ref", "w", "session_id", (F.col("ordinal") + F.col("s.delta")).alias("ordinal"), "s.p", "s.delta")
        .join(turns.drop("reply_to"), ["session_id", "ordinal"])
    )
    local = found(near, F.concat(F.lit("local_"), F.when(F.col("delta") > 0, "+").otherwise(""), F.col("delta").cast("string")), F.lit(LOCAL) - F.lit(LOCAL_STEP) * F.col("p"))
    every = parent.unionByName(child).unionByName(sibling).unionByName(local).filter("other <> anchor_ref")
    # Highest priority per turn, then the earliest anchor.
    best = every.groupBy(*keys, "other").agg(F.max(F.struct(F.round("priority", 9).alias("p"), "w", "reason", "anchor_ref")).alias("b"))
    flat = best.select(*keys, "other", F.col("b.p").alias("priority"), F.col("b.reason").alias("reason"), F.col("b.anchor_ref").alias("anchor_ref"))
    return top_k(flat, list(keys), by_score("priority", "anchor_ref", "other"), max_rows)


def covering(questions: DataFrame, nodes: DataFrame, share: float, scope: tuple[str, ...] = (), keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``(keys, node_id, coverage)`` of the nodes that hold at least ``share`` of a question's informative tokens.

    The share is a number of tokens to have in common, so a pair that shares fewer is
    never formed; see :func:`overlap_join`.
    """
    wanted = questions.select(*keys, *scope, informative(tokens("text")).alias("tokens")).filter("size(tokens) > 0")
    # Rounded before the ceiling, so that a share of exactly so many tokens counts.
    least = F.greatest(F.ceil(F.round(F.size("tokens") * F.lit(share), 9)), F.lit(1)).cast("int")
    held = nodes.select("node_id", *scope, F.array_distinct(tokens("text")).alias("tokens"))
    met = overlap_join(wanted.withColumn("least", least), held, list(keys), scope=scope)
    return met.join(wanted.select(*keys, F.size("tokens").alias("_n")), list(keys)).select(*keys, "node_id", (F.col("shared").cast("double") / F.col("_n")).alias("coverage"))


def coherence(fact_places: DataFrame, hits: DataFrame, keys: tuple[str, ...] = ("query_id",), reach: float = 8.0, damping: float = 6.0) -> DataFrame:
    """``(keys, node_id, coherence)``: closeness of a fact's turns to the raw hits.

    ``fact_places(keys, node_id, session_id, ordinal)``; ``hits(keys, rank,
    session_id, ordinal)`` with one-based ranks.
    """
    pairs = fact_places.join(hits.select(*keys, "session_id", F.col("ordinal").alias("at"), "rank"), [*keys, "session_id"])
    locality = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("ordinal") - F.col("at")) / F.lit(reach))
    discount = F.lit(1.0) / (F.lit(1.0) + (F.col("rank") - 1) / F.lit(damping))
    return pairs.groupBy(*keys, "node_id").agg(F.max(locality * discount).alias("coherence"))
