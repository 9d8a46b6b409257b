"""Pairs of token sets that share at least a given number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.session import cut_lineage


def _rarest_first(rows: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """``keys, _a``: the known tokens of each row, rarest first; a row without any is left out."""
    listed = rows.select(*keys, F.explode("tokens").alias("_t")).join(frequency, "_t")
    return listed.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_t"))), lambda e: e["_t"]).alias("_a"))


def _prefix(tokens: str, least: Column) -> Column:
    """Tokens of which one at least is in every overlap of ``least``: all but the ``least - 1`` most frequent."""
    return F.slice(F.col(tokens), F.lit(1), F.size(tokens) - least + 1)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], node: str = "node_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, scope, node, shared)`` for pairs that share ``least`` tokens or more.

    ``left(keys, scope, tokens, least)`` with ``least >= 1``, ``right(node, scope,
    tokens)``; token lists are distinct and only rows of one ``scope`` meet.  Tokens are
    ordered by how many rows of ``right`` hold them.  Two sets with ``least`` tokens in
    common share one that is not among the last ``least - 1`` of either, so only those
    prefixes are joined: a frequent token is met only by sets that have little else.
    A pair comes out of the bucket of its first common token alone, counted there.
    """
    vocabulary = left.select(F.explode("tokens").alias("_t")).distinct()
    frequency = cut_lineage(right.select(F.explode("tokens").alias("_t")).join(vocabulary, "_t", "left_semi").groupBy("_t").agg(F.count("*").alias("_f")))
    lowest = left.agg(F.min("least")).first()[0] or 1
    mine = _rarest_first(left, [*keys, *scope, "least"], frequency).filter(F.size("_a") >= F.col("least"))
    theirs = _rarest_first(right, [node, *scope], frequency).withColumnRenamed("_a", "_b").filter(F.size("_b") >= lowest)
    a = mine.withColumn("_t", F.explode(_prefix("_a", F.col("least"))))
    b = theirs.withColumn("_t", F.explode(_prefix("_b", F.lit(lowest))))
    common = F.array_intersect("_a", "_b")
    met = a.join(b, [*scope, "_t"]).filter(F.size("_b") >= F.col("least")).withColumn("_c", common)
    return met.filter((F.get("_c", F.lit(0)) == F.col("_t")) & (F.size("_c") >= F.col("least"))).select(*keys, *scope, node, F.size("_c").alias("shared"))
