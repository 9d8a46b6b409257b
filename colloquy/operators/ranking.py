"""Ranks and positions that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.session import cut_lineage

# Scores are compared after rounding so that the order in which a distributed
# sum adds its terms can never swap two rows.
SCORE_DIGITS = 9
POSITION_BLOCK = 1024


def by_score(score: str = "score", *ties: str) -> list[Column]:
    return [F.round(F.col(score), SCORE_DIGITS).desc(), *[F.col(t).asc() for t in ties]]


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key, or all of them, ranked, if ``k`` is None.

    The rank filter becomes a group limit on both sides of the shuffle, so each
    task sends at most ``k`` rows per key and a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if k is None:
        return df.withColumn(rank, F.row_number().over(window).cast("bigint"))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def positions(df: DataFrame, keys: list[str], ordinal: str, ties: list[str] = (), pos: str = "pos", total: str | None = None) -> DataFrame:
    """Zero-based position by an integer ordinal within a group of any size.

    Rows are numbered inside fixed ordinal blocks, and the blocks are offset by
    a running count, so no task sorts a whole group.
    """
    block = F.floor(F.col(ordinal) / POSITION_BLOCK)
    return _blocked(df.withColumn("_block", block), keys, [F.col(ordinal), *[F.col(t) for t in ties]], pos, total)


def positions_by_hash(df: DataFrame, keys: list[str], hashed: str, start: int, pos: str = "pos", total: str | None = None) -> DataFrame:
    """Zero-based position by a hex content id; its first four digits are the block."""
    return _blocked(df.withColumn("_block", F.substring(F.col(hashed), start, 4)), keys, [F.col(hashed)], pos, total)


def _blocked(df: DataFrame, keys: list[str], order: list[Column], pos: str, total: str | None) -> DataFrame:
    counts = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = (
        df.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets.drop("_n"), [*keys, "_block"])
        .withColumn(pos, (F.col("_local") + F.col("_offset")).cast("bigint"))
    )
    return out.drop("_block", "_local", "_offset")


def full_ranks(df: DataFrame, keys: list[str], score: str, tie: str, rank: str = "rank") -> DataFrame:
    """One-based rank by falling score over lists of any length.

    Rows are range-sorted across tasks, numbered inside each range and shifted by
    the running count of earlier ranges.  The sorted rows are written once, so a
    range keeps its rows if an executor is lost.
    """
    order = [*by_score(score), F.col(tie)]
    stored = cut_lineage(df.orderBy(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    counts = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = stored.withColumn("_i", F.row_number().over(inside)).join(offsets, [*keys, "_range"])
    return out.withColumn(rank, (F.col("_i") + F.col("_off")).cast("bigint")).drop("_i", "_off", "_range")
