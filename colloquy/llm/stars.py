"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.llm.frames import stored

# Edges that one task handles with ease.
PART_ROWS = 200_000


def _linked(edges: DataFrame) -> DataFrame:
    """Every edge seen from its larger end, loops and repeats removed."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of every node to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of every node, and the node, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that edges ``u, v`` connect a node with.

    Only nodes that have an edge are listed.  The steps alternate until the edges,
    by then one star per component, no longer change; each is written to the
    shared folder.  A node with very many neighbours is met by sums and joins only.
    """
    current = stored(_linked(edges), "edges")
    mark = None
    while True:
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        # The rows of a step are about those of the one before; a small graph is not cut into many files.
        current = stored(_linked(_small_star(_linked(_large_star(current)))).coalesce(now[0] // PART_ROWS + 1), "stars")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
