"""Count-based turn windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.config import WINDOW_SIZE, WINDOW_STRIDE
from colloquy.operators.ranking import positions


def starts_of(pos: Column, total: Column, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> Column:
    """Starts of every window that covers a position.

    Windows begin at multiples of the stride, and one more ends at the last turn.
    The starts follow from the position itself, so no join is needed.
    """
    last = F.greatest(total - F.lit(size), F.lit(0))
    newest = F.floor(pos / stride)
    oldest = F.greatest(F.ceil((pos - F.lit(size) + 1) / stride), F.lit(0))
    regular = F.transform(F.sequence(oldest, newest), lambda i: (i * stride).cast("bigint"))
    regular = F.filter(regular, lambda s: s <= last)
    final = F.filter(F.array(last.cast("bigint")), lambda s: (pos >= s) & (pos < s + size))
    return F.array_distinct(F.concat(regular, final))


def overlapping(turns: DataFrame, keys: list[str], ordinal: str = "ordinal", size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """One row per (window, turn): ``start`` and ``offset`` in the window."""
    placed = positions(turns, keys, ordinal, pos="pos", total="total")
    out = placed.withColumn("start", F.explode(starts_of(F.col("pos"), F.col("total"), size, stride)))
    return out.withColumn("offset", (F.col("pos") - F.col("start")).cast("int"))


def tumbling(turns: DataFrame, keys: list[str], ordinal: str = "ordinal", size: int = WINDOW_SIZE) -> DataFrame:
    placed = positions(turns, keys, ordinal, pos="pos", total="total")
    return placed.withColumn("start", (F.floor(F.col("pos") / size) * size).cast("bigint")).withColumn("offset", (F.col("pos") - F.col("start")).cast("int"))


def rendered(window_turns: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """Prompt text per window; a window holds at most its size in turns."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("offset", line.alias("line")))), lambda e: e["line"])
    return window_turns.groupBy(*keys, "start").agg(F.count("*").alias("n_turns"), F.array_join(lines, "\n").alias("text"))


def counts(turns: DataFrame, keys: list[str], size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Turns and windows per session, from the length alone."""
    n = turns.groupBy(*keys).agg(F.count("*").alias("n_turns"))
    last = F.greatest(F.col("n_turns") - size, F.lit(0))
    regular = F.floor(last / stride) + 1
    return n.withColumn("n_windows", (regular + F.when(last % stride != 0, 1).otherwise(0)).cast("bigint"))
