"""Overlapping turn windows over a stream: the last turns of a session are the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

from colloquy.config import WINDOW_SIZE, WINDOW_STRIDE
from colloquy.operators.ranking import positions

OUTPUT = "session_id string, start bigint, n_turns int, first_ref string, last_ref string"


def window_stream(turns: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """Every full stride window as soon as its last turn arrives.

    The extra window that ends at a session's last turn is known only once the
    session is over; :func:`closing_windows` gives it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, recent = state.get if state.exists else (0, [])
        recent, done = list(recent), []
        for ref in pd.concat(list(frames), ignore_index=True).sort_values("ordinal")["ref"]:
            recent = (recent + [ref])[-size:]
            seen += 1
            if seen >= size and (seen - size) % stride == 0:
                done.append((key[0], seen - size, size, recent[0], recent[-1]))
        state.update((seen, recent))
        yield pd.DataFrame(done, columns=["session_id", "start", "n_turns", "first_ref", "last_ref"]).astype({"start": "int64", "n_turns": "int32"})

    return turns.select("session_id", "ordinal", "ref").groupBy("session_id").applyInPandasWithState(step, OUTPUT, "seen bigint, recent array<string>", "append", "NoTimeout")


def closing_windows(turns: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """The window that ends at the last turn of a finished session, unless a stride window ends there."""
    placed = positions(turns.select("session_id", "ordinal", "ref"), ["session_id"], "ordinal", pos="pos", total="total")
    start = F.greatest(F.col("total") - size, F.lit(0))
    streamed = (F.col("total") >= size) & ((F.col("total") - size) % stride == 0)
    last = placed.withColumn("start", start.cast("bigint")).filter(~streamed & (F.col("pos") >= F.col("start")))
    return last.groupBy("session_id", "start").agg(F.count("*").cast("int").alias("n_turns"), F.min_by("ref", "pos").alias("first_ref"), F.max_by("ref", "pos").alias("last_ref"))
