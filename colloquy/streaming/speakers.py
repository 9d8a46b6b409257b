"""The one true state machine as a stateful stream: prototypes per case."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from colloquy.config import OnlinePolicy
from colloquy.operators.speakers import DECISION, Registry, decide

STATE = "prototypes array<array<double>>, turns array<bigint>, updates array<bigint>"


def match_stream(turns: DataFrame, order: list[str], keep: list[str], policy: OnlinePolicy = OnlinePolicy(), case: str = "case_id") -> DataFrame:
    """Decisions for a stream of turns; a case's turns must arrive in order across batches.

    Within a batch they are sorted first, so file layout does not matter.
    """
    types = dict(turns.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        registry = Registry(policy, *state.get) if state.exists else Registry(policy)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order)
        yield decide(registry, rows, keep)
        state.update(([p.tolist() for p in registry.prototypes], registry.turns, registry.updates))

    columns = list(dict.fromkeys([case, *order, *keep, "vec"]))
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + DECISION
    return turns.select(*columns).groupBy(case).applyInPandasWithState(step, schema, STATE, "append", "NoTimeout")
