"""Order-dependent folds per key as one sorted streaming pass.

Rows arrive sorted in Arrow batches and a key's state is all that stays in
memory, so a long sequence never becomes one pandas frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Fold(Protocol):
    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None: ...

    def finish(self) -> pd.DataFrame | None: ...


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """Run one fold per key over its rows in ``order``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        fold: Fold | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum()
            for _, part in pdf.groupby(change, sort=False):
                key = tuple(part[keys].iloc[0])
                if key != current:
                    if fold is not None and (last := fold.finish()) is not None:
                        yield last
                    current, fold = key, make(key)
                out = fold.feed(part)
                if out is not None and len(out):
                    yield out
        if fold is not None and (last := fold.finish()) is not None:
            yield last

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
