"""Best one-to-one assignment on the connected parts of a support graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.operators.graph import components


def assign(gains: dict[str, dict[str, int]]) -> dict[str, str]:
    """One partner per left name, and one left name per partner, of largest total gain.

    On equal gain more assigned names win, then the smaller partners in order of the
    left names, where none is smallest.  Successive shortest paths on whole numbers:
    gain, count and choice are digits of one weight, so ties need no enumeration.
    """
    left = sorted(gains)
    right = sorted({name for row in gains.values() for name in row})
    n, base = len(left), len(right) + 1
    rank = {name: i + 1 for i, name in enumerate(right)}
    one = base**n
    # Columns: 1..m are partners, m + i leaves the i-th left name open at no cost.
    costs = [{rank[b]: -(gain * one * (n + 1) + one - rank[b] * base ** (n - 1 - i)) for b, gain in gains[a].items()} | {len(right) + 1 + i: 0} for i, a in enumerate(left)]
    owner: dict[int, int] = {}
    row_price, column_price = [0] * n, dict.fromkeys(range(1, len(right) + n + 1), 0)
    for start in range(n):
        distance: dict[int, int] = {}
        came: dict[int, int] = {}
        done: dict[int, int] = {}
        row, column, travelled = start, 0, 0
        while True:
            for c, cost in costs[row].items():
                reached = travelled + cost - row_price[row] - column_price[c]
                if c not in done and (c not in distance or reached < distance[c]):
                    distance[c], came[c] = reached, column
            column = min((c for c in distance if c not in done), key=lambda c: (distance[c], c))
            travelled = done[column] = distance[column]
            if column not in owner:
                break
            row = owner[column]
        row_price[start] += travelled
        for c, reached in done.items():
            if c in owner:
                row_price[owner[c]] += travelled - reached
            column_price[c] -= travelled - reached
        while column:
            previous = came[column]
            owner[column] = owner[previous] if previous else start
            column = previous
    return {left[r]: right[c - 1] for c, r in sorted(owner.items()) if c <= len(right)}


def assignments(support: DataFrame, case: str, left: str, right: str, gain: str) -> DataFrame:
    """``(case, left, right, gain)``: the chosen pairs of ``support``, whose gains are positive whole numbers.

    Pairs that share no name, directly or through others, do not influence each
    other, so every connected part of a case is solved by itself.
    """
    types = dict(support.dtypes)
    pairs = support.select(case, F.col(left).cast("string").alias("_l"), F.col(right).cast("string").alias("_r"), F.col(gain).cast("bigint").alias("_g"))
    edges = pairs.select(case, F.concat(F.lit("l"), "_l").alias("a"), F.concat(F.lit("r"), "_r").alias("b"))
    roots = components(edges.select(case, F.col("a").alias("node_id")).distinct(), edges, case)
    parts = pairs.join(roots.select(case, F.substr("node_id", F.lit(2)).alias("_l"), F.col("root").alias("_part")), [case, "_l"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        gains: dict[str, dict[str, int]] = {}
        for a, b, g in zip(part["_l"], part["_r"], part["_g"].tolist()):
            gains.setdefault(a, {})[b] = g
        chosen = assign(gains)
        return pd.DataFrame({case: part[case].iloc[0], left: list(chosen), right: list(chosen.values()), gain: [gains[a][b] for a, b in chosen.items()]})

    return parts.groupBy(case, "_part").applyInPandas(run, f"{case} {types[case]}, {left} string, {right} string, {gain} bigint")
