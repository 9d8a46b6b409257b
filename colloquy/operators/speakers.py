"""Speaker prototypes: one-pass matching, asker confidence, cluster-to-gold matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.config import AskerPolicy, OnlinePolicy
from colloquy.operators.assignment import assignments
from colloquy.operators.folds import ordered_fold

DECISION = "speaker string, created boolean, top_cosine double, runner_up double, updated boolean"


class Registry:
    """Prototypes of one case in order of appearance."""

    def __init__(self, policy: OnlinePolicy, prototypes=(), turns=(), updates=()):
        self.policy = policy
        # Rows of one matrix that doubles when it is full.
        self._rows = np.array([np.asarray(p, dtype=np.float64) for p in prototypes]) if len(prototypes) else np.zeros((0, 0))
        self._n = len(self._rows)
        self.turns, self.updates = list(turns), list(updates)

    @property
    def prototypes(self) -> np.ndarray:
        return self._rows[: self._n]

    def _append(self, vector: np.ndarray) -> None:
        if self._n == len(self._rows):
            grown = np.zeros((max(8, 2 * self._n), len(vector)))
            if self._n:
                grown[: self._n] = self.prototypes
            self._rows = grown
        self._rows[self._n] = vector
        self._n += 1

    def ingest(self, vector: np.ndarray) -> tuple:
        """Assign one vector: nearest prototype above the threshold, else a new one."""
        best = runner = None
        if self._n:
            cosines = self.prototypes @ vector
            # Among equal cosines the latest prototype wins.
            at = len(cosines) - 1 - int(np.argmax(cosines[::-1]))
            best = float(cosines[at])
            runner = float(np.partition(cosines, -2)[-2]) if len(cosines) > 1 else None
        if best is None or best < self.policy.match_cosine:
            self._append(vector)
            self.turns.append(1)
            self.updates.append(0)
            return self._name(self._n), True, best, runner, False
        updated = best >= self.policy.update_cosine
        if updated:
            blend = (1.0 - self.policy.alpha) * self.prototypes[at] + self.policy.alpha * vector
            self.prototypes[at] = blend / (np.linalg.norm(blend) + 1e-12)
            self.updates[at] += 1
        self.turns[at] += 1
        return self._name(at + 1), False, best, runner, updated

    @staticmethod
    def _name(number: int) -> str:
        return f"ONLINE_SPK_{number:03d}"


def decide(registry: Registry, rows: pd.DataFrame, keep: list[str]) -> pd.DataFrame:
    made = [registry.ingest(np.asarray(v, dtype=np.float64)) for v in rows["vec"]]
    out = rows[keep].reset_index(drop=True)
    columns = ["speaker", "created", "top_cosine", "runner_up", "updated"]
    return pd.concat([out, pd.DataFrame(made, columns=columns).astype({"top_cosine": "float64", "runner_up": "float64"})], axis=1)


class _Online:
    def __init__(self, policy: OnlinePolicy, keep: list[str]):
        self.registry, self.keep = Registry(policy), keep

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        return decide(self.registry, rows, self.keep)

    def finish(self) -> None:
        return None


def online_match(turns: DataFrame, order: list[str], keep: list[str], policy: OnlinePolicy = OnlinePolicy(), case: str = "case_id") -> DataFrame:
    """Batch twin of the streaming matcher: every case in turn order."""
    types = dict(turns.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + DECISION
    columns = list(dict.fromkeys([case, *order, *keep, "vec"]))
    return ordered_fold(turns.select(*columns), [case], order, lambda key: _Online(policy, keep), schema)


def asker_confidence(ranked: DataFrame, keys: list[str], policy: AskerPolicy = AskerPolicy()) -> DataFrame:
    """Tier from the two nearest prototypes: ``ranked(keys, rank, node_id, score)``."""
    two = ranked.filter("rank <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("node_id"))).alias("nearest"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("cosine"),
        F.max(F.when(F.col("rank") == 2, F.col("node_id"))).alias("runner_up"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(-1.0)).alias("_second"),
    )
    margin: Column = F.col("cosine") - F.col("_second")
    tier = (
        F.when(F.col("cosine") < policy.match, "unresolved")
        .when((F.col("cosine") >= policy.high) & (margin >= policy.margin), "high").otherwise("low")
    )
    return two.withColumn("margin", margin).withColumn("confidence", tier).drop("_second")


def gold_matching(confusion: DataFrame, case: str = "case_id") -> DataFrame:
    """One-to-one cluster-to-speaker pairs per case from counted ``(case, gold, pred, n)``, most turns first."""
    return assignments(confusion.filter("n > 0"), case, "gold", "pred", "n")
