"""Integrity audits; each returns violations or counts and never repairs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from colloquy.errors import ContractViolation

# Field names that would leak answers or identity.
FORBIDDEN_ROOT = ("qa", "answer", "gold", "evidence", "character", "participant_roster", "hidden", "audit", "source_provenance", "query_contract")
FORBIDDEN_TURN = ("addressee", "oracle", "ground_truth", "gold", "evidence", "answer", "voice", "cluster", "speaker_role", "tts_speaker")
IDENTITY_PARTS = ("speaker", "addressee", "voice", "cluster")


def has_marker(name: str, markers: tuple[str, ...]) -> bool:
    """The name is a marker, or starts or ends with one as a whole word."""
    return any(re.fullmatch(rf"{m}|{m}_.*|.*_{m}", name.strip().lower()) for m in markers)


def safe_projection(df: DataFrame, allowed: tuple[str, ...], forbidden: tuple[str, ...] = FORBIDDEN_TURN) -> DataFrame:
    """Whitelisted columns only; a forbidden name on the whitelist is an error."""
    leaking = [c for c in allowed if has_marker(c, forbidden)]
    if leaking:
        raise ContractViolation(f"forbidden fields requested: {leaking}")
    return df.select(*[c for c in df.columns if c in allowed])


def strip_identity(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(p in c.lower() for p in IDENTITY_PARTS)])


def dangling(edges: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges whose end does not exist."""
    return edges.filter(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def count_as(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check_name"), "violations")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of coordinates on both sides, only left and only right."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    status = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing").otherwise("matched")
    return a.join(b, keys, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts lost and gained as multisets; equal relations give zero twice."""
    columns = sorted(set(before.columns))
    left, right = before.select(*columns), after.select(*columns)
    # Copies cancel inside each task before anything moves.
    signed = left.withColumn("_s", F.lit(1)).unionByName(right.withColumn("_s", F.lit(-1)))
    net = signed.groupBy(*columns).agg(F.sum("_s").alias("_n"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).alias("gained"),
    )


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail closed on the first violation."""
    first = violations.take(1)
    if first:
        raise ContractViolation(f"{what}: {first[0].asDict()}")
