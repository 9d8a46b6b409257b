"""Acoustic fragments: evidence between clusters and their reconciliation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.config import FragmentPolicy
from colloquy.operators.ranking import top_k
from colloquy.session import cut_lineage

PAIR = ["case_id", "src", "dst"]


def cluster_sizes(turns: DataFrame) -> DataFrame:
    """``(case, label, session_id, n)``."""
    return turns.groupBy("case_id", "label", "session_id").agg(F.count("*").alias("n"))


def pair_statistics(counts: DataFrame, top_pairs: int = 5) -> DataFrame:
    """Median, maximum, pair count and mean of the best pairs per cluster pair."""
    base = counts.groupBy(*PAIR).agg(F.expr("percentile(value, 0.5D, n)").alias("median"), F.max("value").alias("max_cos"), F.sum("n").alias("pairs"))
    best = top_k(counts, PAIR, [F.col("value").desc()], top_pairs, "_r")
    before = Window.partitionBy(*PAIR).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("n").over(before), F.lit(0))
    take = F.greatest(F.least(F.col("n"), F.lit(top_pairs) - used), F.lit(0))
    means = best.withColumn("_t", take).groupBy(*PAIR).agg((F.sum(F.col("value") * F.col("_t")) / F.sum("_t")).alias("top_mean"))
    return base.join(means, PAIR)


def cluster_summary(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Size, sessions and within-cluster median; the median is NULL for one turn."""
    own = counts.filter("src = dst").groupBy("case_id", F.col("src").alias("label")).agg(F.expr("percentile(value, 0.5D, n)").alias("within_median"))
    total = sizes.groupBy("case_id", "label").agg(F.sum("n").alias("size"), F.count("*").alias("n_sessions"))
    return total.join(own, ["case_id", "label"], "left")


def pair_evidence(counts: DataFrame, sizes: DataFrame, policy: FragmentPolicy = FragmentPolicy()) -> DataFrame:
    """Directed evidence between the clusters of a case."""
    # One row per cluster pair, read in both directions: the counts are ranked once.
    stats = cut_lineage(pair_statistics(counts.filter("src <> dst"), policy.top_pairs))
    both = stats.unionByName(stats.withColumn("_s", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("_s")).drop("_s"))
    info = cluster_summary(counts, sizes)
    for side, name in (("src", "source"), ("dst", "target")):
        both = both.join(
            info.select("case_id", F.col("label").alias(side), F.col("size").alias(f"{name}_size"), F.col("n_sessions").alias(f"_{name}_sessions"), F.col("within_median").alias(f"_{name}_within")),
            ["case_id", side],
        )
    spots = sizes.select("case_id", "label", "session_id")
    shared = (
        spots.withColumnRenamed("label", "src").join(spots.withColumnRenamed("label", "dst"), ["case_id", "session_id"]).filter("src <> dst")
        .groupBy(*PAIR).agg(F.count("*").alias("_shared"))
    )
    e = both.join(shared, PAIR, "left").fillna({"_shared": 0})
    floor = F.least("_source_within", "_target_within")
    cohesion = F.when(floor.isNotNull(), F.col("median") / F.greatest(F.lit(1e-6), floor))
    return e.select(
        *PAIR, "source_size", "target_size", (F.least("source_size", "target_size") / F.greatest("source_size", "target_size")).alias("size_ratio"),
        "max_cos", "top_mean", "median", cohesion.alias("cohesion"),
        (F.col("_shared") / F.greatest(F.lit(1), F.least("_source_sessions", "_target_sessions"))).alias("session_overlap"),
    )


def _score() -> Column:
    """Best pairs decide for one turn, the median for more."""
    return F.when(F.col("source_size") == 1, F.col("top_mean")).otherwise(F.col("median"))


def links(evidence: DataFrame, policy: FragmentPolicy = FragmentPolicy()) -> DataFrame:
    """Best target of every smaller side with the reasons against merging."""
    scored = evidence.withColumn("score", _score())
    # Two rows per cluster, read three times.
    ranked = cut_lineage(top_k(scored, ["case_id", "src"], [F.col("score").desc(), F.col("dst").desc()], 2))
    best = ranked.filter("rank = 1").drop("rank")
    second = ranked.filter("rank = 2").select("case_id", "src", F.col("score").alias("runner"))
    back = best.select("case_id", F.col("src").alias("dst"), F.col("dst").alias("_back"))
    j = best.join(second, ["case_id", "src"], "left").join(back, ["case_id", "dst"], "left").filter("source_size <= target_size")
    single = F.col("source_size") == 1
    has_runner = F.col("runner").isNotNull()
    mutual = F.coalesce(F.col("_back") == F.col("src"), F.lit(False))
    checks = {
        "balanced_components": F.col("size_ratio") > policy.max_size_ratio,
        "target_too_small": single & (F.col("target_size") < policy.min_singleton_target),
        "top_k_mean_below_floor": single & (F.col("top_mean") < policy.min_singleton_mean),
        "margin_below_floor": single & has_runner & (F.col("score") - F.col("runner") < policy.min_singleton_margin),
        "not_reciprocal_best": ~single & ~mutual,
        "relative_separation_below_floor": has_runner
        & F.when(single, F.col("score") / F.greatest(F.lit(1e-8), F.col("runner")) < policy.min_singleton_separation).otherwise(
            F.col("score") < policy.min_separation * F.greatest(F.col("runner"), F.lit(0.02))
        ),
        "cohesion_below_floor": ~single & (F.col("cohesion").isNull() | (F.col("cohesion") < policy.min_cohesion)),
        "session_support_below_floor": ~single & (F.col("session_overlap") < policy.min_session_overlap),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    return j.withColumn("mutual", mutual).withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop("_back")


def reconcile(counts: DataFrame, sizes: DataFrame, policy: FragmentPolicy = FragmentPolicy()) -> DataFrame:
    """``(case, label, final)``: clusters after merging the best link per case and pass.

    Cosine counts add up under relabelling, so a merge is a regrouping and no
    vector is read again.  Cases proceed side by side until none has a link left;
    every merge leaves one cluster less, so this ends.  A case without a link gets
    none later, so its counts are not carried into the next pass.
    """
    mapping = cut_lineage(sizes.select("case_id", "label").distinct().withColumn("final", F.col("label")))
    counts, sizes = cut_lineage(counts), cut_lineage(sizes)
    for number in itertools.count(1):
        proposals = links(pair_evidence(counts, sizes, policy), policy).filter("accepted")
        order = [F.col("score").desc(), F.col("size_ratio").asc(), F.col("src").asc()]
        chosen = cut_lineage(top_k(proposals, ["case_id"], order, 1).select("case_id", "src", "dst"))
        if not chosen.limit(1).count():
            break
        name = F.lit(f"MERGED_{number:03d}")
        renames = chosen.select("case_id", F.explode(F.array("src", "dst")).alias("_from")).withColumn("_to", name)

        def renamed(df: DataFrame, column: str) -> DataFrame:
            j = df.join(renames.withColumnRenamed("_from", column), ["case_id", column], "left")
            return j.withColumn(column, F.coalesce("_to", column)).drop("_to")

        active = chosen.select("case_id")
        mapping = cut_lineage(renamed(mapping, "final"))
        moved = renamed(renamed(counts.join(active, "case_id", "left_semi"), "src"), "dst")
        lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
        counts = cut_lineage(moved.groupBy("case_id", lo.alias("src"), hi.alias("dst"), "value").agg(F.sum("n").alias("n")))
        sizes = cut_lineage(renamed(sizes.join(active, "case_id", "left_semi"), "label").groupBy("case_id", "label", "session_id").agg(F.sum("n").alias("n")))
    return mapping
