"""Evaluation metrics over result relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.ids import panel_key
from colloquy.operators.ranking import top_k

# An answer counts as correct from this score on.
CORRECT = 0.75

# Report categories by fine label and by question-id prefix.
CATEGORIES = ("interaction_attribution", "memory_evolution_conflict", "personalized_qa", "retrieval_reasoning")
FINE_CATEGORY = {
    "attribution": "interaction_attribution",
    "conflict": "memory_evolution_conflict",
    "conflict_detection": "memory_evolution_conflict",
    "supersede": "memory_evolution_conflict",
    "personalized": "personalized_qa",
    "personalized_retrieval": "personalized_qa",
    "personalized_adversarial": "personalized_qa",
    "adversarial": "retrieval_reasoning",
    "multi_hop": "retrieval_reasoning",
    "multi_hop_retrieval": "retrieval_reasoning",
    "single_hop": "retrieval_reasoning",
    "single_hop_retrieval": "retrieval_reasoning",
    "temporal": "retrieval_reasoning",
    "temporal_order": "retrieval_reasoning",
}
PREFIX_CATEGORY = {
    "ADDRESSEE_ATTRIBUTION": "interaction_attribution",
    "SPEAKER_ATTRIBUTION": "interaction_attribution",
    "PERSONALIZATION": "personalized_qa",
    "PERSONALIZATION_APPLICATION": "personalized_qa",
    "CONFLICT_DETECTION": "memory_evolution_conflict",
    "ADVERSARIAL": "retrieval_reasoning",
    "MULTI_HOP": "retrieval_reasoning",
    "SINGLE_HOP": "retrieval_reasoning",
    "TEMPORAL": "retrieval_reasoning",
}


def accuracy(score: Column) -> Column:
    return F.avg((score >= CORRECT).cast("double"))


def summary(results: DataFrame, benchmark: str, topic: str, score: str) -> DataFrame:
    """Topics, questions and micro mean per benchmark."""
    return results.groupBy(benchmark).agg(
        F.countDistinct(topic).alias("topics"), F.count("*").alias("qa"), F.avg(score).alias("mean_score")
    )


def by_level(results: DataFrame, case: str, point: str, score: str) -> DataFrame:
    """Mean and accuracy per case and point, per case, and over everything (micro)."""
    level = F.grouping_id()
    return results.rollup(case, point).agg(
        F.count("*").alias("n"), F.avg(score).alias("avg_score"), accuracy(F.col(score)).alias("acc"), level.alias("level")
    )


def macro(results: DataFrame, case: str, score: str) -> DataFrame:
    """Mean of case means."""
    cases = results.groupBy(case).agg(F.avg(score).alias("a"), accuracy(F.col(score)).alias("c"))
    return cases.agg(F.count("*").alias("n"), F.avg("a").alias("avg_score"), F.avg("c").alias("acc"))


def evidence_recall(gold: DataFrame, retrieved: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Share of distinct gold references retrieved; questions without gold give no row."""
    g, r = gold.select(*keys, "ref").distinct(), retrieved.select(*keys, "ref").distinct().withColumn("_hit", F.lit(1))
    return g.join(r, [*keys, "ref"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_gold"), F.count("_hit").alias("matched"), (F.count("_hit") / F.count("*")).alias("recall")
    )


def win_tie_loss(pairs: DataFrame, new: str, old: str, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.count_if(F.col(new) > F.col(old)).alias("wins"),
        F.count_if(F.col(new) == F.col(old)).alias("ties"),
        F.count_if(F.col(new) < F.col(old)).alias("losses"),
        F.avg(F.col(new) - F.col(old)).alias("mean_gain"),
    )


def paired(results: DataFrame, new_arm: str, old_arm: str, keys: tuple[str, ...] = ("case_id", "qa_id")) -> DataFrame:
    """Scores of two arms on the questions both answered."""
    side = lambda arm, name: results.filter(F.col("arm") == arm).select(*keys, F.col("score").alias(name))
    return side(new_arm, "new").join(side(old_arm, "old"), list(keys))


def category(formal: Column, fine: Column, qa_id: Column, fine_map: dict = FINE_CATEGORY, prefix_map: dict = PREFIX_CATEGORY, formal_set=CATEGORIES) -> Column:
    """``struct(category, source)``: formal label, else fine label, else id prefix."""
    fine_hit, prefix_hit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, target in fine_map.items():
        fine_hit = F.when(fine == label, target).otherwise(fine_hit)
    for prefix, target in reversed(prefix_map.items()):
        prefix_hit = F.when((qa_id == prefix) | qa_id.startswith(prefix + "_"), target).otherwise(prefix_hit)
    formal_hit = F.when(formal.isin(*formal_set), formal)
    source = (
        F.when(formal_hit.isNotNull(), "formal_four_way_category").when(fine_hit.isNotNull(), "legacy_fine_category")
        .when(prefix_hit.isNotNull(), "qa_id_prefix").otherwise("unmapped")
    )
    return F.struct(F.coalesce(formal_hit, fine_hit, prefix_hit, F.lit("unmapped")).alias("category"), source.alias("source"))


def first_per_type(rows: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    return top_k(rows, [kind], [F.col(order)], n, "place")


def hash_panel(rows: DataFrame, case: str, item: str, n: int, seed: str) -> DataFrame:
    """The ``n`` items per case with the smallest seeded digest."""
    keyed = rows.withColumn("digest", panel_key(seed, case, item))
    return top_k(keyed, [case], [F.col("digest"), F.col(item)], n, "place")


def scope_summary(results: DataFrame, by: str, scope: str, score: str, reused: str) -> DataFrame:
    return results.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"),
        F.count_if(F.col(scope) == "asker_only").alias("asker_only"), F.count_if(F.col(scope) == "global").alias("global_scope"),
        F.count_if(F.col(reused)).alias("reused"),
    )


def usage(lines: DataFrame, text: str) -> DataFrame:
    """Call and token totals from usage footers; a footer must add up."""
    footer = r"\[LLM usage\]\s+calls=(\d+)\s+prompt=(\d+)\s+completion=(\d+)\s+total_tokens=(\d+)"
    part = lambda i: F.regexp_extract(text, footer, i).try_cast("bigint")
    found = lines.select(part(1).alias("calls"), part(2).alias("prompt"), part(3).alias("completion"), part(4).alias("total")).filter("calls IS NOT NULL")
    return found.agg(
        F.count("*").alias("footers"), F.sum("calls").alias("calls"), F.sum("total").alias("total_tokens"),
        F.count_if(F.col("prompt") + F.col("completion") != F.col("total")).alias("inconsistent"),
    )


def equal_within(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    return F.abs(a - b) <= tolerance


def diversity(refs: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Spread of a context over its sources: entropy, effective number, redundancy."""
    per_ref = refs.groupBy(*keys, "ref").agg(F.count("*").alias("c"))
    totals = per_ref.groupBy(*keys).agg(
        F.count("*").alias("unique_refs"), F.sum("c").alias("mentions"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("_clogc")
    )
    # -sum(p ln p) = ln(n) - sum(c ln c) / n
    entropy = F.log(F.col("mentions").cast("double")) - F.col("_clogc") / F.col("mentions")
    return totals.select(
        *keys, "unique_refs", "mentions", (F.lit(1.0) - F.col("unique_refs") / F.col("mentions")).alias("redundancy"),
        entropy.alias("entropy"), F.exp(entropy).alias("effective_support"),
    )
