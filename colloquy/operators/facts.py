"""Grounded facts: normalisation with quarantine, identity binding, deduplication, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.errors import ContractViolation
from colloquy.functions.ids import fact_id
from colloquy.functions.text import collapse, distinct_by_key, distinct_nonempty, identity_key, text_key

# Fixed values.
OPERATIONS = (
    "coreference", "relative_time", "reply_resolution", "state_transition",
    "multi_turn_answer", "speaker_attribution", "multi_turn_synthesis",
)
ROLE_WORDS = {"user": ("user", "human", "character", "participant"), "assistant": ("assistant", "agent", "ai", "chatbot")}
UNKNOWN_WORDS = ("", "unknown", "unk", "none", "null", "n/a", "unspecified")
GROUP_WORDS = ("group", "everyone", "all", "all participants", "multiple people")
VIEWS = ("full", "no_coreference", "single_turn_only", "no_role_metadata")


def role(value: Column | str) -> Column:
    """``user``, ``assistant`` or NULL for anything else."""
    word = F.lower(F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, words in ROLE_WORDS.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def normalise(proposed: DataFrame) -> DataFrame:
    """Two-party facts with a ``problem`` column; NULL marks a valid fact.

    ``proposed`` holds the model's fields plus ``character``, ``valid_refs`` and
    ``valid_images`` of its window.  Invalid rows are kept for a quarantine table.
    """
    f = (
        proposed.withColumn("text", collapse(F.coalesce("text", F.lit(""))))
        .withColumn("refer_ids", distinct_nonempty(F.col("refer_ids")))
        .withColumn("image_ids", distinct_nonempty(F.col("image_ids")))
        .withColumn("context_operations", distinct_nonempty(F.col("context_operations")))
        .withColumn("_role", role("source_role"))
    )
    allowed = F.array(*[F.lit(o) for o in OPERATIONS])
    problem = (
        F.when(F.col("text") == "", "empty_text")
        .when((F.size("refer_ids") == 0) | (F.size(F.array_except("refer_ids", "valid_refs")) > 0), "invalid_refer_ids")
        .when(F.size(F.array_except("image_ids", "valid_images")) > 0, "invalid_image_ids")
        .when(F.col("_role").isNull(), "invalid_role")
        .when(F.size(F.array_except("context_operations", allowed)) > 0, "unknown_operation")
    )
    multi = (F.size("refer_ids") > 1) & (F.size("context_operations") == 0)
    f = (
        f.withColumn("problem", problem)
        .withColumn("context_operations", F.when(multi, F.array(F.lit("multi_turn_synthesis"))).otherwise(F.col("context_operations")))
        .withColumn("speaker", F.when(F.col("_role") == "user", F.col("character")).otherwise("assistant"))
        .withColumn("addressee", F.when(F.col("_role") == "user", F.lit("assistant")).otherwise(F.col("character")))
    )
    return f.withColumn("node_id", fact_id("speaker", text_key("text"), "refer_ids")).withColumn(
        "retrieval_text", F.concat(F.lit("speaker="), "speaker", F.lit("; addressee="), "addressee", F.lit("; "), "text")
    ).drop("_role", "valid_refs", "valid_images", "character")


def deduplicate(facts: DataFrame, speaker: str = "speaker", fold: bool = False) -> DataFrame:
    """The version with most references, operations and then highest id per speaker and text key.

    The key travels as a digest, and each task folds its own copies first.
    """
    keyed = facts.withColumn("_k", F.sha2(text_key("text", fold), 256)).withColumn("_r", F.struct(F.size("refer_ids"), F.size("context_operations"), F.col("node_id")))
    best = keyed.groupBy(speaker, "_k").agg(F.max("_r").alias("_r"), F.count("*").alias("copies"))
    kept = best.select(speaker, F.col("_r.node_id").alias("node_id"), "copies")
    return facts.dropDuplicates([speaker, "node_id"]).join(kept, [speaker, "node_id"])


def ablation(facts: DataFrame, view: str) -> DataFrame:
    """A view derived without another extraction."""
    if view == "full":
        return facts
    if view == "no_coreference":
        return facts.filter(~F.array_contains("context_operations", "coreference"))
    if view == "single_turn_only":
        return facts.filter(F.size("refer_ids") == 1)
    if view == "no_role_metadata":
        return facts.withColumn("retrieval_text", F.col("text"))
    raise ContractViolation(f"unknown ablation view: {view}")


def bind_speakers(proposed: DataFrame, raw: DataFrame, keys: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """Speaker grounded in the cited turns.

    ``proposed(keys, proposed, refer_ids)``, ``raw(ref, speaker)``.  One cited
    speaker wins outright; among several the proposal must be one of them.
    """
    cited = proposed.select(*keys, "proposed", F.posexplode("refer_ids").alias("pos", "ref")).join(raw, "ref", "left")
    # A fact cites a handful of turns, so its candidate list is short.
    groups = cited.groupBy(*keys, "proposed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda e: F.trim(F.coalesce(e["speaker"], F.lit("")))).alias("labels"),
        F.count_if(F.col("speaker").isNull()).alias("missing"),
    )
    names = groups.withColumn("candidates", distinct_by_key(F.col("labels"), identity_key))
    match = F.filter("candidates", lambda c: identity_key(c) == identity_key(F.col("proposed")))
    status = (
        F.when(F.col("missing") > 0, "unknown_reference")
        .when(F.size("candidates") == 0, "no_speaker")
        .when(F.size("candidates") == 1, "single_cited_speaker")
        .when(F.size(match) > 0, "model_grounded_multi_speaker")
        .otherwise("not_a_cited_speaker")
    )
    value = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).otherwise(F.get(match, F.lit(0)))
    bound = status.isin("single_cited_speaker", "model_grounded_multi_speaker")
    return names.select(*keys, status.alias("source"), F.when(bound, value).alias("speaker"), F.size("candidates").alias("n_candidates"))


def bind_addressee(proposed: Column, candidates: Column) -> Column:
    """``struct(value, source)``: an allowed identity, ``group`` or ``unknown``."""
    key = identity_key(proposed)
    match = F.filter(distinct_by_key(candidates, identity_key), lambda c: identity_key(c) == key)
    source = (
        F.when(key.isin(*GROUP_WORDS), "model_group")
        .when(key.isin(*UNKNOWN_WORDS), "model_unknown")
        .when(F.size(match) > 0, "model_grounded_candidate")
        .otherwise("unresolved_candidate")
    )
    value = F.when(source == "model_group", "group").when(source == "model_grounded_candidate", F.get(match, F.lit(0))).otherwise("unknown")
    return F.struct(value.alias("value"), source.alias("source"))


def bind_addressees(proposals: Column, candidates: Column) -> Column:
    """Bound addressees of a list; ``group`` anywhere wins, nothing bound is ``unknown``."""
    bound = F.transform(proposals, lambda p: bind_addressee(p, candidates)["value"])
    named = F.array_distinct(F.filter(bound, lambda v: ~v.isin("group", "unknown")))
    return F.when(F.array_contains(bound, "group"), F.array(F.lit("group"))).when(F.size(named) > 0, named).otherwise(F.array(F.lit("unknown")))


def resolve_hints(hints: DataFrame, aliases: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``(keys, hint, stable, source)``: exact alias or unique first word.

    ``hints(keys, hint)`` and ``aliases(stable, alias)``; an ambiguous hint stays
    unresolved.
    """
    a = aliases.select("stable", identity_key("alias").alias("k")).filter("k <> ''").distinct()
    exact = a.groupBy("k").agg(F.min("stable").alias("e"), F.countDistinct("stable").alias("en"))
    first = a.select("stable", F.split_part("k", F.lit(" "), F.lit(1)).alias("k")).groupBy("k").agg(F.min("stable").alias("f"), F.countDistinct("stable").alias("fn"))
    h = hints.withColumn("k", identity_key("hint")).filter("k <> ''")
    j = h.join(exact, "k", "left").join(first, "k", "left")
    is_exact = F.coalesce(F.col("en") == 1, F.lit(False))
    is_first = ~is_exact & ~F.col("k").contains(" ") & F.coalesce(F.col("fn") == 1, F.lit(False))
    return j.select(
        *keys, "hint", F.when(is_exact, F.col("e")).when(is_first, F.col("f")).alias("stable"),
        F.when(is_exact, "exact_profile_alias").when(is_first, "unique_alias_token").otherwise("unresolved_or_ambiguous").alias("source"),
    )
