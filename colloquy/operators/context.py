"""Reorder, filter and merge retrieved contexts.

A context holds at most a few dozen rows per question, so per-question windows
and arrays are small whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.dates import LAST_ORDINAL, UNKNOWN_DATE, date_prefix
from colloquy.functions.text import natural_key
from colloquy.operators.ranking import by_score

# Identity boosts.
SOURCE_BOOST, ADDRESSEE_BOOST, BOOST_CAP = 0.020, 0.010, 0.025
LOW_DIRECT, LOW_RELATION, LOW_CAP, LOW_LEXICAL = 0.010, 0.008, 0.018, 0.2


def _renumber(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fail_open_date(ranked: DataFrame, keys: list[str], date: str = "date", value: str = "time_range") -> DataFrame:
    """Keep rows of the asked date if the list has any, otherwise keep the list.

    Runs after the depth limit of the list and renumbers what is left.
    """
    asked = F.col(value).isNotNull() & (F.length(value) == 10)
    same = F.coalesce(F.col(date) == F.col(value), F.lit(False))
    n = F.count_if(same).over(Window.partitionBy(*keys))
    kept = ranked.withColumn("_n", n).filter(~F.coalesce(asked, F.lit(False)) | (F.col("_n") == 0) | same)
    return _renumber(kept.withColumn("_old", F.col("rank")), keys, [F.col("_old")], "rank").drop("_n", "_old")


def chronological_slots(context: DataFrame, keys: list[str], slot: str = "slot", raw: str = "is_raw") -> DataFrame:
    """Sort raw rows by time within the slots raw rows occupy; other rows stay put.

    ``context`` carries ``date``, ``session_id`` and ``ordinal``.
    """
    day = date_prefix("date")
    order = [
        F.when(day.isNotNull(), 0).otherwise(1), F.coalesce(day, F.lit(UNKNOWN_DATE)), natural_key("session_id"),
        F.coalesce("ordinal", F.lit(LAST_ORDINAL)), F.col(slot),
    ]
    group = [*keys, raw]
    numbered = _renumber(_renumber(context, group, [F.col(slot)], "_place"), group, order, "_time")
    places = numbered.select(*keys, raw, F.col("_place").alias("_n"), F.col(slot).alias("_slot"))
    number = F.when(F.col(raw), F.col("_time")).otherwise(F.col("_place"))
    moved = numbered.withColumn("_n", number).join(places, [*keys, raw, "_n"])
    return moved.withColumn("new_slot", F.col("_slot")).drop("_n", "_place", "_time", "_slot")


def time_order(context: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """Final chronological order of an iterative context; sessions compare as text."""
    order = [F.coalesce("date", F.lit(UNKNOWN_DATE)), F.coalesce("session_id", F.lit("")), F.coalesce("ordinal", F.lit(0)), F.col(slot)]
    return _renumber(context, keys, order, "new_slot")


def visual_budget(context: DataFrame, visual: DataFrame, keys: list[str], node: str = "node_id", limit: int | None = None) -> DataFrame:
    """Context rows with images: visual-channel order first, then context order."""
    best = visual.groupBy(*keys, node).agg(F.min("rank").alias("_v"))
    rows = context.filter("has_image").groupBy(*keys, node).agg(F.min("slot").alias("slot")).join(best, [*keys, node], "left")
    order = [F.when(F.col("_v").isNotNull(), 0).otherwise(1), F.coalesce("_v", "slot"), F.col("slot")]
    out = _renumber(rows, keys, order, "place").drop("_v")
    return out if limit is None else out.filter(F.col("place") <= limit)


def merge_rounds(contexts: DataFrame, rounds: list[str], budgets: tuple[int, ...], top_k: int = 30) -> DataFrame:
    """Add ``packed`` and per-round counts from ranked id arrays, one column per round.

    A round admits only ids no earlier round looked at; its rows displace the tail
    of what is packed, and displaced ids do not come back.
    """
    empty = F.array().cast("array<string>")
    df = contexts.withColumn("_seen", empty).withColumn("packed", empty)
    total = F.lit(0)
    for i, name in enumerate(rounds):
        budget = budgets[min(i, len(budgets) - 1)]
        looked = F.array_distinct(F.slice(F.coalesce(F.col(name), empty), 1, budget))
        df = df.withColumn("_look", looked).withColumn("_new", F.array_except("_look", "_seen"))
        kept = F.slice("packed", F.lit(1), F.greatest(F.lit(top_k) - F.size("_new"), F.lit(0)))
        merged = F.slice("_new", 1, top_k) if i == 0 else F.when(F.size("_new") > 0, F.concat(kept, F.slice("_new", 1, top_k))).otherwise(F.col("packed"))
        df = df.withColumn("packed", merged).withColumn(f"considered_{i}", F.size("_look")).withColumn(f"admitted_{i}", F.size("_new"))
        df = df.withColumn("_seen", F.array_union("_seen", "_look"))
        total = total + F.col(f"considered_{i}")
    return df.withColumn("deduplicated", total - F.size("_seen")).drop("_seen", "_look", "_new")


def selected_first(context: DataFrame, keys: list[str], node: str = "node_id", memory_ids: str = "memory_ids", image_ids: str = "wanted_images", images: str = "image_ids") -> DataFrame:
    """Rows the model pointed at come first; nothing enters or leaves."""

    def last_place(ids: Column, value: Column) -> Column:
        found = F.array_position(F.reverse(ids), value)
        return F.when(found > 0, F.size(ids) - found)

    by_memory = last_place(F.col(memory_ids), F.col(node))
    by_image = F.array_min(F.transform(F.filter(images, lambda i: F.array_contains(image_ids, i)), lambda i: last_place(F.col(image_ids), i)))
    order = [
        by_memory.isNull().cast("int"), F.coalesce(by_memory, F.lit(LAST_ORDINAL)),
        by_image.isNull().cast("int"), F.coalesce(by_image, F.lit(LAST_ORDINAL)), F.col("slot"),
    ]
    return _renumber(context, keys, order, "new_slot")


def identity_rerank(context: DataFrame, fact_roles: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Capped boost for rows whose turns the target speaker spoke or was addressed in.

    ``context(keys, slot, ref)``; ``fact_roles(ref, stable, spoke)``; ``targets(keys, stable)``.
    """
    touched = (
        context.select(*keys, "ref").join(targets, keys).join(fact_roles, ["ref", "stable"])
        .groupBy(*keys, "ref").agg(F.bool_or("spoke").alias("source_hit"), F.bool_or(~F.col("spoke")).alias("addressee_hit"))
    )
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = context.withColumn("_n", n).join(touched, [*keys, "ref"], "left").fillna(False, ["source_hit", "addressee_hit"])
    boost = F.least(F.lit(BOOST_CAP), F.lit(SOURCE_BOOST) * F.col("source_hit").cast("double") + F.lit(ADDRESSEE_BOOST) * F.col("addressee_hit").cast("double"))
    scored = rows.withColumn("boost", boost).withColumn("score", F.lit(1.0) - (F.col("slot") - 1) / (F.lit(4) * F.col("_n")) + F.col("boost"))
    return _renumber(scored, keys, by_score("score", "slot"), "new_slot").drop("_n")


def low_confidence_reorder(context: DataFrame, keys: list[str]) -> DataFrame:
    """Small lexically scaled nudge for an uncertain asker.

    ``context(keys, slot, direct, related, lexical)``.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    pull = (F.lit(LOW_DIRECT) * F.col("direct").cast("double") + F.lit(LOW_RELATION) * F.col("related").cast("double")) * F.least(F.lit(1.0), F.col("lexical") / F.lit(LOW_LEXICAL))
    scored = context.withColumn("_n", n).withColumn("boost", F.least(F.lit(LOW_CAP), pull))
    scored = scored.withColumn("score", F.lit(1.0) - (F.col("slot") - 1) / (F.lit(4) * F.col("_n")) + F.col("boost"))
    return _renumber(scored, keys, by_score("score", "slot"), "new_slot").drop("_n")


def unanimous_addressee(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Addressee of a turn when all its speaker's facts agree.

    ``rows(ref, speaker_ref)``; ``votes(ref, source_speaker_ref, addressee)``.
    Each task keeps the smallest and largest label, so a turn cited by very many
    facts costs two values.
    """
    tally = votes.groupBy("ref", F.col("source_speaker_ref").alias("speaker_ref")).agg(F.min("addressee").alias("_a"), F.max("addressee").alias("_b"))
    j = rows.join(tally, ["ref", "speaker_ref"], "left")
    source = F.when(F.col("_a").isNull(), "no_grounded_fact").when(F.col("_a") == F.col("_b"), "grounded_fact_source_speaker_unanimous").otherwise("grounded_fact_ambiguous")
    return j.withColumn("label_source", source).withColumn("addressee", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("unknown")).drop("_a", "_b")


def freeze(context: DataFrame, keys: list[str], node: str = "node_id") -> DataFrame:
    """Ordered ids and a digest per question, to be written once before scoring."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", node))), lambda e: e[node].cast("string"))
    return context.groupBy(*keys).agg(ids.alias("ids")).withColumn("digest", F.sha2(F.to_json("ids"), 256))
