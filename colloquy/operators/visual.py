"""Image-centred units: cards per image, and image sets with the facts around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN_BLOCK = 64


def _ordered(value: str, *order: str) -> Column:
    """Distinct non-empty values in order of first appearance."""
    pairs = F.array_sort(F.collect_list(F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(*order, F.trim(value).alias("_v")))))
    return F.array_distinct(F.transform(pairs, lambda e: e["_v"]))


def visual_cards(images: DataFrame, fact_images: DataFrame) -> DataFrame:
    """All evidence on one image: ``image_id, text, annotation_text, mem_ids, dates``.

    ``images(image_id, mem_id, place, caption, text, date)`` are images in turns, in
    ``place`` order; ``fact_images(image_id, place, fact)`` facts that cite an image.
    An image cited by facts alone is a card too.
    """
    seen = images.groupBy("image_id").agg(
        _ordered("caption", "place").alias("captions"), _ordered("text", "place").alias("dialogues"),
        F.sort_array(F.collect_set("mem_id")).alias("mem_ids"), F.sort_array(F.collect_set("date")).alias("dates"),
    )
    cited = fact_images.groupBy("image_id").agg(_ordered("fact", "place").alias("facts"))
    none = F.array().cast("array<string>")
    both = seen.join(cited, "image_id", "full_outer").withColumns({c: F.coalesce(c, none) for c in ("captions", "dialogues", "facts", "mem_ids", "dates")})
    return both.select(
        "image_id",
        F.concat(F.lit("image_id="), "image_id", F.lit(". "), F.array_join(F.concat("captions", "dialogues", "facts"), " ")).alias("text"),
        F.concat(F.lit("image_id="), "image_id", F.lit("; "), F.array_join(F.concat("captions", "facts"), " ")).alias("annotation_text"),
        "mem_ids",
        "dates",
    )


def with_nearby_facts(sets: DataFrame, facts: DataFrame) -> DataFrame:
    """Image sets with the texts of the session's facts that cite a turn inside their range.

    ``sets(session_id, set_id, text, low, high)``, ``facts(session_id, place, text,
    turns)``.  The range join is an equi-join on session and block of turns, so a
    long session is cut into many keys.
    """
    block = lambda c: F.floor(F.col(c) / TURN_BLOCK)
    spread = sets.select("session_id", "set_id", "low", "high", F.explode(F.sequence(block("low"), block("high"))).alias("_b"))
    cited = facts.select("session_id", "place", "text", F.explode("turns").alias("turn")).withColumn("_b", block("turn"))
    inside = cited.join(spread, ["session_id", "_b"]).filter(F.col("turn").between(F.col("low"), F.col("high")))
    first = inside.groupBy("session_id", "set_id", "text").agg(F.min("place").alias("place"))
    near = first.groupBy("session_id", "set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda e: e["text"]).alias("_near"))
    joined = sets.join(near, ["session_id", "set_id"], "left")
    return joined.withColumn("retrieval_text", F.concat("text", F.lit(" "), F.array_join(F.coalesce("_near", F.array().cast("array<string>")), " "))).drop("_near")
