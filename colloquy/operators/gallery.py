"""Keyword-gated fusion for questions about images: the raw list, or a collection node with its evidence in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.text import tokens
from colloquy.operators.overlap import overlap_join
from colloquy.operators.ranking import top_k
from colloquy.plans.routes import COLLECTION, VISUAL
from colloquy.session import cut_lineage

SLOTS = 30
# A request for all sets or for one species, a day.
EVERY_SET = r"\b(total|all|overall)\b"
ONE_SPECIES = r"\bsame\s+(?:plant\s+)?species\b"
DAY = r"\b\d{4}-\d{2}-\d{2}\b"
# Label words that name no entity, and words for which adjacent sets count as well.
GENERIC = (
    "the", "a", "an", "and", "or", "of", "in", "at", "from", "user", "shared", "additional", "collection", "option", "options",
    "image", "images", "photo", "photos", "picture", "pictures", "flower", "flowers", "dress", "dresses", "view", "views",
)
BROAD = ("dress", "dresses", "skirt", "skirts", "kimono", "kimonos", "chart", "charts", "plot", "plots", "script", "scripts")
CHOSEN_SETS = 3
KEYWORDS = 2


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def label_keywords(label: Column | str) -> Column:
    """Words of a set's label that name an entity."""
    return F.array_except(F.array_distinct(tokens(label)), _words(GENERIC))


def intents(questions: DataFrame) -> DataFrame:
    """``questions(query_id, text, has_image)`` with what their words ask for."""
    low = F.lower("text")
    return questions.select(
        "query_id", (F.col("has_image") | low.rlike(VISUAL)).alias("visual"), low.rlike(COLLECTION).alias("collection"), low.rlike(EVERY_SET).alias("every"),
        low.rlike(ONE_SPECIES).alias("species"), "has_image", F.array_distinct(F.regexp_extract_all("text", F.lit(DAY), F.lit(0))).alias("days"),
        F.array_intersect(F.array_distinct(tokens("text")), _words(BROAD)).alias("broad"),
    )


def chosen_sets(asked: DataFrame, ranked: DataFrame, sets: DataFrame, by_image: DataFrame | None = None) -> DataFrame:
    """``query_id, place, label, set_id``: the sets that answer each collection request.

    ``ranked(query_id, set_id, rank)`` are sets by text, ``by_image`` the same by the
    question's image, and ``sets(set_id, label, days)``; a day in the question excludes
    sets without it.  A species question takes all sets of the best label, a broad request for
    everything up to two more sets that share its word.
    """
    order = ranked.select("query_id", "set_id", F.lit(False).alias("seen"), "rank")
    if by_image is not None:
        order = order.unionByName(by_image.select("query_id", "set_id", F.lit(True).alias("seen"), "rank"))
    fits = asked.filter("visual AND collection").join(order, "query_id").join(sets.select("set_id", "label", F.col("days").alias("_d")), "set_id")
    fits = fits.filter((F.size("days") == 0) | F.arrays_overlap("days", "_d"))
    # The image ranks species questions that have one, within the sets that the text ranks at all.
    wanted = F.col("species") & F.col("has_image") if by_image is not None else F.lit(False)
    fits = fits.filter(F.col("seen") == wanted)
    first = top_k(fits, ["query_id"], [F.col("rank"), F.col("set_id")], 1, "place")
    shares = F.arrays_overlap("broad", tokens("label"))
    more = fits.filter(~F.col("species") & F.col("every") & shares).join(first.select("query_id", F.col("set_id").alias("_top")), "query_id").filter("set_id <> _top")
    more = top_k(more, ["query_id"], [F.col("rank"), F.col("set_id")], CHOSEN_SETS - 1, "place").withColumn("place", F.col("place") + 1)
    alone = first.filter(~F.col("species")).select("query_id", "place", "label", "set_id").unionByName(more.select("query_id", "place", "label", "set_id"))
    alike = first.filter("species").select("query_id", "place", "label").join(sets.select("label", "set_id"), "label")
    return alone.unionByName(alike.select("query_id", "place", "label", "set_id"))


def extra_images(asked: DataFrame, chosen: DataFrame, cards: DataFrame) -> DataFrame:
    """``query_id, image_id``: images of any session whose card shares two keywords with the best set's label.

    Asked for by species questions and by requests for everything; a day in the latter
    excludes cards without it.
    """
    top = chosen.filter("place = 1").select("query_id", "label").distinct()
    named = top.select("label").distinct().withColumn("tokens", label_keywords("label")).filter(F.size("tokens") >= KEYWORDS).withColumn("least", F.lit(KEYWORDS))
    near = overlap_join(named, cards.select("image_id", F.array_distinct(tokens("text")).alias("tokens")), ["label"], "image_id")
    found = asked.filter("species OR every").join(top, "query_id").join(near, "label").join(cards.select("image_id", F.col("days").alias("_d")), "image_id")
    return found.filter(F.col("species") | (F.size("days") == 0) | F.arrays_overlap("days", "_d")).select("query_id", "image_id")


def fuse(questions: DataFrame, base: DataFrame, ranked: DataFrame, sets: DataFrame, cards: DataFrame, by_image: DataFrame | None = None, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``(query_id, slot, node_id, kind)`` of visual questions, and ``(query_id, route, n_images, image_ids)``.

    ``base(query_id, node_id, rank)`` is the raw list, ``sets(set_id, label, days, image_ids,
    refs)``, ``cards(image_id, text, days, refs)``.  A single-image question keeps its
    raw list; a collection request gets a collection node, the turns that ground it and
    then the rest of the list.
    """
    asked = intents(questions)
    visual = asked.filter("visual")
    # A few rows per question, read by many branches: written once.
    chosen = cut_lineage(chosen_sets(asked, ranked, sets, by_image))
    held = chosen.join(sets.select("set_id", "image_ids", "refs"), "set_id")
    images = cut_lineage(held.select("query_id", F.explode("image_ids").alias("image_id")).unionByName(extra_images(asked, chosen, cards)).distinct())
    from_sets = held.select("query_id", F.lit(0).alias("part"), F.col("place").cast("string").alias("a"), F.col("set_id").cast("string").alias("b"), F.posexplode(F.slice(F.array_distinct("refs"), 1, slots)).alias("i", "node_id"))
    from_cards = images.join(cards.select("image_id", "refs"), "image_id").select("query_id", F.lit(1).alias("part"), F.col("image_id").alias("a"), F.lit("").alias("b"), F.posexplode("refs").alias("i", "node_id"))
    found = from_sets.unionByName(from_cards).groupBy("query_id", "node_id").agg(F.min(F.struct("part", "a", "b", "i")).alias("at"))
    promoted = top_k(found, ["query_id"], [F.col("at")], slots - 1, "n").select("query_id", "node_id", F.lit("promoted").alias("kind"), F.col("n").cast("bigint").alias("n"))
    nodes = chosen.select("query_id").distinct().select("query_id", F.lit("collection").alias("node_id"), F.lit("collection").alias("kind"), F.lit(0).cast("bigint").alias("n"))
    rest = base.join(visual.select("query_id"), "query_id", "left_semi").join(promoted.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    rest = rest.select("query_id", "node_id", F.lit("raw").alias("kind"), (F.col("rank") + slots).cast("bigint").alias("n"))
    context = top_k(nodes.unionByName(promoted).unionByName(rest), ["query_id"], [F.col("n"), F.col("node_id")], slots, "slot").select("query_id", "slot", "node_id", "kind")
    counted = images.groupBy("query_id").agg(F.count("*").alias("n_images"), F.array_sort(F.collect_list("image_id")).alias("image_ids"))
    route = F.when(~F.col("collection"), "raw_visual_fallback").otherwise("explicit_collection_intent")
    summary = visual.join(counted, "query_id", "left").select("query_id", route.alias("route"), F.coalesce("n_images", F.lit(0)).alias("n_images"), F.coalesce("image_ids", F.array().cast("array<string>")).alias("image_ids"))
    return context, summary
