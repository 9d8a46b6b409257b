"""Small row views: visibility, context records, rendered evidence, identity tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.text import _c

# Id prefixes of derived layers, and the sizes of a rendered evidence list.
DERIVED_PREFIXES = ("collection:", "fact:", "profile:", "hier:")
EVIDENCE_ROWS, TEXT_CHARS, CAPTION_CHARS, REFS_SHOWN, IMAGES_SHOWN = 60, 520, 320, 8, 6
TIERS = ("high", "low", "unresolved")


def answer_visible_raw(layer: Column | str, node_id: Column | str) -> Column:
    """A stated layer decides; without one, ids of derived layers are hidden."""
    stated = F.lower(F.coalesce(_c(layer), F.lit("")))
    name = F.lower(F.coalesce(_c(node_id), F.lit("")))
    derived = F.lit(False)
    for prefix in DERIVED_PREFIXES:
        derived = derived | name.startswith(prefix)
    return F.when(stated != "", stated == "raw").otherwise(~derived)


def layer_eligible(facts: DataFrame, visual_sets: bool, kind: str = "fact_kind") -> DataFrame:
    """Only visual sets, or everything but them; a missing kind is an ordinary fact."""
    is_set = F.coalesce(F.col(kind), F.lit("")) == "visual_set"
    return facts.filter(is_set if visual_sets else ~is_set)


def allowed_only(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is allowed; an empty list allows everything."""
    return rows if allowed.isEmpty() else rows.join(allowed.select(key).distinct(), key, "left_semi")


def canonical_refs(refs: Column | str) -> Column:
    """Turn ids without the channel after the first pipe."""
    return F.transform(_c(refs), lambda r: F.split_part(F.trim(r), F.lit("|"), F.lit(1)))


def refs_backfilled(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts without their own references take those of their edges, in order."""
    own = edges.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda e: e["ref"]).alias("_edges"))
    joined = facts.join(own, "node_id", "left")
    has_own = F.coalesce(F.size("refer_ids"), F.lit(0)) > 0
    return joined.withColumn("refer_ids", F.when(has_own, F.col("refer_ids")).otherwise(F.coalesce("_edges", F.array().cast("array<string>")))).drop("_edges")


def context_records(context: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """One record per question: node ids, distinct references in order, and the rows."""
    row = F.struct(F.col(rank).alias("rank"), "node_id", "text", "speaker", "speaker_ref", "addressee", "session_id", "ordinal", "date", "reply_to", "refer_ids")
    rows = context.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("context"))
    return rows.select(
        key,
        F.transform("context", lambda r: r["node_id"]).alias("context_node_ids"),
        F.array_distinct(F.flatten(F.transform("context", lambda r: r["refer_ids"]))).alias("retrieved_refer_ids"),
        F.size("context").alias("n_context"),
        "context",
    )


def compact_evidence(context: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """``key, evidence``: one line per row for the first sixty rows of a context."""
    listed = lambda values, n: F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.coalesce(values, F.array().cast("array<string>")), 1, n), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))
    flat = lambda column, n: F.substring(F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)
    line = F.concat(
        F.lit("["), F.col("_n").cast("string"), F.lit("] id="), F.col("node_id"), F.lit("; speaker="), F.coalesce("speaker", F.lit("unknown")), F.lit("; date="), F.coalesce("date", F.lit("")),
        F.lit("; refer_ids="), listed(F.col("refer_ids"), REFS_SHOWN), F.lit("; image_ids="), listed(F.col("image_ids"), IMAGES_SHOWN), F.lit("; text="), flat("text", TEXT_CHARS), F.lit("; captions="), flat("caption", CAPTION_CHARS),
    )
    numbered = context.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank))).filter(F.col("_n") <= EVIDENCE_ROWS)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda e: e["line"])
    return numbered.groupBy(key).agg(F.array_join(lines, "\n").alias("evidence"))


def answer_view(context: DataFrame, header: str = "header", text: str = "text") -> DataFrame:
    """Text with its bundle header on a line before it; the other rows as they are."""
    return context.withColumn(text, F.when(F.coalesce(F.col(header), F.lit("")) != "", F.concat(F.col(header), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))).otherwise(F.col(text)))


def question_image(session: Column | str, value: Column | str) -> Column:
    """Path of a question's image under its own or a named session; NULL without a value."""
    parts = F.split(_c(value), "/")
    own = F.concat(F.lit("scenes/"), _c(session), F.lit("/image/"), _c(value))
    named = F.concat(F.lit("scenes/"), F.get(parts, F.lit(0)), F.lit("/image/"), F.get(parts, F.lit(1)))
    return F.when(F.coalesce(_c(value), F.lit("")) != "", F.when(F.size(parts) == 2, named).otherwise(own))


def identity_tier(stable: Column | str, confidence: Column | str) -> Column:
    """Tier of an asker; an unknown tier, or a resolved one without a reference, stops the job."""
    ref, tier = F.trim(F.coalesce(_c(stable), F.lit(""))), F.coalesce(_c(confidence), F.lit("unresolved"))
    return F.when(~tier.isin(*TIERS), F.raise_error(F.concat(F.lit("unknown identity tier: "), tier)).cast("string")).when((tier != "unresolved") & (ref == ""), F.raise_error(F.lit("resolved identity lacks a reference")).cast("string")).otherwise(tier)
