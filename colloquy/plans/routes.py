"""Route plans: keyword gates, model-plan validation, safety contracts, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions.dates import explicit_date
from colloquy.functions.jsonish import object_text, truthy
from colloquy.functions.text import _c
from colloquy.session import cut_lineage

# Which retrievers a layer supports.
LAYER_RETRIEVERS = {
    "raw": ("dense", "bm25", "image", "caption"),
    "fact": ("dense", "bm25"),
    "collection": ("dense", "bm25", "image", "caption"),
}

# Routes per intent.
INTENT_ROUTES = {
    "TEXT_FACT": (("raw", ("dense", "bm25")), ("fact", ("dense", "bm25"))),
    "VISUAL_SINGLE": (("raw", ("image", "caption", "dense")),),
    "VISUAL_COLLECTION": (("collection", ("image", "dense", "bm25")), ("raw", ("caption", "dense"))),
    "TEMPORAL": (("raw", ("dense", "bm25")), ("fact", ("dense",))),
    "CONFLICT": (("raw", ("bm25", "dense")), ("fact", ("bm25", "dense"))),
    "MULTI_HOP": (("raw", ("dense", "bm25")), ("fact", ("dense", "bm25"))),
    "EVENT_SCOPED": (("collection", ("dense", "bm25")), ("raw", ("dense", "bm25"))),
}
GATE_ROUTES = {name: INTENT_ROUTES[name] for name in ("VISUAL_COLLECTION", "VISUAL_SINGLE", "TEXT_FACT")}
KEYWORD_ROUTES = {
    "VISUAL_COLLECTION": (("collection", ("image", "caption", "dense", "bm25")), ("raw", ("image", "caption", "dense", "bm25"))),
    "VISUAL_SINGLE": (("raw", ("image", "caption", "dense", "bm25")),),
    "TEMPORAL": INTENT_ROUTES["TEXT_FACT"],
    "TEXT_FACT": INTENT_ROUTES["TEXT_FACT"],
}

# Observable keyword patterns.
VISUAL = r"(?iU)\b(image|images|photo|photos|picture|pictures|visual|look like|depicts)\b"
COLLECTION = (
    r"(?iU)\bhow many\b|\btotal\b|\bnumber of\b|\b(?:search for|find) all\b|"
    r"\ball\s+(?:\w+\s+){0,3}(?:images|photos|pictures)\b|\bwhich\s+(?:\w+\s+){0,3}(?:images|photos|pictures)\b"
)
TEMPORAL = r"(?iU)\b(before|after|earlier|later|first|last|then|timeline|chronological|in order|sequence)\b"
FIRST_PERSON = r"(?iU)\b(?:i|me|my|mine|myself)\b"

ROUTE_TYPE = "struct<layer:string,retrievers:array<string>,query:string>"
REFINEMENT_CAPS = {"missing_evidence": 6, "supporting_memory_ids": 12, "supporting_image_ids": 12}


def route(layer: str, retrievers, query: Column) -> Column:
    kinds = F.array(*[F.lit(r) for r in retrievers]).cast("array<string>")
    return F.struct(F.lit(layer).alias("layer"), kinds.alias("retrievers"), query.alias("query"))


def _routes_for(intent: Column, table: dict, query: Column) -> Column:
    out = F.array().cast(f"array<{ROUTE_TYPE}>")
    for name, rows in table.items():
        out = F.when(intent == name, F.array(*[route(layer, kinds, query) for layer, kinds in rows])).otherwise(out)
    return out


def _gate(question: Column, has_image: Column) -> tuple[Column, Column]:
    visual = has_image | question.rlike(VISUAL)
    return visual, visual & question.rlike(COLLECTION)


def heuristic_gate(question: Column | str, has_image: Column) -> Column:
    """Plan from image presence and keywords."""
    q = _c(question)
    visual, collection = _gate(q, has_image)
    intent = F.when(collection, "VISUAL_COLLECTION").when(visual, "VISUAL_SINGLE").otherwise("TEXT_FACT")
    return _gate_plan("heuristic_gate", intent, GATE_ROUTES, q, F.lit(None).cast("string"), F.lit("score"))


def keyword_gate(question: Column | str, has_image: Column) -> Column:
    """Plan with hybrid visual routes, chronology and an explicit date."""
    q = _c(question)
    visual, collection = _gate(q, has_image)
    intent = (
        F.when(collection, "VISUAL_COLLECTION").when(visual, "VISUAL_SINGLE").when(q.rlike(TEMPORAL), "TEMPORAL").otherwise("TEXT_FACT")
    )
    order = F.when(intent == "TEMPORAL", "time").otherwise("score")
    return _gate_plan("keyword_gate", intent, KEYWORD_ROUTES, q, explicit_date(q), order)


def fixed_intent_plan(question: Column | str, model_output: Column | str) -> Column:
    """Plan from one model label; anything unreadable is a text fact."""
    q = _c(question)
    label = F.upper(F.coalesce(F.get_json_object(object_text(model_output), "$.intent"), F.lit("TEXT_FACT")))
    intent = F.when(label.isin(*INTENT_ROUTES), label).otherwise("TEXT_FACT")
    order = F.when(intent == "TEMPORAL", "time").otherwise("score")
    return _gate_plan("model_type_fixed_route", intent, INTENT_ROUTES, q, F.lit(None).cast("string"), order)


def _gate_plan(strategy: str, intent: Column, table: dict, question: Column, date: Column, order: Column) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"),
        intent.alias("intent"),
        question.alias("rewritten_query"),
        _routes_for(intent, table, question).alias("routes"),
        F.array().cast("array<string>").alias("sub_questions"),
        date.alias("time_range"),
        order.alias("sort_by"),
    )


def routes_text(routes: Column) -> Column:
    """``layer:retriever+retriever;...`` for reports."""
    return F.array_join(F.transform(routes, lambda r: F.concat(r["layer"], F.lit(":"), F.array_join(r["retrievers"], "+"))), ";")


def _text(value: Column) -> Column:
    return F.when(value != "", value)


def validated_plan(plans: DataFrame, raw: str = "model_output", question: str = "question", has_image: str = "has_image") -> DataFrame:
    """Add ``plan``: the model's routes after caps, layer rules and safety contracts.

    Output that is not a JSON object gives the raw fallback route.
    """
    q = F.col(question)
    payload = object_text(raw)
    fields = F.from_json(
        payload,
        "rewritten_query STRING, routes ARRAY<STRUCT<layer: STRING, retrievers: ARRAY<STRING>, query: STRING>>, sub_questions ARRAY<STRING>, "
        "time_range STRING, speaker_hint STRING, sort_by STRING, needs_visual_memory STRING, needs_event_scope STRING, "
        "needs_temporal_reasoning STRING, known_asker STRING, speaker_scope STRING",
    )
    df = plans.withColumn("_p", fields).withColumn("router_parse_ok", payload.isNotNull())
    df = df.withColumn("_rewritten", F.coalesce(_text(F.col("_p.rewritten_query")), q))

    def cleaned(candidate: Column) -> Column:
        layer = F.lower(F.coalesce(candidate["layer"], F.lit("")))
        allowed = F.array().cast("array<string>")
        for name, kinds in LAYER_RETRIEVERS.items():
            allowed = F.when(layer == name, F.array(*[F.lit(k) for k in kinds])).otherwise(allowed)
        asked = F.transform(F.slice(F.coalesce(candidate["retrievers"], F.array().cast("array<string>")), 1, 3), lambda r: F.lower(r))
        kept = F.array_intersect(asked, allowed)
        query = F.coalesce(_text(candidate["query"]), F.col("_rewritten"))
        return F.struct(layer.alias("layer"), kept.alias("retrievers"), query.alias("query"))

    listed = F.slice(F.coalesce(F.col("_p.routes"), F.array().cast(f"array<{ROUTE_TYPE}>")), 1, 4)
    df = df.withColumn("_valid", F.filter(F.transform(F.filter(listed, lambda c: c.isNotNull()), cleaned), lambda r: F.size(r["retrievers"]) > 0))
    layers = F.slice(F.array_distinct(F.transform("_valid", lambda r: r["layer"])), 1, 2)

    def merged(layer: Column) -> Column:
        own = F.filter("_valid", lambda r: r["layer"] == layer)
        kinds = F.array_distinct(F.flatten(F.transform(own, lambda r: r["retrievers"])))
        return F.struct(layer.alias("layer"), kinds.alias("retrievers"), F.get(own, F.lit(0))["query"].alias("query"))

    merged_routes = F.transform(layers, merged)
    df = df.withColumn("_r", F.when(F.size(layers) > 0, merged_routes).otherwise(F.array(route("raw", ("dense", "bm25"), q))))
    df = df.withColumn("_visual", truthy("_p.needs_visual_memory")).withColumn("_event", truthy("_p.needs_event_scope"))
    df = df.withColumn("_temporal", truthy("_p.needs_temporal_reasoning"))
    by_time = F.col("_temporal") | F.coalesce(F.lower("_p.sort_by") == "time", F.lit(False))
    df = df.withColumn("_sort", F.when(by_time, "time").otherwise("score"))

    extra = F.col("_rewritten")
    is_visual = lambda r: r["layer"].isin("raw", "collection")
    none = lambda test: ~F.exists("_r", test)
    # Chronology always keeps verbatim turns.
    df = _swap_second(df, (F.col("_sort") == "time") & none(lambda r: r["layer"] == "raw"), route("raw", ("dense", "bm25"), extra))
    # An attached image is always matched visually.
    df = _swap_second(df, F.col(has_image) & none(is_visual), route("raw", (), extra))
    df = _add_kinds(df, F.col(has_image), is_visual, ("image", "caption"))
    # Remembered images use a free slot or the existing visual route.
    df = _append(df, F.col("_visual") & none(is_visual) & (F.size("_r") < 2), route("raw", (), extra))
    df = _add_kinds(df, F.col("_visual"), is_visual, ("image", "caption"))
    df = _append(df, F.col("_event") & none(lambda r: r["layer"] == "collection") & (F.size("_r") < 2), route("collection", ("dense", "bm25"), extra))
    p = F.col("_p")
    plan = F.struct(
        F.lit("two_level_dynamic_route").alias("strategy"),
        F.lit(None).cast("string").alias("intent"),
        extra.alias("rewritten_query"),
        F.col("_r").alias("routes"),
        F.filter(F.slice(F.coalesce(p["sub_questions"], F.array().cast("array<string>")), 1, 2), lambda s: s.isNotNull() & (s != "")).alias("sub_questions"),
        F.coalesce(explicit_date(q), p["time_range"]).alias("time_range"),
        p["speaker_hint"].alias("speaker_hint"),
        F.col("_sort").alias("sort_by"),
        F.col("_visual").alias("model_needs_visual_memory"),
        F.col("_event").alias("model_needs_event_scope"),
        F.col("_temporal").alias("model_needs_temporal_reasoning"),
        p["known_asker"].alias("known_asker"),
        F.when(p["speaker_scope"] == "asker_only", "asker_only").otherwise("global").alias("speaker_scope"),
    )
    # Plans are one small row per question and every later step reads them often.
    return cut_lineage(df.withColumn("plan", plan).drop("_p", "_rewritten", "_valid", "_r", "_visual", "_event", "_temporal", "_sort"))


def unified_contract(plans: DataFrame, question: str = "question") -> DataFrame:
    """Fact path for visual events, the original question on raw turns, dense and BM25 everywhere."""
    q, p = F.col(question), F.col("plan")
    df = plans.withColumn("_r", p["routes"])
    no_fact = ~F.exists("_r", lambda r: r["layer"] == "fact")
    df = _append(df, p["model_needs_visual_memory"] & p["model_needs_event_scope"] & no_fact, route("fact", ("dense", "bm25"), F.coalesce(_text(p["rewritten_query"]), q)))
    original = lambda r: (r["layer"] == "raw") & (F.trim(r["query"]) == F.trim(q))
    df = df.withColumn("_has", F.exists("_r", original))
    df = _add_kinds(df, F.col("_has"), original, ("dense", "bm25"))
    df = _append(df, ~F.col("_has"), route("raw", ("dense", "bm25"), q))
    floor = F.array(F.lit("dense"), F.lit("bm25"))
    df = df.withColumn(
        "_r",
        F.transform(
            "_r",
            lambda r: F.when(
                r["layer"].isin("fact", "collection"),
                F.struct(r["layer"].alias("layer"), F.array_union(r["retrievers"], floor).alias("retrievers"), r["query"].alias("query")),
            ).otherwise(r),
        ),
    )
    return cut_lineage(df.withColumn("plan", p.withField("routes", F.col("_r")).withField("strategy", F.lit("unified_hybrid_route"))).drop("_r", "_has"))


def _append(df: DataFrame, when: Column, extra: Column) -> DataFrame:
    return df.withColumn("_r", F.when(when, F.concat("_r", F.array(extra))).otherwise(F.col("_r")))


def _swap_second(df: DataFrame, when: Column, extra: Column) -> DataFrame:
    return df.withColumn("_r", F.when(when, F.concat(F.slice("_r", 1, 1), F.array(extra))).otherwise(F.col("_r")))


def _add_kinds(df: DataFrame, when: Column, test, kinds: tuple[str, ...]) -> DataFrame:
    """Add retrievers to the first route that passes the test."""
    first = F.array_position(F.transform("_r", test), F.lit(True)) - 1
    added = F.array(*[F.lit(k) for k in kinds])
    changed = F.transform(
        "_r",
        lambda r, i: F.when(
            i == first, F.struct(r["layer"].alias("layer"), F.array_union(r["retrievers"], added).alias("retrievers"), r["query"].alias("query"))
        ).otherwise(r),
    )
    return df.withColumn("_r", F.when(when, changed).otherwise(F.col("_r")))


def refinement(decisions: DataFrame, raw: str = "model_output", question: str = "question", has_image: str = "has_image") -> DataFrame:
    """Stop or refine: ``sufficient``, ``stop_reason``, capped id lists and the next ``plan``."""
    payload = object_text(raw)
    fields = F.from_json(
        payload, "sufficient STRING, reasoning STRING, missing_evidence STRING, supporting_memory_ids STRING, supporting_image_ids STRING"
    )
    df = validated_plan(decisions, raw, question, has_image)
    df = unified_contract(df, question).withColumn("_d", fields)

    def ids(name: str) -> Column:
        listed = F.from_json(F.col(f"_d.{name}"), "ARRAY<STRING>")
        kept = F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, REFINEMENT_CAPS[name])
        return F.filter(kept, lambda v: v.isNotNull() & (v != ""))

    parsed = F.col("router_parse_ok")
    missing = F.col("_d.missing_evidence")
    single = F.when(missing.isNotNull() & (missing != "") & ~missing.startswith("["), F.array(missing)).otherwise(ids("missing_evidence"))
    enough = ~parsed | truthy("_d.sufficient")
    return (
        df.withColumn("sufficient", enough)
        .withColumn("stop_reason", F.when(~parsed, "refinement_parse_failed").when(enough, "evidence_sufficient"))
        .withColumn("reasoning", F.substring(F.coalesce("_d.reasoning", F.lit("")), 1, 1000))
        .withColumn("missing_evidence", F.when(parsed, single).otherwise(F.array().cast("array<string>")))
        .withColumn("supporting_memory_ids", ids("supporting_memory_ids"))
        .withColumn("supporting_image_ids", ids("supporting_image_ids"))
        .withColumn("plan", F.when(~F.col("sufficient"), F.col("plan")))
        .drop("_d")
    )


def action_signature(plan: Column) -> Column:
    """Equal for plans that would run the same retrieval."""
    norm = lambda t: F.lower(F.trim(F.coalesce(t, F.lit(""))))
    routes = F.transform(plan["routes"], lambda r: F.struct(r["layer"].alias("l"), F.array_sort(F.array_distinct(r["retrievers"])).alias("r"), norm(r["query"]).alias("q")))
    return F.to_json(F.struct(norm(plan["rewritten_query"]).alias("query"), routes.alias("routes")))


def bundle_gate(plan: Column, always: bool = False, soft: bool = True) -> Column:
    """``struct(active, reason)``: whether evidence is grouped for the answer."""
    if always:
        return F.struct(F.lit(True).alias("active"), F.lit("global_v1").alias("reason"))
    if not soft:
        return F.struct(F.lit(False).alias("active"), F.lit("disabled").alias("reason"))
    temporal = F.coalesce(plan["model_needs_temporal_reasoning"], F.lit(False))
    wanted = (F.size(F.coalesce(plan["sub_questions"], F.array().cast("array<string>"))) >= 2) & F.coalesce(plan["model_needs_event_scope"], F.lit(False))
    reason = F.when(temporal, "global_temporal_order_preserved").when(wanted, "model_cross_turn_decomposition").otherwise("model_gate_rejected")
    return F.struct((~temporal & wanted).alias("active"), reason.alias("reason"))


def asker_query(question: Column | str, confidence: Column | str, stable: Column | str) -> Column:
    """First-person question by a speaker identified with high confidence."""
    known = (_c(confidence) == "high") & (F.trim(F.coalesce(_c(stable), F.lit(""))) != "")
    return F.coalesce(known & _c(question).rlike(FIRST_PERSON), F.lit(False))
