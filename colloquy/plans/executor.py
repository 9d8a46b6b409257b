"""Runs the route plans of all questions as one batch of set operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from colloquy.config import LAYER_WEIGHT, MULTI_PARTY, ExecutorProfile
from colloquy.errors import ContractViolation
from colloquy.functions.vectors import dot
from colloquy.operators import bm25, dense, fusion, projection
from colloquy.operators.context import fail_open_date
from colloquy.operators.lookup import fetch, lookup
from colloquy.operators.packing import pack_context
from colloquy.operators.ranking import by_score, full_ranks, top_k
from colloquy.session import cut_lineage

VISUAL = ("caption", "image")


@dataclass(frozen=True)
class Memory:
    """One memory: layers, edges and an encoder ``(df, id, text) -> (id, vec)``."""

    raw: DataFrame  # ref, text, session_id, ordinal, date
    facts: DataFrame  # node_id, text, collection_id, refer_ids
    collection_vectors: DataFrame  # node_id, vec
    collection_dates: DataFrame  # node_id, date
    encode: Callable[[DataFrame, str, str], DataFrame]
    captions: DataFrame | None = None  # ref, text
    images: DataFrame | None = None  # ref, vec
    media: DataFrame | None = None  # node_id, ref: turns that show an image which a fact cites
    collection_refs: DataFrame | None = None  # node_id, pos, ref
    question_images: DataFrame | None = None  # query_id, vec

    def fact_refs(self) -> DataFrame:
        return self.facts.select("node_id", F.posexplode("refer_ids").alias("pos", "ref"))


def work_items(plans: DataFrame, own_image: DataFrame | None = None) -> DataFrame:
    """One row per question, route and retriever; channels sort by first use.

    Equal requests of several questions share one ``request_id``.  An image request of a
    question in ``own_image(query_id)`` is about its own image, and so its own.
    """
    p = F.col("plan")
    routes = plans.select("query_id", p["rewritten_query"].alias("_rw"), p["time_range"].alias("time_range"), F.posexplode(p["routes"]).alias("route", "r"))
    flat = routes.select("query_id", "time_range", "route", F.col("r.layer").alias("layer"), F.posexplode("r.retrievers").alias("place", "retriever"), F.coalesce("r.query", "_rw", F.lit("")).alias("text"))
    flat = flat.withColumn("_at", F.col("route") * 10 + F.col("place"))
    first = flat.groupBy("query_id", "layer", "retriever").agg(F.min("_at").alias("_first"))
    named = flat.join(first, ["query_id", "layer", "retriever"])
    channel = F.format_string("%03d.%s.%s", "_first", "layer", "retriever")
    if own_image is None:
        request = F.sha1("text")
    else:
        named = named.join(own_image.select("query_id", F.lit(True).alias("_own")), "query_id", "left")
        own = F.coalesce("_own", F.lit(False)) & (F.col("retriever") == "image")
        request = F.when(own, F.concat(F.lit("image:"), F.col("query_id").cast("string"))).otherwise(F.sha1("text"))
    return named.select("query_id", "time_range", "layer", "retriever", "text", channel.alias("channel"), F.col("route").alias("variant"), request.alias("request_id"))


def _requests(work: DataFrame, layer: str, retriever: str) -> DataFrame:
    kind = (F.col("layer") == layer) & (F.col("retriever") == retriever)
    return work.filter(kind).select(F.col("request_id").alias("query_id"), "text").dropDuplicates(["query_id"])


def _visual(memory: Memory, retriever: str, encoded: DataFrame, k: int) -> DataFrame:
    """Turns by caption or image; a plan that asks for data the memory lacks is an error."""
    source = memory.captions if retriever == "caption" else memory.images
    if source is None:
        raise ContractViolation(f"a plan asks for {retriever} retrieval, but the memory has no {retriever} data")
    return dense.dense_topk(memory.encode(source, "ref", "text") if retriever == "caption" else source, encoded, k, node="ref")


def _request_vectors(asked: DataFrame, memory: Memory, retriever: str) -> DataFrame:
    """``(query_id, vec)`` of requests: an image request asks by the question's image where there is one, else by its text."""
    if retriever != "image" or memory.question_images is None:
        return memory.encode(asked, "query_id", "text")
    shown = memory.question_images.select(F.concat(F.lit("image:"), F.col("query_id").cast("string")).alias("query_id"), "vec")
    by_image = asked.select("query_id").join(shown, "query_id")
    return memory.encode(asked.join(shown, "query_id", "left_anti"), "query_id", "text").unionByName(by_image)


def ranked_requests(work: DataFrame, memory: Memory, k: int) -> DataFrame:
    """``(layer, retriever, request_id, rank, node_id)`` for every distinct request."""
    layers = {"raw": memory.raw.select(F.col("ref").alias("node_id"), "text"), "fact": memory.facts.select("node_id", "text")}
    # At most a dozen layer-retriever pairs exist, whatever the number of questions.
    used = {(r["layer"], r["retriever"]) for r in work.select("layer", "retriever").distinct().collect()}
    lists = []
    for layer in ("raw", "fact", "collection"):
        for retriever in ("dense", "bm25", *VISUAL):
            if (layer, retriever) not in used:
                continue
            asked = _requests(work, layer, retriever)
            if retriever == "bm25" and layer != "collection":
                hits = bm25.bm25_topk(layers[layer], asked, k)
            elif retriever == "bm25":
                hits = bm25.group_topk(memory.facts.select("collection_id", "text"), "collection_id", "text", bm25.question_terms(asked), k)
            else:
                encoded = _request_vectors(asked, memory, retriever)
                if retriever == "dense":
                    corpus = memory.collection_vectors if layer == "collection" else memory.encode(layers[layer], "node_id", "text")
                    hits = dense.dense_topk(corpus, encoded, k)
                else:
                    hits = _visual(memory, retriever, encoded, k)
                    if layer == "collection":
                        hits = _to_collections(hits, memory)
            lists.append(hits.select(F.lit(layer).alias("layer"), F.lit(retriever).alias("retriever"), F.col("query_id").alias("request_id"), "rank", "node_id"))
    if not lists:
        return work.sparkSession.createDataFrame([], "layer string, retriever string, request_id string, rank int, node_id string")
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


class Answered:
    """Ranked lists kept over rounds: a request is answered once, whichever plan or round asks it again."""

    KEYS = ("layer", "retriever", "request_id")

    def __init__(self) -> None:
        self._lists: DataFrame | None = None
        self._known: DataFrame | None = None
        self._stats: DataFrame | None = None

    def fact_stats(self, memory: Memory) -> DataFrame:
        """Term statistics of all facts, counted in one pass for all rounds."""
        if self._stats is None:
            self._stats = cut_lineage(bm25.document_stats(memory.facts, "node_id", "text"))
        return self._stats

    def lists(self, work: DataFrame, memory: Memory, k: int) -> DataFrame:
        """The lists of all requests so far, those of ``work`` among them; only new requests reach the corpus.

        A request without hits is remembered as well.  Lists and requests are written
        to the shared folder, so later rounds do not repeat earlier ones.
        """
        asked = work.select("query_id", *self.KEYS, "text")
        fresh = cut_lineage(asked if self._known is None else asked.join(self._known, list(self.KEYS), "left_anti"))
        found = cut_lineage(ranked_requests(fresh, memory, k))
        named = fresh.select(*self.KEYS).distinct()
        self._lists = found if self._lists is None else self._lists.unionByName(found)
        self._known = named if self._known is None else self._known.unionByName(named)
        return self._lists


def _to_collections(hits: DataFrame, memory: Memory) -> DataFrame:
    """Visual hits summed per session collection."""
    homes = memory.raw.select(F.col("ref").alias("node_id"), F.col("session_id").alias("home"))
    summed = fetch(hits, homes, "node_id").groupBy("query_id", F.col("home").alias("node_id")).agg(
        F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / (60 + r)).alias("score"), F.min("rank").alias("_first")
    )
    return top_k(summed, ["query_id"], by_score("score", "_first"), None)


def _dates(lists: DataFrame, memory: Memory) -> DataFrame:
    """``(node_id, date)`` of the listed nodes; a fact has the date of the first dated turn it cites."""
    listed = cut_lineage(lists.select("node_id").distinct())
    raw = lookup(listed, memory.raw.select(F.col("ref").alias("node_id"), "date"), "node_id")
    dated = fetch(lookup(listed, memory.fact_refs(), "node_id"), memory.raw.select("ref", "date"), "ref").filter("date IS NOT NULL")
    facts = dated.groupBy("node_id").agg(F.min_by("date", "pos").alias("date"))
    groups = lookup(listed, memory.collection_dates.select("node_id", "date"), "node_id")
    return raw.select("node_id", "date").unionByName(facts).unionByName(groups.select("node_id", "date"))


def channels(plans: DataFrame, memory: Memory, profile: ExecutorProfile, answered: Answered | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw-layer lists (facts already projected) and collection lists."""
    # Ranked lists are a few dozen rows per question; each stage is written once
    # because several later steps read it.
    work = cut_lineage(work_items(plans, memory.question_images))
    hits = (answered or Answered()).lists(work, memory, profile.candidate_k)
    lists = cut_lineage(work.drop("text").join(hits, ["layer", "retriever", "request_id"]))
    lists = cut_lineage(fail_open_date(lists.join(_dates(lists, memory), "node_id", "left"), ["query_id", "channel", "variant"]))
    head = ["query_id", "channel", "variant"]
    raw = memory.raw.select("ref", "session_id", "ordinal")
    upper = lists.filter("layer = 'fact'").select(*head, "rank", "node_id")
    grounded = projection.grounding(upper, memory.fact_refs(), raw, memory.media, radius=profile.neighbor_radius, adjacent=profile.adjacent_weight, keys=tuple(head))
    projected = projection.project(grounded, tuple(head)).select(*head, F.lit(LAYER_WEIGHT["fact"]).alias("weight"), "rank", F.col("ref").alias("node_id"))
    direct = lists.filter("layer = 'raw'").select(*head, F.lit(LAYER_WEIGHT["raw"]).alias("weight"), "rank", "node_id")
    groups = lists.filter("layer = 'collection'").select(*head, F.lit(LAYER_WEIGHT["collection"]).alias("weight"), "rank", "node_id")
    return direct.unionByName(projected), groups


def member_facts(chosen: DataFrame, plans: DataFrame, memory: Memory, n: int, stats: DataFrame | None = None) -> DataFrame:
    """Best ``n`` member facts of each question's collection, by fused full lists.

    Only members of a chosen collection are indexed and scored, and only for the
    questions that chose it; term statistics are those of all facts.
    """
    homes = chosen.select("query_id", F.col("node_id").alias("collection_id"))
    asked = plans.select("query_id", F.coalesce(F.col("plan")["rewritten_query"], F.lit("")).alias("text")).join(homes, "query_id")
    members = cut_lineage(fetch(homes.select("collection_id").distinct(), memory.facts.select("node_id", "text", "collection_id"), "collection_id"))
    terms = bm25.question_terms(asked)
    if stats is None:
        stats = bm25.document_stats(memory.facts, "node_id", "text")
    # A node counts all its rows, those in other collections among them.
    own_rows = fetch(members.select("node_id").distinct(), memory.facts.select("node_id", "text"), "node_id")
    index = bm25.postings(own_rows, "node_id", "text", vocabulary=terms)
    inside = index.join(members.select("node_id", "collection_id"), "node_id")
    sparse = bm25.score(inside, terms.join(homes, "query_id"), ("collection_id",), stats=stats).select("query_id", "node_id", "score")
    own = memory.encode(asked, "query_id", "text").withColumnRenamed("vec", "_q").join(homes, "query_id")
    vectors = memory.encode(members, "node_id", "text").join(members.select("node_id", "collection_id"), "node_id")
    near = own.join(vectors, "collection_id").select("query_id", "node_id", dot("_q", "vec").alias("score"))
    lists = None
    for name, scored in (("0.dense", near), ("1.bm25", sparse)):
        one = full_ranks(scored, ["query_id"], "score", "node_id").select("query_id", F.lit(name).alias("channel"), F.lit(1.0).alias("weight"), "rank", "node_id")
        lists = one if lists is None else lists.unionByName(one)
    return fusion.rrf(lists, k=n)


def _expanded(chosen: DataFrame, plans: DataFrame, memory: Memory, profile: ExecutorProfile, answered: Answered) -> tuple[DataFrame, DataFrame]:
    """``(query_id, refs)`` of each collection node, and the turns ``(query_id, rank, ref)`` it puts in front."""
    raw = memory.raw.select("ref", "session_id", "ordinal")
    if profile.promote_refs:
        if memory.collection_refs is None:
            raise ContractViolation("the profile promotes what collections cite, but the memory has no collection references")
        cited = chosen.join(memory.collection_refs, "node_id").groupBy("query_id", "ref").agg(F.min("pos").alias("_at"))
        known = cut_lineage(cited.join(raw.select("ref"), "ref", "left_semi"))
        promoted = top_k(known, ["query_id"], [F.col("_at"), F.col("ref")], None).select("query_id", "rank", "ref")
    else:
        best = cut_lineage(member_facts(chosen, plans, memory, profile.member_facts, answered.fact_stats(memory)).select("query_id", "rank", "node_id"))
        promoted = projection.project(projection.grounding(best, memory.fact_refs(), raw, memory.media, radius=profile.neighbor_radius, adjacent=profile.adjacent_weight))
        cited = lookup(best, memory.fact_refs(), "node_id").groupBy("query_id", "ref").agg(F.min(F.struct("rank", "pos")).alias("_at"))
    # A node's references go into one row, as everywhere else.
    refs = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "ref"))), lambda e: e["ref"]).alias("refs"))
    return refs, cut_lineage(promoted)


def execute(plans: DataFrame, memory: Memory, profile: ExecutorProfile = MULTI_PARTY, answered: Answered | None = None) -> DataFrame:
    """``(query_id, slot, node_id)``: the packed context of every plan.

    Rounds over one memory pass the same ``answered``, and repeat no request.
    """
    answered = answered or Answered()
    lists, groups = channels(plans, memory, profile, answered)
    lists = cut_lineage(lists)
    fused = cut_lineage(fusion.rrf(fusion.collapse_variants(lists)).select("query_id", "rank", F.col("node_id").alias("ref")))
    found = fusion.rrf(fusion.collapse_variants(groups)).select("query_id", "node_id", "rank", "score")
    if profile.consensus:
        edges = memory.facts.select(F.col("collection_id").alias("node_id"), F.explode("refer_ids").alias("ref"))
        found = fusion.consensus(found, edges, fused)
    chosen = cut_lineage(found.filter("rank = 1").select("query_id", "node_id"))
    refs, promoted = _expanded(chosen, plans, memory, profile, answered)
    node = chosen.join(refs, "query_id").select("query_id", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.concat(F.lit("collection:"), "node_id").alias("node_id"), F.lit(True).alias("is_upper"), "refs")

    def turns(df: DataFrame, part: int) -> DataFrame:
        return df.select("query_id", F.lit(part).alias("part"), "rank", F.col("ref").alias("node_id"), F.lit(False).alias("is_upper"), F.array("ref").alias("refs"))

    rest = fused.join(promoted.select("query_id", "ref"), ["query_id", "ref"], "left_anti")
    node = cut_lineage(node)
    every = cut_lineage(node.unionByName(turns(promoted, 1)).unionByName(turns(rest, 2)))
    # A plan that found nothing falls back to dense raw turns.
    plans = plans.select("query_id", "plan")
    empty = plans.select("query_id", F.col("plan")["rewritten_query"].alias("text")).join(every.select("query_id"), "query_id", "left_anti")
    spare = dense.dense_topk(
        memory.encode(memory.raw.select(F.col("ref").alias("node_id"), "text"), "node_id", "text"), memory.encode(empty, "query_id", "text"), profile.candidate_k
    ).withColumnRenamed("node_id", "ref")
    ordered = top_k(every.unionByName(turns(spare, 3)), ["query_id"], [F.col("part"), F.col("rank"), F.col("node_id")], None, "idx")
    quota = node.select("query_id", F.least(F.lit(profile.quota_cap), F.greatest(F.lit(profile.quota_floor), F.size("refs"))).alias("quota"))
    candidates = ordered.join(quota, "query_id", "left").fillna({"quota": profile.quota_floor})
    style = plans.select("query_id", (F.col("plan")["strategy"] == "unified_hybrid_route").alias("_packed"), F.col("plan")["sort_by"].alias("_sort"))
    tagged = candidates.join(style, "query_id")
    packed = pack_context(tagged.filter("_packed"), profile.top_k)
    plain = tagged.filter(~F.col("_packed") & (F.col("idx") <= profile.top_k)).select("query_id", F.col("idx").alias("slot"), "node_id")
    context = cut_lineage(packed.unionByName(plain))
    by_time = style.join(node.select("query_id"), "query_id", "left_anti").filter("_sort = 'time'").select("query_id", F.lit(True).alias("_time"))
    info = fetch(context.select("node_id").distinct(), memory.raw.select(F.col("ref").alias("node_id"), "date", "ordinal"), "node_id")
    timed = context.join(by_time, "query_id", "left").join(info, "node_id", "left")
    chronological = F.coalesce(F.col("_time"), F.lit(False))
    order = [F.when(chronological, F.coalesce("date", F.lit(""))), F.when(chronological, F.coalesce("ordinal", F.lit(0))), F.col("slot")]
    return top_k(timed.withColumnRenamed("slot", "_slot").withColumn("slot", F.col("_slot")), ["query_id"], order, profile.top_k, "_n").select("query_id", F.col("_n").alias("slot"), "node_id")
