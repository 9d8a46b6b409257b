"""Row views, visual units, ids and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.identity import _NEAREST_SQL, confusion
from colloquy.catalog.provenance import RAW_BM25_SQL, raw_hits
from colloquy.catalog.registry import query
from colloquy.functions.dates import coordinates, session_number
from colloquy.operators import context, views, visual
from colloquy.operators.lookup import fetch
from colloquy.operators.ranking import top_k
from colloquy.sources.tables import FACTS_SQL, TURNS_SQL, fact_refs, facts, turns

_DAY = "CASE WHEN conv_id % 7 <> 0 THEN format('2024-01-{:02d}', 1 + conv_id % 5) END"
_IMAGE = "'I' || ((conv_id * 7 + turn_idx) % 97)"


def _day():
    return F.when(F.pmod("conv_id", F.lit(7)) != 0, F.format_string("2024-01-%02d", 1 + F.pmod("conv_id", F.lit(5))))


def _image():
    return F.concat(F.lit("I"), F.pmod(F.col("conv_id") * 7 + F.col("turn_idx"), F.lit(97)).cast("string"))


@query(
    f"""WITH {FACTS_SQL}, n AS (SELECT 'raw' AS layer, 'raw:' || ref AS id FROM turns UNION ALL SELECT NULL, ref FROM turns UNION ALL SELECT NULL, node_id FROM facts UNION ALL SELECT 'Fact', node_id FROM facts UNION ALL SELECT NULL, 'Collection:' || session_id FROM turns)
SELECT coalesce(layer, '') AS layer, CASE WHEN layer IS NOT NULL THEN lower(layer) = 'raw' ELSE NOT regexp_matches(lower(id), '^(collection|fact|profile|hier):') END AS visible, count(*) AS n FROM n GROUP BY 1, 2"""
)
def answer_visible(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that an answer may cite, with and without a stated layer."""
    t, f, none = turns(spark, d), facts(spark, d), F.lit(None).cast("string")
    rows = t.select(F.lit("raw").alias("layer"), F.col("node_id").alias("id"))
    for part in (t.select(none, "ref"), f.select(none, "node_id"), f.select(F.lit("Fact"), "node_id"), t.select(none, F.concat(F.lit("Collection:"), "session_id"))):
        rows = rows.union(part)
    seen = views.answer_visible_raw("layer", "id").alias("visible")
    return rows.groupBy(F.coalesce("layer", F.lit("")).alias("layer"), seen).agg(F.count("*").alias("n"))


_CTX = f"""{FACTS_SQL}, {RAW_BM25_SQL}, ctx AS (
  SELECT rb.qid, rb.rank, 'raw:' || t.ref AS node_id, t.*, {_DAY} AS date, CASE WHEN reply_to IS NULL THEN [t.ref] ELSE [t.ref, reply_to] END AS refs, {_IMAGE} AS image FROM rb JOIN turns t ON t.ref = rb.node)"""


def _context(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).withColumns({
        "date": _day(), "refer_ids": F.array_compact(F.array("ref", "reply_to")), "image_ids": F.array(_image()), "caption": F.concat(F.lit("a picture\nof "), _image()), "addressee": F.lit(None).cast("string"),
    })
    return fetch(raw_hits(spark, d), t, "ref")


@query(
    f"""WITH {_CTX}, r AS (SELECT qid, rank, unnest(refs) AS ref, generate_subscripts(refs, 1) AS p FROM ctx), u AS (SELECT qid, ref, min(rank * 10 + p) AS first FROM r GROUP BY qid, ref),
k AS (SELECT qid, string_agg(ref, ',' ORDER BY first) AS refs FROM u GROUP BY qid)
SELECT qid AS item_id, CAST(count(*) AS INTEGER) AS n_context, md5(string_agg(node_id, ',' ORDER BY rank)) AS nodes, md5(any_value(k.refs)) AS refs, md5(string_agg(coalesce(date, '') || speaker_ref || text, ',' ORDER BY rank)) AS body FROM ctx JOIN k USING (qid) GROUP BY qid"""
)
def context_records(spark: SparkSession, d: str) -> DataFrame:
    """Frozen records of retrieved contexts."""
    r = views.context_records(_context(spark, d), "query_id")
    body = F.transform("context", lambda c: F.concat(F.coalesce(c["date"], F.lit("")), c["speaker_ref"], c["text"]))
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    return r.select(F.col("query_id").alias("item_id"), "n_context", digest("context_node_ids").alias("nodes"), digest("retrieved_refer_ids").alias("refs"), digest(body).alias("body"))


@query(
    f"""WITH {_CTX} SELECT qid AS item_id, md5(string_agg('[' || rank || '] id=' || node_id || '; speaker=' || speaker || '; date=' || coalesce(date, '') || '; refer_ids=[''' || array_to_string(refs, ''', ''') || ''']; image_ids=[''' || image
  || ''']; text=' || left(replace(text, chr(10), ' '), 520) || '; captions=a picture of ' || image, chr(10) ORDER BY rank)) AS digest FROM ctx GROUP BY qid"""
)
def compact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The controller's view of a context, one shortened line per row."""
    lines = views.compact_evidence(_context(spark, d), "query_id")
    return lines.select(F.col("query_id").alias("item_id"), F.md5(F.col("evidence").cast("binary")).alias("digest"))


@query(f"WITH {_CTX} SELECT qid AS item_id, rank, md5(CASE WHEN reply_to IS NOT NULL THEN 'answers ' || reply_to || chr(10) || text ELSE text END) AS digest FROM ctx")
def answer_view(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a header before their text where they have one."""
    rows = views.answer_view(_context(spark, d).withColumn("header", F.concat(F.lit("answers "), "reply_to")))
    return rows.select(F.col("query_id").alias("item_id"), "rank", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_CTX} SELECT qid AS item_id, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY coalesce(date, '9999-12-31'), session_id, ordinal, rank) AS INTEGER) AS slot FROM ctx")
def iterative_time_sort(spark: SparkSession, d: str) -> DataFrame:
    """Final order of an iterative context by date, session as text, turn."""
    out = context.time_order(_context(spark, d), ["query_id"], "rank")
    return out.select(F.col("query_id").alias("item_id"), "node_id", F.col("new_slot").alias("slot"))


@query(f"WITH {TURNS_SQL} SELECT case_id, coalesce(max({_DAY}), '') AS last_date, count({_DAY}) AS dated FROM turns GROUP BY case_id")
def last_dates(spark: SparkSession, d: str) -> DataFrame:
    """Latest date of every case; none is empty."""
    return turns(spark, d).withColumn("day", _day()).groupBy("case_id").agg(F.coalesce(F.max("day"), F.lit("")).alias("last_date"), F.count("day").alias("dated"))


@query(
    f"""WITH {TURNS_SQL}, ids AS (SELECT 'session' || conv_id || ':' || ordinal AS id FROM turns UNION ALL SELECT 'x:D' || conv_id || ':' || ordinal FROM turns UNION ALL SELECT ref FROM turns UNION ALL SELECT 'raw:' || ref FROM turns UNION ALL SELECT speaker_ref FROM turns),
c AS (SELECT CASE WHEN regexp_matches(id, '(^|:)session\\d+:\\d+$') THEN regexp_extract(id, '(session\\d+):', 1) WHEN regexp_matches(id, '(^|:)D\\d+:\\d+$') THEN regexp_extract(id, '(D\\d+):', 1) WHEN regexp_matches(id, '(^|:)S\\d+_T\\d+$') THEN regexp_extract(id, '(S\\d+)_T', 1) ELSE '' END AS session,
  CASE WHEN regexp_matches(id, '(^|:)((session|D)\\d+:|S\\d+_T)\\d+$') THEN CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) END AS ordinal FROM ids)
SELECT session, coalesce(ordinal, -1) AS ordinal, count(*) AS n FROM c GROUP BY 1, 2"""
)
def turn_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Session and turn read from ids of all three grammars."""
    t = turns(spark, d)
    place = lambda head: F.concat(F.lit(head), F.col("conv_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string"))
    ids = t.select(place("session").alias("id"))
    for part in (place("x:D"), F.col("ref"), F.col("node_id"), F.col("speaker_ref")):
        ids = ids.union(t.select(part))
    c = ids.select(coordinates("id").alias("c")).select("c.*")
    return c.groupBy("session", F.coalesce("ordinal", F.lit(-1)).alias("ordinal")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TURNS_SQL}, s AS (SELECT DISTINCT CASE WHEN conv_id % 11 = 0 THEN 'D' || conv_id ELSE session_id END AS sid, case_id, conv_id FROM turns)
SELECT case_id, sid, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN conv_id % 11 = 0 THEN 1000000000 ELSE conv_id END, sid) AS INTEGER) AS place FROM s"""
)
def session_order(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by number; ids without one come last, by text."""
    sid = F.when(F.pmod("conv_id", F.lit(11)) == 0, F.concat(F.lit("D"), F.col("conv_id").cast("string"))).otherwise(F.col("session_id"))
    s = turns(spark, d).select("case_id", sid.alias("sid")).distinct()
    return top_k(s, ["case_id"], [session_number("sid"), F.col("sid")], None, "place")


@query(f"WITH {FACTS_SQL} SELECT node_id, array_to_string(refer_ids, ',') AS refs FROM facts")
def canonical_refs(spark: SparkSession, d: str) -> DataFrame:
    """References that name a channel, back to their turns."""
    marked = F.transform("refer_ids", lambda r: F.concat(F.lit(" "), r, F.lit("|user|x")))
    return facts(spark, d).select("node_id", F.array_join(views.canonical_refs(marked), ",").alias("refs"))


@query(f"WITH {FACTS_SQL} SELECT node_id, array_to_string(refer_ids, ',') AS refs FROM facts")
def refs_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Facts that lost their references get them back from their edges."""
    f = facts(spark, d)
    lost = f.withColumn("refer_ids", F.when(F.pmod("ordinal", F.lit(2)) == 0, F.col("refer_ids")))
    return views.refs_backfilled(lost.dropDuplicates(["node_id"]), fact_refs(f.dropDuplicates(["node_id"]))).select("node_id", F.array_join("refer_ids", ",").alias("refs"))


@query(
    f"""WITH {TURNS_SQL}, v AS (SELECT session_id, CASE turn_idx % 3 WHEN 0 THEN NULL WHEN 1 THEN 'p' || turn_idx || '.png' ELSE 'S1/q.png' END AS v FROM turns)
SELECT CASE WHEN v IS NULL THEN '' WHEN contains(v, '/') THEN 'scenes/S1/image/q.png' ELSE 'scenes/' || session_id || '/image/' || v END AS path, count(*) AS n FROM v GROUP BY 1"""
)
def question_images(spark: SparkSession, d: str) -> DataFrame:
    """Image paths of questions, in their own session or a named one."""
    m = F.pmod("turn_idx", F.lit(3))
    value = F.when(m == 1, F.concat(F.lit("p"), F.col("turn_idx").cast("string"), F.lit(".png"))).when(m == 2, F.lit("S1/q.png"))
    return turns(spark, d).groupBy(F.coalesce(views.question_image("session_id", value), F.lit("")).alias("path")).agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL} SELECT CASE conv_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'unresolved' END AS tier, count(*) AS n FROM turns GROUP BY 1")
def identity_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Askers by identity tier, each checked against the contract."""
    m = F.pmod("conv_id", F.lit(3))
    tier = F.when(m == 0, "high").when(m == 1, "low")
    return turns(spark, d).groupBy(views.identity_tier(F.when(m < 2, F.col("speaker_ref")), tier).alias("tier")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {FACTS_SQL}, s AS (SELECT DISTINCT session_id, 2 AS low, 3 + conv_id % 4 AS high, 'set of ' || session_id AS text FROM turns),
c AS (SELECT s.session_id, f.text, min(f.ordinal) AS place FROM s JOIN facts f USING (session_id), unnest(f.refer_ids) AS r(ref) WHERE CAST(regexp_extract(r.ref, '(\\d+)$', 1) AS INTEGER) BETWEEN low AND high GROUP BY 1, 2),
n AS (SELECT session_id, string_agg(text, ' ' ORDER BY place, text) AS near, count(*) AS k FROM c GROUP BY 1)
SELECT s.session_id, md5(s.text || ' ' || coalesce(near, '')) AS digest FROM s LEFT JOIN n USING (session_id)"""
)
def visual_set_facts(spark: SparkSession, d: str) -> DataFrame:
    """Image sets enriched by the facts whose turns lie in their range."""
    sets = turns(spark, d).select("session_id", "conv_id").distinct().select("session_id", F.lit(0).alias("set_id"), F.concat(F.lit("set of "), "session_id").alias("text"), F.lit(2).cast("bigint").alias("low"), (3 + F.pmod("conv_id", F.lit(4))).cast("bigint").alias("high"))
    numbers = F.transform("refer_ids", lambda r: F.regexp_extract(r, r"(\d+)$", 1).cast("int"))
    f = facts(spark, d).select("session_id", F.col("ordinal").alias("place"), "text", numbers.alias("turns"))
    return visual.with_nearby_facts(sets, f).select("session_id", F.md5(F.col("retrieval_text").cast("binary")).alias("digest"))


@query(
    f"""WITH {FACTS_SQL}, t AS (SELECT {_IMAGE} AS image_id, ref, conv_id * 1000 + ordinal AS place, 'caption ' || (turn_idx % 4) AS caption, trim(text) AS text, {_DAY} AS date FROM turns),
f AS (SELECT image_id, place, facts.text FROM facts JOIN t USING (ref)),
u AS (SELECT image_id, 1 AS part, caption AS v, min(place) AS place FROM t GROUP BY 1, 3 UNION ALL SELECT image_id, 2, text, min(place) FROM t WHERE text <> '' GROUP BY 1, 3 UNION ALL SELECT image_id, 3, text, min(place) FROM f WHERE text <> '' GROUP BY 1, 3)
SELECT image_id, md5('image_id=' || image_id || '. ' || string_agg(v, ' ' ORDER BY part, place)) AS card, md5('image_id=' || image_id || '; ' || string_agg(v, ' ' ORDER BY part, place) FILTER (WHERE part <> 2)) AS annotation,
  (SELECT count(DISTINCT ref) FROM t WHERE t.image_id = u.image_id) AS n_memories, (SELECT count(DISTINCT date) FROM t WHERE t.image_id = u.image_id) AS n_dates FROM u GROUP BY image_id"""
)
def visual_cards(spark: SparkSession, d: str) -> DataFrame:
    """Captions, dialogue and facts of one image as one retrieval unit."""
    place = (F.col("conv_id") * 1000 + F.col("ordinal")).alias("place")
    t = turns(spark, d).select(_image().alias("image_id"), F.col("ref").alias("mem_id"), place, F.concat(F.lit("caption "), F.pmod("turn_idx", F.lit(4)).cast("string")).alias("caption"), "text", _day().alias("date"))
    f = facts(spark, d).select("ref", F.col("text").alias("fact")).join(t.select(F.col("mem_id").alias("ref"), "image_id", "place"), "ref").select("image_id", "place", "fact")
    cards = visual.visual_cards(t, f)
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return cards.select("image_id", digest("text").alias("card"), digest("annotation_text").alias("annotation"), F.size("mem_ids").cast("bigint").alias("n_memories"), F.size("dates").cast("bigint").alias("n_dates"))


@query(
    f"""WITH {_NEAREST_SQL}, c AS (SELECT DISTINCT gold, pred FROM s WHERE n = 1)
SELECT 'over_split' AS problem, gold AS label, string_agg(pred, ',' ORDER BY pred) AS others FROM c GROUP BY gold HAVING count(*) > 1 UNION ALL SELECT 'merged', pred, string_agg(gold, ',' ORDER BY gold) FROM c GROUP BY pred HAVING count(*) > 1"""
)
def split_and_merged(spark: SparkSession, d: str) -> DataFrame:
    """Labels spread over several prototypes, and prototypes that mix several labels."""
    c = confusion(spark, d)
    named = lambda problem, label, other: c.groupBy(F.col(label).alias("label")).agg(F.array_sort(F.collect_set(other)).alias("o")).filter(F.size("o") > 1).select(F.lit(problem).alias("problem"), "label", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("others"))
    return named("over_split", "gold", "pred").unionByName(named("merged", "pred", "gold"))
