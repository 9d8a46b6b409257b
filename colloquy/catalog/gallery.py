"""Questions about images over the whole memory: all visual branches of keyword-gated fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.provenance import RAW_BM25_SQL, q_items, raw_hits
from colloquy.catalog.registry import query
from colloquy.catalog.views import _DAY, _IMAGE, _day, _image
from colloquy.functions.text import tokens
from colloquy.operators import bm25, gallery, visual
from colloquy.operators.ranking import by_score, top_k
from colloquy.sources.tables import FACTS_SQL, bm25_sql, facts, turns

_GENERIC = "[" + ", ".join(f"'{w}'" for w in gallery.GENERIC) + "]"
_BROAD = "[" + ", ".join(f"'{w}'" for w in gallery.BROAD) + "]"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

_FUSED = f"""{FACTS_SQL}, {RAW_BM25_SQL}, joined AS (SELECT session_id, string_agg(text, ' ') AS text FROM turns GROUP BY session_id),
{bm25_sql("sb", "joined", "session_id", "text", "benchmark", "item_id", "text", 100000000)},
img AS (SELECT *, {_IMAGE} AS image_id, {_DAY} AS day FROM turns),
sets AS (SELECT session_id AS set_id, array_to_string({_TOKENS.format("arg_min(text, ordinal)")}[1:2], ' ') || CASE WHEN any_value(conv_id) % 3 = 0 THEN ' dress' ELSE ' view' END AS label,
  any_value(day) AS day, list_distinct(list(image_id)) AS image_ids FROM img GROUP BY session_id),
ctok AS (SELECT image_id, unnest({_TOKENS.format("'caption ' || (turn_idx % 4)")}) AS t FROM img UNION SELECT i.image_id, unnest({_TOKENS.format("f.text")}) FROM facts f JOIN img i USING (ref)
  UNION SELECT image_id, unnest(['image', 'id', lower(image_id)]) FROM img),
ask AS (SELECT item_id AS qid, item_id % 6 = 5 AS has_image, text || CASE item_id % 7 WHEN 0 THEN ' how many photos in total' WHEN 1 THEN ' find all dress pictures overall' WHEN 2 THEN ' which photos show the same species'
  WHEN 3 THEN ' the photo please' WHEN 4 THEN ' how many pictures on 2024-01-0' || (1 + item_id % 5) ELSE '' END AS text FROM benchmark),
asked AS (SELECT qid, has_image OR regexp_matches(lower(text), '\\b(image|images|photo|photos|picture|pictures|visual|look like|depicts)\\b') AS visual,
  regexp_matches(lower(text), '\\bhow many\\b|\\btotal\\b|\\bnumber of\\b|\\b(?:search for|find) all\\b|\\ball\\s+(?:\\w+\\s+){{0,3}}(?:images|photos|pictures)\\b|\\bwhich\\s+(?:\\w+\\s+){{0,3}}(?:images|photos|pictures)\\b') AS coll,
  regexp_matches(lower(text), '\\b(total|all|overall)\\b') AS every, regexp_matches(lower(text), '\\bsame\\s+(?:plant\\s+)?species\\b') AS species,
  list_distinct(regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')) AS days, list_intersect(list_distinct({_TOKENS.format("text")}), {_BROAD}) AS broad FROM ask),
fits AS (SELECT a.*, s.set_id, s.label, sb.rank FROM asked a JOIN sb USING (qid) JOIN sets s ON s.set_id = sb.node WHERE visual AND coll AND (len(days) = 0 OR list_contains(days, s.day))),
top AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, set_id) = 1),
more AS (SELECT f.qid, f.label, f.set_id, 1 + row_number() OVER (PARTITION BY f.qid ORDER BY f.rank, f.set_id) AS place FROM fits f JOIN top t ON t.qid = f.qid AND t.set_id <> f.set_id
  WHERE NOT f.species AND f.every AND len(list_intersect(f.broad, {_TOKENS.format("f.label")})) > 0 QUALIFY place <= 3),
chosen AS (SELECT qid, label, set_id, 1 AS place FROM top WHERE NOT species UNION ALL SELECT qid, label, set_id, place FROM more UNION ALL SELECT t.qid, t.label, s.set_id, 1 FROM top t JOIN sets s USING (label) WHERE t.species),
keys AS (SELECT label, list_filter(list_distinct({_TOKENS.format("label")}), lambda x: NOT list_contains({_GENERIC}, x)) AS ks FROM (SELECT DISTINCT label FROM top)),
hit AS (SELECT label, image_id FROM (SELECT label, unnest(ks) AS t FROM keys WHERE len(ks) >= 2) JOIN ctok USING (t) GROUP BY label, image_id HAVING count(*) >= 2),
extra AS (SELECT t.qid, image_id FROM top t JOIN hit USING (label) WHERE species OR (every AND (len(days) = 0 OR EXISTS (SELECT 1 FROM img i WHERE i.image_id = hit.image_id AND list_contains(t.days, i.day))))),
images AS (SELECT DISTINCT qid, unnest(image_ids) AS image_id FROM chosen JOIN sets USING (set_id) UNION SELECT qid, image_id FROM extra),
found AS (SELECT qid, i.ref AS node, 0 AS part, CAST(place AS VARCHAR) AS a, set_id AS b, i.ordinal - 1 AS i FROM chosen JOIN img i ON i.session_id = set_id
  UNION ALL SELECT qid, ref, 1, images.image_id, '', row_number() OVER (PARTITION BY qid, images.image_id ORDER BY ref) - 1 FROM images JOIN img USING (image_id)),
promoted AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY spot) AS n FROM (SELECT qid, node, min((part, a, b, i)) AS spot FROM found GROUP BY qid, node) QUALIFY n <= 29)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    m = F.pmod("query_id", F.lit(7))
    tail = (
        F.when(m == 0, " how many photos in total").when(m == 1, " find all dress pictures overall").when(m == 2, " which photos show the same species").when(m == 3, " the photo please")
        .when(m == 4, F.concat(F.lit(" how many pictures on 2024-01-0"), (1 + F.pmod("query_id", F.lit(5))).cast("string"))).otherwise("")
    )
    return q_items(spark, d).select("query_id", F.concat("text", tail).alias("text"), (F.pmod("query_id", F.lit(6)) == 5).alias("has_image"))


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = turns(spark, d).select("conv_id", "session_id", "ordinal", "ref", "text", "turn_idx", _image().alias("image_id"), _day().alias("day"), (F.col("conv_id") * 1000 + F.col("ordinal")).alias("place"))
    first = tokens(F.min_by("text", "ordinal"))
    kind = F.when(F.pmod(F.any_value("conv_id"), F.lit(3)) == 0, " dress").otherwise(" view")
    # A session is one set; its turns are few.
    sets = t.groupBy(F.col("session_id").alias("set_id")).agg(
        F.concat(F.array_join(F.slice(first, 1, 2), " "), kind).alias("label"), F.array_compact(F.array(F.any_value("day"))).alias("days"), F.collect_set("image_id").alias("image_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ref"))), lambda e: e["ref"]).alias("refs"),
    )
    seen = t.select("image_id", F.col("ref").alias("mem_id"), "place", F.concat(F.lit("caption "), F.pmod("turn_idx", F.lit(4)).cast("string")).alias("caption"), "text", F.col("day").alias("date"))
    cited = facts(spark, d).select("ref", F.col("text").alias("fact")).join(t.select("ref", "image_id", "place"), "ref").select("image_id", "place", "fact")
    cards = visual.visual_cards(seen, cited).select("image_id", F.col("annotation_text").alias("text"), F.col("dates").alias("days"), F.col("mem_ids").alias("refs"))
    terms = bm25.question_terms(q_items(spark, d))
    ranked = top_k(bm25.score(bm25.group_postings(t, "session_id", "text", terms), terms), ["query_id"], by_score("score", "node_id"), None)
    base = raw_hits(spark, d).withColumnRenamed("ref", "node_id")
    return gallery.fuse(_asked(spark, d), base, ranked.select("query_id", F.col("node_id").alias("set_id"), "rank"), sets, cards)


@query(
    f"""WITH {_FUSED},
rest AS (SELECT rb.qid, rb.node, rb.rank FROM rb JOIN asked USING (qid) LEFT JOIN promoted p ON p.qid = rb.qid AND p.node = rb.node WHERE visual AND p.node IS NULL),
u AS (SELECT DISTINCT qid, 'collection' AS node, 'collection' AS kind, 0 AS n FROM chosen UNION ALL SELECT qid, node, 'promoted', n FROM promoted UNION ALL SELECT qid, node, 'raw', rank + 30 FROM rest)
SELECT qid AS item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY n, node) AS INTEGER) AS slot, node AS node_id, kind FROM u QUALIFY slot <= 30"""
)
def visual_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Context of every question about images: a collection node and its turns in front where a collection is asked for."""
    return _fused(spark, d)[0].withColumnRenamed("query_id", "item_id")


@query(
    f"""WITH {_FUSED}, n AS (SELECT qid, count(*) AS n_images, string_agg(image_id, ',' ORDER BY image_id) AS ids FROM images GROUP BY qid)
SELECT qid AS item_id, CASE WHEN coll THEN 'explicit_collection_intent' ELSE 'raw_visual_fallback' END AS route, coalesce(n_images, 0) AS n_images, coalesce(ids, '') AS image_ids FROM asked LEFT JOIN n USING (qid) WHERE visual"""
)
def visual_counts(spark: SparkSession, d: str) -> DataFrame:
    """Route of every question about images and the distinct images that answer it, over all sessions."""
    return _fused(spark, d)[1].select(F.col("query_id").alias("item_id"), "route", "n_images", F.array_join("image_ids", ",").alias("image_ids"))
