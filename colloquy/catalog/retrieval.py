"""Ranked retrieval: tokens, inverted index, dense channels, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.sqlparts import coverage_sql, dense_sql, hashed_sql, rrf_sql, vector_topk_sql
from colloquy.functions.text import coverage, quotes, tokens
from colloquy.operators import bm25, dense, fusion
from colloquy.operators.lookup import fetch
from colloquy.operators.ranking import by_score, top_k
from colloquy.sources.encoders import hashed_vectors
from colloquy.sources.tables import FACTS_SQL, bm25_sql, documents, fact_refs, facts, questions, table

LONG_TOKEN = 5


@query(
    """SELECT kind, id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms FROM (
  SELECT 'document' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents
  UNION ALL SELECT 'page', page_id, regexp_extract_all(lower(html), '[a-z0-9]+') FROM pages)"""
)
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), tokens("text").alias("t"))
    pages = table(spark, d, "pages", "page_id", "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), tokens("html").alias("t"))
    both = docs.unionByName(pages)
    return both.select("kind", "id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(
    """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf,
  round(ln(1e0 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 5e-1) / (count(DISTINCT doc_id) + 5e-1)), 9) AS idf
FROM tok GROUP BY term"""
)
def bm25_index_terms(spark: SparkSession, d: str) -> DataFrame:
    # One shuffle: occurrences and first occurrences are counted side by side.
    t = documents(spark, d, "text").select(tokens("text").alias("t"))
    both = F.concat(
        F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))),
        F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))),
        F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))),
    )
    counts = t.select(F.explode(both).alias("e")).groupBy("e.term").agg(F.sum("e.df").alias("df"), F.sum("e.cf").alias("cf"))
    n = documents(spark, d, "doc_id").agg(F.count("*")).scalar()
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts.filter("term != ''").select("term", "df", "cf", F.round(idf, 9).alias("idf"))


def _docs_bm25(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    q = questions(spark, d).withColumnRenamed("item_id", "query_id")
    return bm25.bm25_topk(documents(spark, d), q, k, node="doc_id")


def _docs_dense(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    corpus = hashed_vectors(documents(spark, d), "doc_id", "text")
    q = hashed_vectors(questions(spark, d), "item_id", "text")
    return dense.dense_topk(corpus, q, k, node="doc_id", qid="item_id")


_BM25 = bm25_sql("bm", "documents", "doc_id", "text", "benchmark", "item_id", "text", 30)
_HASHED = hashed_sql("dh", "documents", "doc_id", "text") + "," + hashed_sql("qh", "benchmark", "item_id", "text")
_DENSE = _HASHED + "," + dense_sql("de", "dh", "qh", 30)


@query(f"WITH {_BM25} SELECT qid AS item_id, node AS doc_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _docs_bm25(spark, d).select(F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_CENTROIDS = """
dims AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM dims GROUP BY label, i),
sizes AS (SELECT label, sqrt(sum(v * v)) + 1e-12 AS size FROM means GROUP BY label),
cent AS (SELECT label, list(v / size ORDER BY i) AS vec FROM means JOIN sizes USING (label) GROUP BY label)"""


@query(
    f"WITH {_CENTROIDS}, {vector_topk_sql('t', 'embeddings', 'vec_id', 'embedding', 'cent', 'label', 'vec', 30)} "
    "SELECT qid AS label, node AS vec_id, rank, round(score, 6) AS score FROM t"
)
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every label's mean vector, over all vectors."""
    e = table(spark, d, "embeddings")
    centers = dense.mean_vectors(e, "label", "embedding")
    hits = dense.dense_topk(e, centers, 30, node="vec_id", vec="embedding", qid="label")
    return hits.select(F.col("query_id").alias("label"), F.col("node_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE} SELECT qid AS item_id, node AS doc_id, rank, round(score, 6) AS score FROM de")
def text_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = _docs_dense(spark, d)
    return hits.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def channel(hits: DataFrame, name: str, weight: float, variant=None, keys: tuple[str, ...] = ("query_id",), node: str = "node_id") -> DataFrame:
    """A ranked list in the common channel layout."""
    v = F.lit(0) if variant is None else variant
    return hits.select(*keys, F.lit(name).alias("channel"), F.lit(weight).alias("weight"), v.alias("variant"), "rank", node)


@query(
    f"WITH {_BM25}, {_DENSE}, ch AS (SELECT qid, node, 0 AS ch, rank, 1e0 AS weight FROM bm UNION ALL SELECT qid, node, 1, rank, 1e0 FROM de), "
    f"{rrf_sql('f', 'ch', 10)} SELECT qid AS item_id, rank, node AS doc_id, round(score, 9) AS score FROM f"
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    both = channel(_docs_bm25(spark, d), "raw.bm25", 1.0).unionByName(channel(_docs_dense(spark, d), "raw.dense", 1.0))
    fused = fusion.rrf(both, k=10)
    return fused.select(F.col("query_id").alias("item_id"), "rank", F.col("node_id").alias("doc_id"), F.round("score", 9).alias("score"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Every question as written and reduced to its longer words."""
    q = questions(spark, d)
    long_words = F.array_join(F.filter(tokens("text"), lambda t: F.length(t) >= LONG_TOKEN), " ")
    forms = F.array(F.struct(F.lit(0).alias("variant"), F.col("text")), F.struct(F.lit(1).alias("variant"), long_words.alias("text")))
    return q.select(F.col("item_id").alias("query_id"), F.explode(forms).alias("f")).select("query_id", "f.variant", "f.text")


def _variant_bm25(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_topk(documents(spark, d), _variants(spark, d), 30, node="doc_id", keys=("query_id", "variant"))


_VARIANTS = (
    _BM25 + "," + bm25_sql("bl", "documents", "doc_id", "text", "benchmark", "item_id", "text", 30, f"WHERE len(term) >= {LONG_TOKEN}")
    + ", vr AS (SELECT qid, node, 0 AS variant, rank FROM bm UNION ALL SELECT qid, node, 1, rank FROM bl)"
)


@query(
    f"""WITH {_VARIANTS}, {_DENSE},
inner_f AS (SELECT qid, node, sum(1e0 / (60 + rank)) AS s, min(variant * 100000 + rank) AS first FROM vr GROUP BY qid, node),
one AS (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, first, node) AS rank FROM inner_f),
ch AS (SELECT qid, node, 0 AS ch, rank, 1e0 AS weight FROM one UNION ALL SELECT qid, node, 1, rank, 1e0 FROM de),
{rrf_sql('f', 'ch', 30)} SELECT qid AS item_id, rank, node AS doc_id, round(score, 9) AS score FROM f"""
)
def query_variant_collapse(spark: SparkSession, d: str) -> DataFrame:
    variants = channel(_variant_bm25(spark, d), "raw.bm25", 1.0, F.col("variant"))
    ranked = variants.unionByName(channel(_docs_dense(spark, d), "raw.dense", 1.0))
    fused = fusion.rrf(fusion.collapse_variants(ranked), k=30)
    return fused.select(F.col("query_id").alias("item_id"), "rank", F.col("node_id").alias("doc_id"), F.round("score", 9).alias("score"))


@query(
    f"""WITH {_VARIANTS}, {_DENSE},
ch AS (SELECT qid, node, 'bm25' AS ch, variant * 30 + rank AS rank FROM vr UNION ALL SELECT qid, node, 'dense', rank FROM de),
best AS (SELECT qid, node, ch, min(rank) AS rank FROM ch GROUP BY ALL),
f AS (SELECT qid, node, sum(1e0 / (60 + rank)) AS score, count(*) AS n_channels FROM best GROUP BY qid, node)
SELECT item_id, rank, doc_id, n_channels, score FROM (SELECT qid AS item_id, node AS doc_id, n_channels, round(score, 9) AS score,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank FROM f) WHERE rank <= 30"""
)
def rrf_dedup_topk(spark: SparkSession, d: str) -> DataFrame:
    """A list that repeats a document counts it once, at its best place."""
    repeated = _variant_bm25(spark, d).withColumn("rank", F.col("variant") * 30 + F.col("rank"))
    ranked = channel(repeated, "bm25", 1.0).unionByName(channel(_docs_dense(spark, d), "dense", 1.0))
    fused = fusion.rrf_dedup(ranked, k=30)
    return fused.select(
        F.col("query_id").alias("item_id"), "rank", F.col("node_id").alias("doc_id"), "n_channels", F.round("score", 9).alias("score")
    )


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates with question and document text."""
    q = questions(spark, d).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = documents(spark, d).withColumnRenamed("doc_id", "node_id")
    return fetch(_docs_bm25(spark, d).join(q, "query_id"), docs, "node_id")


_CAND = f"{_BM25}, cand AS (SELECT b.qid, b.node, b.rank, q.text AS question, d.text FROM bm b JOIN benchmark q ON q.item_id = b.qid JOIN documents d ON d.doc_id = b.node)"


@query(f"WITH {_CAND} SELECT qid AS item_id, node AS doc_id, round({coverage_sql('question', 'text')}, 9) AS coverage FROM cand")
def lexical_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return c.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), F.round(coverage("question", "text"), 9).alias("coverage"))


def anchors(candidates: DataFrame, keys: tuple[str, ...] = ("query_id",), max_anchors: int = 2, floor: float = 0.38) -> DataFrame:
    """Strong utterances of a ranked list: exact quotes first, else lexical support."""
    normalized = F.array_join(tokens("text"), " ")
    q = candidates.withColumn("_quotes", quotes("question")).withColumn("_norm", normalized)
    exact = F.exists("_quotes", lambda x: F.contains(F.col("_norm"), x) | F.contains(x, F.col("_norm")))
    scored = q.withColumn("_exact", exact).withColumn("_cov", coverage("question", "text"))
    kept = scored.filter(F.col("_exact") | ((F.size("_quotes") == 0) & (F.col("_cov") >= floor)))
    confidence = F.when(F.col("_exact"), F.lit(1.0)).otherwise(F.col("_cov")) + F.lit(1.0) / (1000 + F.col("rank") - 1)
    kept = kept.withColumn("_conf", confidence).withColumn("raw_rank", F.col("rank"))
    best = top_k(kept.drop("rank"), list(keys), by_score("_conf", "raw_rank", "node_id"), max_anchors, "anchor")
    return best.select(
        *keys, "node_id", "anchor", "raw_rank", F.when(F.col("_exact"), "exact_quote").otherwise("lexical_semantic").alias("source"),
        F.least(F.col("_conf"), F.lit(1.0)).alias("confidence"),
    )


@query(
    f"""WITH {_CAND},
forms AS (SELECT *, 'plain' AS form FROM cand UNION ALL SELECT qid, node, rank, 'Who said "' || question || '"?', text, 'quoted' FROM cand),
parts AS (SELECT *, list_filter(list_transform(regexp_extract_all(question, '["“”‘’]([^"“”‘’]{{8,}})["“”‘’]', 1),
    lambda q: array_to_string(regexp_extract_all(lower(q), '[a-z0-9]+'), ' ')), lambda q: q <> '') AS quotes,
  array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS norm, {coverage_sql('question', 'text')} AS cov FROM forms),
ex AS (SELECT *, len(list_filter(quotes, lambda q: contains(norm, q) OR contains(q, norm))) > 0 AS exact FROM parts),
kept AS (SELECT *, CASE WHEN exact THEN 1e0 ELSE cov END + 1e0 / (1000 + rank - 1) AS conf FROM ex WHERE exact OR (len(quotes) = 0 AND cov >= 38e-2)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY form, qid ORDER BY round(conf, 9) DESC, rank, node) AS INTEGER) AS anchor FROM kept)
SELECT form, qid AS item_id, node AS doc_id, anchor, rank AS raw_rank, CASE WHEN exact THEN 'exact_quote' ELSE 'lexical_semantic' END AS source,
  round(least(conf, 1e0), 9) AS confidence FROM r WHERE anchor <= 2"""
)
def semantic_anchors(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    quoted = F.concat(F.lit('Who said "'), "question", F.lit('"?'))
    forms = F.array(
        F.struct(F.lit("plain").alias("form"), F.col("question").alias("q")), F.struct(F.lit("quoted").alias("form"), quoted.alias("q"))
    )
    c = c.withColumn("f", F.explode(forms)).withColumn("form", F.col("f.form")).withColumn("question", F.col("f.q"))
    out = anchors(c, ("form", "query_id"))
    return out.select(
        "form", F.col("query_id").alias("item_id"), F.col("node_id").alias("doc_id"), "anchor", "raw_rank", "source",
        F.round("confidence", 9).alias("confidence"),
    )


def source_collections(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    """Sources ranked as collections of their documents."""
    q = questions(spark, d).withColumnRenamed("item_id", "query_id")
    terms = bm25.question_terms(q)
    return bm25.group_topk(documents(spark, d, "source", "text"), "source", "text", terms, k)


SOURCE_BM25_SQL = "srcs AS (SELECT source, string_agg(text, ' ') AS text FROM documents GROUP BY source), " + bm25_sql(
    "cb", "srcs", "source", "text", "benchmark", "item_id", "text", 30
)


@query(f"WITH {SOURCE_BM25_SQL} SELECT qid AS item_id, node AS source, rank, round(score, 6) AS score FROM cb")
def collection_bm25(spark: SparkSession, d: str) -> DataFrame:
    hits = source_collections(spark, d)
    return hits.select(F.col("query_id").alias("item_id"), F.col("node_id").alias("source"), "rank", F.round("score", 6).alias("score"))


# Image channel: the vector that shares the question's id is its attached image.


def _question_images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return questions(spark, d).select("item_id").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("vec"))


def _image_topk(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return dense.dense_topk(e, _question_images(spark, d), k, node="vec_id", vec="embedding", qid="item_id")


_QIMG = "qimg AS (SELECT b.item_id, e.embedding AS vec FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"
_IMG = f"{_QIMG}, {vector_topk_sql('im', 'embeddings', 'vec_id', 'embedding', 'qimg', 'item_id', 'vec', 30)}"


@query(
    f"""WITH {_IMG}, s AS (SELECT qid, source, sum(1e0 / (60 + rank)) AS score, min(rank) AS first FROM im JOIN documents ON doc_id = node GROUP BY qid, source)
SELECT qid AS item_id, source, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first) AS INTEGER) AS rank, round(score, 9) AS score FROM s"""
)
def visual_to_collection(spark: SparkSession, d: str) -> DataFrame:
    """Image hits summed up to the collections that hold them."""
    hits = _image_topk(spark, d).join(documents(spark, d, "doc_id", "source"), F.col("doc_id") == F.col("node_id"))
    summed = hits.groupBy("query_id", "source").agg(
        F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / (60 + r)).alias("score"), F.min("rank").alias("first")
    )
    ranked = top_k(summed, ["query_id"], by_score("score", "first"), 30)
    return ranked.select(F.col("query_id").alias("item_id"), "source", "rank", F.round("score", 9).alias("score"))


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """One card per image: the document that carries it is its text."""
    images = table(spark, d, "embeddings", "vec_id")
    return documents(spark, d).join(images, F.col("doc_id") == F.col("vec_id"), "left_semi").withColumnRenamed("doc_id", "image_id")


def card_ranks(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    cards = _cards(spark, d)
    q = questions(spark, d).withColumnRenamed("item_id", "query_id")
    text = dense.dense_topk(hashed_vectors(cards, "image_id", "text"), hashed_vectors(q, "query_id", "text"), 30, node="image_id")
    sparse = bm25.bm25_topk(cards, q, 30, node="image_id")
    image = _image_topk(spark, d)
    lists = channel(text, "0.text", 0.75).unionByName(channel(sparse, "1.bm25", 0.75)).unionByName(channel(image, "2.image", 2.0))
    return fusion.rrf(lists, k=k)


_CARD_BASE = (
    "card AS (SELECT doc_id AS image_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), "
    + hashed_sql("kh", "card", "image_id", "text") + "," + hashed_sql("qh", "benchmark", "item_id", "text") + "," + dense_sql("kd", "kh", "qh", 30)
    + "," + bm25_sql("kb", "card", "image_id", "text", "benchmark", "item_id", "text", 30) + "," + _IMG
    + ", kch AS (SELECT qid, node, 0 AS ch, rank, 75e-2 AS weight FROM kd UNION ALL SELECT qid, node, 1, rank, 75e-2 FROM kb "
    "UNION ALL SELECT qid, node, 2, rank, 2e0 FROM im)," + rrf_sql("kr", "kch", 5)
)


@query(f"WITH {_CARD_BASE} SELECT qid AS item_id, node AS image_id, rank, round(score, 9) AS score FROM kr")
def visual_card_rank(spark: SparkSession, d: str) -> DataFrame:
    return card_ranks(spark, d).select(F.col("query_id").alias("item_id"), F.col("node_id").alias("image_id"), "rank", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_CARD_BASE}, mem AS (SELECT qid, rank, doc_id, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS n
  FROM kr k JOIN embeddings e ON e.vec_id = k.node JOIN documents m ON m.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id)
SELECT qid AS item_id, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS INTEGER) AS rank FROM mem WHERE n = 1"""
)
def card_memory_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Cards back to the memories that show them; a memory appears once, at its first card."""
    n = table(spark, d, "embeddings", "vec_id").agg(F.count("*")).scalar()
    owners = documents(spark, d, "doc_id").withColumn("node_id", F.pmod("doc_id", n))
    linked = card_ranks(spark, d).join(owners, "node_id").groupBy("query_id", "doc_id").agg(F.min("rank").alias("card"))
    ranked = top_k(linked, ["query_id"], [F.col("card"), F.col("doc_id")], None)
    return ranked.select(F.col("query_id").alias("item_id"), "doc_id", "rank")


@query(
    f"""WITH {_QIMG}, labs AS (SELECT e.label, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
sets AS (SELECT label, string_agg(text, ' ') AS text FROM labs GROUP BY label),
{bm25_sql("tb", "sets", "label", "text", "benchmark", "item_id", "text", 1000000)},
m AS (SELECT q.item_id, e.label, list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s, e.vec_id FROM qimg q, embeddings e),
top2 AS (SELECT item_id, label, avg(s) AS v FROM (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY round(s, 9) DESC, vec_id) AS n FROM m) WHERE n <= 2 GROUP BY 1, 2),
nt AS (SELECT qid, count(*) AS n FROM tb GROUP BY qid),
j AS (SELECT t.item_id, t.label, v, 9e-1 * v + 1e-1 / (60 + coalesce(b.rank, coalesce(n.n, 0) + 1)) AS score FROM top2 t
  LEFT JOIN tb b ON b.qid = t.item_id AND b.node = t.label LEFT JOIN nt n ON n.qid = t.item_id)
SELECT item_id, label, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, label) AS INTEGER) AS rank, round(v, 6) AS visual, round(score, 6) AS score FROM j"""
)
def visual_set_by_image(spark: SparkSession, d: str) -> DataFrame:
    """Image sets by their two nearest members, with a small text-rank share."""
    e = table(spark, d, "embeddings")
    near = dense.dense_topk(e, _question_images(spark, d), 2, node="vec_id", vec="embedding", qid="item_id", group="label")
    visual = near.groupBy("query_id", "grp").agg(F.avg("score").alias("v")).withColumnRenamed("grp", "label")
    q = questions(spark, d).withColumnRenamed("item_id", "query_id")
    terms = bm25.question_terms(q)
    members = documents(spark, d).join(e.select("vec_id", "label"), F.col("doc_id") == F.col("vec_id"))
    scored = bm25.score(bm25.group_postings(members, "label", "text", terms), terms)
    ranked = top_k(scored, ["query_id"], by_score("score", "node_id"), None)
    text = ranked.select("query_id", F.col("node_id").alias("label"), F.col("rank").alias("text_rank"))
    listed = text.groupBy("query_id").agg(F.count("*").alias("n"))
    joined = visual.join(text, ["query_id", "label"], "left").join(listed, "query_id", "left")
    rank = F.coalesce("text_rank", F.coalesce("n", F.lit(0)) + 1)
    scored = joined.withColumn("score", F.lit(0.9) * F.col("v") + F.lit(0.1) / (60 + rank))
    ranked = top_k(scored, ["query_id"], by_score("score", "label"), None)
    return ranked.select(F.col("query_id").alias("item_id"), "label", "rank", F.round("v", 6).alias("visual"), F.round("score", 6).alias("score"))


def fact_hybrid(spark: SparkSession, d: str, depth: int = 30) -> DataFrame:
    """Facts ranked by fused dense and BM25 lists."""
    f = facts(spark, d).select("node_id", "text")
    q = questions(spark, d).withColumnRenamed("item_id", "query_id")
    near = dense.dense_topk(hashed_vectors(f, "node_id", "text"), hashed_vectors(q, "query_id", "text"), depth)
    sparse = bm25.bm25_topk(f, q, depth)
    return fusion.rrf(channel(near, "0.dense", 1.0).unionByName(channel(sparse, "1.bm25", 1.0)))


FACT_HYBRID_SQL = (
    FACTS_SQL + "," + hashed_sql("fh", "facts", "node_id", "text") + "," + hashed_sql("qh", "benchmark", "item_id", "text") + ","
    + dense_sql("fd", "fh", "qh", 30) + "," + bm25_sql("fb", "facts", "node_id", "text", "benchmark", "item_id", "text", 30)
    + ", fch AS (SELECT qid, node, 0 AS ch, rank, 1e0 AS weight FROM fd UNION ALL SELECT qid, node, 1, rank, 1e0 FROM fb)," + rrf_sql("fr", "fch")
)


@query(f"WITH {FACT_HYBRID_SQL} SELECT qid AS item_id, node AS node_id, rank, round(score, 9) AS score FROM fr")
def fact_hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return fact_hybrid(spark, d).select(F.col("query_id").alias("item_id"), "node_id", "rank", F.round("score", 9).alias("score"))


@query(
    f"""WITH {FACT_HYBRID_SQL}, hit AS (SELECT qid, ref, rank, node FROM fr JOIN fact_refs r ON r.node_id = fr.node)
SELECT qid AS item_id, ref, round(sum(1e0 / (60 + rank)), 9) AS score_sum, round(max(1e0 / (60 + rank)), 9) AS score_max,
  array_to_string(list(node ORDER BY rank)[1:3], ',') AS matched FROM hit GROUP BY qid, ref"""
)
def source_memory_rank(spark: SparkSession, d: str) -> DataFrame:
    """Turns behind the ranked facts, scored by sum and by best fact."""
    hits = fact_hybrid(spark, d).join(fact_refs(facts(spark, d)), "node_id")
    gain = F.lit(1.0) / (60 + F.col("rank"))
    return hits.groupBy(F.col("query_id").alias("item_id"), "ref").agg(
        F.round(F.sum(gain), 9).alias("score_sum"),
        F.round(F.max(gain), 9).alias("score_max"),
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda e: e["node_id"]), 1, 3), ",").alias("matched"),
    )
