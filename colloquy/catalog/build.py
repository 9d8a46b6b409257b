"""Memory construction and route planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.registry import query
from colloquy.functions.ids import fact_id
from colloquy.functions.jsonish import object_text
from colloquy.functions.names import core, norm, plausible, words
from colloquy.functions.text import text_key
from colloquy.operators import facts as factops, windows
from colloquy.operators.ranking import positions
from colloquy.plans import routes
from colloquy.sources.tables import FACTS_SQL, TURNS_SQL, documents, facts, table, turns

SHORT = dict(size=4, stride=2)

_WINDOWS = TURNS_SQL + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS p, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
forms(form, size, stride) AS (VALUES ('short', 4, 2), ('standard', 12, 6)),
starts AS (SELECT DISTINCT form, size, session_id, s AS start FROM (
  SELECT form, size, session_id, unnest(list_append(range(0, greatest(n - size + 1, 1), stride), greatest(n - size, 0))) AS s FROM (SELECT DISTINCT session_id, n FROM pos), forms)),
member AS (SELECT s.form, s.session_id, s.start, p.ref, CAST(p.p - s.start AS INTEGER) AS off, p.speaker, p.text FROM starts s JOIN pos p USING (session_id)
  WHERE p.p >= s.start AND p.p < s.start + s.size)"""


def _window_forms(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    short = windows.overlapping(t, ["session_id"], **SHORT).withColumn("form", F.lit("short"))
    return short.unionByName(windows.overlapping(t, ["session_id"]).withColumn("form", F.lit("standard")))


@query(f"WITH {_WINDOWS} SELECT form, session_id, CAST(start AS BIGINT) AS start, off AS offset_in, ref FROM member")
def turn_windows(spark: SparkSession, d: str) -> DataFrame:
    return _window_forms(spark, d).select("form", "session_id", "start", F.col("offset").alias("offset_in"), "ref")


@query(
    f"""WITH {_WINDOWS} SELECT form, session_id, CAST(start AS BIGINT) AS start, count(*) AS n_turns,
  md5(string_agg('[' || ref || '] ' || speaker || ': ' || text, chr(10) ORDER BY off)) AS digest FROM member GROUP BY form, session_id, start"""
)
def window_prompts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), "ref", F.lit("] "), "speaker", F.lit(": "), "text")
    out = windows.rendered(_window_forms(spark, d), ["form", "session_id"], line)
    return out.select("form", "session_id", "start", "n_turns", F.md5("text").alias("digest"))


@query(f"WITH {TURNS_SQL} SELECT session_id, ref, CAST((row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1) // 4 * 4 AS BIGINT) AS start FROM turns")
def turn_windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(turns(spark, d), ["session_id"], size=4).select("session_id", "ref", "start")


@query(f"WITH {_WINDOWS} SELECT session_id, (SELECT count(*) FROM turns t WHERE t.session_id = s.session_id) AS n_turns, count(*) AS n_windows FROM starts s WHERE form = 'short' GROUP BY session_id")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return windows.counts(turns(spark, d), ["session_id"], **SHORT).select("session_id", "n_turns", "n_windows")


@query(
    FACTS_SQL.join(["WITH ", ""])
    + r""" SELECT ref, node_id, 'fact:' || substr(sha1('{"refer_ids": [' || list_aggregate(list_transform(refer_ids, lambda r: '"' || r || '"'), 'string_agg', ', ') ||
  '], "speaker_ref": "' || source_speaker_ref || '", "text": "' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) || '"}'), 1, 16) AS audio_id FROM facts"""
)
def fact_signature(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return f.select("ref", "node_id", fact_id("source_speaker_ref", text_key("text", fold=True), "refer_ids", "speaker_ref").alias("audio_id"))


@query(
    f"""WITH {TURNS_SQL}, p AS (SELECT *, CASE WHEN speaker = 'user' THEN person WHEN speaker = 'assistant' THEN 'assistant' END AS who FROM turns)
SELECT ref, CASE WHEN ordinal = 5 THEN 'invalid_refer_ids' WHEN ordinal = 3 THEN 'invalid_image_ids' WHEN who IS NULL THEN 'invalid_role' WHEN ordinal = 4 THEN 'unknown_operation' ELSE '' END AS problem,
  CASE WHEN reply_to IS NOT NULL THEN 2 ELSE 1 END AS n_refs,
  CASE WHEN ordinal = 4 THEN 'guessing' WHEN reply_to IS NOT NULL THEN 'multi_turn_synthesis' ELSE '' END AS ops FROM p"""
)
def fact_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Proposed facts checked against their window; bad ones keep their reason."""
    t = turns(spark, d)
    refs = F.when(F.col("reply_to").isNotNull(), F.array("reply_to", "ref", "ref")).otherwise(F.array("ref"))
    none = F.array().cast("array<string>")
    proposed = t.select(
        "ref", F.col("text"), refs.alias("refer_ids"), F.col("speaker").alias("source_role"), F.col("speaker_ref").alias("character"),
        F.when(F.col("ordinal") == 3, F.array(F.lit("img:missing"))).otherwise(none).alias("image_ids"),
        F.when(F.col("ordinal") == 4, F.array(F.lit("guessing"))).otherwise(none).alias("context_operations"),
        F.when(F.col("ordinal") == 5, none).otherwise(F.array_compact(F.array("ref", "reply_to"))).alias("valid_refs"),
        none.alias("valid_images"),
    )
    out = factops.normalise(proposed)
    return out.select("ref", F.coalesce("problem", F.lit("")).alias("problem"), F.size("refer_ids").alias("n_refs"), F.array_join("context_operations", ",").alias("ops"))


@query(
    FACTS_SQL.join(["WITH ", ""])
    + r""", every AS (SELECT speaker, node_id, text, len(refer_ids) AS nr, n_ops AS no FROM facts
  UNION ALL SELECT source, 'doc:' || doc_id, text, 1, 0 FROM documents),
k AS (SELECT *, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM every)
SELECT speaker, arg_max(node_id, (nr, no, node_id)) AS node_id, count(*) AS copies FROM k GROUP BY speaker, key"""
)
def fact_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("speaker", "node_id", "text", "refer_ids", "context_operations")
    docs = documents(spark, d, "doc_id", "text", "source").select(
        F.col("source").alias("speaker"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("node_id"), "text",
        F.array(F.col("doc_id").cast("string")).alias("refer_ids"), F.array().cast("array<string>").alias("context_operations"),
    )
    return factops.deduplicate(f.unionByName(docs)).select("speaker", "node_id", "copies")


@query(
    f"""WITH {FACTS_SQL}, v AS (SELECT 'full' AS view_name, node_id, retrieval_text, ref FROM facts UNION ALL SELECT 'no_coreference', node_id, retrieval_text, ref FROM facts
  UNION ALL SELECT 'single_turn_only', node_id, retrieval_text, ref FROM facts WHERE len(refer_ids) = 1 UNION ALL SELECT 'no_role_metadata', node_id, text, ref FROM facts)
SELECT view_name, ref, md5(retrieval_text) AS digest FROM v"""
)
def ablation_views(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    out = None
    for view in factops.VIEWS:
        rows = factops.ablation(f, view).select(F.lit(view).alias("view_name"), "ref", F.md5("retrieval_text").alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH {TURNS_SQL}, v AS (SELECT session_id, ref, speaker_ref, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS i FROM turns WHERE speaker = 'assistant'),
t AS (SELECT DISTINCT session_id FROM turns)
SELECT t.session_id AS template_qa_id, CASE WHEN i IS NULL THEN t.session_id ELSE t.session_id || format('__V{{:02d}}', i) END AS qa_id,
  CASE WHEN i IS NULL THEN 'ordinary' ELSE 'persona_versioned' END AS kind, coalesce(ref, '') AS answer_ref FROM t LEFT JOIN v USING (session_id)"""
)
def template_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Question templates unrolled into one unit per version."""
    t = turns(spark, d)
    versions = positions(t.filter("speaker = 'assistant'").select("session_id", "ref", "ordinal"), ["session_id"], "ordinal")
    units = t.select("session_id").distinct().join(versions, "session_id", "left")
    qa_id = F.when(F.col("pos").isNull(), F.col("session_id")).otherwise(F.concat("session_id", F.format_string("__V%02d", (F.col("pos") + 1).cast("int"))))
    return units.select(
        F.col("session_id").alias("template_qa_id"), qa_id.alias("qa_id"),
        F.when(F.col("pos").isNull(), "ordinary").otherwise("persona_versioned").alias("kind"), F.coalesce("ref", F.lit("")).alias("answer_ref"),
    )


@query(
    f"""WITH {FACTS_SQL}, p AS (SELECT node_id, refer_ids, ref, CASE ordinal % 4 WHEN 0 THEN '  @' || lower(source_speaker_ref) WHEN 1 THEN 'unknown' WHEN 2 THEN source_speaker_ref ELSE 'nobody' END AS proposed FROM facts),
c AS (SELECT p.ref AS fact_ref, proposed, t.speaker_ref, min(pos) AS pos FROM p JOIN (SELECT ref AS fref, unnest(refer_ids) AS cited, generate_subscripts(refer_ids, 1) AS pos FROM facts) x ON x.fref = p.ref
  JOIN turns t ON t.ref = x.cited GROUP BY ALL),
g AS (SELECT fact_ref, proposed, list(speaker_ref ORDER BY pos) AS cand FROM c GROUP BY fact_ref, proposed),
m AS (SELECT *, list_filter(cand, lambda x: lower(x) = lower(trim(ltrim(trim(proposed), '@')))) AS hit FROM g)
SELECT fact_ref AS ref, CAST(len(cand) AS INTEGER) AS n_candidates, CASE WHEN len(cand) = 1 THEN 'single_cited_speaker' WHEN len(hit) > 0 THEN 'model_grounded_multi_speaker' ELSE 'not_a_cited_speaker' END AS source,
  CASE WHEN len(cand) = 1 THEN cand[1] WHEN len(hit) > 0 THEN hit[1] ELSE '' END AS speaker FROM m"""
)
def speaker_binding(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    m = F.pmod("ordinal", F.lit(4))
    who = F.when(m == 0, F.concat(F.lit("  @"), F.lower("source_speaker_ref"))).when(m == 1, "unknown").when(m == 2, F.col("source_speaker_ref")).otherwise("nobody")
    raw = turns(spark, d).select("ref", F.col("speaker_ref").alias("speaker"))
    proposed = f.select(F.col("ref").alias("fact_ref"), who.alias("proposed"), "refer_ids")
    out = factops.bind_speakers(proposed, raw, ("fact_ref",))
    return out.select(F.col("fact_ref").alias("ref"), "n_candidates", "source", F.coalesce("speaker", F.lit("")).alias("speaker"))


@query(
    f"""WITH {TURNS_SQL}, p AS (SELECT ref, person, CASE ordinal % 5 WHEN 0 THEN 'Everyone' WHEN 1 THEN 'N/A' WHEN 2 THEN '@' || lower(person) WHEN 3 THEN 'Stranger' ELSE 'assistant' END AS proposed FROM turns)
SELECT ref, CASE WHEN proposed = 'Everyone' THEN 'group' WHEN starts_with(proposed, '@') THEN person WHEN proposed = 'assistant' THEN 'ASSISTANT' ELSE 'unknown' END AS value,
  CASE WHEN proposed = 'Everyone' THEN 'model_group' WHEN proposed = 'N/A' THEN 'model_unknown' WHEN starts_with(proposed, '@') OR proposed = 'assistant' THEN 'model_grounded_candidate' ELSE 'unresolved_candidate' END AS source FROM p"""
)
def addressee_binding(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    person = F.format_string("P%02d", F.pmod("conv_id", F.lit(12)))
    m = F.pmod("ordinal", F.lit(5))
    who = F.when(m == 0, "Everyone").when(m == 1, "N/A").when(m == 2, F.concat(F.lit("@"), F.lower(person))).when(m == 3, "Stranger").otherwise("assistant")
    bound = t.select("ref", factops.bind_addressee(who, F.array(person, F.lit("ASSISTANT"), F.lit("assistant"))).alias("b"))
    return bound.select("ref", "b.value", "b.source")


_ALIAS = "aliases AS (SELECT s_name AS stable, s_name AS alias FROM supplier UNION SELECT p_brand, p_name FROM part UNION SELECT p_brand, p_brand FROM part)"


@query(
    f"""WITH {_ALIAS}, k AS (SELECT DISTINCT stable, lower(alias) AS k FROM aliases),
hints AS (SELECT DISTINCT hint FROM (SELECT alias AS hint FROM aliases UNION ALL SELECT '@' || split_part(p_name, ' ', 1) FROM part UNION ALL SELECT c_name FROM customer)),
hk AS (SELECT hint, lower(ltrim(hint, '@')) AS k FROM hints),
e AS (SELECT k, min(stable) AS s, count(DISTINCT stable) AS n FROM k GROUP BY k),
f AS (SELECT split_part(k, ' ', 1) AS k, min(stable) AS s, count(DISTINCT stable) AS n FROM k GROUP BY 1)
SELECT hint, CASE WHEN e.n = 1 THEN e.s WHEN NOT contains(hk.k, ' ') AND f.n = 1 THEN f.s ELSE '' END AS stable,
  CASE WHEN e.n = 1 THEN 'exact_profile_alias' WHEN NOT contains(hk.k, ' ') AND f.n = 1 THEN 'unique_alias_token' ELSE 'unresolved_or_ambiguous' END AS source
FROM hk LEFT JOIN e ON e.k = hk.k LEFT JOIN f ON f.k = hk.k"""
)
def hint_resolution(spark: SparkSession, d: str) -> DataFrame:
    s, p, c = table(spark, d, "supplier", "s_name"), table(spark, d, "part", "p_brand", "p_name"), table(spark, d, "customer", "c_name")
    aliases = s.select(F.col("s_name").alias("stable"), F.col("s_name").alias("alias")).union(p.select("p_brand", "p_name")).union(p.select("p_brand", "p_brand")).distinct()
    firsts = p.select(F.concat(F.lit("@"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("hint"))
    hints = aliases.select(F.col("alias").alias("hint")).union(firsts).union(c).distinct()
    out = factops.resolve_hints(hints, aliases, ())
    return out.select("hint", F.coalesce("stable", F.lit("")).alias("stable"), "source")


@query(
    r"""WITH r AS (SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
  WHEN 2 THEN 'answer ' || props || ' done' WHEN 3 THEN replace(props, '}', '') ELSE '[' || props || ', 1' END AS raw FROM events)
SELECT event_id, event_id % 5 <> 3 AS parsed, CASE WHEN event_id % 5 <> 3 THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) ELSE '' END AS k FROM r"""
)
def noisy_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects recovered from strict, fenced, chatty and broken text."""
    m = F.pmod("event_id", F.lit(5))
    raw = (
        F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("answer "), "props", F.lit(" done"))).when(m == 3, F.replace("props", F.lit("}"), F.lit("")))
        .otherwise(F.concat(F.lit("["), "props", F.lit(", 1")))
    )
    e = table(spark, d, "events", "event_id", "props").select("event_id", object_text(raw).alias("o"))
    return e.select("event_id", F.col("o").isNotNull().alias("parsed"), F.coalesce(F.get_json_object("o", "$.k"), F.lit("")).alias("k"))


_TEXTS = """texts AS (SELECT 'document' AS kind, doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'page', page_id, lower(html) FROM pages
  UNION ALL SELECT 'question', item_id, lower(text) || CASE item_id % 5 WHEN 0 THEN ' how many photos on 2024-05-0' || (1 + item_id % 9) || '?' WHEN 1 THEN ' what came first?' WHEN 2 THEN ' which of the red pictures depicts it' ELSE '' END FROM benchmark),
W AS (SELECT '(^|[^\\p{L}\\p{N}_])' AS l, '($|[^\\p{L}\\p{N}_])' AS r),
g AS (SELECT kind, id, t, (id % 7 = 0) OR regexp_matches(t, l || '(image|images|photo|photos|picture|pictures|visual|look like|depicts)' || r) AS visual,
  regexp_matches(t, l || '(how many|total|number of|search for all|find all|all\\s+([\\p{L}\\p{N}_]+\\s+){0,3}(images|photos|pictures)|which\\s+([\\p{L}\\p{N}_]+\\s+){0,3}(images|photos|pictures))' || r) AS coll,
  regexp_matches(t, l || '(before|after|earlier|later|first|last|then|timeline|chronological|in order|sequence)' || r) AS temporal,
  regexp_extract(t, '(^|[^\\p{L}\\p{N}_])(20\\d{2}-\\d{2}-\\d{2})($|[^\\p{L}\\p{N}_])', 2) AS day FROM texts, W)""".replace("\\\\", "\\")


def _gate_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, d, "pages", "page_id", "html").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    m = F.pmod("item_id", F.lit(5))
    tail = (
        F.when(m == 0, F.concat(F.lit(" how many photos on 2024-05-0"), (1 + F.pmod("item_id", F.lit(9))).cast("string"), F.lit("?")))
        .when(m == 1, " what came first?").when(m == 2, " which of the red pictures depicts it").otherwise("")
    )
    asked = table(spark, d, "benchmark", "item_id", "text").select(F.lit("question").alias("kind"), F.col("item_id").alias("id"), F.concat("text", tail).alias("t"))
    return docs.unionByName(pages).unionByName(asked)


@query(
    f"""WITH {_TEXTS} SELECT kind, id, CASE WHEN visual AND coll THEN 'VISUAL_COLLECTION' WHEN visual THEN 'VISUAL_SINGLE' ELSE 'TEXT_FACT' END AS intent,
  CASE WHEN visual AND coll THEN 'collection:image+dense+bm25;raw:caption+dense' WHEN visual THEN 'raw:image+caption+dense' ELSE 'raw:dense+bm25;fact:dense+bm25' END AS routes FROM g"""
)
def route_gate(spark: SparkSession, d: str) -> DataFrame:
    p = _gate_texts(spark, d).withColumn("plan", routes.heuristic_gate("t", F.pmod("id", F.lit(7)) == 0))
    return p.select("kind", "id", "plan.intent", routes.routes_text(F.col("plan.routes")).alias("routes"))


@query(
    f"""WITH {_TEXTS} SELECT kind, id, CASE WHEN visual AND coll THEN 'VISUAL_COLLECTION' WHEN visual THEN 'VISUAL_SINGLE' WHEN temporal THEN 'TEMPORAL' ELSE 'TEXT_FACT' END AS intent,
  CASE WHEN visual AND coll THEN 'collection:image+caption+dense+bm25;raw:image+caption+dense+bm25' WHEN visual THEN 'raw:image+caption+dense+bm25' ELSE 'raw:dense+bm25;fact:dense+bm25' END AS routes,
  day AS time_range, CASE WHEN temporal AND NOT visual THEN 'time' ELSE 'score' END AS sort_by FROM g"""
)
def route_gate_r1(spark: SparkSession, d: str) -> DataFrame:
    p = _gate_texts(spark, d).withColumn("plan", routes.keyword_gate("t", F.pmod("id", F.lit(7)) == 0))
    return p.select(
        "kind", "id", "plan.intent", routes.routes_text(F.col("plan.routes")).alias("routes"),
        F.coalesce("plan.time_range", F.lit("")).alias("time_range"), "plan.sort_by",
    )


_NAMES = "names AS (SELECT DISTINCT name FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT 'Dr. ' || p_name FROM part UNION ALL SELECT p_name || ' ' || p_type FROM part UNION ALL SELECT n_name FROM nation))"


@query(
    f"""WITH {_NAMES}, n AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z]+', ' ', 'g')) AS norm FROM names),
c AS (SELECT name, norm, regexp_replace(norm, '^((mr|mrs|ms|dr|doctor)( |$))+', '') AS core FROM n)
SELECT name, norm, core, CAST(len(list_filter(string_split(core, ' '), lambda x: x <> '')) AS INTEGER) AS n_words,
  len(list_filter(string_split(core, ' '), lambda x: x <> '')) BETWEEN 1 AND 3 AS plausible FROM c"""
)
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_name", "p_type")
    names = (
        table(spark, d, "customer", "c_name").union(table(spark, d, "supplier", "s_name")).union(p.select(F.concat(F.lit("Dr. "), "p_name")))
        .union(p.select(F.concat_ws(" ", "p_name", "p_type"))).union(table(spark, d, "nation", "n_name")).distinct().toDF("name")
    )
    return names.select("name", norm("name").alias("norm"), core("name").alias("core"), F.size(words(core("name"))).alias("n_words"), plausible("name").alias("plausible"))
