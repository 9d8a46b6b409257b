"""Speaker identity: acoustic graphs, prototypes, names and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.registry import query
from colloquy.catalog.retrieval import _CENTROIDS
from colloquy.catalog.sqlparts import assignment_sql
from colloquy.config import BOUNDARY_FRAGMENTS
from colloquy.functions.names import NON_NAMES
from colloquy.operators import dense, fragments, graph, naming, speakers
from colloquy.sources.tables import TURN_VECTORS_SQL, TURNS_SQL, table, turn_vectors, turns

# The test vectors are nearly orthogonal, so the graph uses the matching threshold.
GRAPH_COSINE = 0.35


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the speaker as acoustic cluster."""
    return turns(spark, d).select("case_id", "session_id", "turn_idx", F.col("speaker_ref").alias("cluster"), "text")


@query(
    f"""WITH {TURNS_SQL} SELECT a.case_id, a.session_id, a.turn_idx, a.speaker_ref AS cluster, b.speaker_ref AS next_cluster FROM turns a JOIN turns b ON b.session_id = a.session_id AND b.turn_idx = a.turn_idx + 1"""
)
def response_pairs(spark: SparkSession, d: str) -> DataFrame:
    return naming.adjacent(spoken(spark, d)).select("case_id", "session_id", "turn_idx", "cluster", "next_cluster")


@query(
    f"""WITH {TURNS_SQL}, p AS (SELECT a.case_id, a.session_id, least(a.speaker_ref, b.speaker_ref) AS x, greatest(a.speaker_ref, b.speaker_ref) AS y FROM turns a JOIN turns b ON b.session_id = a.session_id AND b.turn_idx = a.turn_idx + 1 WHERE a.speaker_ref <> b.speaker_ref),
e AS (SELECT DISTINCT * FROM p), n AS (SELECT session_id, count(*) AS n FROM e GROUP BY session_id),
t AS (SELECT case_id, session_id, c, count(*) AS k FROM (SELECT case_id, session_id, x AS c FROM e UNION ALL SELECT case_id, session_id, y FROM e) GROUP BY ALL)
SELECT case_id, session_id, c AS cluster FROM t JOIN n USING (session_id) WHERE k = n"""
)
def hub_clusters(spark: SparkSession, d: str) -> DataFrame:
    return naming.hub_clusters(spoken(spark, d))


_NON = "[" + ", ".join(f"'{w}'" for w in NON_NAMES) + "]"
_NAME_RE = r"((?:(?:Ms|Mr|Mrs|Dr)\.?\s+)?[A-Z][A-Za-z''’-]+(?:\s+[A-Z][A-Za-z''’-]+){0,2})"
_LEAD_RE = r"^\s*(?:(?i:oh)\s*[,!-]?\s+)?(?:(?i:hey|hi|hello|thanks|okay|alright|so)\s*[,!-]?\s+)?" + _NAME_RE + r"\s*[,!:]"
_TRAIL_RE = r",\s*" + _NAME_RE + r"\s*[?!.]\s*$"


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z]+', ' ', 'g'))"


@query(
    f"""WITH {TURNS_SQL}, pr AS (SELECT a.case_id, a.session_id, a.turn_idx, b.speaker_ref AS cluster, a.text, regexp_extract(a.text, '{_LEAD_RE}', 1) AS ld, regexp_extract(a.text, '{_TRAIL_RE}', 1) AS tr,
  regexp_replace(a.text, '{_LEAD_RE}', '') AS rest FROM turns a JOIN turns b ON b.session_id = a.session_id AND b.turn_idx = a.turn_idx + 1 WHERE a.speaker_ref <> b.speaker_ref),
nm AS (SELECT *, CASE WHEN ld <> '' THEN ld ELSE tr END AS name FROM pr),
w AS (SELECT *, list_filter(string_split(regexp_replace({_norm_sql('name')}, '^((mr|mrs|ms|dr|doctor)( |$))+', ''), ' '), lambda x: x <> '') AS words FROM nm WHERE name <> ''),
k AS (SELECT * FROM w WHERE len(words) BETWEEN 1 AND 3 AND len(list_intersect(words, {_NON})) = 0 AND NOT (ld <> '' AND regexp_matches(rest, '^\\s*(?:and\\s+)?[A-Z][A-Za-z''’-]+\\s*[,—-]'))),
v AS (SELECT *, array_to_string(string_split({_norm_sql('name')}, ' '), '\\s+') AS pat FROM k)
SELECT case_id, session_id, cluster, name, turn_idx AS source_turn, contains(' ' || {_norm_sql('text')} || ' ', ' ' || {_norm_sql('name')} || ' ')
  AND (regexp_matches(lower(text), '^\\s*(?:oh\\s*[,!-]?\\s+)?(?:(?:hey|hi|hello|thanks|okay|alright|so)\\s*[,!-]?\\s+)?' || pat || '\\s*[,!:]') OR regexp_matches(lower(text), ',\\s*' || pat || '\\s*[?!.]?\\s*$')) AS valid FROM v"""
)
def identity_events(spark: SparkSession, d: str) -> DataFrame:
    """Names called at the start or end of a turn and who answered."""
    from colloquy.functions.names import addresses, mentions

    e = naming.response_events(spoken(spark, d))
    return e.select("case_id", "session_id", "cluster", "name", "source_turn", (mentions("text", "name") & addresses("text", "name")).alias("valid"))


@query(
    f"""WITH {TURN_VECTORS_SQL}, {_CENTROIDS},
s AS (SELECT t.ref, c.label, list_dot_product(t.embedding, c.vec) AS s FROM turn_vectors t, cent c),
r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY round(s, 9) DESC, label) AS n FROM s),
b AS (SELECT ref, max(CASE WHEN n = 1 THEN label END) AS nearest, max(CASE WHEN n = 1 THEN s END) AS c, max(CASE WHEN n = 2 THEN label END) AS runner_up, max(CASE WHEN n = 2 THEN s END) AS c2 FROM r WHERE n <= 2 GROUP BY ref)
SELECT ref, nearest, runner_up, round(c, 6) AS cosine, round(c - c2, 6) AS margin, CASE WHEN c < 35e-2 THEN 'unresolved' WHEN c >= 4e-1 AND c - c2 >= 2e-2 THEN 'high' ELSE 'low' END AS confidence FROM b"""
)
def nearest_prototype_margin(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's voice against the label prototypes, with its confidence tier."""
    centers = dense.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    tv = turn_vectors(spark, d)
    ranked = speakers_nearest(tv, centers)
    out = speakers.asker_confidence(ranked, ["ref"])
    return out.select("ref", "nearest", "runner_up", F.round("cosine", 6).alias("cosine"), F.round("margin", 6).alias("margin"), "confidence")


def speakers_nearest(tv: DataFrame, centers: DataFrame) -> DataFrame:
    """Two nearest prototypes per turn; the prototypes are the few questions of a scan."""
    hits = dense.nearest_queries(tv, centers, 2, node="ref", vec="embedding", qid="label")
    return hits.select(F.col("node_id").alias("ref"), F.col("query_id").alias("node_id"), "score", "rank")


@query(
    f"""WITH RECURSIVE {TURN_VECTORS_SQL},
e AS (SELECT a.case_id, a.ord AS x, b.ord AS y FROM (SELECT *, conv_id * 8 + turn_idx AS ord FROM turn_vectors) a JOIN (SELECT *, conv_id * 8 + turn_idx AS ord FROM turn_vectors) b
  ON a.case_id = b.case_id AND a.ord <> b.ord AND list_dot_product(a.embedding, b.embedding) >= 35e-2),
walk AS (SELECT case_id, conv_id * 8 + turn_idx AS x, conv_id * 8 + turn_idx AS y FROM turn_vectors UNION SELECT w.case_id, w.x, e.y FROM walk w JOIN e ON e.case_id = w.case_id AND e.x = w.y),
root AS (SELECT case_id, x, min(y) AS r FROM walk GROUP BY case_id, x)
SELECT case_id, ref, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY r) AS INTEGER) AS component FROM root JOIN (SELECT case_id, ref, conv_id * 8 + turn_idx AS x FROM turn_vectors) USING (case_id, x)"""
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Cosine components of the turns of every case, numbered by first appearance."""
    tv = turn_vectors(spark, d).select("case_id", "ref", (F.col("conv_id") * 8 + F.col("turn_idx")).alias("node_id"), F.col("embedding").alias("vec"))
    edges = graph.similar_edges(tv, GRAPH_COSINE)
    found = graph.numbered(graph.components(tv, edges))
    return found.join(tv.select("case_id", "node_id", "ref"), ["case_id", "node_id"]).select("case_id", "ref", "component")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return turn_vectors(spark, d).select("case_id", "session_id", F.col("ref").alias("node_id"), F.col("speaker_ref").alias("label"), F.col("embedding").alias("vec"))


_COS_SQL = f"""{TURN_VECTORS_SQL},
cos AS (SELECT a.case_id, least(a.speaker_ref, b.speaker_ref) AS src, greatest(a.speaker_ref, b.speaker_ref) AS dst, round(list_dot_product(a.embedding, b.embedding), 6) AS v
  FROM turn_vectors a JOIN turn_vectors b ON a.case_id = b.case_id AND a.ref < b.ref),
sz AS (SELECT case_id, speaker_ref AS label, count(*) AS size, count(DISTINCT session_id) AS n_sessions FROM turn_vectors GROUP BY 1, 2),
wm AS (SELECT case_id, src AS label, quantile_cont(v, 5e-1) AS within FROM cos WHERE src = dst GROUP BY 1, 2)"""


@query(f"WITH {_COS_SQL} SELECT case_id, label, size, n_sessions, round(within, 7) AS within_median FROM sz JOIN wm USING (case_id, label)")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d)
    s = fragments.cluster_summary(graph.cosine_counts(v), fragments.cluster_sizes(v)).filter("within_median IS NOT NULL")
    return s.select("case_id", "label", "size", "n_sessions", F.round("within_median", 7).alias("within_median"))


_EVID_SQL = f"""{_COS_SQL},
x AS (SELECT case_id, src, dst, quantile_cont(v, 5e-1) AS median, max(v) AS max_cos, list_avg(list(v ORDER BY v DESC)[1:5]) AS top_mean FROM cos WHERE src <> dst GROUP BY 1, 2, 3),
dir AS (SELECT * FROM x UNION ALL SELECT case_id, dst, src, median, max_cos, top_mean FROM x),
ss AS (SELECT DISTINCT case_id, speaker_ref AS label, session_id FROM turn_vectors),
sh AS (SELECT a.case_id, a.label AS src, b.label AS dst, count(*) AS shared FROM ss a JOIN ss b USING (case_id, session_id) WHERE a.label <> b.label GROUP BY 1, 2, 3),
ev AS (SELECT d.*, s.size AS ss, t.size AS ts, least(s.size, t.size) / greatest(s.size, t.size) AS size_ratio,
  CASE WHEN ws.within IS NULL AND wt.within IS NULL THEN NULL ELSE d.median / greatest(1e-6, least(coalesce(ws.within, wt.within), coalesce(wt.within, ws.within))) END AS cohesion,
  coalesce(shared, 0) / greatest(1, least(s.n_sessions, t.n_sessions)) AS overlap
  FROM dir d JOIN sz s ON s.case_id = d.case_id AND s.label = d.src JOIN sz t ON t.case_id = d.case_id AND t.label = d.dst
  LEFT JOIN wm ws ON ws.case_id = d.case_id AND ws.label = d.src LEFT JOIN wm wt ON wt.case_id = d.case_id AND wt.label = d.dst LEFT JOIN sh ON sh.case_id = d.case_id AND sh.src = d.src AND sh.dst = d.dst)"""


@query(
    f"WITH {_EVID_SQL} SELECT case_id, src, dst, round(max_cos, 6) AS max_cos, round(top_mean, 8) AS top_mean, round(median, 7) AS median, round(size_ratio, 9) AS size_ratio, round(overlap, 9) AS session_overlap FROM ev"
)
def cluster_pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d)
    e = fragments.pair_evidence(graph.cosine_counts(v), fragments.cluster_sizes(v))
    return e.select(
        "case_id", "src", "dst", F.round("max_cos", 6).alias("max_cos"), F.round("top_mean", 8).alias("top_mean"), F.round("median", 7).alias("median"),
        F.round("size_ratio", 9).alias("size_ratio"), F.round("session_overlap", 9).alias("session_overlap"),
    )


_LINK_SQL = f"""{_EVID_SQL}, sc AS (SELECT *, CASE WHEN ss = 1 THEN top_mean ELSE median END AS score FROM ev),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, src ORDER BY score DESC, dst DESC) AS n FROM sc),
b1 AS (SELECT * FROM rk WHERE n = 1), b2 AS (SELECT case_id, src, score AS runner FROM rk WHERE n = 2),
lk AS (SELECT b1.*, runner, bk.dst = b1.src AS mutual FROM b1 LEFT JOIN b2 USING (case_id, src) LEFT JOIN b1 bk ON bk.case_id = b1.case_id AND bk.src = b1.dst WHERE b1.ss <= b1.ts)"""


@query(f"WITH {_LINK_SQL} SELECT case_id, src, dst, mutual FROM lk")
def reciprocal_best(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d)
    return fragments.links(fragments.pair_evidence(graph.cosine_counts(v), fragments.cluster_sizes(v))).select("case_id", "src", "dst", "mutual")


@query(
    f"""WITH {_LINK_SQL} SELECT case_id, src, dst, round(score, 6) AS score, array_to_string(list_filter([
  CASE WHEN size_ratio > 1e0 / 3 THEN 'balanced_components' END, CASE WHEN ss = 1 AND ts < 10 THEN 'target_too_small' END, CASE WHEN ss = 1 AND top_mean < 35e-2 THEN 'top_k_mean_below_floor' END,
  CASE WHEN ss = 1 AND score - runner < 75e-3 THEN 'margin_below_floor' END, CASE WHEN ss > 1 AND NOT mutual THEN 'not_reciprocal_best' END,
  CASE WHEN (ss = 1 AND score / greatest(1e-8, runner) < 125e-2) OR (ss > 1 AND score < 15e-1 * greatest(runner, 2e-2)) THEN 'relative_separation_below_floor' END,
  CASE WHEN ss > 1 AND (cohesion IS NULL OR cohesion < 7e-1) THEN 'cohesion_below_floor' END, CASE WHEN ss > 1 AND overlap < 5e-1 THEN 'session_support_below_floor' END], lambda r: r IS NOT NULL), ',') AS reasons FROM lk"""
)
def fragment_links(spark: SparkSession, d: str) -> DataFrame:
    v = labelled(spark, d)
    out = fragments.links(fragments.pair_evidence(graph.cosine_counts(v), fragments.cluster_sizes(v)))
    return out.select("case_id", "src", "dst", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query()
def reconcile_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Clusters after repeated best merges, under the session-boundary policy."""
    v = labelled(spark, d)
    return fragments.reconcile(graph.cosine_counts(v), fragments.cluster_sizes(v), BOUNDARY_FRAGMENTS)


@query()
def online_speaker_match(spark: SparkSession, d: str) -> DataFrame:
    """One-pass prototype matching of every case in turn order."""
    tv = turn_vectors(spark, d).withColumn("vec", F.col("embedding"))
    out = speakers.online_match(tv, ["conv_id", "turn_idx"], ["case_id", "ref"])
    return out.select("case_id", "ref", "speaker", "created", F.round("top_cosine", 9).alias("top_cosine"), "updated")


_ALIAS_SQL = """al AS (SELECT c_mktsegment AS case_id, 'N' || c_nationkey AS stable, o_orderpriority AS alias, CASE WHEN o_orderstatus = 'F' AND o_custkey % 50 = 0 THEN 'self_identification' ELSE 'direct_response' END AS event_type,
  'S' || (o_custkey % 9) AS session_id FROM orders JOIN customer ON c_custkey = o_custkey),
st AS (SELECT case_id, stable, alias, count(*) FILTER (WHERE event_type = 'self_identification') AS self_count, count(*) FILTER (WHERE event_type = 'direct_response') AS direct_count,
  count(DISTINCT session_id) FILTER (WHERE event_type = 'direct_response') AS direct_sessions FROM al GROUP BY ALL)"""


def alias_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as name claims: segments are cases, nations identities, priorities names."""
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    own = (F.col("o_orderstatus") == "F") & (F.pmod("o_custkey", F.lit(50)) == 0)
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("case_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("stable"), F.col("o_orderpriority").alias("alias"),
        F.when(own, "self_identification").otherwise("direct_response").alias("event_type"), F.concat(F.lit("S"), F.pmod("o_custkey", F.lit(9)).cast("string")).alias("session_id"),
    )


@query(f"WITH {_ALIAS_SQL} SELECT * FROM st")
def alias_candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    return naming.alias_stats(alias_events(spark, d))


@query(
    f"""WITH {_ALIAS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, stable ORDER BY self_count DESC, alias DESC) AS n, lead(self_count) OVER (PARTITION BY case_id, stable ORDER BY self_count DESC, alias DESC) AS nxt FROM st WHERE self_count > 0),
p AS (SELECT case_id, stable, alias FROM r WHERE n = 1 AND (nxt IS NULL OR nxt < self_count))
SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY case_id, alias) = 1"""
)
def alias_stage_self(spark: SparkSession, d: str) -> DataFrame:
    return naming.alias_from_self(naming.alias_stats(alias_events(spark, d)))


_SELF_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY case_id, stable ORDER BY self_count DESC, alias DESC) AS n, lead(self_count) OVER (PARTITION BY case_id, stable ORDER BY self_count DESC, alias DESC) AS nxt FROM st WHERE self_count > 0),
own AS (SELECT case_id, stable, alias FROM r WHERE n = 1 AND (nxt IS NULL OR nxt < self_count) QUALIFY count(*) OVER (PARTITION BY case_id, alias) = 1)"""


@query(
    f"""WITH RECURSIVE {_ALIAS_SQL}, {_SELF_SQL},
backed AS (SELECT case_id, stable, alias, direct_count * 1000 + direct_sessions * 100 AS score FROM st ANTI JOIN own USING (case_id, stable) ANTI JOIN (SELECT case_id, alias FROM own) USING (case_id, alias)
  WHERE self_count = 0 AND direct_count >= 2 AND direct_sessions >= 2),
{assignment_sql("joint", "backed", "stable", "alias", "score")}
SELECT case_id, stable, alias, 'self_identification' AS reason FROM own UNION ALL SELECT case_id, stable, alias, 'global_one_to_one_direct_response' FROM joint"""
)
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Self claims first, then a joint one-to-one assignment on the connected parts of each case."""
    events = alias_events(spark, d)
    identities = events.select("case_id", "stable").distinct().withColumn("current", F.lit(""))
    return naming.resolve_aliases(naming.alias_stats(events), identities)


@query()
def cluster_naming(spark: SparkSession, d: str) -> DataFrame:
    """Names per cluster from accepted events, merged into stable identities."""
    s = spoken(spark, d)
    named = naming.cluster_names(naming.accepted_events(s), s)
    return naming.stable_identities(named).join(named.select("case_id", "cluster", "status", "evidence"), ["case_id", "cluster"])


_NEAREST_SQL = f"{_CENTROIDS}, s AS (SELECT e.vec_id, e.label AS gold, c.label AS pred, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.vec), 9) DESC, c.label) AS n FROM embeddings e, cent c)"


def nearest_labels(spark: SparkSession, d: str) -> DataFrame:
    """``(vec_id, gold, pred)``: the label of every vector and that of its nearest prototype."""
    e = table(spark, d, "embeddings")
    centers = dense.mean_vectors(e, "label", "embedding")
    nearest = dense.nearest_queries(e, centers, 1, node="vec_id", vec="embedding", qid="label").select(F.col("node_id").alias("vec_id"), F.col("query_id").alias("pred"))
    return e.select("vec_id", F.col("label").alias("gold")).join(nearest, "vec_id")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return nearest_labels(spark, d).groupBy("gold", "pred").agg(F.count("*").alias("n"))


@query(f"WITH {_NEAREST_SQL} SELECT gold, pred, count(*) AS n FROM s WHERE n = 1 GROUP BY gold, pred")
def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    """Label against nearest prototype, counted."""
    return confusion(spark, d)


@query(
    f"""WITH RECURSIVE {_NEAREST_SQL}, {TURN_VECTORS_SQL},
conf AS (SELECT case_id, CAST(gold AS VARCHAR) AS gold, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM turn_vectors JOIN (SELECT vec_id, gold, pred FROM s WHERE n = 1) USING (vec_id) GROUP BY ALL),
{assignment_sql("best", "conf", "gold", "pred", "n")} SELECT * FROM best"""
)
def cluster_gold_matching(spark: SparkSession, d: str) -> DataFrame:
    """Best one-to-one pairing of prototypes and labels over the turns of every case."""
    heard = turn_vectors(spark, d).select("case_id", "vec_id").join(nearest_labels(spark, d), "vec_id")
    return speakers.gold_matching(heard.groupBy("case_id", "gold", "pred").agg(F.count("*").alias("n")))
