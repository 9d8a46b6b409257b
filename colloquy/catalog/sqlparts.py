"""Checking-SQL fragments shared by several queries."""

from __future__ import annotations

from colloquy.functions.text import STOPWORDS

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def informative_sql(text: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
        f"lambda x: len(x) > 1 AND NOT list_contains({STOP_SQL}, x)))"
    )


def coverage_sql(question: str, text: str) -> str:
    q = informative_sql(question)
    t = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"CASE WHEN len({q}) = 0 THEN 0e0 ELSE CAST(len(list_intersect({q}, list_distinct({t}))) AS DOUBLE) / len({q}) END"


def hashed_sql(name: str, corpus: str, node: str, text: str) -> str:
    """CTEs ending in ``name(node, b, w)``: unit-length hashed token counts."""
    return f"""
{name}_t AS (SELECT {node} AS node, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {corpus}),
{name}_c AS (SELECT node, (ascii(t) * 31 + ascii(right(t, 1)) * 7 + len(t)) % 64 AS b, CAST(count(*) AS DOUBLE) AS c FROM {name}_t GROUP BY 1, 2),
{name}_n AS (SELECT node, sqrt(sum(c * c)) AS size FROM {name}_c GROUP BY node),
{name} AS (SELECT node, b, c / size AS w FROM {name}_c JOIN {name}_n USING (node))"""


def dense_sql(name: str, corpus: str, queries: str, k: int) -> str:
    """CTEs ending in ``name(qid, node, score, rank)`` from two hashed relations."""
    return f"""
{name}_s AS (SELECT q.node AS qid, d.node, sum(q.w * d.w) AS score FROM {queries} q JOIN {corpus} d USING (b) GROUP BY q.node, d.node),
{name} AS (SELECT * FROM (SELECT qid, node, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank
  FROM {name}_s) WHERE rank <= {k})"""


def vector_topk_sql(name: str, corpus: str, node: str, vec: str, queries: str, qid: str, qvec: str, k: int, extra: str = "") -> str:
    return f"""
{name}_s AS (SELECT q.{qid} AS qid, d.{node} AS node, {extra} list_dot_product(CAST(q.{qvec} AS DOUBLE[]), CAST(d.{vec} AS DOUBLE[])) AS score
  FROM {queries} q, {corpus} d),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, node) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {k})"""


def rrf_sql(name: str, source: str, k: int | None = None) -> str:
    """CTEs ending in ``name(qid, node, score, rank)`` from ``source(qid, node, ch, rank, weight)``."""
    limit = f"WHERE rank <= {k}" if k else ""
    return f"""
{name}_f AS (SELECT qid, node, sum(weight / (60 + rank)) AS score, min(ch * 100000 + rank) AS first FROM {source} GROUP BY qid, node),
{name} AS (SELECT * FROM (SELECT qid, node, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, first, node) AS INTEGER) AS rank
  FROM {name}_f) {limit})"""


def assignment_sql(name: str, support: str, left: str, right: str, gain: str) -> str:
    """CTEs ending in ``name(case_id, left, right, gain)``: best one-to-one pairs by subsets of partners.

    They need ``WITH RECURSIVE``.
    """
    return f"""
{name}_l AS (SELECT case_id, {left}, row_number() OVER (PARTITION BY case_id ORDER BY {left}) AS i FROM (SELECT DISTINCT case_id, {left} FROM {support})),
{name}_r AS (SELECT case_id, {right}, 1 << (row_number() OVER (PARTITION BY case_id ORDER BY {right}) - 1) AS bit FROM (SELECT DISTINCT case_id, {right} FROM {support})),
{name}_o AS (SELECT case_id, i, '' AS pick, 0 AS bit, 0 AS gain, 0 AS one FROM {name}_l
  UNION ALL SELECT case_id, i, {right}, bit, {gain}, 1 FROM {support} JOIN {name}_l USING (case_id, {left}) JOIN {name}_r USING (case_id, {right})),
{name}_d AS (
  SELECT DISTINCT case_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS score, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS picks FROM {support}
  UNION ALL
  SELECT case_id, i, mask, score, n, picks FROM (
    SELECT d.case_id, CAST(o.i AS BIGINT) AS i, CAST(d.mask + o.bit AS BIGINT) AS mask, CAST(d.score + o.gain AS BIGINT) AS score, CAST(d.n + o.one AS BIGINT) AS n, list_append(d.picks, o.pick) AS picks,
      row_number() OVER (PARTITION BY d.case_id, d.mask + o.bit ORDER BY d.score + o.gain DESC, d.n + o.one DESC, list_append(d.picks, o.pick)) AS place
    FROM {name}_d d JOIN {name}_o o ON o.case_id = d.case_id AND o.i = d.i + 1 AND (d.mask & o.bit) = 0) WHERE place = 1),
{name}_b AS (SELECT d.case_id, picks FROM {name}_d d JOIN (SELECT case_id, max(i) AS i FROM {name}_l GROUP BY case_id) USING (case_id, i)
  QUALIFY row_number() OVER (PARTITION BY d.case_id ORDER BY score DESC, n DESC, picks) = 1),
{name} AS (SELECT case_id, {left}, {right}, {gain} FROM {name}_b JOIN {name}_l USING (case_id) JOIN {support} USING (case_id, {left}) WHERE {right} = picks[i])"""
