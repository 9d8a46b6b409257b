"""DuckDB SQL for the queries that SQL can express."""

LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({column}, '{pattern}'), [])"


OP10 = f"""
WITH doc AS (SELECT doc_id, {_words(LOWERED.format("text"), ALPHANUMERIC)} AS ws FROM documents),
item AS (SELECT item_id, {_words(LOWERED.format("text"), ALPHANUMERIC)} AS ws FROM benchmark),
test AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS w
  FROM item, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
seen AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM doc, (SELECT DISTINCT n FROM test) AS lengths, unnest(range(1, len(ws) - n + 2)) AS t(i)),
met AS (SELECT DISTINCT doc_id, item_id, i, n FROM seen JOIN test USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6 = f"""
WITH doc AS (SELECT doc_id, {_words("text", BLANK_SEPARATED)} AS ws FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM doc, unnest(range(1, len(ws) - 18)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, p FROM win, unnest(range(i, i + 20)) AS t(p) WHERE nth > 1),
word AS (SELECT doc_id, p, ws[p] AS w FROM doc, unnest(range(1, len(ws) + 1)) AS t(p)),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_words(LOWERED.format("text"), BLANK_SEPARATED)} AS ws FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 1], ' ') AS s
  FROM doc, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS t(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) AS p
  JOIN size u ON u.doc_id = a JOIN size v ON v.doc_id = b WHERE 100 * common >= 80 * (u.n + v.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, min(b) = a AS kept
FROM reach LEFT JOIN size ON size.doc_id = a GROUP BY a
"""

OP7 = f"""
WITH doc AS (
  SELECT doc_id, source, CAST(len({_words("text", BLANK_SEPARATED)}) AS BIGINT) AS size, md5('mix|' || doc_id) AS h FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM doc GROUP BY source),
lev AS (
  SELECT *, CAST((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM src WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
goal AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT max(level) FROM lev WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE))) AS target
  FROM src),
num AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM doc JOIN goal USING (source))
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - before)) END AS BIGINT) AS taken
FROM num
"""

OP8 = """
WITH vec AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM vec q JOIN vec c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _crc_table() -> list[int]:
    """The byte table of CRC-32, by its rule."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, as BIGINT."""
    digits = f"hex(encode({text}))"
    nibble = "strpos('0123456789ABCDEF', substr({0}, {1}, 1)) - 1"
    octets = f"[CAST(16 * ({nibble.format(digits, '2 * i + 1')}) + {nibble.format(digits, '2 * i + 2')} AS BIGINT) FOR i IN range(length({digits}) // 2)]"
    table = f"CAST({_crc_table()} AS BIGINT[])"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


OP13 = f"""
WITH doc AS (SELECT doc_id, {_words(LOWERED.format("text"), ALPHANUMERIC)} AS ws FROM documents),
item AS (SELECT {_words(LOWERED.format("text"), ALPHANUMERIC)} AS ws FROM benchmark),
mine AS (
  SELECT doc_id, array_to_string(ws[i : i + n - 1], ' ') AS f, count(*) AS c
  FROM doc, unnest([1, 2, 3]) AS k(n), unnest(range(1, len(ws) - n + 2)) AS t(i) GROUP BY ALL),
theirs AS (
  SELECT array_to_string(ws[i : i + n - 1], ' ') AS f, count(*) AS c
  FROM item, unnest([1, 2, 3]) AS k(n), unnest(range(1, len(ws) - n + 2)) AS t(i) GROUP BY ALL),
known AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM mine UNION SELECT f FROM theirs)),
s AS (SELECT bucket, sum(c) AS s FROM mine JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM theirs JOIN known USING (f) GROUP BY bucket),
ratio AS (
  SELECT bucket, (CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(s), 0) FROM s) AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(t), 0) FROM t) AS DOUBLE) + 10000)) AS r
  FROM s LEFT JOIN t USING (bucket)),
weighed AS (
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * CAST(floor(1000 * ln(r)) AS BIGINT)) AS BIGINT) AS weight
  FROM mine JOIN known USING (f) JOIN ratio USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (doc_id)),
ranked AS (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank, 5 * count(*) OVER () // 100 AS wanted FROM scored WHERE eligible)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= wanted THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _repair_step(state: int) -> str:
    """Best {c, a, t} (cost, audit, lines) from a grammar state at row r, inserted turns not yet tried."""
    forced, role = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")][state]
    keep = {0: "CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 END", 1: "CASE ini WHEN 'u' THEN 3 END", 2: "CASE ini WHEN 'a' THEN 4 END", 3: "CASE ini WHEN 'u' THEN 3 END"}[state]
    return f"""list_min(list_filter([
      {{c: v[{state + 1}].c + 2, a: 'D' || v[{state + 1}].a, t: v[{state + 1}].t}},
      CASE WHEN NOT gone THEN {{c: v[{forced + 1}].c + 1 + extra, a: 'R' || v[{forced + 1}].a, t: list_prepend('{role}:' || text, v[{forced + 1}].t)}} END,
      CASE WHEN NOT gone AND ({keep}) IS NOT NULL THEN {{c: v[{keep}].c + extra, a: 'K' || v[{keep}].a, t: list_prepend(role || ':' || text, v[{keep}].t)}} END
    ], lambda x: x IS NOT NULL))"""


def _insert(target: str, role: str) -> str:
    return f"{{c: {target}.c + 5, a: 'I' || {target}.a, t: list_prepend('{role}:', {target}.t)}}"


OP11 = f"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM told, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)),
placed AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare
  FROM after),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 'truncated' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair, count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed),
r AS (SELECT conv_id, pos, n, ini, role, text, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
go AS (
  SELECT DISTINCT conv_id, n + 1 AS pos, [{{c: 0, a: '', t: CAST([] AS VARCHAR[])}}, {{c: 10, a: 'II', t: ['user:', 'assistant:']}}, {{c: 5, a: 'I', t: ['assistant:']}}, {{c: 0, a: '', t: CAST([] AS VARCHAR[])}}] AS v FROM r
  UNION ALL
  SELECT conv_id, pos, [list_min([b[1], {_insert("w[1]", "user")}]), list_min([b[2], {_insert("w[1]", "user")}]), w[1], w[2]] AS v
  FROM (
    SELECT conv_id, pos, b, [list_min([b[3], {_insert("b[4]", "assistant")}]), list_min([b[4], {_insert("b[3]", "user")}])] AS w
    FROM (
      SELECT r.conv_id, r.pos, [{", ".join(_repair_step(s) for s in range(4))}] AS b
      FROM go JOIN r ON r.conv_id IS NOT DISTINCT FROM go.conv_id AND r.pos = go.pos - 1))),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v[1].c, 0) AS BIGINT) AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM ids.conv_id AND go.pos = 1
"""
