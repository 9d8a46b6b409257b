"""Facts from windows by a scripted extractor, under every contract."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.catalog.build import SHORT
from colloquy.catalog.registry import query
from colloquy.operators import extraction
from colloquy.sources.sinks import fingerprint
from colloquy.sources.tables import TURNS_SQL, turns
from colloquy.streaming.jobs import fresh_location

LINE = re.compile(r"^\[(S(\d+)_T(\d+))\|speaker_ref=([^\]]*)\] (\S+): ", re.M)


def scripted() -> extraction.Extractor:
    """One fact a turn.  Some windows cite an unknown turn until they are corrected, some
    facts name an operation that does not exist, and for some sessions the service is down."""

    def answer(message: str) -> dict:
        seen = LINE.findall(message)
        corrected = "failed grounding validation" in message
        session, first = int(seen[0][1]), int(seen[0][2]) - 1
        if session % 11 == 5:
            raise ConnectionError("service down")
        facts = []
        for i, (ref, _, _, who, role) in enumerate(seen):
            before = seen[i - 1]
            facts.append({
                "text": f"{who} said {ref}", "refer_ids": [before[0], ref] if i % 2 else ref, "source_role": role,
                "source_speaker_ref": "nobody" if i % 4 == 3 else who, "speaker": "nobody" if i % 4 == 3 else role,
                "addressee_refs": ["everyone", before[3], "stranger"][i % 3], "context_operations": ["guessing"] if session % 7 == 3 and i == 1 else [],
            })
        if first % 4 == 2 and not corrected:
            facts[0]["refer_ids"] = ["S0_T999"]
        return {"facts": facts}

    return answer


def scripted_names() -> extraction.Extractor:
    """The same facts with displayed names in place of stable ids."""
    inner = scripted()

    def answer(message: str) -> dict:
        found = inner(message)
        return {"facts": [{k: v for k, v in fact.items() if k != "source_speaker_ref"} for fact in found["facts"]]}

    return answer


_WINDOWS = TURNS_SQL + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS p, count(*) OVER (PARTITION BY session_id) AS n FROM turns),
starts AS (SELECT DISTINCT session_id, s AS start FROM (SELECT session_id, unnest(list_append(range(0, greatest(n - 3, 1), 2), greatest(n - 4, 0))) AS s FROM (SELECT DISTINCT session_id, n FROM pos))),
m AS (SELECT p.case_id, p.conv_id, p.session_id, s.start, p.p - s.start AS i, p.ref, p.speaker AS role, p.speaker_ref AS who, p.person, min(p.turn_idx) OVER w AS first_turn,
    count(*) OVER w AS len, bool_or(p.speaker = 'user') OVER w AS has_user, lag(p.ref) OVER (w ORDER BY p.p) AS pref, lag(p.speaker_ref) OVER (w ORDER BY p.p) AS pwho, lag(p.speaker) OVER (w ORDER BY p.p) AS prole
  FROM starts s JOIN pos p ON p.session_id = s.session_id AND p.p >= s.start AND p.p < s.start + 4 WINDOW w AS (PARTITION BY s.session_id, s.start))"""


@query(
    f"""WITH {_WINDOWS},
j AS (SELECT contract, m.*, CASE WHEN conv_id % 11 = 5 THEN 'extraction_failed: service down' WHEN conv_id % 7 = 3 AND i = 1 THEN 'unknown_operation'
    WHEN contract = 'two_party' AND role NOT IN ('user', 'assistant') THEN 'invalid_role' WHEN contract = 'audio' AND i % 4 = 3 AND pwho <> who THEN 'not_a_cited_speaker'
    WHEN contract = 'multi_party' AND i % 4 = 3 AND prole <> role THEN 'not_a_cited_speaker' ELSE '' END AS problem
  FROM m, (VALUES ('two_party'), ('multi_party'), ('audio')) AS c(contract)),
a AS (SELECT *, CASE WHEN bool_or(problem <> '') OVER (PARTITION BY contract, session_id, start) OR first_turn % 4 = 2 THEN 2 ELSE 1 END AS attempt FROM j),
d AS (SELECT *, CASE contract WHEN 'two_party' THEN CASE WHEN role = 'user' THEN person ELSE 'assistant' END ELSE role END AS shown,
    CASE contract WHEN 'two_party' THEN CASE WHEN role = 'assistant' THEN CASE WHEN has_user THEN person ELSE 'user' END ELSE 'assistant' END
      WHEN 'multi_party' THEN CASE i % 3 WHEN 0 THEN 'everyone' WHEN 1 THEN pwho ELSE 'stranger' END
      ELSE CASE WHEN i % 3 = 0 THEN 'group' WHEN i % 3 = 1 AND pwho <> who THEN prole ELSE 'unknown' END END AS heard FROM a)
SELECT contract, session_id, CAST(start AS BIGINT) AS start, CAST(i AS INTEGER) AS item, attempt, problem, CASE WHEN problem = '' THEN shown ELSE '' END AS speaker, CASE WHEN problem = '' THEN heard ELSE '' END AS addressee,
  CAST(1 + i % 2 AS INTEGER) AS n_refs, CASE WHEN problem = 'unknown_operation' THEN 'guessing' WHEN i % 2 = 1 THEN 'multi_turn_synthesis' ELSE '' END AS ops,
  CASE WHEN problem = '' THEN 'fact:' || substr(sha1('{{"refer_ids": [' || CASE WHEN i % 2 = 1 THEN '"' || pref || '", ' ELSE '' END || '"' || ref || '"], "speaker' || CASE WHEN contract = 'audio' THEN '_ref": "' || who ELSE '": "' || shown END
    || '", "text": "' || lower(who) || ' said ' || lower(ref) || '"}}'), 1, 16) ELSE '' END AS node_id
FROM d WHERE NOT starts_with(problem, 'extraction')
UNION ALL
SELECT DISTINCT contract, session_id, CAST(start AS BIGINT), -1, 2, problem, '', '', 0, '', '' FROM d WHERE starts_with(problem, 'extraction')"""
)
def window_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every window under every contract, and what is quarantined after two attempts."""
    t = turns(spark, d).withColumn("images", F.array().cast("array<struct<id: string, caption: string>>"))
    held = extraction.windowed(t, **SHORT)
    out = None
    for contract in extraction.CONTRACTS:
        version = spark.range(1).select(fingerprint("script 1", contract)).first()[0]
        maker = scripted_names if contract == "multi_party" else scripted
        rows = extraction.extract(spark, held, maker, contract, fresh_location(spark, f"facts-{contract}"), version, attempts=2, batches=1).withColumn("contract", F.lit(contract))
        out = rows if out is None else out.unionByName(rows)
    fine = F.col("problem").isNull()
    shown = lambda c: F.when(fine, F.col(c)).otherwise("").alias(c)
    return out.select(
        "contract", "session_id", "start", "item", "attempt", F.coalesce("problem", F.lit("")).alias("problem"), shown("speaker"), shown("addressee"), F.size("refer_ids").alias("n_refs"),
        F.array_join("context_operations", ",").alias("ops"), shown("node_id"),
    )
