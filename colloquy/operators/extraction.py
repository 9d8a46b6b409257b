"""Facts from turn windows by an external extractor, with quarantine and resume.

A lateral Python table function calls the extractor once per window and attempt and
yields its proposals as rows.  Grounding is checked on columns.  All windows that
are not clean go into the next attempt together, with the reason added to their
message; what is still wrong after the last attempt is quarantined, with its reason.

Finished windows are committed to a location in batches.  A run that starts again
there skips them, and refuses results of another fingerprint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.config import WINDOW_SIZE, WINDOW_STRIDE
from colloquy.errors import ContractViolation
from colloquy.functions.ids import fact_id
from colloquy.functions.text import collapse, distinct_by_key, distinct_nonempty, identity_key, text_key
from colloquy.operators import facts as factops, windows

Extractor = Callable[[str], dict]
ATTEMPTS = 4
# Windows commit together in this many batches, so an interrupted run loses one of them.
BATCHES = 8
KEYS = ["case_id", "session_id", "start"]
TURN = "struct<ref: string, speaker: string, speaker_ref: string, text: string, images: array<struct<id: string, caption: string>>>"
PROPOSAL = (
    "item int, failure string, text string, speaker string, source_role string, addressees array<string>, "
    "context_operations array<string>, refer_ids array<string>, image_ids array<string>, participants array<string>, details map<string, string>"
)
# Optional descriptive fields that a fact may carry.
DETAILS = ("subject", "predicate", "object", "fact_type", "claimant", "valid_time", "original_time_expression")


def windowed(turns: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE) -> DataFrame:
    """``case_id, session_id, start, turns`` per overlapping window; ``turns`` holds ``size`` entries at most.

    ``turns(case_id, session_id, ordinal, ref, speaker, speaker_ref, text, images)``.
    """
    placed = windows.overlapping(turns, ["case_id", "session_id"], size=size, stride=stride)
    entry = F.struct("ref", "speaker", "speaker_ref", "text", "images")
    held = F.array_sort(F.collect_list(F.struct("offset", entry.alias("turn"))))
    return placed.groupBy(*KEYS).agg(F.transform(held, lambda e: e["turn"]).alias("turns"))


def message(turns: Column) -> Column:
    """The window as the extractor sees it: who speaks, then every turn with its reference and images."""
    pictures = lambda t: F.array_join(F.transform(F.coalesce(t["images"], F.array().cast("array<struct<id: string, caption: string>>")), lambda i: F.concat(F.lit("\n  [image_id="), i["id"], F.lit("; caption="), F.when(F.coalesce(i["caption"], F.lit("")) == "", "unknown").otherwise(i["caption"]), F.lit("]"))), "")
    line = lambda t: F.concat(F.lit("["), t["ref"], F.lit("|speaker_ref="), t["speaker_ref"], F.lit("] "), t["speaker"], F.lit(": "), t["text"], pictures(t))
    people = F.array_sort(F.array_distinct(F.transform(turns, lambda t: F.concat(F.lit("- "), t["speaker_ref"], F.lit(": "), t["speaker"]))))
    return F.concat(F.array_join(people, "\n"), F.lit("\n\n"), F.array_join(F.transform(turns, line), "\n"))


def _table_function(make_extractor: Callable[[], Extractor]):
    """Table function that asks the extractor, opened once per Python worker, about one window."""
    opened: list[Extractor] = []

    def words(value) -> str | None:
        return None if value is None else str(value).strip()

    def listed(value) -> list[str]:
        return [str(v).strip() for v in ([value] if isinstance(value, str) else value or [])]

    @F.udtf(returnType=PROPOSAL)
    class Proposals:
        def eval(self, message: str):
            try:
                if not opened:
                    opened.append(make_extractor())
                answer = opened[0](message)
                found = answer.get("facts", []) if isinstance(answer, dict) else None
                if not isinstance(found, list) or any(not isinstance(f, dict) for f in found):
                    raise ValueError("facts must be a list of objects")
                if not found:
                    raise ValueError("no facts returned")
                rows = [
                    (
                        i, None, words(f.get("text")), words(f.get("source_speaker_ref") or f.get("speaker_ref") or f.get("speaker")), words(f.get("source_role")),
                        listed(f.get("addressee_refs", f.get("addressee", "unknown"))), listed(f.get("context_operations")), listed(f.get("refer_ids")), listed(f.get("image_ids")),
                        listed(f.get("participants")), {k: words(f[k]) for k in DETAILS if words(f.get(k))},
                    )
                    for i, f in enumerate(found)
                ]
            except Exception as error:  # the service decides what it raises; the window is tried again or quarantined
                rows = [(-1, str(error), None, None, None, [], [], [], [], [], {})]
            yield from rows

    return Proposals


def _lookup(turns: Column, ref: Column, field: str) -> Column:
    return F.get(F.filter(turns, lambda t: t["ref"] == ref), F.lit(0))[field]


def _grounded(proposed: DataFrame) -> DataFrame:
    """Cleaned lists, and the problems that all contracts share, in ``problem``."""
    allowed = F.array(*[F.lit(o) for o in factops.OPERATIONS])
    refs = F.transform("turns", lambda t: t["ref"])
    pictures = F.flatten(F.transform("turns", lambda t: F.transform(F.coalesce(t["images"], F.array().cast("array<struct<id: string, caption: string>>")), lambda i: i["id"])))
    clean = proposed.withColumns({"text": collapse(F.coalesce("text", F.lit(""))), **{c: distinct_nonempty(F.col(c)) for c in ("refer_ids", "image_ids", "context_operations", "participants")}})
    problem = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit("extraction_failed: "), "failure"))
        .when(F.col("text") == "", "empty_text")
        .when((F.size("refer_ids") == 0) | (F.size(F.array_except("refer_ids", refs)) > 0), "invalid_refer_ids")
        .when(F.size(F.array_except("image_ids", pictures)) > 0, "invalid_image_ids")
        .when(F.size(F.array_except("context_operations", allowed)) > 0, "unknown_operation")
    )
    several = (F.size("refer_ids") > 1) & (F.size("context_operations") == 0)
    return clean.withColumns({"problem": problem, "context_operations": F.when(several, F.array(F.lit("multi_turn_synthesis"))).otherwise(F.col("context_operations"))})


def _cited(proposed: DataFrame, field: str) -> DataFrame:
    """``speaker_value`` and ``binding``: one cited speaker wins, among several the proposal must be one of them."""
    spoken = F.transform("refer_ids", lambda r: F.trim(F.coalesce(_lookup(F.col("turns"), r, field), F.lit(""))))
    named = proposed.withColumn("candidates", distinct_by_key(spoken, identity_key))
    match = F.filter("candidates", lambda c: identity_key(c) == identity_key("speaker"))
    binding = F.when(F.size("candidates") == 0, "no_speaker").when(F.size("candidates") == 1, "single_cited_speaker").when(F.size(match) > 0, "model_grounded_multi_speaker").otherwise("not_a_cited_speaker")
    value = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).otherwise(F.get(match, F.lit(0)))
    bound = named.withColumns({"binding": binding, "speaker_value": value})
    ungrounded = F.when(F.col("binding").isin("no_speaker", "not_a_cited_speaker"), F.col("binding"))
    return bound.withColumn("problem", F.coalesce("problem", ungrounded))


def two_party(proposed: DataFrame) -> DataFrame:
    """Facts of a user and an assistant: the role names the speaker, the other one is addressed."""
    base = _grounded(proposed)
    role = factops.role("source_role")
    person = F.coalesce(F.get(F.filter("turns", lambda t: factops.role(t["speaker"]) == "user"), F.lit(0))["speaker_ref"], F.lit("user"))
    speaker = F.when(role == "user", person).otherwise("assistant")
    other = F.when(role == "user", F.lit("assistant")).otherwise(person)
    facts = base.withColumns({"problem": F.coalesce("problem", F.when(role.isNull(), "invalid_role")), "binding": F.lit("role"), "speaker_ref": speaker, "addressee_refs": F.array(other), "evidence": F.array(speaker)})
    facts = facts.withColumns({"speaker": speaker, "addressee": other})
    label = F.concat(F.lit("speaker="), "speaker", F.lit("; addressee="), "addressee", F.lit("; "), "text")
    return _shaped(facts, fact_id("speaker", text_key("text"), "refer_ids"), label)


def multi_party(proposed: DataFrame) -> DataFrame:
    """Facts of a group: the cited turns ground the speaker, the addressee is as proposed."""
    bound = _cited(_grounded(proposed), "speaker")
    addressee = F.coalesce(F.get(distinct_nonempty(F.col("addressees")), F.lit(0)), F.lit("unknown"))
    facts = bound.withColumns({"speaker": F.col("speaker_value"), "speaker_ref": F.col("speaker_value"), "addressee": addressee, "addressee_refs": F.array(addressee), "evidence": F.col("candidates")})
    return _shaped(facts, fact_id("speaker", text_key("text"), "refer_ids"), F.col("text"))


def audio(proposed: DataFrame) -> DataFrame:
    """Facts over recognised voices: stable ids ground speaker and addressees, names are only displayed."""
    bound = _cited(_grounded(proposed), "speaker_ref")
    heard = distinct_nonempty(F.transform("turns", lambda t: t["speaker_ref"]))
    others = F.array_remove(heard, F.coalesce("speaker_value", F.lit("")))
    refs = factops.bind_addressees(F.col("addressees"), others)
    shown = lambda ref: F.get(F.filter("turns", lambda t: t["speaker_ref"] == ref), F.lit(0))["speaker"]
    facts = bound.withColumns({"speaker_ref": F.col("speaker_value"), "addressee_refs": F.when(F.size("addressees") == 0, F.array(F.lit("unknown"))).otherwise(refs), "evidence": distinct_nonempty(F.transform("refer_ids", lambda r: _lookup(F.col("turns"), r, "speaker_ref")))})
    first = F.get("addressee_refs", F.lit(0))
    facts = facts.withColumns({"speaker": shown(F.col("speaker_ref")), "addressee": F.when(first.isin("unknown", "group"), first).otherwise(F.array_join(F.transform("addressee_refs", shown), ", "))})
    return _shaped(facts, fact_id("speaker_ref", text_key("text", fold=True), "refer_ids", "speaker_ref"), F.col("text"))


def _shaped(facts: DataFrame, node: Column, retrieval_text: Column) -> DataFrame:
    plain = F.col("problem").isNull()
    return facts.select(
        *KEYS, "item", "attempt", "problem", F.when(plain, node).alias("node_id"), "text", F.when(plain, retrieval_text).alias("retrieval_text"), "speaker", "speaker_ref", "binding", "addressee", "addressee_refs",
        "evidence", "context_operations", "refer_ids", "image_ids", "participants", "details",
    )


CONTRACTS = {"two_party": two_party, "multi_party": multi_party, "audio": audio}


def attempt_once(windows_left: DataFrame, make_extractor: Callable[[], Extractor], contract: str, attempt: int) -> DataFrame:
    """Checked proposals of one call per window; ``windows_left(case_id, session_id, start, turns, correction)``."""
    asked = windows_left.withColumn("message", F.concat(message(F.col("turns")), F.coalesce(F.concat(F.lit("\nYour previous output failed grounding validation: "), "correction", F.lit(". Regenerate the complete JSON for this same window.")), F.lit(""))))
    called = asked.lateralJoin(_table_function(make_extractor)(F.col("message").outer()))
    return CONTRACTS[contract](called.withColumn("attempt", F.lit(attempt)))


def extract(spark: SparkSession, held: DataFrame, make_extractor: Callable[[], Extractor], contract: str, location: str, fingerprint: str, attempts: int = ATTEMPTS, batches: int = BATCHES) -> DataFrame:
    """All proposals of all windows, those with a ``problem`` to be quarantined.

    ``held`` is :func:`windowed`.  Facts are the rows whose ``problem`` is null.  Every
    batch of windows is committed below ``location`` when it is done; batches found
    there are not asked again, and found under another ``fingerprint`` they stop the run.
    """
    if contract not in CONTRACTS:
        raise ContractViolation(f"unknown fact contract: {contract}")
    if not 1 <= attempts <= 8:
        raise ContractViolation("attempts must be between 1 and 8")
    _claim(spark, location, fingerprint)
    numbered = held.withColumn("batch", F.pmod(F.xxhash64(*KEYS), F.lit(batches)))
    for batch in range(batches):
        target = f"{location}/done/{batch}"
        if _exists(spark, f"{target}/_SUCCESS"):
            continue
        left = numbered.filter(F.col("batch") == batch).drop("batch").withColumn("correction", F.lit(None).cast("string"))
        clean = None
        for attempt in range(1, attempts + 1):
            rows = _written(attempt_once(left, make_extractor, contract, attempt), f"{location}/work/{uuid.uuid4().hex}")
            wrong = rows.filter("problem IS NOT NULL").groupBy(*KEYS).agg(F.min_by("problem", "item").alias("correction"))
            last = attempt == attempts or wrong.isEmpty()
            finished = rows if last else rows.join(wrong, KEYS, "left_anti")
            clean = finished if clean is None else clean.unionByName(finished)
            if last:
                break
            left = left.drop("correction").join(wrong, KEYS)
        # A batch that stopped half-way has no success mark and is written anew.
        clean.write.mode("overwrite").parquet(target)
    return spark.read.parquet(*[f"{location}/done/{batch}" for batch in range(batches)])


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _claim(spark: SparkSession, location: str, fingerprint: str) -> None:
    """Mark a location with the fingerprint of its results, or stop if it carries another."""
    path = f"{location}/fingerprint"
    if _exists(spark, f"{path}/_SUCCESS"):
        held = spark.read.text(path).first()[0]
        if held != fingerprint:
            raise ContractViolation(f"{location} holds windows of fingerprint {held}")
        return
    spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(path)
