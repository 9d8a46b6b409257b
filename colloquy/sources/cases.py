"""Dialogue case files: typed scan, flattening, media, questions, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.errors import ContractViolation
from colloquy.functions.dates import unified_turn_id
from colloquy.operators.audits import require_empty
from colloquy.schema import CASE_JSON, QA_JSON


def scan_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case file; a file that breaks the schema stops the job."""
    return spark.read.schema(CASE_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("source_file", F.input_file_name())


def session_dates(cases: DataFrame) -> DataFrame:
    """``(case_id, session_id, date)``; dates are strings or ``{"date": ...}``, else the session row."""
    mapped = cases.select("case_id", F.explode("session_dates").alias("session_id", "v"))
    value = F.coalesce(F.get_json_object("v", "$.date"), F.when(~F.trim("v").startswith("{"), F.col("v")))
    listed = cases.select("case_id", F.explode("sessions").alias("s")).select("case_id", "s.session_id", F.col("s.date").alias("fallback"))
    out = mapped.select("case_id", "session_id", value.alias("date")).join(listed, ["case_id", "session_id"], "full_outer")
    return out.select("case_id", "session_id", F.coalesce("date", "fallback", F.lit("")).alias("date"))


def _media(t: Column) -> Column:
    """``struct(image_ids, images, audio_ref)`` from scalar, list and object fields."""
    none = F.array().cast("array<string>")
    listed = F.coalesce(t["image_ids"], F.when(t["image_id"].isNotNull(), F.array(t["image_id"])), none)
    plain = F.filter(F.transform(listed, lambda i: F.trim(i)), lambda i: i != "")
    as_map = F.from_json(t["image_captions"], "MAP<STRING, STRING>")
    as_list = F.coalesce(F.from_json(t["image_captions"], "ARRAY<STRING>"), F.when(t["image_caption"].isNotNull(), F.array(t["image_caption"])), none)
    image_type = "array<struct<image_id:string,caption:string,path:string>>"
    objects = F.coalesce(t["images"], F.array().cast("array<struct<image_id:string,id:string,caption:string,path:string>>"))
    named = F.transform(objects, lambda o: F.struct(F.trim(F.coalesce(F.nullif(o["image_id"], F.lit("")), o["id"], F.lit(""))).alias("image_id"), o["caption"].alias("caption"), o["path"].alias("path")))
    named = F.filter(named, lambda o: o["image_id"] != "")
    ids = F.array_distinct(F.concat(plain, F.transform(named, lambda o: o["image_id"])))

    def card(i: Column) -> Column:
        own = F.get(F.filter(named, lambda o: o["image_id"] == i), F.lit(0))
        place = F.array_position(plain, i)
        caption = F.coalesce(own["caption"], as_map[i], F.when(place > 0, F.get(as_list, (place - 1).cast("int"))))
        return F.struct(i.alias("image_id"), caption.alias("caption"), own["path"].alias("path"))

    audio = F.coalesce(*[F.nullif(F.trim(t[c]), F.lit("")) for c in ("audio_ref", "audio_path", "audio_file")])
    return F.struct(ids.alias("image_ids"), F.transform(ids, card).cast(image_type).alias("images"), audio.alias("audio_ref"))


def flatten_turns(cases: DataFrame, legacy_ids: bool = True) -> DataFrame:
    """Raw nodes in load order; missing turn ids are made from session and offset."""
    sessions = cases.select("case_id", F.explode("dialogues").alias("session_id", "turns"))
    t = sessions.select("case_id", "session_id", F.posexplode("turns").alias("turn_idx", "t"))
    made = F.concat_ws(":", "session_id", F.col("turn_idx").cast("string")) if legacy_ids else unified_turn_id("session_id", "turn_idx")
    ref = F.coalesce(F.nullif(F.col("t.turn_id"), F.lit("")), made)
    who = F.coalesce(*[F.nullif(F.col(f"t.{c}"), F.lit("")) for c in ("speaker_name", "speaker_id", "speaker_role")], F.lit("unknown"))
    m = _media(F.col("t"))
    raw = t.select(
        "case_id", F.concat(F.lit("raw:"), ref).alias("node_id"), F.lit("raw").alias("layer"), ref.alias("ref"), F.coalesce("t.text", F.lit("")).alias("text"),
        who.alias("speaker"), F.coalesce("t.speaker_id", who).alias("speaker_ref"), "session_id", F.col("turn_idx").alias("source_turn_idx"),
        F.coalesce(F.nullif("t.ordinal", F.lit(0)), F.col("turn_idx") + 1).alias("ordinal"), F.col("t.timestamp").alias("timestamp"),
        F.col("t.reply_to_turn_id").alias("reply_to"), F.array(ref).alias("refer_ids"), m.alias("_m"),
    ).select("*", "_m.image_ids", "_m.images", "_m.audio_ref").drop("_m")
    dated = raw.join(session_dates(cases), ["case_id", "session_id"], "left").fillna({"date": ""})
    line = F.transform("images", lambda i: F.concat(F.lit("image_id="), i["image_id"], F.lit("; caption="), F.coalesce(i["caption"], F.lit(""))))
    captioned = F.exists("images", lambda i: i["caption"].isNotNull())
    return dated.withColumn("retrieval_text", F.when(captioned, F.concat_ws("\n", "text", F.array_join(line, "\n"))).otherwise(F.col("text")))


def check_turns(raw: DataFrame) -> None:
    """Turn ids are unique per case and every reply closes."""
    require_empty(raw.groupBy("case_id", "ref").count().filter("count > 1"), "duplicate turn id")
    targets = raw.select("case_id", F.col("ref").alias("reply_to"))
    require_empty(raw.filter("reply_to IS NOT NULL").join(targets, ["case_id", "reply_to"], "left_anti").select("case_id", "ref", "reply_to"), "reply to unknown turn")


def questions(cases: DataFrame) -> DataFrame:
    """``(case_id, pos, qa_id, question, answer, gold)`` from either place and any evidence field."""
    wrapped = F.from_json(F.get_json_object("qa", "$.qa_pairs"), QA_JSON)
    rows = F.coalesce(F.when(F.col("qa").startswith("["), F.from_json("qa", QA_JSON)), wrapped, F.from_json("qa_pairs", QA_JSON))
    q = cases.select("case_id", F.posexplode(rows).alias("pos", "q"))
    text = F.coalesce(*[F.nullif(F.col(f"q.{c}"), F.lit("")) for c in ("question", "question_text", "query")], F.lit(""))
    gold = F.coalesce("q.evidence_ids", "q.evidence", "q.gold_evidence_ids", "q.gold_evidence", F.array().cast("array<string>"))
    return q.select("case_id", "pos", "q.qa_id", text.alias("question"), "q.answer", gold.alias("gold"), "q.fine_category", "q.four_way_category")


def question_view(qa: DataFrame) -> DataFrame:
    """What retrieval may see of a question."""
    return qa.select("case_id", "qa_id", "question")


def translate_ids(refs: DataFrame, raw: DataFrame) -> DataFrame:
    """Legacy ``S:offset`` references in the unified grammar; an unknown one is an error."""
    ids = raw.select("case_id", F.concat_ws(":", "session_id", F.col("source_turn_idx").cast("string")).alias("ref"), unified_turn_id("session_id", "source_turn_idx").alias("unified"))
    joined = refs.join(ids, ["case_id", "ref"], "left")
    require_empty(joined.filter("unified IS NULL"), "reference does not close to a turn")
    return joined


def join_sidecar(raw: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Predicted speakers on turns; both sides must cover the same coordinates.

    ``sidecar(case_id, session_id, source_turn_idx, stable_id, display, acoustic_id)``.
    """
    keys = ["case_id", "session_id", "source_turn_idx"]
    require_empty(sidecar.groupBy(*keys).count().filter("count > 1"), "duplicate sidecar coordinate")
    require_empty(raw.select(*keys).join(sidecar, keys, "left_anti"), "turn without sidecar row")
    require_empty(sidecar.select(*keys).join(raw, keys, "left_anti"), "sidecar row without turn")
    return raw.drop("speaker", "speaker_ref").join(sidecar.withColumnsRenamed({"stable_id": "speaker_ref", "display": "speaker"}), keys)


def check_registry(prototypes: DataFrame, n_turns: int) -> None:
    """Prototypes are finite, of one length and non-zero, and account for every turn."""
    square = F.aggregate("prototype", F.lit(0.0), lambda s, v: s + v * v)
    broken = square.isNull() | F.isnan(square) | (square <= 0) | (F.col("assigned_turns") < 1) | (F.col("updates") < 0)
    require_empty(prototypes.filter(broken), "invalid prototype")
    row = prototypes.agg(F.countDistinct(F.size("prototype")).alias("d"), F.countDistinct("speaker_id").alias("s"), F.count("*").alias("n"), F.sum("assigned_turns").alias("t")).first()
    if row["d"] != 1 or row["s"] != row["n"] or row["t"] != n_turns:
        raise ContractViolation(f"registry does not add up: {row.asDict()} for {n_turns} turns")
