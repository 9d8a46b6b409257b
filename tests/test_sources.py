import json
import uuid

import pytest
from pyspark.sql import functions as F

from colloquy.errors import ContractViolation
from colloquy.sources import cases, sinks
from colloquy.session import shared_dir


@pytest.fixture()
def folder(spark):
    return f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"


@pytest.fixture()
def case_file(tmp_path):
    doc = {
        "case_id": "G1",
        "session_dates": {"S1": "2024-01-01", "S2": {"date": "2024-01-02"}},
        "sessions": [{"session_id": "S1"}, {"session_id": "S2"}, {"session_id": "S3", "date": "2024-01-03"}],
        "dialogues": {
            "S1": [{"text": "hello", "speaker_name": "Ann"}, {"text": "look", "speaker_id": "P2", "image_ids": ["i1", "i2"], "image_captions": ["one"], "images": [{"id": "i3", "caption": "three"}], "audio_file": "a.wav"}],
            "S2": [{"turn_id": "S2_T001", "text": "yes", "ordinal": 7, "speaker_role": "guide"}],
            "S3": [{"turn_id": "S3_T001", "text": "re", "reply_to_turn_id": "S2_T001"}],
        },
        "qa": {"qa_pairs": [{"qa_id": "q1", "question_text": "who?", "evidence": ["S1:0"]}, {"qa_id": "q2", "query": "what?"}]},
    }
    (tmp_path / "g1.json").write_text(json.dumps(doc))
    return str(tmp_path)


def test_case_flattening(spark, case_file):
    raw = cases.flatten_turns(cases.scan_cases(spark, case_file))
    cases.check_turns(raw)
    got = {r.ref: r for r in raw.collect()}
    assert set(got) == {"S1:0", "S1:1", "S2_T001", "S3_T001"}
    assert got["S1:0"].speaker == "Ann" and got["S1:1"].speaker == "P2" and got["S2_T001"].speaker == "guide" and got["S3_T001"].speaker == "unknown"
    assert got["S1:1"].image_ids == ["i1", "i2", "i3"] and [i.caption for i in got["S1:1"].images] == ["one", None, "three"] and got["S1:1"].audio_ref == "a.wav"
    assert "image_id=i1; caption=one" in got["S1:1"].retrieval_text and got["S1:0"].retrieval_text == "hello"
    assert {r.session_id: r.date for r in got.values()} == {"S1": "2024-01-01", "S2": "2024-01-02", "S3": "2024-01-03"}
    assert got["S2_T001"].ordinal == 7 and got["S1:1"].ordinal == 2


def test_questions_and_id_translation(spark, case_file):
    c = cases.scan_cases(spark, case_file)
    qa = cases.questions(c)
    rows = {r.qa_id: (r.question, r.gold) for r in qa.collect()}
    assert rows == {"q1": ("who?", ["S1:0"]), "q2": ("what?", [])} and cases.question_view(qa).columns == ["case_id", "qa_id", "question"]
    raw = cases.flatten_turns(c)
    refs = qa.select("case_id", F.explode("gold").alias("ref"))
    assert cases.translate_ids(refs, raw).first().unified == "S1_T001"
    with pytest.raises(ContractViolation):
        cases.translate_ids(refs.withColumn("ref", F.lit("S9:9")), raw)


def test_sidecar_must_cover_both_sides(spark, case_file):
    raw = cases.flatten_turns(cases.scan_cases(spark, case_file))
    side = raw.select("case_id", "session_id", "source_turn_idx", F.lit("SPK_A").alias("stable_id"), F.lit("Ann").alias("display"), F.lit("ac1").alias("acoustic_id"))
    assert cases.join_sidecar(raw, side).filter("speaker_ref = 'SPK_A'").count() == 4
    for bad in (side.filter("session_id <> 'S2'"), side.union(side.limit(1)), side.union(side.limit(1).withColumn("session_id", F.lit("S8")))):
        with pytest.raises(ContractViolation):
            cases.join_sidecar(raw, bad)


def test_registry_audit(spark):
    good = spark.createDataFrame([("a", [1.0, 0.0], 3, 1), ("b", [0.0, 1.0], 2, 0)], "speaker_id string, prototype array<double>, assigned_turns int, updates int")
    cases.check_registry(good, 5)
    for bad, n in ((good, 6), (good.withColumn("prototype", F.array(F.lit(0.0), F.lit(0.0))), 5), (good.withColumn("speaker_id", F.lit("a")), 5)):
        with pytest.raises(ContractViolation):
            cases.check_registry(bad, n)


def test_write_once_and_resume(spark, folder):
    done = spark.createDataFrame([(1,)], "id int")
    sinks.require_new(spark, folder)
    sinks.write_once(done, folder)
    with pytest.raises(Exception):
        sinks.write_once(done, folder)
    with pytest.raises(ContractViolation):
        sinks.require_new(spark, folder)
    left = sinks.pending(spark.createDataFrame([(1,), (2,)], "id int"), sinks.read_or_empty(spark, folder, "id int"), ["id"])
    assert [r.id for r in left.collect()] == [2]
    assert sinks.read_or_empty(spark, folder + "-none", "id int").count() == 0


def test_equal_messages_are_called_once_and_failures_stay_open(spark):
    def client():
        def call(text):
            if text == "bad":
                raise RuntimeError("down")
            return text.upper()

        return call

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "old")], "id int, message string")
    key = lambda m: F.sha2(F.concat_ws("\x01", F.lit(""), F.lit(m)), 256)
    cache = spark.range(1).select(key("old").alias("contract_sha256"), F.lit("kept").alias("response"))
    answered, fresh = sinks.cached_calls(rows, cache, "message", client)
    assert {r.id: r.response for r in answered.collect()} == {1: "A", 2: "A", 3: None, 4: "kept"} and fresh.count() == 1
    scores = sinks.judge_scores(spark.createDataFrame([('{"score": 0.5}',), ('{"score": 7}',), ("x",)], "response string")).collect()
    assert [r.score for r in scores] == [0.5, None, None]


def test_event_cards_round_trip(spark):
    rows = [(f"fact:{i:016x}", f"t{i}", f"speaker; t{i}", "a", "b", [f"D{i % 2}:{i}"], ["coreference"]) for i in range(4)]
    f = spark.createDataFrame(rows, "node_id string, text string, retrieval_text string, speaker string, addressee string, refer_ids array<string>, context_operations array<string>")
    cards = sinks.event_cards(f, "case", "full")
    assert sorted((r.session_id, r.event_id) for r in cards.collect()) == [("D0", "CF0001"), ("D0", "CF0002"), ("D1", "CF0001"), ("D1", "CF0002")]
    assert sinks.read_event_cards(cards).count() == 4
    with pytest.raises(ContractViolation):
        sinks.event_cards(f.withColumn("refer_ids", F.array(F.lit("D1:1"), F.lit("D2:1"))), "case", "full")


def test_cached_calls_ask_once_per_message(spark, tmp_path):
    from colloquy.sources.sinks import cached_calls

    log = str(tmp_path / "calls")

    def client():
        def ask(text):
            with open(log, "a") as out:
                out.write(text + "\n")
            return text.upper()

        return ask

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, message string")
    cache = spark.createDataFrame([], "contract_sha256 string, response string")
    answered, fresh = cached_calls(rows, cache, "message", client)
    assert sorted((r.id, r.response) for r in answered.collect()) == [(1, "A"), (2, "B"), (3, "A")]
    assert fresh.count() == 2 and answered.count() == 3
    with open(log) as made:
        assert sorted(made.read().split()) == ["a", "b"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from colloquy.streaming.jobs import drain

    source, place = str(tmp_path / "in"), str(tmp_path / "run")
    for part in ([1, 2], [3]):
        spark.createDataFrame([(i,) for i in part], "i int").write.mode("append").parquet(source)
        out = drain(spark.readStream.schema("i int").parquet(source), place)
    assert sorted(r.i for r in out.collect()) == [1, 2, 3]


def test_every_rank_without_a_limit(spark):
    from pyspark.sql import functions as F

    from colloquy.operators.ranking import top_k

    ranked = top_k(spark.range(100).withColumn("k", F.col("id") % 2), ["k"], [F.col("id").desc()], None)
    assert ranked.count() == 100 and dict(ranked.dtypes)["rank"] == "bigint" and ranked.agg(F.max("rank")).first()[0] == 50
