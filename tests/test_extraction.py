"""Window facts: grounding under each contract, quarantine, resume and fingerprints."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

import oracle
from colloquy.errors import ContractViolation
from colloquy.operators import extraction

TURNS = "case_id string, session_id string, ordinal int, ref string, speaker string, speaker_ref string, text string, images array<struct<id: string, caption: string>>"


def turns(spark, names=("Ann", "Bo", "Ann"), sessions=("S1",)):
    rows = [
        ("C1", s, i + 1, f"{s}_T{i + 1:03d}", name, f"V{ord(name[0])}", f"text {i}", [("img1", "a dog"), ("img2", None)] if i == 0 else [])
        for s in sessions for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, TURNS)


def answering(facts):
    def make():
        return lambda message: facts(message) if callable(facts) else {"facts": facts}

    return make


def once(spark, contract, facts, **more):
    held = extraction.windowed(turns(spark, **more), size=3, stride=3).withColumn("correction", F.lit(None).cast("string"))
    return {r.item: r for r in extraction.attempt_once(held, answering(facts), contract, 1).collect()}


def test_message_names_speakers_turns_and_images(spark):
    text = extraction.windowed(turns(spark), size=3, stride=3).select(extraction.message(F.col("turns"))).first()[0]
    assert text == (
        "- V65: Ann\n- V66: Bo\n\n[S1_T001|speaker_ref=V65] Ann: text 0\n  [image_id=img1; caption=a dog]\n  [image_id=img2; caption=unknown]\n"
        "[S1_T002|speaker_ref=V66] Bo: text 1\n[S1_T003|speaker_ref=V65] Ann: text 2"
    )


def test_audio_facts_bind_to_stable_ids(spark):
    got = once(spark, "audio", [
        {"text": " Ann  likes dogs ", "refer_ids": ["S1_T001", "S1_T003", "S1_T001"], "speaker_ref": "anybody", "addressee_refs": ["@v66", "V65"], "image_ids": ["img1"], "subject": "Ann"},
        {"text": "Both agree", "refer_ids": ["S1_T001", "S1_T002"], "source_speaker_ref": " @V66", "addressee_refs": ["nobody", "Everyone"]},
        {"text": "Who?", "refer_ids": ["S1_T001", "S1_T002"], "source_speaker_ref": "V77"},
        {"text": "No such image", "refer_ids": "S1_T002", "image_ids": "img9"},
        {"text": "", "refer_ids": ["S1_T002"]},
        {"text": "Elsewhere", "refer_ids": ["S1_T002", "S2_T001"]},
    ])
    assert (got[0].speaker, got[0].speaker_ref, got[0].binding, got[0].addressee, got[0].addressee_refs, got[0].text) == ("Ann", "V65", "single_cited_speaker", "Bo", ["V66"], "Ann likes dogs")
    assert got[0].refer_ids == ["S1_T001", "S1_T003"] and got[0].context_operations == ["multi_turn_synthesis"] and got[0].details == {"subject": "Ann"}
    assert (got[1].speaker_ref, got[1].binding, got[1].addressee, got[1].evidence) == ("V66", "model_grounded_multi_speaker", "group", ["V65", "V66"])
    assert [got[i].problem for i in range(6)] == [None, None, "not_a_cited_speaker", "invalid_image_ids", "empty_text", "invalid_refer_ids"]
    assert got[0].node_id.startswith("fact:") and got[2].node_id is None


def test_multi_party_keeps_the_proposed_addressee(spark):
    got = once(spark, "multi_party", [{"text": "Hi", "refer_ids": ["S1_T002"], "speaker": "x", "addressee": " Cy "}, {"text": "Ho", "refer_ids": ["S1_T002"], "context_operations": "guessing"}])
    assert (got[0].speaker, got[0].addressee, got[0].retrieval_text, got[0].context_operations) == ("Bo", "Cy", "Hi", [])
    assert got[1].problem == "unknown_operation"


def test_two_party_roles(spark):
    got = once(spark, "two_party", [{"text": "Hi", "refer_ids": ["S1_T001"], "source_role": "Human"}, {"text": "Yo", "refer_ids": ["S1_T002"], "source_role": "agent"}, {"text": "Um", "refer_ids": ["S1_T002"], "source_role": "narrator"}], names=("user", "assistant"))
    assert [(got[i].speaker, got[i].addressee) for i in (0, 1)] == [("V117", "assistant"), ("assistant", "V117")]
    assert got[0].retrieval_text == "speaker=V117; addressee=assistant; Hi" and got[2].problem == "invalid_role"


@pytest.mark.parametrize("answer, reason", [({"facts": []}, "no facts"), ({"facts": "x"}, "list of objects"), ([], "list of objects"), ({"facts": [1]}, "list of objects")])
def test_unusable_answers_are_one_quarantined_row(spark, answer, reason):
    got = once(spark, "audio", lambda message: answer)
    assert list(got) == [-1] and reason in got[-1].problem and got[-1].problem.startswith("extraction_failed")


def counted(folder, good_after=1):
    """Extractor that leaves a file per call; a window is clean from its ``good_after``-th call on."""

    def make():
        def answer(message):
            ref = message.split("[", 1)[1].split("|")[0]
            with open(os.path.join(folder, f"{ref}-{uuid.uuid4().hex}"), "w"):
                pass
            calls = sum(f.startswith(ref + "-") for f in os.listdir(folder))
            return {"facts": [{"text": ref, "refer_ids": [ref if calls >= good_after else "none"]}]}

        return answer

    return make


def run(spark, folder, calls, fingerprint="one", good_after=1, attempts=3, batches=3):
    held = extraction.windowed(turns(spark, sessions=[f"S{i}" for i in range(6)]), size=3, stride=3)
    return extraction.extract(spark, held, counted(calls, good_after), "audio", folder, fingerprint, attempts=attempts, batches=batches)


def test_only_unclean_windows_are_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = run(spark, str(tmp_path / "out"), str(calls), good_after=2).collect()
    assert len(rows) == 6 and {(r.attempt, r.problem) for r in rows} == {(2, None)}
    assert len(os.listdir(calls)) == 12


def test_quarantine_after_the_last_attempt(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = run(spark, str(tmp_path / "out"), str(calls), good_after=9, attempts=2).collect()
    assert {(r.attempt, r.problem, r.node_id) for r in rows} == {(2, "invalid_refer_ids", None)} and len(os.listdir(calls)) == 12


def test_killed_run_goes_on_after_its_last_batch(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    target, plain, begun = str(tmp_path / "out"), extraction.attempt_once, []

    def dying(*args):
        begun.append(1)
        if len(begun) == 3:
            raise KeyboardInterrupt
        return plain(*args)

    monkeypatch.setattr(extraction, "attempt_once", dying)
    with pytest.raises(KeyboardInterrupt):
        run(spark, target, str(calls))
    monkeypatch.setattr(extraction, "attempt_once", plain)
    before = len(os.listdir(calls))
    rows = run(spark, target, str(calls)).collect()
    assert 0 < before < 6 and len(rows) == 6 and len(os.listdir(calls)) == 6
    # Everything is there: nothing is asked again.
    assert len(run(spark, target, str(calls)).collect()) == 6 and len(os.listdir(calls)) == 6


def test_other_fingerprint_is_refused(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    run(spark, str(tmp_path / "out"), str(calls))
    with pytest.raises(ContractViolation, match="fingerprint"):
        run(spark, str(tmp_path / "out"), str(calls), fingerprint="two")


def test_query(spark, small):
    got = oracle.compare(spark, "window_facts", small)
    assert got["match"], got
