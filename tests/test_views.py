import pytest

from colloquy.operators import views, visual


def test_identity_tier_contract(spark):
    ok = spark.createDataFrame([("P1", "high"), (None, None), ("", "unresolved")], "ref string, tier string")
    assert [r.t for r in ok.select(views.identity_tier("ref", "tier").alias("t")).collect()] == ["high", "unresolved", "unresolved"]
    for bad in (("P1", "sure"), (" ", "low")):
        with pytest.raises(Exception, match="identity"):
            spark.createDataFrame([bad], "ref string, tier string").select(views.identity_tier("ref", "tier")).collect()


def test_allowed_and_layers(spark):
    rows = spark.createDataFrame([("a", "visual_set"), ("b", None), ("c", "event")], "id string, fact_kind string")
    none = spark.createDataFrame([], "id string")
    assert views.allowed_only(rows, none, "id").count() == 3
    assert views.allowed_only(rows, spark.createDataFrame([("b",), ("z",)], "id string"), "id").count() == 1
    assert [r.id for r in views.layer_eligible(rows, True).collect()] == ["a"]
    assert sorted(r.id for r in views.layer_eligible(rows, False).collect()) == ["b", "c"]


def test_visibility_and_images(spark):
    rows = spark.createDataFrame([(None, "Fact:1"), ("RAW", "fact:1"), (None, "S1_T001"), ("collection", "S1"), (None, None)], "layer string, id string")
    assert [r.v for r in rows.select(views.answer_visible_raw("layer", "id").alias("v")).collect()] == [False, True, True, False, True]
    images = spark.createDataFrame([("S1", "a.png"), ("S1", "S2/b.png"), ("S1", None), ("S1", "")], "s string, v string")
    assert [r.p for r in images.select(views.question_image("s", "v").alias("p")).collect()] == ["scenes/S1/image/a.png", "scenes/S2/image/b.png", None, None]


def test_rendered_evidence_is_shortened(spark):
    schema = "q int, rank int, node_id string, speaker string, date string, refer_ids array<string>, image_ids array<string>, text string, caption string"
    rows = spark.createDataFrame([(1, i, f"n{i}", None, None, [f"r{k}" for k in range(12)], None, "x\n" * 600, None) for i in range(1, 70)], schema)
    lines = views.compact_evidence(rows, "q").first()["evidence"].split("\n")
    assert len(lines) == views.EVIDENCE_ROWS
    assert lines[0].startswith("[1] id=n1; speaker=unknown; date=; refer_ids=['r0', 'r1', 'r2', 'r3', 'r4', 'r5', 'r6', 'r7']; image_ids=[]; text=x x ")
    assert len(lines[0].split("text=")[1].split("; captions=")[0]) == views.TEXT_CHARS


def test_set_range_crosses_blocks(spark):
    sets = spark.createDataFrame([("s", 1, "set", 60, 200), ("s", 2, "none", 500, 501)], "session_id string, set_id int, text string, low bigint, high bigint")
    facts = spark.createDataFrame([("s", i, f"f{i % 3}", [i, i + 1]) for i in range(0, 300, 50)], "session_id string, place int, text string, turns array<int>")
    got = {r.set_id: r.retrieval_text for r in visual.with_nearby_facts(sets, facts).collect()}
    assert got == {1: "set f1 f0 f2", 2: "none "}


def test_image_known_from_facts_alone(spark):
    images = spark.createDataFrame([("i1", "m2", 2, "cap", "text", "d"), ("i1", "m1", 1, "cap", "", None)], "image_id string, mem_id string, place int, caption string, text string, date string")
    cited = spark.createDataFrame([("i2", 1, "fact")], "image_id string, place int, fact string")
    got = {r.image_id: r for r in visual.visual_cards(images, cited).collect()}
    assert got["i1"].text == "image_id=i1. cap text" and got["i1"].mem_ids == ["m1", "m2"] and got["i1"].dates == ["d"]
    assert got["i2"].text == "image_id=i2. fact" and got["i2"].mem_ids == []


def test_records_keep_first_places(spark):
    schema = "q int, rank int, node_id string, text string, speaker string, speaker_ref string, addressee string, session_id string, ordinal int, date string, reply_to string, refer_ids array<string>"
    row = lambda rank, refs: (1, rank, f"n{rank}", "t", "s", "S", None, "S1", rank, None, None, refs)
    r = views.context_records(spark.createDataFrame([row(2, ["b", "a"]), row(1, ["c", "b"])], schema), "q").first()
    assert r.context_node_ids == ["n1", "n2"] and r.retrieved_refer_ids == ["c", "b", "a"] and r.n_context == 2


def test_refs_backfill_keeps_order(spark):
    facts = spark.createDataFrame([("f1", None), ("f2", ["x"]), ("f3", [])], "node_id string, refer_ids array<string>")
    edges = spark.createDataFrame([("f1", 1, "b"), ("f1", 0, "a"), ("f2", 0, "y")], "node_id string, pos int, ref string")
    got = {r.node_id: r.refer_ids for r in views.refs_backfilled(facts, edges).collect()}
    assert got == {"f1": ["a", "b"], "f2": ["x"], "f3": []}
