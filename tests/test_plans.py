import pytest
from pyspark.sql import functions as F

from colloquy.plans import routes as R


def plan(spark, question, output, image=False, unified=False):
    df = spark.createDataFrame([(1, question, image, output)], "query_id int, question string, has_image boolean, model_output string")
    out = R.validated_plan(df)
    return (R.unified_contract(out) if unified else out).first()


def shape(p):
    return [(r.layer, list(r.retrievers)) for r in p.routes]


@pytest.mark.parametrize(
    "question,image,intent",
    [("How many images show a cat?", False, "VISUAL_COLLECTION"), ("what is this", True, "VISUAL_SINGLE"), ("Who won?", False, "TEXT_FACT"), ("how many people came", False, "TEXT_FACT")],
)
def test_heuristic_gate(spark, question, image, intent):
    row = spark.range(1).select(R.heuristic_gate(F.lit(question), F.lit(image)).alias("p")).first().p
    assert row.intent == intent and row.sort_by == "score"


def test_keyword_gate_time_and_date(spark):
    row = spark.range(1).select(R.keyword_gate(F.lit("What happened first on 2024-05-06?"), F.lit(False)).alias("p")).first().p
    assert (row.intent, row.sort_by, row.time_range) == ("TEMPORAL", "time", "2024-05-06")
    assert shape(row) == [("raw", ["dense", "bm25"]), ("fact", ["dense", "bm25"])]


def test_fixed_intent_plan_falls_back(spark):
    get = lambda raw: spark.range(1).select(R.fixed_intent_plan(F.lit("q"), F.lit(raw)).alias("p")).first().p
    assert get('```json\n{"intent":"event_scoped"}\n```').intent == "EVENT_SCOPED" and get("nonsense").intent == "TEXT_FACT"
    assert get('{"intent":"TEMPORAL"}').sort_by == "time"


def test_caps_merges_and_layer_matrix(spark):
    raw = '{"routes":[{"layer":"FACT","retrievers":["DENSE","image","bm25"]},{"layer":"raw","retrievers":["bm25","bm25"],"query":"x"},{"layer":"raw","retrievers":["caption"]},{"layer":"collection","retrievers":["dense"]},{"layer":"raw","retrievers":["dense"]}]}'
    p = plan(spark, "q", raw).plan
    assert shape(p) == [("fact", ["dense", "bm25"]), ("raw", ["bm25", "caption"])] and p.routes[1].query == "x" and p.routes[0].query == "q"


@pytest.mark.parametrize("raw", ["not json", '{"routes":null}', '{"routes":[]}', '{"routes":[{"layer":"raw"}]}', '{"routes":"raw"}'])
def test_raw_fallback(spark, raw):
    assert shape(plan(spark, "q", raw).plan) == [("raw", ["dense", "bm25"])]


def test_safety_contracts(spark):
    fact = '{"routes":[{"layer":"fact","retrievers":["dense"]},{"layer":"collection","retrievers":["dense"]}]'
    timed = plan(spark, "q", fact + ',"sort_by":"TIME"}').plan
    assert shape(timed) == [("fact", ["dense"]), ("raw", ["dense", "bm25"])] and timed.sort_by == "time"
    seen = plan(spark, "q", '{"routes":[{"layer":"fact","retrievers":["dense"]}]}', image=True).plan
    assert shape(seen) == [("fact", ["dense"]), ("raw", ["image", "caption"])]
    wanted = plan(spark, "q", fact + ',"needs_visual_memory":"True"}').plan
    assert shape(wanted)[1] == ("collection", ["dense", "image", "caption"])
    event = plan(spark, "q", '{"routes":[{"layer":"raw","retrievers":["dense"]}],"needs_event_scope":true}').plan
    assert shape(event)[1] == ("collection", ["dense", "bm25"])


def test_unified_contract_adds_floor(spark):
    row = plan(spark, "q", '{"rewritten_query":"other","routes":[{"layer":"collection","retrievers":["image"]}],"needs_visual_memory":true,"needs_event_scope":true}', unified=True)
    assert shape(row.plan) == [("collection", ["image", "caption", "dense", "bm25"]), ("fact", ["dense", "bm25"]), ("raw", ["dense", "bm25"])]
    assert row.plan.routes[2].query == "q" and row.plan.strategy == "unified_hybrid_route"
    same = plan(spark, "q ", '{"routes":[{"layer":"raw","retrievers":["image"],"query":" q"}]}', unified=True).plan
    assert shape(same) == [("raw", ["image", "dense", "bm25"])]


def test_refinement_decisions(spark):
    df = spark.createDataFrame(
        [(1, "q", False, "broken"), (2, "q", False, '{"sufficient":"TRUE","supporting_memory_ids":["a","b"],"missing_evidence":"gap"}'), (3, "q", False, '{"sufficient":false,"routes":[]}')],
        "query_id int, question string, has_image boolean, model_output string",
    )
    rows = {r.query_id: r for r in R.refinement(df).collect()}
    assert rows[1].sufficient and rows[1].stop_reason == "refinement_parse_failed" and rows[1].plan is None
    assert rows[2].sufficient and rows[2].supporting_memory_ids == ["a", "b"] and rows[2].missing_evidence == ["gap"]
    assert not rows[3].sufficient and shape(rows[3].plan) == [("raw", ["dense", "bm25"])]


def test_bundle_gate_reasons(spark):
    mk = lambda subs, event, time: F.struct(F.array(*[F.lit(s) for s in subs]).cast("array<string>").alias("sub_questions"), F.lit(event).alias("model_needs_event_scope"), F.lit(time).alias("model_needs_temporal_reasoning"))
    get = lambda c: tuple(spark.range(1).select(c.alias("g")).first().g)
    assert get(R.bundle_gate(mk("ab", True, False))) == (True, "model_cross_turn_decomposition")
    assert get(R.bundle_gate(mk("ab", True, True))) == (False, "global_temporal_order_preserved")
    assert get(R.bundle_gate(mk("a", True, False))) == (False, "model_gate_rejected")
    assert get(R.bundle_gate(mk("a", True, False), soft=False)) == (False, "disabled") and get(R.bundle_gate(mk("a", True, False), always=True))[1] == "global_v1"
