"""Executor: collections that stand for what they cite, media edges, and questions asked by their own image."""

from dataclasses import replace

import pytest

from colloquy.config import GALLERY, MULTI_PARTY
from colloquy.errors import ContractViolation
from colloquy.plans import executor
from colloquy.plans.executor import Memory, execute
from colloquy.plans.routes import validated_plan
from colloquy.sources.encoders import hashed_vectors

RAW = [("a1", "we saw a heron", "A", 1), ("a2", "nice", "A", 2), ("a3", "at the lake", "A", 3), ("a4", "bye", "A", 4), ("b1", "bread rises", "B", 1), ("b2", "with yeast", "B", 2)]


@pytest.fixture(scope="module")
def memory(spark):
    raw = spark.createDataFrame([(*r, "2024-01-01") for r in RAW], "ref string, text string, session_id string, ordinal int, date string")
    facts = spark.createDataFrame([("f1", "a heron at the lake", "A", ["a1"]), ("f2", "yeast makes bread rise", "B", ["b1"])], "node_id string, text string, collection_id string, refer_ids array<string>")
    vectors = hashed_vectors(spark.createDataFrame([("A", "heron lake"), ("B", "bread yeast")], "node_id string, text string"), "node_id", "text")
    dates = spark.createDataFrame([("A", "2024-01-01"), ("B", "2024-01-01")], "node_id string, date string")
    images = spark.createDataFrame([("a4", [1.0, 0.0]), ("b2", [0.0, 1.0])], "ref string, vec array<double>")
    return Memory(raw, facts, vectors, dates, hashed_vectors, images=images)


def context(spark, memory, routes, profile, question="the heron at the lake"):
    asked = spark.createDataFrame([(1, question, False, '{"rewritten_query":"' + question + '","routes":[' + routes + "]}")], "query_id bigint, question string, has_image boolean, model_output string")
    rows = execute(validated_plan(asked).select("query_id", "plan"), memory, profile).orderBy("slot").collect()
    return [r.node_id for r in rows]


def test_gallery_promotes_what_a_collection_cites(spark, memory):
    refs = spark.createDataFrame([("A", 0, "a3"), ("A", 1, "gone"), ("A", 2, "a1"), ("A", 3, "a3"), ("B", 0, "b1")], "node_id string, pos int, ref string")
    got = context(spark, replace(memory, collection_refs=refs), '{"layer":"collection","retrievers":["bm25"]}', GALLERY)
    assert got[:3] == ["collection:A", "a3", "a1"] and "gone" not in got and len(got) == len(set(got))
    # Members of the best facts instead: the heron turn and its neighbour.
    assert context(spark, memory, '{"layer":"collection","retrievers":["bm25"]}', MULTI_PARTY)[:3] == ["collection:A", "a1", "a2"]


def test_gallery_needs_collection_references(spark, memory):
    with pytest.raises(ContractViolation, match="collection references"):
        context(spark, memory, '{"layer":"collection","retrievers":["bm25"]}', GALLERY)


def test_media_edges_lead_to_the_turns_that_show_an_image(spark, memory):
    plan = '{"layer":"fact","retrievers":["bm25"]}'
    assert "b2" not in context(spark, memory, plan, MULTI_PARTY)
    media = spark.createDataFrame([("f1", "b2")], "node_id string, ref string")
    assert context(spark, replace(memory, media=media), plan, MULTI_PARTY)[:2] == ["a1", "b2"]


def test_image_requests_use_the_question_image(spark, memory):
    plan = '{"layer":"raw","retrievers":["image"]}'
    shown = replace(memory, question_images=spark.createDataFrame([(1, [0.0, 1.0])], "query_id bigint, vec array<double>"), encode=_two_numbers(spark))
    assert context(spark, shown, plan, MULTI_PARTY)[0] == "b2"
    assert context(spark, replace(shown, question_images=shown.question_images.limit(0)), plan, MULTI_PARTY)[0] == "a4"


def test_rounds_ask_the_corpus_for_new_requests_only(spark, memory, monkeypatch):
    """The second round repeats one request, for another question, and adds one."""
    asked, plain = [], executor.ranked_requests
    monkeypatch.setattr(executor, "ranked_requests", lambda work, *rest: (asked.append({(r.layer, r.retriever, r.text) for r in work.collect()}), plain(work, *rest))[1])

    def plans(*rows):
        made = [(i, q, False, '{"rewritten_query":"' + q + '","routes":[' + routes + "]}") for i, q, routes in rows]
        return validated_plan(spark.createDataFrame(made, "query_id bigint, question string, has_image boolean, model_output string")).select("query_id", "plan")

    words, facts = '{"layer":"raw","retrievers":["bm25"]}', '{"layer":"fact","retrievers":["bm25"]}'
    rounds = [plans((1, "heron", words), (2, "zebra", words)), plans((2, "heron", words), (1, "zebra", words), (3, "yeast", facts))]
    answered = executor.Answered()
    got = [sorted(map(tuple, execute(p, memory, answered=answered).collect())) for p in rounds]
    first, second = asked
    assert {t for _, _, t in first} == {"heron", "zebra"} and {t for _, _, t in second} == {"yeast"}
    assert got == [sorted(map(tuple, execute(p, memory).collect())) for p in rounds]


def _two_numbers(spark):
    """Encoder of the image space that puts every text at the first axis."""
    from pyspark.sql import functions as F

    return lambda df, node, text: df.select(node, F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
