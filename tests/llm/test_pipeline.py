from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from colloquy.llm import quality
from tests.llm.helpers import awkward
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_minhash import brute as brute_groups


def test_stages_on_a_small_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontamination", "mixing"]

    good = stages["quality"](spark, docs, small).cache()
    kept = {r.doc_id for r in good.collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.01 * len(labels) and good.columns == docs.columns

    texts = [(r.doc_id, r.text) for r in good.collect()]
    single = stages["near_dedup"](spark, good, small).cache()
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in brute_groups(texts, 5).items() if i == c}

    cut = stages["substring_dedup"](spark, single, small).cache()
    assert cut.columns == docs.columns and cut.count() == single.count()
    assert cut.filter("n_chars <> length(text)").isEmpty()

    clean = stages["decontamination"](spark, cut, small).cache()
    found = brute_hits([(r.doc_id, r.text) for r in cut.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {i for i, h in found.items() if not h[-1]}

    mixed = stages["mixing"](spark, clean, small)
    assert mixed.count() == clean.count()
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert by_source.filter("abs(taken - target) > 0.5 + 1e-6").isEmpty()


def test_awkward_documents_pass_every_stage(spark, small, monkeypatch):
    docs = awkward(spark).select(pipeline.COLUMNS)
    monkeypatch.setattr(quality, "learn", lambda *a, **k: quality.fit([], __import__("numpy").zeros(0)))
    for name, stage in pipeline.STAGES:
        frame = stage(spark, docs, small)
        assert frame.count() <= docs.count()
        assert stage(spark, docs.limit(0), small).count() == 0
        docs = frame if name != "mixing" else docs
