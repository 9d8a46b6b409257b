import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.operators import bm25
from colloquy.operators.local_topk import SCORE_BLOCK, row_runs
from colloquy.sources.encoders import BUCKETS, _count_vectors


def peak(run):
    tracemalloc.start()
    out = run()
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, held / 1e6


def weights(questions: int, words: int) -> bm25.Weights:
    names = [f"w{i:03d}" for i in range(words)]
    terms = pa.table({"query_id": np.repeat(np.arange(questions), words), "term": names * questions})
    stats = pa.table({"term": [*names, bm25.SENTINEL], "df": [3] * words + [10], "length": [30] * words + [400]})
    return bm25.Weights(terms, stats, ("query_id",))


def test_runs_hold_whole_rows():
    assert list(row_runs(np.array([1, 2, 3, 9, 1]), 5)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(row_runs(np.array([0, 0]), 5)) == [(0, 2)] and list(row_runs(np.array([], dtype=int), 5)) == []


def test_scores_unroll_a_bounded_number_of_hits(monkeypatch):
    w = weights(200, 40)
    lists = pa.array([[f"w{(i * j) % 40:03d}" for j in range(60)] for i in range(1500)])
    scores, mb = peak(lambda: w.scores(lists))
    # Twelve million hits; one array of them alone takes a hundred megabytes.
    assert mb < 90
    monkeypatch.setattr(bm25, "HIT_BLOCK", 1 << 40)
    monkeypatch.setattr(bm25, "TOKEN_BLOCK", 1 << 40)
    assert np.array_equal(scores, w.scores(lists)) and scores.min() > 0


def test_scores_read_a_bounded_number_of_tokens():
    w = weights(2, 3)
    _, mb = peak(lambda: w.scores(pa.array([["other", "w001"] * 500] * 4000)))
    assert mb < 40


def test_variants_of_a_question_are_scored_apart_and_in_blocks():
    names = [f"w{i:02d}" for i in range(30)]
    terms = pa.table({"query_id": [q for q in range(150) for _ in range(60)], "variant": ([0] * 30 + [1] * 30) * 150, "term": names * 300})
    stats = pa.table({"term": [*names, bm25.SENTINEL], "df": [3] * 30 + [10], "length": [30] * 30 + [400]})
    w = bm25.Weights(terms, stats, ("query_id", "variant"))
    scores, mb = peak(lambda: w.scores(pa.array([names] * 1000)))
    assert scores.shape == (1000, 300) and w.names[1] == (0, 1) and np.ptp(scores) < 1e-9 and mb < 90


def test_a_block_of_scores_is_small():
    assert SCORE_BLOCK * 8 <= 8 << 20


def test_encoder_counts_a_bounded_number_of_tokens():
    lists = pa.array([np.arange(2000, dtype=np.int32) % BUCKETS] * 4000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), lists], names=["id", "b"])
    (out,), mb = peak(lambda: list(_count_vectors(iter([batch]))))
    assert out.num_rows == 4000 and mb < 60


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [("a", "the cat sat"), ("a", "the dog sat"), ("a", "the cat sat on"), ("b", "cat cat"), (None, "the end"), ("c", ""), ("d", None)]
    return spark.createDataFrame(rows, "node_id string, text string")


def test_document_stats_are_those_of_the_index(repeated):
    round_ = lambda df: sorted((r.term, r.df, r.n_docs, round(r.avgdl, 12), round(r.idf, 12)) for r in df.collect())
    assert round_(bm25.document_stats(repeated, "node_id", "text")) == round_(bm25.term_stats(bm25.postings(repeated, "node_id", "text")))


def test_corpus_terms_are_counted_before_they_move(spark, repeated):
    stats = bm25.corpus_stats(repeated, "text", spark.createDataFrame([("cat",), ("none",)], "term string"))
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate [term")
    assert {r.term: (r.df, r.length) for r in stats.collect()} == {"cat": (3, 9), "": (6, 14)}


def test_rounds_look_the_memory_up_without_shuffling_it(spark):
    from colloquy.operators import projection

    raw = spark.range(1000).select(F.format_string("r%d", "id").alias("ref"), F.lit("s").alias("session_id"), F.col("id").alias("ordinal"))
    refs = spark.range(1000).select(F.format_string("f%d", "id").alias("node_id"), F.lit(0).alias("pos"), F.format_string("r%d", "id").alias("ref"))
    upper = spark.createDataFrame([(1, 1, "f7")], "query_id int, rank int, node_id string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = projection.grounding(upper, refs, raw)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.ref, r.relation) for r in found.collect()) == [("r6", "adjacent"), ("r7", "direct"), ("r8", "adjacent")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_finished_cases_are_not_read_again(spark, monkeypatch):
    from colloquy.config import FragmentPolicy
    from colloquy.operators import fragments

    read = []
    plain = fragments.pair_evidence

    def watched(counts, sizes, policy):
        read.append(({r.case_id for r in counts.select("case_id").distinct().collect()}, {r.case_id for r in sizes.select("case_id").distinct().collect()}))
        return plain(counts, sizes, policy)

    monkeypatch.setattr(fragments, "pair_evidence", watched)
    counts = [("C", "A", "A", 1.0, 45), ("C", "B", "B", 1.0, 45), ("C", "F", "F", 1.0, 3), ("C", "A", "F", 0.95, 30), ("C", "B", "F", 0.1, 30), ("C", "A", "B", 0.05, 100)]
    counts += [("D", "A", "A", 1.0, 45), ("D", "B", "B", 1.0, 45), ("D", "A", "B", 0.05, 100)]
    sizes = [("C", "A", "S0", 10), ("C", "B", "S0", 10), ("C", "F", "S0", 3), ("D", "A", "S0", 10), ("D", "B", "S0", 10)]
    got = fragments.reconcile(
        spark.createDataFrame(counts, "case_id string, src string, dst string, value double, n bigint"),
        spark.createDataFrame(sizes, "case_id string, label string, session_id string, n bigint"), FragmentPolicy(),
    )
    assert {(r.case_id, r.label): r.final for r in got.collect()} == {("C", "A"): "MERGED_001", ("C", "F"): "MERGED_001", ("C", "B"): "B", ("D", "A"): "A", ("D", "B"): "B"}
    assert read == [({"C", "D"}, {"C", "D"}), ({"C"}, {"C"})]
