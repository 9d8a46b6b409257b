"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import oracle
from colloquy.catalog import ORACLES, QUERIES

ROWS_ONLY = {
    "pack_context", "evidence_bundles", "anchor_pack", "reconcile_fragments", "online_speaker_match",
    "cluster_naming", "stream_speaker_match", "executor_context", "iterative_rounds", "boundary_identities",
}
# Long jobs run once, in the tests below.
SEPARATE = {"executor_context", "iterative_rounds", "stream_speaker_match", "online_speaker_match", "reconcile_fragments", "boundary_identities"}


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SEPARATE))
def test_query(spark, small, con, name):
    got = oracle.compare(spark, name, small, con)
    assert got["match"] is not False, got
    assert got["rows"] > 0 or name in {"identity_events", "alias_stage_self"}


def test_stream_equals_batch(spark, small):
    batch = QUERIES["online_speaker_match"](spark, small).toPandas()
    stream = QUERIES["stream_speaker_match"](spark, small).toPandas()
    assert oracle.rows(batch) == oracle.rows(stream) and len(batch)


def test_result_does_not_depend_on_partitioning(spark, small):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = oracle.rows(QUERIES["rrf_fusion"](spark, small).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert oracle.rows(QUERIES["rrf_fusion"](spark, small).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_executor_and_rounds(spark, small):
    context = QUERIES["executor_context"](spark, small).toPandas()
    assert context.groupby("item_id")["slot"].apply(lambda s: sorted(s) == list(range(1, len(s) + 1))).all()
    assert not context.duplicated(["item_id", "node_id"]).any() and context.groupby("item_id").size().max() <= 30
    unified = context[context["item_id"] % 6 != 5]
    assert not unified["node_id"].str.startswith("collection:").any()
    rounds = QUERIES["iterative_rounds"](spark, small).toPandas()
    assert rounds["item_id"].is_unique and set(rounds["item_id"]) == set(context["item_id"])
    reason = dict(zip(rounds["item_id"], rounds["stop_reason"]))
    assert all(r == "evidence_sufficient" for i, r in reason.items() if i % 4 == 0)
    assert all(r == "refinement_parse_failed" for i, r in reason.items() if i % 4 == 1)
    assert rounds["n_packed"].max() <= 20
