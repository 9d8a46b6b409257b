from pyspark.sql import functions as F

from colloquy.operators import fusion

LIST = "query_id int, channel string, weight double, variant int, rank int, node_id string"


def ranked(spark, lists):
    rows = [(1, ch, w, v, i, n) for ch, w, v, nodes in lists for i, n in enumerate(nodes, 1)]
    return spark.createDataFrame(rows, LIST)


def test_variants_share_one_vote(spark):
    df = ranked(spark, [("fact.dense", 0.75, 0, "AB"), ("fact.dense", 0.75, 1, "BC"), ("raw.bm25", 1.0, 0, "R")])
    out = fusion.collapse_variants(df).orderBy("channel", "rank").collect()
    assert [(r.channel, r.node_id) for r in out] == [("fact.dense", "B"), ("fact.dense", "A"), ("fact.dense", "C"), ("raw.bm25", "R")]


def test_single_list_passes_unchanged_even_with_repeats(spark):
    df = ranked(spark, [("raw.image", 1.0, 0, "XYX")])
    assert sorted((r.rank, r.node_id) for r in fusion.collapse_variants(df).collect()) == [(1, "X"), (2, "Y"), (3, "X")]


def test_rrf_counts_repeats_and_dedup_does_not(spark):
    df = ranked(spark, [("a", 1.0, 0, "XYX"), ("b", 1.0, 0, "YX")])
    full = {r.node_id: r.score for r in fusion.rrf(df).collect()}
    assert abs(full["X"] - (1 / 61 + 1 / 63 + 1 / 62)) < 1e-15
    once = {r.node_id: r.score for r in fusion.rrf_dedup(df).collect()}
    assert abs(once["X"] - (1 / 61 + 1 / 62)) < 1e-15 and abs(once["Y"] - (1 / 62 + 1 / 61)) < 1e-15


def test_ties_go_to_first_seen_whatever_the_partitioning(spark):
    df = ranked(spark, [("a", 1.0, 0, "ZA"), ("b", 1.0, 0, "AZ")])
    for n in (1, 7):
        assert [r.node_id for r in fusion.rrf(df.repartition(n)).orderBy("rank").collect()] == ["Z", "A"]
    assert [r.node_id for r in fusion.rrf_dedup(df).orderBy("rank").collect()] == ["A", "Z"]


def test_consensus_prefers_supported_collection(spark):
    found = spark.createDataFrame([(1, "wrong", 1, 0.065), (1, "right", 2, 0.063)], "query_id int, node_id string, rank int, score double")
    members = spark.createDataFrame([("wrong", "X"), ("right", "A"), ("right", "B")], "node_id string, ref string")
    evidence = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "X")], "query_id int, rank int, ref string")
    out = fusion.consensus(found, members, evidence).orderBy("rank").collect()
    assert [r.node_id for r in out] == ["right", "wrong"] and out[0].support_hits == 2
    bare = fusion.consensus(found, members, evidence, weight=0.0).orderBy("rank").collect()
    assert bare[0].node_id == "wrong"
    assert fusion.consensus(found, members, evidence.filter(F.lit(False))).orderBy("rank").first().node_id == "wrong"
