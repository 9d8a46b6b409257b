"""Set-overlap join, and the visual branches of keyword-gated fusion."""

import random

import pytest

import oracle
from colloquy.operators import gallery, relations
from colloquy.operators.overlap import overlap_join

TOKENS = "id int, s string, tokens array<string>, least int"


@pytest.mark.parametrize("scoped", [False, True])
def test_overlap_equals_all_pairs(spark, scoped):
    pick = random.Random(5)
    word = lambda: f"w{min(pick.randrange(30), pick.randrange(30))}"
    left = [(i, pick.choice("ab"), sorted({word() for _ in range(pick.randrange(9))}), pick.randrange(1, 4)) for i in range(40)]
    right = [(i, pick.choice("ab"), sorted({word() for _ in range(pick.randrange(12))} | {"odd"}), 0) for i in range(60)]
    want = {
        (a, b, len(set(x) & set(y))) for a, s, x, k in left for b, t, y, _ in right if (s == t or not scoped) and len(set(x) & set(y)) >= k
    }
    frame = lambda rows, name: spark.createDataFrame(rows, TOKENS).withColumnRenamed("id", name)
    scope = ("s",) if scoped else ()
    l, r = frame(left, "query_id"), frame(right, "node_id").drop("least")
    if not scoped:
        l, r = l.drop("s"), r.drop("s")
    got = overlap_join(l, r, ["query_id"], scope=scope).collect()
    assert {(g.query_id, g.node_id, g.shared) for g in got} == want and len(got) == len(want) > 50


def test_nothing_to_meet(spark):
    some = spark.createDataFrame([(1, ["a"], 1)], "query_id int, tokens array<string>, least int")
    none = spark.createDataFrame([], "node_id int, tokens array<string>")
    assert overlap_join(some, none, ["query_id"]).count() == 0 and overlap_join(some.limit(0), none, ["query_id"]).count() == 0


def test_covering_counts_an_exact_share(spark):
    """Eighteen of a hundred tokens are 0.18 of them."""
    words = [f"x{i}" for i in range(100)]
    q = spark.createDataFrame([(1, " ".join(words))], "query_id int, text string")
    nodes = spark.createDataFrame([("in", " ".join(words[:18])), ("out", " ".join(words[:17])), ("twice", "x1 x1 " * 20)], "node_id string, text string")
    assert [(r.node_id, r.coverage) for r in relations.covering(q, nodes, 0.18).collect()] == [("in", 0.18)]


SETS = [
    ("s1", "moon orchid", ["2024-01-01"], ["i1", "i2"], ["t1", "t2"]), ("s2", "silk dress", ["2024-01-02"], ["i3"], ["t3"]), ("s3", "wool dresses", [], ["i4"], ["t4"]),
    ("s4", "evening dress", ["2024-01-02"], ["i5"], ["t5", "t1"]), ("s5", "moon orchid", ["2024-01-03"], ["i6"], ["t6"]),
]
CARDS = [("i1", "a moon orchid", ["2024-01-01"], ["t1"]), ("i7", "orchid by the moon", ["2024-01-05"], ["t7"]), ("i8", "moon only", [], ["t8"]), ("i3", "silk dress", [], ["t3"])]


def fused(spark, text, order, has_image=False, by_image=None):
    q = spark.createDataFrame([(1, text, has_image)], "query_id int, text string, has_image boolean")
    base = spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(["t9", "t2", "t8"])], "query_id int, node_id string, rank int")
    ranks = lambda ids: spark.createDataFrame([(1, s, i + 1) for i, s in enumerate(ids)], "query_id int, set_id string, rank int")
    sets = spark.createDataFrame(SETS, "set_id string, label string, days array<string>, image_ids array<string>, refs array<string>")
    cards = spark.createDataFrame(CARDS, "image_id string, text string, days array<string>, refs array<string>")
    context, summary = gallery.fuse(q, base, ranks(order), sets, cards, ranks(by_image) if by_image else None)
    rows = [r.node_id for r in context.orderBy("slot").collect()]
    told = summary.first()
    return rows, (told.route, told.n_images, told.image_ids) if told else None


def test_single_image_question_keeps_the_raw_list(spark):
    assert fused(spark, "what does the photo show", ["s1"]) == (["t9", "t2", "t8"], ("raw_visual_fallback", 0, []))
    assert fused(spark, "no such intent", ["s1"]) == ([], None)


def test_collection_takes_the_best_set(spark):
    assert fused(spark, "how many photos of it", ["s1", "s2"]) == (["collection", "t1", "t2", "t9", "t8"], ("explicit_collection_intent", 2, ["i1", "i2"]))


def test_request_for_everything_reaches_other_sessions(spark):
    """Two shared keywords add an image, one does not; a day in the question excludes cards without it."""
    rows, told = fused(spark, "the total number of photos", ["s1", "s2"])
    assert told[1:] == (3, ["i1", "i2", "i7"]) and rows == ["collection", "t1", "t2", "t7", "t9", "t8"]
    assert fused(spark, "total photos on 2024-01-01", ["s2", "s1"])[1][1:] == (2, ["i1", "i2"])


def test_broad_request_spans_adjacent_sets(spark):
    rows, told = fused(spark, "find all dress pictures", ["s2", "s1", "s4", "s3"])
    assert told[1:] == (2, ["i3", "i5"]) and rows == ["collection", "t3", "t5", "t1", "t9", "t2", "t8"]


def test_species_question_takes_all_sets_of_a_label(spark):
    text = "which photos show the same plant species"
    assert fused(spark, text, ["s5", "s2"])[1][1:] == (4, ["i1", "i2", "i6", "i7"])
    assert fused(spark, text, ["s2", "s1"], has_image=True, by_image=["s1", "s2"])[1][1:] == (4, ["i1", "i2", "i6", "i7"])


def test_queries(spark, small):
    for name in ("visual_fusion", "visual_counts", "profile_state_expansion"):
        got = oracle.compare(spark, name, small)
        assert got["match"], got
