import itertools
import math
import random

from pyspark.sql import functions as F

from colloquy.operators import context, packing, projection


def test_projection_media_direct_adjacent(spark):
    raw = spark.createDataFrame([(f"T{i}", "S1", i) for i in range(4)], "ref string, session_id string, ordinal int")
    upper = spark.createDataFrame([(1, 1, "f")], "query_id int, rank int, node_id string")
    refs = spark.createDataFrame([("f", 0, "T2")], "node_id string, pos int, ref string")
    media = spark.createDataFrame([("f", "T1")], "node_id string, ref string")
    got = {r.ref: r.relation for r in projection.grounding(upper, refs, raw, media).collect()}
    assert got == {"T1": "media", "T2": "direct", "T3": "adjacent"}


def test_packing_quota_then_new_references():
    refs = [["T1", "T2", "T3", "T4"], ["T1"], ["T2"], ["T3"], ["T5"], ["T6"]]
    upper = [True] + [False] * 5
    assert packing.diverse_selection(refs, upper, 4, 2, True) == [0, 1, 2, 4]
    hidden = packing.diverse_selection([["T1"], ["T1"], ["T2"], ["T3"]], [True, False, False, False], 3, 2, False)
    assert hidden == [1, 2, 3]


def _enumerate(refs, upper, top_k, quota, expose):
    """Straight reading of the selection rule, one candidate at a time."""
    eff = lambda c: math.exp(-sum(v / sum(c.values()) * math.log(v / sum(c.values())) for v in c.values())) if c else 0.0
    limit, chosen, counts = top_k + (not expose), [], {}

    def take(i):
        chosen.append(i)
        for r in refs[i]:
            counts[r] = counts.get(r, 0) + 1

    lead = upper.index(True) if True in upper else None
    if lead is not None:
        take(lead)
        support = [i for i in range(len(refs)) if i != lead and set(refs[i]) & set(refs[lead])]
        for i in support[: min(quota, limit - 1)]:
            take(i)
    while len(chosen) < min(limit, len(refs)):
        def gain(i):
            r = set(refs[i])
            after = dict(counts)
            for x in r:
                after[x] = after.get(x, 0) + 1
            spread = max(-1, min(1, (eff(after) - eff(counts)) / max(len(r), 1)))
            over = max([len(r & set(refs[c])) / len(r | set(refs[c])) for c in chosen if r | set(refs[c])], default=0) if r else 0
            return round(0.5 / (1 + i) + 0.25 * (len(r - counts.keys()) / len(r) if r else 0) + 0.25 * spread - 0.1 * over, 12)

        take(max((i for i in range(len(refs)) if i not in chosen), key=lambda i: (gain(i), -i)))
    return chosen if expose else [i for i in chosen if not upper[i]][:top_k]


def test_packing_matches_enumeration_on_random_candidates():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randint(1, 12)
        refs = [rng.sample("ABCDEFG", rng.randint(0, 4)) for _ in range(n)]
        upper = [rng.random() < 0.2 for _ in range(n)]
        args = (rng.randint(1, 8), rng.randint(0, 4), rng.random() < 0.5)
        assert packing.diverse_selection(refs, upper, *args) == _enumerate(refs, upper, *args)


def test_bundles_keep_membership_and_reject_bad_sizes(spark):
    group = lambda *g: [(x, 1) for x in g]
    rows = [(1, 1, "r2", "b", group("f1", "lonely")), (1, 2, "noise", "c", []), (1, 3, "r1", "a", group("f1"))]
    schema = "query_id int, slot int, node_id string, date_key string, groups array<struct<group_id:string,source_rank:int>>"
    out = packing.evidence_bundles(spark.createDataFrame(rows, schema)).orderBy("new_slot").collect()
    assert [(r.node_id, r.bundle) for r in out] == [("r1", 1), ("r2", 1), ("noise", 0)]
    assert packing.claim_groups({"one": {0}, "seven": set(range(7))}, {"one": 1, "seven": 1}) == []


def test_anchor_packing_keeps_prefix_and_packets():
    base = [f"T{i:03d}" for i in range(1, 41)]
    out = packing.anchor_order(base, ["T029", "T035"], [("T031", "T029")], [], 30, 24)
    assert out[:24] == base[:24] and out[24:27] == ["T029", "T031", "T035"] and len(out) == len(set(out)) == 30
    assert packing.anchor_order(["a"], [], [], [], 0, 24) == []
    for n in itertools.product((0, 2), repeat=2):
        packed = packing.anchor_order(base[:5], base[5 : 5 + n[0]], [], base[8 : 8 + n[1]], 30, 24)
        assert set(packed) == set(base[:5] + base[5 : 5 + n[0]] + base[8 : 8 + n[1]])


def test_date_filter_is_fail_open_and_after_the_limit(spark):
    rows = [(1, i, f"n{i}", day) for i, day in enumerate(["2024-08-01", "2024-08-05", "2024-08-11"], 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, node_id string, date string")
    kept = lambda v: [r.node_id for r in context.fail_open_date(df.withColumn("time_range", F.lit(v).cast("string")), ["query_id"]).orderBy("rank").collect()]
    assert kept("2024-08-05") == ["n2"]
    for value in ("2025-01-01", "in August", None):
        assert kept(value) == ["n1", "n2", "n3"]


def test_slot_sort_moves_only_raw_rows(spark):
    rows = [(1, 1, False, "c", None, "S1", 0), (1, 2, True, "b", "2024-02-02", "S10", 1), (1, 3, True, "a", "2024-02-02", "S2", 4), (1, 4, True, "x", None, "S1", 1)]
    df = spark.createDataFrame(rows, "query_id int, slot int, is_raw boolean, node_id string, date string, session_id string, ordinal int")
    out = context.chronological_slots(df, ["query_id"]).orderBy("new_slot").collect()
    assert [r.node_id for r in out] == ["c", "a", "b", "x"]


def test_rounds_displace_the_tail_and_evicted_ids_stay_out(spark):
    df = spark.createDataFrame([(1, list("abc"), list("cd"), list("ae"))], "query_id int, c0 array<string>, c1 array<string>, c2 array<string>")
    row = context.merge_rounds(df, ["c0", "c1", "c2"], (3, 2, 2), 3).first()
    # d displaces c; c and a were seen, so only e is new in the last round.
    assert row.packed == ["a", "b", "e"] and (row.admitted_1, row.admitted_2, row.deduplicated) == (1, 1, 2)


def test_selected_rows_first_and_visual_budget(spark):
    df = spark.createDataFrame([(1, i, n, ["c", "a"], [], []) for i, n in enumerate("abcd", 1)], "query_id int, slot int, node_id string, memory_ids array<string>, wanted_images array<string>, image_ids array<string>")
    assert [r.node_id for r in context.selected_first(df, ["query_id"]).orderBy("new_slot").collect()] == list("cabd")
    ctx = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", False), (1, 3, "c", True)], "query_id int, slot int, node_id string, has_image boolean")
    vis = spark.createDataFrame([(1, 1, "z"), (1, 2, "c")], "query_id int, rank int, node_id string")
    assert [r.node_id for r in context.visual_budget(ctx, vis, ["query_id"]).orderBy("place").collect()] == ["c", "a"]
