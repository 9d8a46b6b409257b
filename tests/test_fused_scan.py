import numpy as np

from colloquy.operators import fused_scan
from colloquy.operators.fused_scan import DotScorer, RankList, fused_topk


def brute(lists, k):
    """Rank everything per list, then fuse."""
    total = {}
    for scores, allowed, positive in lists:
        rows = [i for i in range(len(scores)) if allowed[i] and (scores[i] > 0 or not positive)]
        for place, i in enumerate(sorted(rows, key=lambda i: (-round(float(scores[i]), 9), i)), 1):
            total[i] = total.get(i, 0) + 1 / (60 + place)
    return sorted(total, key=lambda i: (-round(total[i], 9), i))[:k]


def test_full_list_fusion_equals_enumeration(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 900
    a, b = rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
    a[300:600] = a[0]  # a third are copies
    groups = np.array(["x", "y", "x"] * (n // 3))
    qa, qb = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    frame = lambda m: spark.createDataFrame([(i, m[i].tolist(), groups[i]) for i in range(n)], "node_id bigint, payload array<double>, grp string").repartition(5)
    owner = {0: "x", 1: "y", 2: "x"}
    fa, fb = frame(a), frame(b)
    lists = [RankList("a", fa, DotScorer([0, 1, 2], qa), owner), RankList("b", fb, DotScorer([0, 1, 2], qb))]
    got = {}
    for r in fused_topk(lists, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.node_id)
    for q in range(3):
        assert got[q] == brute([(a @ qa[q], groups == owner[q], False), (b @ qb[q], np.ones(n, bool), False)], 5)
