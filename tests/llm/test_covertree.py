import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm.covertree import CoverTree, top_k


def brute(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for q in good:
        if q % 100:
            continue
        best = set()
        for c in good:
            if c != q:
                best |= {(-sum(a * b for a, b in zip(x, y)), c) for x in good[q] for y in good[c]}
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(best)[:k])]
    return sorted(out)


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, score string, rank int")
    return sorted(tuple(r) for r in top_k(table, F.col("vec_id") % 100 == 0, **sizes).collect())


@pytest.mark.parametrize("block,queries", [(4096, 512), (70, 2)])
def test_against_all_pairs(spark, block, queries):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centers[i % 5] * (1 + i % 3) + 0.1 * rng.normal(size=8)]) for i in range(501)]
    assert run(spark, rows, block=block, query_block=queries) == brute(rows)


def test_awkward_vectors(spark):
    same = [0.5, 0.25, -1.0]
    rows = [(0, same), (1, same), (2, same), (3, None), (4, [0.1, None, 0.2]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (100, [-1.0, 2.0, 3.0]), (None, same), (2, same), (200, None)]
    assert run(spark, rows) == brute(rows)
    assert len(run(spark, rows)) == 8


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)]
    assert [r[2] for r in run(spark, rows)] == list(range(1, 11))


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (9, [2.0])]) == [(0, 1, 9, 1024 * 2048)]
    assert run(spark, []) == []


def test_tree_covers_its_points():
    points = np.random.default_rng(2).normal(size=(700, 4)) ** 3
    tree = CoverTree(points, leaf=8)

    def visit(node):
        inside = points[tree.order[node.low : node.high]]
        assert np.sqrt(((inside - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert not node.children or [c.low for c in node.children] + [node.high] == [node.low] + [c.high for c in node.children]
        for child in node.children:
            visit(child)

    visit(tree.root)
    assert sorted(tree.order) == list(range(700))
