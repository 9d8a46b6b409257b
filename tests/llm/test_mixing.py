import math

from pyspark.sql import functions as F

from colloquy.llm.mixing import digest, hypergeometric, mixture, shards, split, targets
from tests.llm.helpers import awkward, blank_words, frame, prose


def brute_targets(sizes):
    """The limit, and the excess reshared by weight until nothing is above it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not above:
            return {**out, **{s: level * weight[s] for s in free}}
        out |= {s: 3.0 * sizes[s] for s in above}
        free -= above
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 200, "c": 30, "d": 5, None: 40}, {"x": 7}, {"a": 0, "b": 9}, {"a": 0, None: 0}, {f"s{k}": k * k for k in range(20)}):
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = brute_targets(sizes)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def check(docs):
    rows = docs.collect()
    found = mixture(docs, shard_words=500)
    got = digest(found).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len(blank_words(r.text))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(blank_words(r.text))
    want, source_of = brute_targets(sizes), {}
    for r in found.collect():
        source_of.setdefault(r.source, []).append(r)
    for source, own in source_of.items():
        assert sum(c.words for r in own for c in r.copies) == math.floor(want[source] + 0.5)
        assert all(r.source_size == sizes[source] and math.isclose(r.target, want[source], abs_tol=1e-6) for r in own)
        assert all(sum(c.words for c in r.copies) <= 3 * r.size for r in own)
    again = sorted(map(str, digest(mixture(docs, shard_words=500)).collect()))
    assert again == sorted(map(str, got))
    return found


def test_awkward_documents(spark):
    check(awkward(spark))


def test_hot_source_and_shards(spark):
    docs = frame(spark, [(i, prose(i, 1 + i % 40), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)])
    found = check(docs)
    mixed = shards(found).collect()
    assert len(mixed) == sum(len(r.copies) for r in found.collect())
    assert len({(r.shard, r.place, r.id) for r in mixed}) == len(mixed)
    assert max(r.shard for r in mixed) > 3


def test_split_keeps_every_quota(spark):
    quotas = spark.createDataFrame([([100, 0, 37, 2],)], "quotas array<bigint>")
    rows = split(quotas, 7, "x").collect()
    assert sorted(r.shard for r in rows) == list(range(7))
    assert [sum(c) for c in zip(*[r.quotas for r in rows])] == [100, 0, 37, 2]
    assert {sum(r.quotas) for r in rows} <= {19, 20} and min(q for r in rows for q in r.quotas) >= 0


def test_hypergeometric_is_distributed_as_it_should(spark):
    n, m, t = 50, 12, 20
    uniform = (F.col("id") + 0.5) / 20_000.0
    long = lambda x: F.lit(x).cast("bigint")
    got = {r.x: r["count"] / 20_000 for r in spark.range(20_000).groupBy(hypergeometric(long(n), long(m), long(t), uniform).alias("x")).count().collect()}
    for x in range(13):
        exact = math.comb(m, x) * math.comb(n - m, t - x) / math.comb(n, t) if t - x <= n - m else 0
        assert abs(got.get(x, 0) - exact) < 2e-4


def test_no_words_and_empty(spark):
    docs = awkward(spark)
    got = digest(mixture(docs.filter("doc_id in (3, 4, 5)"))).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}
    assert digest(mixture(docs.limit(0))).count() == 0
