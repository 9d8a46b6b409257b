"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source, in a fixed random order, are cut into *blocks*.  A
source contributes whole passes over its blocks and, in its last pass, a first
part of them, so that its words equal its target.  All these block draws are dealt
to output shards by a binary tree: a node knows how many draws of each source
belong to its shards, and gives its left half a multivariate-hypergeometric share.
Every shard then takes the next draws of each source, so no two shards share one,
and orders its documents by hash.  Everything is a DataFrame function; the
documents themselves move once, to be numbered inside their block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.frames import stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
# Mean documents in a block, and the most blocks of a source (then blocks grow).
BLOCK_DOCS = 64
SOURCE_BLOCKS = 1 << 16
SHARD_WORDS = 1 << 20


def _log_factorial(n: Column) -> Column:
    """log n! by Stirling's series, exact to double precision from the seventh shift."""
    x = n + F.lit(8.0)
    small = F.lit(0.0)
    for k in range(1, 8):
        small = small + F.log(n + F.lit(float(k)))
    inverse = 1.0 / x
    series = inverse * (F.lit(1 / 12) - inverse * inverse * (F.lit(1 / 360) - inverse * inverse / 1260))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - small


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and not copied into every place of use."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(population: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """Hypergeometric variate by inversion, within twelve standard deviations of the mean."""
    total = population.cast("double")
    mean = draws * marked / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1.0))) * (total - draws) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0)))

    def bounds(s: Column) -> Column:
        low = F.greatest(F.lit(0), draws - (population - marked), F.floor(s["mean"] - 12 * s["spread"] - 2)).cast("bigint")
        high = F.least(draws, marked, F.ceil(s["mean"] + 12 * s["spread"] + 2)).cast("bigint")
        return F.struct(low.alias("low"), high.alias("high"))

    def inverted(r: Column) -> Column:
        low, high = r["low"], r["high"]
        parts = [(1.0, marked), (-1.0, low), (-1.0, marked - low), (1.0, population - marked), (-1.0, draws - low), (-1.0, population - marked - draws + low), (-1.0, population), (1.0, draws), (1.0, population - draws)]
        terms = F.array(*[F.struct(F.lit(sign).alias("sign"), n.cast("double").alias("n")) for sign, n in parts])
        first = F.exp(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["sign"] * _log_factorial(t["n"])))

        def step(acc: Column, x: Column) -> Column:
            up = acc["sum"] + acc["p"]
            ratio = (marked - x).cast("double") * (draws - x) / ((x + 1).cast("double") * (population - marked - draws + x + 1))
            return F.struct(up.alias("sum"), (acc["p"] * F.coalesce(ratio, F.lit(0.0))).alias("p"), (acc["n"] + F.when(up < uniform, 1).otherwise(0)).cast("bigint").alias("n"))

        start = F.struct(F.lit(0.0).alias("sum"), first.alias("p"), F.lit(0).cast("bigint").alias("n"))
        # The last value of the range needs no step: everything above belongs to it.
        return F.when(high <= low, low).otherwise(low + F.aggregate(F.sequence(low, F.greatest(high - 1, low)), start, step)["n"])

    return _let(_let(F.struct(mean.alias("mean"), spread.alias("spread")), bounds), inverted)


def _left_share(quotas: Column, draws: Column, seed: Column) -> Column:
    """Multivariate-hypergeometric share of ``draws`` out of ``quotas``, source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda a, q: a + q)

    def step(acc: Column, i: Column) -> Column:
        marked = F.element_at(quotas, i + 1)
        uniform = (F.pmod(F.xxhash64(seed, i), F.lit(1 << 53)) + 0.5) / float(1 << 53)
        drawn = lambda v: F.when(acc["population"] <= 0, F.lit(0).cast("bigint")).otherwise(hypergeometric(acc["population"], v["marked"], acc["draws"], v["uniform"]))
        after = lambda g: F.struct((acc["population"] - marked).alias("population"), (acc["draws"] - g).alias("draws"), F.concat(acc["out"], F.array(g)).alias("out"))
        return _let(_let(F.struct(marked.alias("marked"), uniform.alias("uniform")), drawn), after)

    start = F.struct(total.alias("population"), draws.alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(quotas) - 1), start, step)["out"]


def split(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``shard, quotas``: the one row of ``quotas`` (array of bigint) dealt to ``shards`` shards of even size."""
    total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
    tree = quotas.select(F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("high"), "quotas", total.alias("all"))
    for level in range(max(0, math.ceil(math.log2(shards)))):
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        even = lambda s: F.floor(F.col("all") * s / shards)
        share = F.when(F.col("high") - F.col("low") < 2, F.col("quotas")).otherwise(
            _left_share(F.col("quotas"), (even(middle) - even(F.col("low"))).cast("bigint"), F.xxhash64(F.lit(seed), "low", "high"))
        )
        tree = tree.withColumn("share", share).withColumn("middle", middle.cast("bigint"))
        left = F.struct(F.col("low"), F.when(F.col("high") - F.col("low") < 2, F.col("high")).otherwise(F.col("middle")).alias("high"), F.col("share").alias("quotas"))
        right = F.struct(F.col("middle").alias("low"), F.col("high"), F.zip_with("quotas", "share", lambda q, s: q - s).alias("quotas"))
        halves = F.when(F.col("high") - F.col("low") < 2, F.array(left)).otherwise(F.array(left, right))
        tree = tree.select(F.explode(halves).alias("half"), "all").select("half.*", "all")
        if level % 4 == 3:
            tree = stored(tree, "tree")
    return tree.select(F.col("low").alias("shard"), "quotas")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, target``: shares of all words by weight, at most ``repeats`` times the source.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    The words over a source's limit go to the others by weight until none is above:
    the target is the smaller of the limit and a common level times the weight.
    The table has a row per source, so its few windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.withColumn("all", F.sum("source_size").over(everything)).withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    common = leveled.withColumn("common", F.max(fits).over(everything))
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap").cast("double")))
    return common.select("source", "source_size", share.alias("target"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id, source, size, source_size, target, copies``.

    ``copies`` lists what the mix takes of the document: ``(pass, shard, place,
    words)``; ``place`` orders a shard.  A source's words are its target, rounded; the
    last document it takes in its last pass may be cut to its first words.  Null
    texts have size 0 and contribute no words; a null source is a source; rows with
    equal ids are ordered by size.  Without words there is nothing to take.
    """
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            mixed.alias("h"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = stored(targets(sources.drop("docs"), weights, repeats).join(sources.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    words = F.floor(F.col("target") + 0.5).cast("bigint")
    plan = plan.withColumns({
        "source_blocks": F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(SOURCE_BLOCKS)).cast("bigint"),
        "passes": F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("bigint"),
        "rest": F.when(F.col("source_size") > 0, F.pmod(words, F.col("source_size"))).otherwise(0).cast("bigint"),
    }).drop("docs")
    key = plan.select(F.col("source").alias("_s"), "source_blocks")
    block = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * F.col("source_blocks") / F.lit(1 << 32)).cast("bigint")
    placed = sized.join(F.broadcast(key) if _small(plan) else key, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", block).drop("_s", "source_blocks")
    inside = Window.partitionBy("source", "block").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed")
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    row = Window.partitionBy("source").orderBy("block")
    blocks = blocks.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = blocks.withColumns({
        "before": F.coalesce(F.sum("block_size").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "nth": F.row_number().over(row) - 1,
        "n": F.count("*").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    draws = F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    blocks = stored(blocks.withColumn("draws", draws.cast("bigint")), "blocks")
    quotas = blocks.groupBy("source").agg(F.sum("draws").alias("quota")).agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("all"))
    quotas = stored(quotas.filter(F.size("all") > 0).select(F.transform("all", lambda x: x["source"]).alias("sources"), F.transform("all", lambda x: x["quota"]).alias("quotas")), "quotas")
    mixed_words = plan.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    shards = max(1, math.ceil(int(mixed_words) / shard_words))
    dealt = stored(split(quotas.select("quotas"), shards, seed), "dealt")
    named = dealt.crossJoin(F.broadcast(quotas.select("sources"))).select("shard", F.explode(F.arrays_zip("sources", "quotas")).alias("x")).select("shard", F.col("x.sources").alias("source"), F.col("x.quotas").alias("quota"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranks = named.withColumn("from", F.coalesce(F.sum("quota").over(upto), F.lit(0))).filter("quota > 0")
    ranks = ranks.select("source", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("quota") - 1)).alias("draw"))
    taken = blocks.filter("draws > 0").select("source", "block", "before", "rest", "passes", "n", "nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("draws") - 1)).alias("pass"))
    taken = taken.withColumn("draw", F.col("pass") * F.col("n") + F.col("nth"))
    left = taken.withColumnRenamed("source", "_s").join(ranks, F.col("_s").eqNullSafe(F.col("source")) & (ranks["draw"] == taken["draw"])).drop("_s")
    per_block = left.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"), F.first("before").alias("before"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    sums = plan.select(F.col("source").alias("_s"), "source_size", "target")
    out = placed.join(per_block.withColumnsRenamed({"source": "_s", "block": "_b"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b")
    out = out.join(F.broadcast(sums) if _small(plan) else sums, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    tail = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead"))).cast("bigint")
    copy = lambda d: F.struct(
        d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), "h", d["pass"]).alias("place"), F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(tail).alias("words")
    )
    copies = F.filter(F.transform(F.coalesce("drawn", F.array().cast("array<struct<pass:bigint,shard:bigint>>")), copy), lambda c: c["words"] > 0)
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def _small(plan: DataFrame, rows: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast."""
    return plan.count() <= rows


def shards(found: DataFrame) -> DataFrame:
    """``shard, place, id, pass, words``: the mix itself, each shard in its own order."""
    every = found.select("id", F.explode("copies").alias("c")).select("c.shard", "c.place", "id", "c.pass", "c.words")
    return every.repartition("shard").sortWithinPartitions("shard", "place", "id")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of :func:`mixture`."""
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))
