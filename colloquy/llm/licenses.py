"""Licence notices by a trained paragraph classifier.

Paragraphs are single lines, and stretches of words, across line ends, along which a
notice runs.  They are described by the word n-grams they share with known
notices.  A sparse multinomial logistic regression over those n-grams names a
licence family or ``unknown``; its confidence is calibrated by a temperature, and a
named family counts only if the paragraph also holds most of one of the family's
notices.  Reading, features, scores and the comparison are DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.frames import stored

UNKNOWN = "unknown"
GRAMS = 3
# Corpus paragraphs without a notice's words that join the unknown class, and the smallest confidence and containment of a hit.
NEGATIVES = 2_000
CONFIDENCE = 0.5
CONTAINED = 0.7
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)

# Words that may be put into or left out of a notice, and places that share a cell when stretches are held against each other.
SLACK = 8
CELL = 64

# Sentences of public licence notices, by family.
NOTICES = {
    "agpl": ("licensed under the GNU Affero General Public License version 3", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX License Identifier AGPL 3.0"),
    "apache": ("Licensed under the Apache License Version 2.0", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0", "SPDX License Identifier Apache 2.0"),
    "bsd": ("Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "Released under the BSD License", "licensed under the BSD 3 Clause License", "SPDX License Identifier BSD 3 Clause"),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc0": ("Released under CC0 1.0 Universal", "dedicated to the public domain under the Creative Commons Zero waiver"),
    "gpl": ("This work is licensed under the GNU General Public License version 3", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License", "SPDX License Identifier GPL 3.0", "licensed under the GPL"),
    "isc": ("Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "SPDX License Identifier ISC"),
    "lgpl": ("licensed under the GNU Lesser General Public License version 3", "This library is free software under the terms of the GNU Lesser General Public License", "SPDX License Identifier LGPL 3.0"),
    "mit": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "SPDX License Identifier MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License v 2.0", "licensed under the Mozilla Public License 2.0", "SPDX License Identifier MPL 2.0"),
    "proprietary": ("All rights reserved", "Unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense"),
}
# Sentences with the words of notices that grant nothing.
DECOYS = (
    "a driver needs a license", "the license of the restaurant was renewed", "the terms of the agreement are public", "free software is a public good", "he was released on condition",
    "the source of the river is free", "permission was granted to the person", "the general public was informed", "use of the library is free of charge", "the work was published by the foundation",
    "the new version is subject to change", "rights and duties of the public", "he obtained a copy of the file", "the license fee was paid under protest",
)
# Words that occur in any English text and do not make an n-gram a feature.
COMMON = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "file", "following", "for", "forms", "in", "is", "it", "may", "met", "not", "of", "or", "person", "that", "the", "this", "to", "use", "via", "with", "without", "work", "you",
)
# Notices around which something else is said, for training.
FRAMES = ("{0}", "{0}.", "note: {0}", "{0}, see the file for details", "copyright the authors. {0}", "(c) {0} and others")


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits; version numbers fall apart."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _key_words() -> list[str]:
    found = {w for notices in NOTICES.values() for n in notices for w in re.findall("[a-z0-9]+", n.lower())}
    return sorted(w for w in found - set(COMMON) if not w.isdigit())


def grams(ws: Column, keys: list[str]) -> Column:
    """Distinct n-grams of up to ``GRAMS`` words that hold a key word; only the places of key words are looked at."""
    size = F.size(ws)
    none = F.array().cast("array<int>")
    places = F.when(size > 0, F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at(ws, i).isin(*keys))).otherwise(none)

    def of_length(n: int) -> Column:
        # A lambda's second parameter would be the index, so n is bound outside.
        first, last = (lambda p: F.greatest(p - (n - 1), F.lit(1))), (lambda p: F.least(p, size - (n - 1)))
        near = F.transform(places, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(none))
        return F.transform(F.array_distinct(F.flatten(near)), lambda s: F.array_join(F.slice(ws, s, n), " "))

    return F.array_distinct(F.concat(*[of_length(n) for n in range(1, GRAMS + 1)]))


def placed_grams(ws: Column, keys: list[str]) -> Column:
    """``(at, n, gram)`` of every occurrence of such an n-gram; places count from 1."""
    size = F.size(ws)
    none = F.array().cast("array<int>")
    places = F.when(size > 0, F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at(ws, i).isin(*keys))).otherwise(none)

    def of_length(n: int) -> Column:
        first, last = (lambda p: F.greatest(p - (n - 1), F.lit(1))), (lambda p: F.least(p, size - (n - 1)))
        near = F.transform(places, lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p))).otherwise(none))
        return F.transform(F.array_distinct(F.flatten(near)), lambda s: F.struct(s.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(ws, s, n), " ").alias("gram")))

    return F.concat(*[of_length(n) for n in range(1, GRAMS + 1)])


def occurrences(docs: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """``id, copy, at, n, gram`` over whole texts: line ends and comment marks stand between words only.  ``copy`` tells texts of one id apart."""
    text = F.regexp_replace(F.col(text_col).cast("string"), r"(?m)^\s*(?:dnl|[Rr][Ee][Mm])\s", " ")
    ws = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("copy"), word_list(text).alias("ws")).filter(F.exists("ws", lambda w: w.isin(*keys)))
    return ws.select("id", "copy", F.explode(placed_grams(F.col("ws"), keys)).alias("x")).select("id", "copy", "x.*")


def paragraphs(docs: DataFrame, keys: list[str], id_col: str, text_col: str) -> DataFrame:
    """``id, line, ws``: lines that hold a key word; the others have no feature and are unknown."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line", "text"))
    return lines.select("id", "line", word_list(F.col("text")).alias("ws")).filter(F.exists("ws", lambda w: w.isin(*keys)))


def templates(spark: SparkSession) -> DataFrame:
    """``family, notice, gram, size``: the n-grams of every notice."""
    rows = [(f, i, n) for f, notices in NOTICES.items() for i, n in enumerate(notices)]
    own = spark.createDataFrame(rows, "family string, notice int, text string").withColumn("g", grams(word_list(F.col("text")), _key_words()))
    return own.select("family", "notice", F.explode("g").alias("gram"), F.size("g").alias("size"))


def compared(lines: DataFrame) -> DataFrame:
    """``id, line, family, contained``: the largest part of a family's notice that a paragraph holds."""
    known = F.broadcast(templates(lines.sparkSession))
    met = lines.select("id", "line", F.explode("g").alias("gram")).join(known, "gram").groupBy("id", "line", "family", "notice", "size").agg(F.countDistinct("gram").alias("n"))
    return met.groupBy("id", "line", "family").agg(F.max(F.col("n") / F.col("size")).alias("contained"))


def stretches(grams_at: DataFrame) -> DataFrame:
    """``id, copy, family, contained, first, last``: places along which a notice runs in order.

    An n-gram at place ``p`` of a text and ``q`` of a notice votes for a start at
    ``p - q``.  Votes at most ``SLACK`` apart are one stretch, so words may be put in or left
    out; it lies where most of its votes fall.
    """
    spark, keys = grams_at.sparkSession, _key_words()
    rows = [(f, i, n) for f, notices in NOTICES.items() for i, n in enumerate(notices)]
    own = spark.createDataFrame(rows, "family string, notice int, text string").withColumn("ws", word_list(F.col("text")))
    own = own.select("family", "notice", F.size("ws").alias("length"), F.size(grams(F.col("ws"), keys)).alias("size"), F.explode(placed_grams(F.col("ws"), keys)).alias("x"))
    known = F.broadcast(own.select("family", "notice", "length", "size", F.col("x.gram").alias("gram"), F.col("x.at").alias("place")))
    group = ["id", "copy", "family", "notice", "length", "size"]
    votes = grams_at.select("id", "copy", "at", "gram").join(known, "gram").withColumn("start", F.col("at") - F.col("place") + 1)
    voted = votes.groupBy(*group, "start").agg(F.collect_set("gram").alias("g"))
    part = F.floor(F.col("start") / SLACK)
    met = voted.withColumn("part", F.explode(F.array(part, part + 1))).groupBy(*group, "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("g")))).alias("n"), F.max(F.struct(F.size("g").alias("n"), (-F.col("start")).alias("back"))).alias("most"))
    first = -F.col("most.back")
    kept = met.filter(F.col("n") >= CONTAINED * F.col("size")).select("id", "copy", "family", (F.col("n") / F.col("size")).alias("contained"), F.greatest(first, F.lit(1)).alias("first"), (first + F.col("length") - 1).alias("last"))
    return kept.groupBy("id", "copy", "family", "first", "last").agg(F.max("contained").alias("contained"))


def _cells(first: str, last: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(first) / CELL), F.floor(F.col(last) / CELL)))


def contested(found: DataFrame) -> DataFrame:
    """``found`` with ``low, high``: the stretch and all that share half of the shorter one with it, which the classifier has to tell apart."""
    celled = found.withColumn("cell", _cells("first", "last"))
    other = celled.select("id", "copy", "cell", F.col("first").alias("f"), F.col("last").alias("l")).distinct()
    shared = F.least("last", "l") - F.greatest("first", "f") + 1
    shorter = F.least(F.col("last") - F.col("first"), F.col("l") - F.col("f")) + 1
    met = celled.join(other, ["id", "copy", "cell"]).filter(2 * shared >= shorter)
    return met.groupBy("id", "copy", "family", "first", "last", "contained").agg(F.min("f").alias("low"), F.max("l").alias("high"))


def runs(grams_at: DataFrame, found: DataFrame) -> DataFrame:
    """``id, line, g`` of the contested stretches; ``id`` is the struct ``(id, copy, low, high)``, ``line`` 0."""
    spans = found.select("id", "copy", "low", "high").distinct().withColumn("cell", _cells("low", "high"))
    inside = grams_at.withColumn("cell", F.floor(F.col("at") / CELL)).join(spans, ["id", "copy", "cell"]).filter((F.col("at") >= F.col("low")) & (F.col("at") + F.col("n") - 1 <= F.col("high")))
    return inside.groupBy(F.struct("id", "copy", "low", "high").alias("id")).agg(F.collect_set("gram").alias("g")).select("id", F.lit(0).alias("line"), "g")


def training_rows(lines: DataFrame, met: DataFrame) -> DataFrame:
    """``label, fold, g``: framed notices, decoys, and paragraphs of ``lines`` that hold no whole notice."""
    spark, keys = lines.sparkSession, _key_words()
    rows = [(f, k, frame.format(n)) for f, notices in NOTICES.items() for n in notices for k, frame in enumerate(FRAMES)]
    rows += [(UNKNOWN, k, frame.format(d)) for d in DECOYS for k, frame in enumerate(FRAMES)] + [(UNKNOWN, k, w) for k, w in enumerate(keys)]
    framed = spark.createDataFrame(rows, "label string, fold int, text string").select("label", F.pmod("fold", F.lit(3)).alias("fold"), grams(word_list(F.col("text")), keys).alias("g"))
    free = lines.join(met.filter(F.col("contained") >= CONTAINED).select("id", "line").distinct(), ["id", "line"], "left_anti")
    some = free.orderBy(F.xxhash64("id", "line"), "id", "line").limit(NEGATIVES)
    return framed.unionByName(some.select(F.lit(UNKNOWN).alias("label"), F.pmod("line", F.lit(3)).cast("int").alias("fold"), "g"))


def fit(rows: DataFrame) -> tuple[list[tuple[str, str, float]], dict[str, float]]:
    """Non-zero ``(gram, family, weight)`` and the families' intercepts."""
    families = sorted([*NOTICES, UNKNOWN])
    code = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("label")) - 1
    counted = CountVectorizer(inputCol="g", outputCol="features", binary=True, minDF=3, vocabSize=1 << 14).fit(rows)
    data = counted.transform(rows).select(code.cast("double").alias("label"), "features")
    model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.9, maxIter=25, tol=1e-4).fit(data)
    matrix = model.coefficientMatrix.toArray()
    present = families[: matrix.shape[0]]
    weights = [(counted.vocabulary[j], f, float(matrix[i, j])) for i, f in enumerate(present) for j in matrix[i].nonzero()[0]]
    return weights, {f: float(b) for f, b in zip(present, model.interceptVector)}


def logits(lines: DataFrame, weights: list[tuple[str, str, float]], intercepts: dict[str, float]) -> DataFrame:
    """``id, line, logits``: per paragraph with grams ``g`` an array of ``(z, family)``.

    The weights are those of the notices' n-grams and of a bounded training set, so
    they are broadcast.
    """
    spark = lines.sparkSession
    table = F.broadcast(spark.createDataFrame(weights or [("", UNKNOWN, 0.0)], "gram string, family string, w double"))
    every = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(b).alias("w")) for f, b in intercepts.items()])
    start = lines.select("id", "line", F.explode(every).alias("x")).select("id", "line", "x.*")
    own = lines.select("id", "line", F.explode("g").alias("gram")).join(table, "gram").select("id", "line", "family", "w")
    sums = start.unionByName(own).groupBy("id", "line", "family").agg(F.sum("w").alias("z"))
    return sums.groupBy("id", "line").agg(F.collect_list(F.struct("z", "family")).alias("logits"))


def chances(temperature: float) -> Column:
    """``(p, family)`` of every family, by the tempered softmax."""
    top = F.array_max(F.transform("logits", lambda x: x["z"]))
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x["z"] - top) / temperature))
    return F.transform("logits", lambda x: F.struct((F.exp((x["z"] - top) / temperature) / total).alias("p"), x["family"].alias("family")))


def calibrate(rows: DataFrame) -> float:
    """The temperature with the least log loss on the third of the training rows that a fit on the others has not seen."""
    weights, intercepts = fit(rows.filter("fold <> 0"))
    seen = stored(rows.filter("fold = 0").select(F.monotonically_increasing_id().alias("id"), F.lit(0).alias("line"), "label", "g"), "fold")
    scored = logits(seen, weights, intercepts).join(seen.select("id", "label"), "id")
    own = lambda t: F.element_at(F.filter(chances(t), lambda x: x["family"] == F.col("label")), 1)["p"]
    losses = scored.select(*[(-F.log(F.greatest(F.coalesce(own(t), F.lit(1e-6)), F.lit(1e-6)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)])
    means = losses.agg(*[F.avg(c).alias(c) for c in losses.columns]).first()
    return min(zip(means, TEMPERATURES))[1]


def _best(lines: DataFrame, weights: list[tuple[str, str, float]], intercepts: dict[str, float], temperature: float) -> DataFrame:
    """``id, line, family, score`` of the paragraphs that are not ``unknown`` with a probability of at least ``CONFIDENCE``."""
    best = logits(lines, weights, intercepts).select("id", "line", F.array_max(chances(temperature)).alias("best")).select("id", "line", "best.family", F.col("best.p").alias("score"))
    return best.filter((F.col("family") != UNKNOWN) & (F.col("score") >= CONFIDENCE))


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line, family, score, contained``: confirmed licence notices, one row per paragraph.

    A paragraph counts if the best family is not ``unknown``, its calibrated
    probability is at least ``CONFIDENCE`` and the paragraph holds at least ``CONTAINED`` of
    the n-grams of one of the family's notices.  Null and empty texts have none.
    Rows with equal ids are one document: equal lines at the same place count once.

    Paragraphs are stretches along which a notice runs, wrapped or several to a line;
    ``line`` is then the first word's place.  A line counts for a family that no
    stretch of the document shows: its notice has more words put in.
    """
    keys = _key_words()
    lines = stored(paragraphs(docs, keys, id_col, text_col).select("id", "line", grams(F.col("ws"), keys).alias("g")).distinct(), "paragraphs")
    grams_at = stored(occurrences(docs, keys, id_col, text_col), "occurrences")
    # A few thousand short rows: one partition keeps each step of the fit to one task.
    met = stored(compared(lines), "compared")
    rows = stored(training_rows(lines, met).coalesce(1), "training").coalesce(1).cache()
    weights, intercepts = fit(rows)
    temperature = calibrate(rows)
    found = stored(contested(stored(stretches(grams_at), "stretches")), "contested")
    told = _best(runs(grams_at, found), weights, intercepts, temperature).select("id.*", "family", "score")
    long = found.join(told, ["id", "copy", "low", "high", "family"])
    long = stored(long.groupBy("id", F.col("low").alias("line"), "family").agg(F.max("score").alias("score"), F.max("contained").alias("contained")), "runs")
    short = _best(lines, weights, intercepts, temperature).join(met, ["id", "line", "family"]).filter(F.col("contained") >= CONTAINED)
    short = short.join(long.select("id", "family").distinct(), ["id", "family"], "left_anti")
    return long.unionByName(short.select("id", "line", "family", "score", "contained"))


def by_document(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, license, n_notices, score, contained`` per row of ``docs``; no notice: empty, 0, 0, 0."""
    sums = found.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("license"), F.count("*").alias("n_notices"), F.max("score").alias("score"), F.max("contained").alias("contained"))
    joined = docs.select(F.col(id_col).alias("id")).join(sums, "id", "left")
    zero = F.lit(0.0)
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("license", F.lit("")).alias("license"), F.coalesce("n_notices", F.lit(0).cast("bigint")).alias("n_notices"), F.coalesce("score", zero).alias("score"), F.coalesce("contained", zero).alias("contained"))
