"""Vector expressions for single pairs; bulk scoring is in operators.dense."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.functions.text import _c


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalise(a: Column | str, floor: float = 1e-12) -> Column:
    size = F.greatest(norm(a), F.lit(floor))
    return F.transform(_c(a), lambda v: v.cast("double") / size)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
