"""Corpus preparation: quality, near-dedup, substring dedup, decontamination, mixing.

Each stage takes ``(spark, docs, folder)`` and returns a frame that is written and
read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.deploy import ship_package
from colloquy.llm import mixing, quality
from colloquy.llm.decontaminate import contamination, hits
from colloquy.llm.frames import stored, table, without
from colloquy.llm.minhash import near_duplicates
from colloquy.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels."""
    _ready(spark)
    model = quality.learn(docs, table(spark, folder, "labels"), F.lit(True))
    return quality.score(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, the one with the smallest id, of every group of near-duplicates (five-word shingles).

    Rows with equal ids stay or go together; rows without an id stay.
    """
    _ready(spark)
    found = near_duplicates(docs)
    return without(docs.select(COLUMNS), found.filter("id <> component").select(F.col("id").alias("doc_id")), "doc_id")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the words that repeat earlier ones; an untouched text keeps its layout."""
    _ready(spark)
    found = remove_repeats(docs, carry=["lang", "source"], keep_layout=True)
    return found.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    _ready(spark)
    found = hits(contamination(docs, table(spark, folder, "benchmark")))
    return without(docs.select(COLUMNS), found.filter("contaminated").select("doc_id"), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """What a mix by source weights takes of every document, and into which shards."""
    _ready(spark)
    found = mixing.mixture(docs)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# A fitted classifier and MinHash have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark, os.path.dirname(os.path.abspath(__file__)))


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
