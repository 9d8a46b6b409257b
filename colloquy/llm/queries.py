"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from colloquy.llm.decontaminate import contamination, hits
from colloquy.llm.frames import fold_of, table
from colloquy.llm import covertree, dialogs, html, langid, licenses, minhash, mixing, quality, resampling, simhash
from colloquy.llm.ctw import code_lengths
from colloquy.llm.oracles import OP6, OP7, OP8, OP9, OP10, OP11, OP13
from colloquy.llm.substrings import digest, remove_repeats
from pyspark.sql import DataFrame, SparkSession, functions as F


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by rank-order n-gram profiles."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs, fold_of("doc_id", 3) != 1)
    found = langid.identify(docs.select("doc_id", "text"), known)
    return found.select(F.col("id").alias("doc_id"), (fold_of("id", 3) == 1).alias("held_out"), "lang_pred", "score", "distance")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families whose notices stand in each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.by_document(docs, licenses.notices(docs))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by naive-Bayes-scaled support vectors."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, folder, "labels"), fold_of("id", 5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page by tag-path ratios."""
    return html.extract(table(spark, folder, "pages"))


def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every text under context-tree weighting."""
    docs = table(spark, folder, "documents")
    found = code_lengths(docs, fold_of("doc_id", 5) != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the word sequences that also occur earlier."""
    return digest(remove_repeats(table(spark, folder, "documents")))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources, weighing 5, 2, 1 in turn, takes of each document."""
    return mixing.digest(mixing.mixture(table(spark, folder, "documents")))


def op8_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Ten largest inner products of every hundredth vector with all others."""
    return covertree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near-duplicate documents over two-word shingles."""
    return minhash.digest(minhash.near_duplicates(table(spark, folder, "documents"), width=2))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold passages of the benchmark, and how much of them."""
    return hits(contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the damaged conversations and their cheapest repairs."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    broken = dialogs.damaged(rows)
    found = dialogs.diagnosed(broken)
    return dialogs.digest(rows, found, dialogs.repaired(broken, found))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in two bits or fewer."""
    return simhash.digest(simhash.near_duplicates(table(spark, folder, "documents")))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A twentieth of the documents, drawn towards the benchmark's distribution."""
    return resampling.digest(resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_quality": op3_quality,
    "op4_html": op4_html,
    "op5_context_tree": op5_context_tree,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_cover_tree": op8_cover_tree,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}
ORACLES = {"op6_substring_dedup": OP6, "op7_mixing": OP7, "op8_cover_tree": OP8, "op9_minhash": OP9, "op10_decontaminate": OP10, "op11_conversation_repair": OP11, "op13_resampling": OP13}
