"""Importance resampling of documents towards a target distribution.

Hashed word features are counted over the corpus and over the target.  Their
log-ratios, an array of one gain per bucket, score every document, and Gumbel noise
drawn from the id turns the best scores into a weighted sample without
replacement.  The cutoff is found without sorting the corpus: a quantile sketch
proposes a bracket around it, exact counts outside validate the bracket or widen it,
and only what lies inside is narrowed on and finally sorted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.frames import long_of, stored
from colloquy.llm.tokens import slices

BUCKETS = 10_000
LONGEST = 3
SEED = 42
MIN_WORDS = 20
PERCENT = 5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
# Bytes of a text whose words are held at once.
PIECE = 1 << 20

# Half the share of rows that a sketched bracket should hold, and the sketch's relative error.
SLACK, ACCURACY = 0.005, 1000
# Rows of a bracket that are sorted to find the cutoff; a larger one is narrowed first.
SORTED = 100_000


def features(text: bytes, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """``(number of words, feature buckets)`` of consecutive pieces of a text.

    A run's checksum continues that of the run one word shorter, and the last two
    words of a piece are carried into the next.
    """
    text = text.lower()
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + piece)
        stop = gap.start() if gap else len(text)
        fresh = _WORD.findall(text, at, stop)
        words = carried + fresh
        spaced = [b" " + w for w in words]
        runs = list(map(zlib.crc32, words))
        found: list[int] = []
        for length in range(1, LONGEST + 1):
            if length > 1:
                runs = list(map(zlib.crc32, spaced[length - 1 :], runs))
            found += runs[max(0, len(carried) - length + 1) :]
        yield len(fresh), np.array(found, dtype=np.int64) % BUCKETS
        carried = words[-(LONGEST - 1) :]
        at = stop


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts per bucket; each task sends one row per bucket it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0)):
                raw = buf.tobytes()
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    for _, found in features(raw[a:b]):
                        counts += np.bincount(found, minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket in thousandths; the table has ``BUCKETS`` rows whatever the input."""
    spark = corpus.sparkSession
    s, t = (bucket_counts(x).withColumnRenamed("n", name) for x, name in ((corpus, "s"), (target, "t")))
    table = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    all_rows = Window.partitionBy()
    real = {c: F.col(c).cast("double") for c in ("s", "t")}
    whole = {c: F.sum(c).over(all_rows).cast("double") for c in ("s", "t")}
    ratio = (real["t"] + 1) * (whole["s"] + BUCKETS) / ((real["s"] + 1) * (whole["t"] + BUCKETS))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in table.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[row.bucket] = row.gain
    return out


def weights(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight`` per row: the sum of the gains of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offs in slices(batch.column(1)):
                raw = buf.tobytes()
                out = np.zeros((3, high - low), dtype=np.int64)
                for d, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    for n, found in features(raw[a:b]):
                        out[:, d] += n, len(found), table[found].sum()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, out)], names=["id", "n_words", "n_features", "weight"])

    chosen = docs.select(long_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the id's digest; a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def nth_largest(rows: DataFrame, column: str, k: int, slack: float = SLACK, limit: int = SORTED) -> tuple[int, int]:
    """``(value, rows above it)`` of the ``k``-th largest of a long column without nulls, 1 <= k <= rows.

    Every step sketches two quantiles around the place wanted and counts exactly what
    lies above and inside.  A bracket that misses the place is widened, fourfold or more, until
    it holds everything; one that hits becomes the next step's rows.
    """
    above, total, width = 0, rows.count(), slack
    value = F.col(column)
    while total > limit:
        place = 1 - (k - above) / total
        low, high, least, most = rows.agg(
            F.percentile_approx(column, [max(0.0, place - width), min(1.0, place + width)], ACCURACY).alias("q"), F.min(column).alias("least"), F.max(column).alias("most")
        ).select(F.col("q")[0], F.col("q")[1], "least", "most").first()
        low, high = least if place - width <= 0 else low, most if place + width >= 1 else high
        over, inside = rows.agg(F.count_if(value > high), F.count_if(value.between(low, high))).first()
        if not over < k - above <= over + inside:
            width = 4 * width + 1 / total
            continue
        if low == high:
            return low, above + over
        if inside == total:
            # The sketch can't tell the values apart: halve the range instead.
            middle = low + (high - low) // 2
            over = rows.agg(F.count_if(value > middle)).first()[0]
            low, high, over, inside = (middle + 1, high, 0, over) if over >= k - above else (low, middle, over, total - over)
        rows = rows.filter(value.between(low, high))
        above, total, width = above + over, inside, slack
    best = rows.select(column).orderBy(value.desc()).limit(k - above)
    found = best.agg(F.min(column)).first()[0]
    return found, above + rows.filter(value > found).count()


def drawn(scored: DataFrame, k: int, slack: float = SLACK, limit: int = SORTED) -> DataFrame:
    """The ``k`` rows of highest ``score``, ties to the smaller ``id`` (null last), with their ``rank``."""
    scored = scored.withColumn("late", F.coalesce(-F.col("id"), F.lit(-(1 << 63))))
    if k <= 0:
        return scored.limit(0).drop("late").withColumn("rank", F.lit(None).cast("bigint"))
    cut, above = nth_largest(scored, "score", k, slack, limit)
    last, _ = nth_largest(scored.filter(F.col("score") == cut), "late", k - above, slack, limit)
    best = scored.filter((F.col("score") > cut) | ((F.col("score") == cut) & (F.col("late") >= last)))
    order = [F.col("score").desc(), F.col("late").desc()]
    # Sorted by ranges and written once, so that a range keeps its rows if an executor is lost.
    ranges = stored(best.orderBy(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = ranges.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(sizes), "range")
    # Equal ids may leave more rows than wanted at the cutoff.
    return numbered.withColumn("rank", (F.col("place") + F.col("shift")).cast("bigint")).filter(F.col("rank") <= k).drop("late", "range", "place", "shift")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` per row of ``docs``; rank is null for what is not drawn.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred are drawn.
    Null and blank texts have no features, weight 0 and are never drawn.  A null id has
    the noise of an empty one and comes last among ties.  Rows with equal ids and
    scores are ranked in any order.  Empty tables are allowed on either side.
    """
    table = gains(docs.select(F.col(text_col).alias("text")), target.select(F.col("text")))
    scored = weights(docs, table, id_col, text_col).withColumn("score", F.col("weight") + noise("id", seed))
    scored = stored(scored, "scored")
    chosen = F.col("n_words") >= min_words
    count = scored.filter(chosen).count()
    best = stored(drawn(scored.filter(chosen), percent * count // 100), "drawn")
    edge = best.orderBy(F.col("rank").desc()).select("score", "id").first()
    if edge is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    # What lies beyond the last drawn row is undrawn; only rows equal to it can be on both sides.
    late = F.coalesce(-F.col("id"), F.lit(-(1 << 63)))
    last = -(1 << 63) if edge.id is None else -edge.id
    beyond = ~chosen | (F.col("score") < edge.score) | ((F.col("score") == edge.score) & (late < last))
    same = scored.filter(chosen & (F.col("score") == edge.score) & (late == last))
    taken = best.filter((F.col("score") == edge.score) & (late == last)).count()
    spare = same.withColumn("copy", F.row_number().over(Window.orderBy("n_features"))).filter(F.col("copy") > taken).drop("copy")
    undrawn = scored.filter(beyond).unionByName(spare).withColumn("rank", F.lit(None).cast("bigint"))
    return best.unionByName(undrawn)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of :func:`resample`."""
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
