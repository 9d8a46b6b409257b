import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm import quality
from colloquy.llm.frames import fold_of
from colloquy.llm.tokens import string_buffers
from tests.llm.helpers import awkward, frame


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, fold_of("id", 5) != 0)
    held = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(fold_of("doc_id", 5) == 0)
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.95


def test_features_are_indicators():
    doc, feature = quality.features(*string_buffers(pa.array(["Aa bb Aa bb", "Aa bb", "", "!! 12"])))
    assert len(np.unique(doc * quality._SIZE * 4 + feature)) == len(doc)
    assert set(doc) == {0, 1, 3}
    assert set(feature[doc == 1]) <= set(feature[doc == 0])


def test_descent_separates():
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([4, 5]), np.array([4, 6])] * 5
    label = np.array([True, True, False, False] * 5)
    model = quality.fit(rows, label)
    scores = [model.scores(model.margins(np.zeros(2, dtype=int), r, 1))[0] for r in rows]
    assert all((s >= 0.5) == y for s, y in zip(scores, label))


def test_awkward_documents_and_labels(spark):
    docs = awkward(spark).union(frame(spark, [(1, "again", "en", "a"), (None, "no id", None, None)]))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (7, None), (8, 1), (13, 0)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels, F.lit(True))
    got = quality.score(docs, model)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert set(docs.columns) - {"score"} <= set(got.columns)


def test_one_class_no_labels_and_empty(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs, quality.learn(docs, none, F.lit(True))).select("score").distinct().count() == 1
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert quality.score(docs.limit(0), quality.learn(docs, one, F.lit(True))).count() == 0
