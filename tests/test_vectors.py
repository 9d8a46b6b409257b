"""Vector cache: one call per distinct text, over requests and runs."""

import os
import uuid

import numpy as np

from colloquy.sources.encoders import encode_texts
from colloquy.sources.vectors import VectorCache


def counting(folder):
    """Encoder that leaves a file per text it sees."""

    def make():
        def encode(texts):
            for text in texts:
                with open(os.path.join(folder, f"{len(text)}-{uuid.uuid4().hex}"), "w") as out:
                    out.write(text)
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])

        return encode

    return lambda df, node, text: encode_texts(df, node, text, make)


def seen(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_one_call_per_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = VectorCache(spark, str(tmp_path / "cache"), counting(str(calls)))
    first = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, body string")
    got = {r.id: r.vec for r in cache(first, "id", "body").collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[3] and np.allclose(np.linalg.norm(list(got.values()), axis=1), 1)
    assert seen(calls) == ["", "aa", "b"]
    # Another request and another run: only the new text is encoded.
    again = VectorCache(spark, str(tmp_path / "cache"), counting(str(calls)))
    more = {r.id: r.vec for r in again(spark.createDataFrame([("x", "b"), ("y", "ca")], "id string, t string"), "id", "t").collect()}
    assert more["x"] == got[2] and seen(calls) == ["", "aa", "b", "ca"]
    again.warm((first, "body"), (spark.createDataFrame([("ca",), ("d",)], "t string"), "t"))
    assert seen(calls) == ["", "aa", "b", "ca", "d"]


def test_same_text_in_two_parts_is_one_row(spark, tmp_path):
    location = str(tmp_path / "cache")
    for part in ("a", "b"):
        spark.createDataFrame([("s", [1.0])], "signature string, vec array<double>").write.parquet(f"{location}/vectors/part={part}")
    assert VectorCache(spark, location, None).table().count() == 1
