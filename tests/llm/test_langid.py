from pyspark.sql import functions as F

from colloquy.llm import langid
from colloquy.llm.frames import fold_of
from tests.llm.helpers import awkward, frame


def brute_grams(text):
    import collections
    import unicodedata

    symbols = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    stream = "_" + "".join(w + "_" for w in symbols.split()) if symbols.split() else "__"
    out = collections.Counter()
    for n in (1, 2, 3):
        for p in range(len(stream) - n + 1):
            g = stream[p : p + n]
            if g != "_" and "__" not in g:
                out[g] += 1
    return out


def decoded(code):
    points = []
    while code:
        points.append(code & ((1 << 21) - 1))
        code >>= 21
    return "".join(chr(p) for p in reversed(points))


def test_grams_are_counted_exactly():
    import pyarrow as pa

    from colloquy.llm.tokens import string_buffers

    texts = ["the cat, the dog", "", "été été", "a", "ΑΒΓ 12 абв 漢字 𝔸x"]
    lowered = pa.array([t.lower() for t in texts])
    owner, code, n = langid.grams(*string_buffers(lowered))
    for d, text in enumerate(texts):
        got = {decoded(int(c)): int(k) for o, c, k in zip(owner, code, n) if o == d}
        assert got == dict(brute_grams(text))


def test_languages_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = langid.profiles(docs, fold_of("doc_id", 3) != 1)
    found = langid.identify(docs, known, carry=["lang"]).filter(fold_of("id", 3) == 1)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98


def test_awkward_documents(spark):
    docs = awkward(spark)
    known = langid.profiles(docs, F.lit(True))
    got = {r.id: r for r in langid.identify(docs, known).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {3, 4, 5, 15}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert set(known) == {"en", "fr", "de"} or set(known) == {"en", "fr"}


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "some text", None, None), (None, None, None, None)])
    assert langid.profiles(docs, F.lit(True)) == {}
    assert sorted((r.lang_pred, r.score) for r in langid.identify(docs, {}).collect()) == [("und", 0.0), ("und", 1.0)]
    assert langid.identify(docs.limit(0), {}).count() == 0


def test_rare_languages_keep_all_their_documents(spark):
    import collections

    rare = {f"r{k}": [f"xq{chr(97 + k % 26)}z{'v' * (k // 26)}", f"kw{chr(97 + k % 26)}"] for k in range(30)}
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(100_000 + 2 * k + j, t, name) for k, (name, texts) in enumerate(rare.items()) for j, t in enumerate(texts)], many.schema)
    known = langid.profiles(many.unionByName(few), F.lit(True))
    assert set(known) == {"en", *rare}
    for name, texts in rare.items():
        counts = collections.Counter()
        for t in texts:
            counts.update(brute_grams(t))
        assert sorted(decoded(c) for c in known[name]) == sorted(counts)
