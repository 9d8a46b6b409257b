import hashlib
import json
import re

from pyspark.sql import functions as F

from colloquy.functions import dates, ids, jsonish, names, text


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_fact_id_equals_canonical_json(spark):
    body, refs, who = "Été—chose: ß \"q\" x_1", ["D1:1", "D1:2"], "Zoë \"Z\""
    key = re.sub(r"\W+", " ", body.lower()).strip()
    want = json.dumps({"speaker": who, "text": key, "refer_ids": refs}, sort_keys=True, ensure_ascii=False)
    got = one(spark, ids.fact_id("s", text.text_key("t"), F.array(F.lit("D1:1"), F.lit("D1:2"))), s=who, t=body)
    assert got == "fact:" + hashlib.sha1(want.encode()).hexdigest()[:16]


def test_tokens_split_on_accents_and_casefold_expands(spark):
    assert one(spark, text.tokens("t"), t="Éttê ABC-12") == ["tt", "abc", "12"]
    for value in ("Straße ﬁn ς", "WEIẞ"):
        assert one(spark, text.casefold("t"), t=value) == value.casefold()


def test_natural_key_orders_numbers(spark):
    df = spark.createDataFrame([("S10_T002",), ("S2_T010",), ("S2_T003",)], "s string")
    assert [r.s for r in df.orderBy(text.natural_key("s")).collect()] == ["S2_T003", "S2_T010", "S10_T002"]


def test_dates_and_coordinates(spark):
    assert one(spark, dates.date_prefix("d"), d="2024-08-05T10:00") == "2024-08-05"
    assert one(spark, dates.date_prefix("d"), d="2024-02-31") is None
    assert one(spark, dates.explicit_date("d"), d="on 2024-08-05 or 2024-08-06") == "2024-08-05"
    for ref, want in {"raw:x:session3:7": ("session3", 7), "D2:11": ("D2", 11), "S4_T009": ("S4", 9), "zzz": ("", None)}.items():
        assert tuple(one(spark, dates.coordinates("r"), r=ref)) == want


def test_noisy_json(spark):
    cases = {'{"a":1}': True, 'x ```json\n{"a":1}\n``` y': True, 'so {"a":1} end': True, '{"a":': False, "[1]": False, "": False}
    for raw, ok in cases.items():
        assert (one(spark, jsonish.object_text("r"), r=raw) is not None) is ok, raw


def test_strip_speaker_and_keys(spark):
    assert one(spark, text.strip_speaker("t", "s"), t="  A.B : hi: there", s="A.B") == "hi: there"
    assert one(spark, text.strip_speaker("t", "s"), t="Anna said", s="An") == "Anna said"
    assert one(spark, text.identity_key("t"), t=" @@Lin  Wu ") == "lin wu"


def test_names(spark):
    assert one(spark, names.core("n"), n="Dr. Mr Alice Chen") == "alice chen"
    assert not one(spark, names.plausible("n"), n="Okay") and one(spark, names.plausible("n"), n="Ms. Alice Chen")
    fam = lambda a, b: one(spark, names.same_family("a", "b"), a=a, b=b)
    assert fam("Alice", "Alice Chen") and not fam("Alice Chen", "Alice Park") and not fam("", "Alice")
    assert one(spark, names.addresses("t", "n"), t="Hey Alice, come", n="Alice") and not one(spark, names.addresses("t", "n"), t="I saw Alice here", n="Alice")
