"""Change log of labels, and identity tables at session boundaries: restarts, replays and earlier versions."""

import pytest
from pyspark.sql import functions as F

import oracle
from colloquy.catalog.streams import modal_names
from colloquy.streaming import boundaries, changelog
from colloquy.streaming.jobs import drain

TURN = "case_id string, ref string, speaker_ref string, text string"
BATCHES = [
    [("C1", "r1", "V1", "amy hello"), ("C1", "r2", "V2", "bob yes"), ("C2", "q1", "V1", "cy there")],
    [("C1", "r3", "V1", "zoe hello"), ("C1", "r4", "V1", "zoe again")],
    [("C2", "q2", "V1", "cy more"), ("C1", "r5", "V2", "bob no"), ("C1", "r6", "V2", None)],
]


def write(spark, folder, number):
    spark.createDataFrame(BATCHES[number], TURN).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).parquet(folder)


def labels(frame):
    return {(r.case_id, r.ref): r.label for r in frame.collect()}


def batch(spark, upto):
    rows = [row for rows in BATCHES[:upto] for row in rows]
    return labels(modal_names(spark.createDataFrame(rows, TURN)))


def test_stop_and_restart_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    for number in range(2):
        write(spark, source, number)
        changelog.run(stream(spark, source), modal_names, out, buckets=3)
        assert labels(changelog.as_of(spark, out)) == batch(spark, number + 1)
    log = changelog.read_log(spark, out)
    # The second batch renamed the first speaker, so the label of an earlier turn was taken back.
    assert {(r.kind, r.label, r.case_version) for r in log.filter("ref = 'r1'").collect()} == {("assert", "amy", 1), ("retract", "amy", 2), ("assert", "zoe", 2)}
    assert log.filter("ref = 'r2'").count() == 1
    write(spark, source, 2)
    changelog.run(stream(spark, source), modal_names, out, buckets=3)
    for upto in (1, 2, 3):
        assert labels(changelog.as_of(spark, out, upto - 1)) == batch(spark, upto)
    assert labels(changelog.as_of(spark, out)) == batch(spark, 3)
    first = changelog.as_of_version(spark, out, spark.createDataFrame([("C1", 1), ("C2", 1)], "case_id string, case_version int"))
    assert labels(first) == batch(spark, 1)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "log")
    frames = [spark.createDataFrame(rows, TURN) for rows in BATCHES]
    for number, frame in enumerate(frames):
        changelog.apply_batch(frame, number, modal_names, out, buckets=3)
    before = sorted(map(tuple, changelog.read_log(spark, out).collect()), key=str)
    changelog.apply_batch(frames[1], 1, modal_names, out, buckets=3)
    changelog.apply_batch(frames[2], 2, modal_names, out, buckets=3)
    assert sorted(map(tuple, changelog.read_log(spark, out).collect()), key=str) == before


def test_turn_that_the_resolver_drops_is_retracted(spark, tmp_path):
    out = str(tmp_path / "log")
    only_last = lambda t: t.groupBy("case_id").agg(F.max("ref").alias("ref")).withColumn("label", F.lit("last"))
    for number, rows in enumerate(BATCHES[:2]):
        changelog.apply_batch(spark.createDataFrame(rows, TURN), number, only_last, out, buckets=2)
    assert labels(changelog.as_of(spark, out)) == {("C1", "r4"): "last", ("C2", "q1"): "last"}


def test_empty_log(spark, tmp_path):
    assert changelog.as_of(spark, str(tmp_path / "none")).count() == 0


HEARD = "case_id string, session_no bigint, turn_idx int, session_id string, label string, claim string"
SESSIONS = [
    [("C", 1, 0, "S1", "V2", "amy"), ("C", 1, 1, "S1", "V3", None)],
    [("C", 2, 0, "S2", "V1", "amy"), ("C", 2, 1, "S2", "V3", "bo"), ("D", 5, 0, "S5", "V9", "")],
    [("C", 2, 2, "S2", "V2", "bo"), ("C", 4, 0, "S4", "V3", "bo"), ("D", 6, 0, "S6", "V9", "dee")],
    [("C", 7, 0, "S7", "V1", "x")],
]
WANT = {
    ("C", 1, "S1"): {("V2", "amy", "V2", 1, 1), ("V3", None, "V3", 1, 0)},
    ("C", 2, "S2"): {("V1", "amy", "V1", 1, 1), ("V2", "amy", "V1", 2, 1), ("V3", "bo", "V3", 2, 1)},
    ("C", 3, "S4"): {("V1", "amy", "V1", 1, 1), ("V2", "amy", "V1", 2, 1), ("V3", "bo", "V3", 3, 2)},
    ("D", 1, "S5"): {("V9", None, "V9", 1, 0)},
}


def tables(rows):
    out = {}
    for r in rows.collect():
        out.setdefault((r.case_id, r.version, r.session_id), set()).add((r.label, r.name, r.stable, r.n_turns, r.claims))
    return out


@pytest.mark.parametrize("parts", [[4], [1, 3], [1, 1, 1, 1], [3, 1]])
def test_boundary_tables_go_on_over_restarts(spark, tmp_path, parts):
    boundaries.use_rocksdb(spark)
    source, done = str(tmp_path / "in"), 0
    for size in parts:
        rows = [row for session in SESSIONS[done : done + size] for row in session]
        spark.createDataFrame(rows, HEARD).coalesce(1).write.mode("append").parquet(source)
        done += size
        found = drain(boundaries.boundary_stream(spark.readStream.schema(HEARD).parquet(source)), str(tmp_path / "out"))
    assert tables(found) == WANT


def test_queries(spark, small):
    for name in ("relabelled_turns", "boundary_tables", "boundary_payload"):
        got = oracle.compare(spark, name, small)
        assert got["match"], got
