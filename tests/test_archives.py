"""Archives of arrays: round trip over many partitions, exact coverage, malformed archives."""

import zipfile

import numpy as np
import pytest

from colloquy.errors import ContractViolation
from colloquy.sources.archives import read_archives, stream_vectors
from colloquy.sources.cases import check_registry

TURNS = "case_id string, session_id string, turn_idx int, text string"


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_round_trip(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    arrays = {"vectors": rng.normal(size=(23, 5)).astype(np.float32), "keys": np.array([f"S1:{i} é" for i in range(23)]), "n": np.arange(23, dtype=np.int32), "ok": np.arange(23) % 2 == 0, "tag": np.array([b"x", b"yy"] * 11 + [b""])}
    save(tmp_path / "a.npz", **arrays)
    save(tmp_path / "b.npz", **{k: v[:3] for k, v in arrays.items()})
    got = read_archives(spark, str(tmp_path / "*.npz"), rows=4)
    assert dict(got.dtypes) == {"archive": "string", "row": "bigint", "vectors": "array<double>", "keys": "string", "n": "bigint", "ok": "boolean", "tag": "string"}
    assert got.rdd.getNumPartitions() == 7
    rows = {(r.archive, r["row"]): r for r in got.collect()}
    assert len(rows) == 26
    for (name, i), r in rows.items():
        assert (r["keys"], r.n, r.ok, r.tag) == (arrays["keys"][i], i, bool(arrays["ok"][i]), arrays["tag"][i].decode()) and np.allclose(r.vectors, arrays["vectors"][i])


def test_empty_archive(spark, tmp_path):
    np.savez(tmp_path / "a.npz", vectors=np.zeros((0, 3)), keys=np.zeros(0, dtype="U4"))
    assert read_archives(spark, str(tmp_path / "a.npz")).count() == 0


@pytest.mark.parametrize("arrays, reason", [({"a": np.zeros(3), "b": np.zeros(4)}, "differ in length"), ({"a": np.float64(1)}, "differ in length"), ({"a": np.zeros((2, 2, 2))}, "3 axes"), ({"a": np.array([1j])}, "not read"), ({"a": np.asfortranarray(np.ones((2, 3)))}, "by rows")])
def test_arrays_that_are_no_rows(spark, tmp_path, arrays, reason):
    np.savez(tmp_path / "a.npz", **arrays)
    with pytest.raises(Exception, match=reason):
        read_archives(spark, str(tmp_path / "a.npz")).count()


def test_broken_archives(spark, tmp_path):
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    with pytest.raises(Exception, match="invalid archive"):
        read_archives(spark, str(tmp_path / "bad.npz")).count()
    with pytest.raises(Exception, match="no archive at"):
        read_archives(spark, str(tmp_path / "none.npz"))
    np.savez(tmp_path / "one.npz", a=np.zeros(1))
    np.savez(tmp_path / "two.npz", b=np.zeros(1))
    with pytest.raises(Exception, match="and not"):
        read_archives(spark, str(tmp_path / "[ot]*.npz")).count()
    with pytest.warns(UserWarning), zipfile.ZipFile(tmp_path / "twice.npz", "w") as out:
        for _ in range(2):
            out.write(tmp_path / "one.npz", "a.npy")
    with pytest.raises(Exception, match="repeats a member"):
        read_archives(spark, str(tmp_path / "twice.npz")).count()


def test_exact_coverage_of_the_transcript(spark, tmp_path):
    np.savez(tmp_path / "a.npz", keys=np.array(["S:1:0", "S:1:1"]), vectors=np.eye(2))
    archive = read_archives(spark, str(tmp_path / "a.npz"))
    turns = [("C", "S:1", 0, "hi"), ("C", "S:1", 1, "yes")]
    got = stream_vectors(archive, spark.createDataFrame(turns, TURNS)).orderBy("turn_idx").collect()
    assert [(r.text, r.vec) for r in got] == [("hi", [1.0, 0.0]), ("yes", [0.0, 1.0])]
    for wrong, reason in ((turns[:1], "archive row without a turn"), ([*turns, ("C", "S:2", 0, "more")], "turn without an archive row")):
        with pytest.raises(ContractViolation, match=reason):
            stream_vectors(archive, spark.createDataFrame(wrong, TURNS))
    with pytest.raises(ContractViolation, match="repeats a turn"):
        stream_vectors(archive.union(archive), spark.createDataFrame(turns, TURNS))


def test_registry_read_from_an_archive(spark, tmp_path):
    np.savez(tmp_path / "r.npz", speaker_id=np.array(["V1", "V2"]), prototype=np.eye(2), assigned_turns=np.array([3, 4]), updates=np.array([0, 1]))
    registry = read_archives(spark, str(tmp_path / "r.npz"))
    check_registry(registry, 7)
    with pytest.raises(ContractViolation):
        check_registry(registry, 8)
