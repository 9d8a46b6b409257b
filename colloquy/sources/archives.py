"""Archives of arrays (``.npz``) as a Spark data source, and what a case expects of them.

Every member's first axis is the row axis.  A partition is a run of rows of one
archive, read out of its members without unpacking them whole, so one large archive is
read by many tasks.  Paths must open on every executor, as a shared mount does.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from colloquy.errors import ContractViolation
from colloquy.operators.audits import require_empty

ROWS = 65_536
BATCH = 4096
_ARROW = {"b": pa.bool_(), "i": pa.int64(), "u": pa.int64(), "f": pa.float64(), "U": pa.string(), "S": pa.string()}
_DDL = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "U": "string", "S": "string"}


def _header(stream) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if fortran and len(shape) > 1:
        raise ContractViolation("arrays must be stored by rows")
    if dtype.hasobject or dtype.kind not in _ARROW:
        raise ContractViolation(f"arrays of {dtype} are not read")
    return shape, dtype


def members(path: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    """Shape and type of every member; a member name may occur once."""
    try:
        with zipfile.ZipFile(path) as archive:
            names = archive.namelist()
            if len(names) != len(set(names)):
                raise ContractViolation(f"{path} repeats a member")
            out = {}
            for name in names:
                with archive.open(name) as stream:
                    out[name.removesuffix(".npy")] = _header(stream)
            return out
    except (OSError, zipfile.BadZipFile) as error:
        raise ContractViolation(f"invalid archive {path}: {error}") from error


def _rows(path: str, name: str, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows ``low`` to ``high`` of a member, a batch at a time."""
    with zipfile.ZipFile(path) as archive, archive.open(f"{name}.npy") as stream:
        shape, dtype = _header(stream)
        width = int(np.prod(shape[1:], dtype=np.int64))
        stream.seek(low * width * dtype.itemsize, os.SEEK_CUR)
        for at in range(low, high, BATCH):
            n = min(BATCH, high - at)
            raw = stream.read(n * width * dtype.itemsize)
            yield np.frombuffer(raw, dtype=dtype).reshape(n, *shape[1:])


def _column(rows: np.ndarray) -> pa.Array:
    kind = _ARROW[rows.dtype.kind]
    if rows.dtype.kind == "S":
        rows = np.char.decode(rows, "utf-8")
    flat = pa.array(rows.ravel().tolist() if pa.types.is_string(kind) else rows.ravel(), type=kind, safe=True)
    if rows.ndim == 1:
        return flat
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


class Slice(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], rows: int):
        self.paths, self.names, self.rows = paths, names, rows

    def partitions(self) -> list[Slice]:
        out = []
        for path in self.paths:
            shapes = {name: shape for name, (shape, _) in members(path).items()}
            if set(shapes) != set(self.names):
                raise ContractViolation(f"{path} holds {sorted(shapes)} and not {sorted(self.names)}")
            lengths = {shape[0] if shape else -1 for shape in shapes.values()}
            if len(lengths) != 1 or -1 in lengths:
                raise ContractViolation(f"members of {path} differ in length: {shapes}")
            out += [Slice(path, low, min(low + self.rows, max(lengths))) for low in range(0, max(lengths), self.rows)]
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        at = partition.low
        for columns in zip(*(_rows(partition.path, name, partition.low, partition.high) for name in self.names)):
            n = len(columns[0])
            head = [pa.array([os.path.basename(partition.path)] * n), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays([*head, *map(_column, columns)], names=["archive", "row", *self.names])
            at += n


class ArrayArchives(DataSource):
    """``spark.read.format("arrays")``: ``archive, row`` and a column per member.

    Options: ``path``, a file or pattern; ``rows`` of a partition.  All archives must hold
    the members of the first; vectors become lists.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _paths(self) -> list[str]:
        found = sorted(glob.glob(self.options["path"]))
        if not found:
            raise ContractViolation(f"no archive at {self.options['path']}")
        return found

    def schema(self) -> str:
        fields = []
        for name, (shape, dtype) in members(self._paths()[0]).items():
            if len(shape) > 2:
                raise ContractViolation(f"{name} has {len(shape)} axes")
            fields.append(f"`{name}` " + (f"array<{_DDL[dtype.kind]}>" if len(shape) == 2 else _DDL[dtype.kind]))
        return "archive string, row bigint, " + ", ".join(fields)

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self._paths(), schema.names[2:], int(self.options.get("rows", ROWS)))


def read_archives(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(ArrayArchives)
    return spark.read.format("arrays").option("path", path).option("rows", rows).load()


def stream_vectors(archive: DataFrame, turns: DataFrame) -> DataFrame:
    """``(case_id, session_id, turn_idx, text, vec)``: the vectors of a case's turns, which they must cover exactly.

    ``archive(keys, vectors)`` names its rows ``session:turn``; ``turns(case_id,
    session_id, turn_idx, text)``.
    """
    place = F.regexp_extract("keys", r"^(.*):(\d+)$", 2)
    require_empty(archive.filter(place == "").select("keys"), "archive key without a turn")
    found = archive.select(F.regexp_extract("keys", r"^(.*):(\d+)$", 1).alias("session_id"), place.cast("int").alias("turn_idx"), F.col("vectors").alias("vec"))
    keys = ["session_id", "turn_idx"]
    require_empty(found.groupBy(*keys).count().filter("count > 1"), "archive repeats a turn")
    require_empty(found.select(*keys).join(turns, keys, "left_anti"), "archive row without a turn")
    require_empty(turns.select(*keys).join(found, keys, "left_anti"), "turn without an archive row")
    return turns.select("case_id", *keys, "text").join(found, keys).select("case_id", *keys, "text", "vec")
