"""Words and word hashes of Arrow string columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes that are cut out of a batch at once; every array below is a small multiple of this.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
_POSITIONS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.arange(256, dtype=np.uint8)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that belong to a word: all but the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


# [^\x20\x09-\x0D]+
BLANK_SEPARATED = byte_class((0x20, 0x20), (0x09, 0x0D))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(_POSITIONS * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_TABLES = {0: _table(0x5851F42D), 1: _table(0x14057B7E)}


@dataclass
class Words:
    """The words of consecutive documents; ``first[d]:first[d + 1]`` are document d's."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    docs: int

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        width: type = np.int64
    elif pa.types.is_string(column.type):
        width = np.int32
    else:
        return string_buffers(column.cast(pa.string()))
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offs


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets)`` of runs of rows of about ``limit`` bytes, 4,096 rows at most.

    A run holds at least one row, so a longer text is a run of its own.
    """
    buf, offs = string_buffers(column)
    n, row = len(offs) - 1, 0
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), row + CHUNK_ROWS, n)
        yield row, stop, buf[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, fold: np.ndarray = KEEP) -> Words:
    """Maximal runs of word bytes; a word never crosses two documents."""
    if fold is not KEEP:
        buf = fold[buf]
    n = len(buf)
    inside = table[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    inner = offs[(offs > 0) & (offs < n)]
    begin[inner] |= inside[inner]
    finish[inner - 1] |= inside[inner - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    first = np.searchsorted(starts, offs)
    return Words(buf, starts, ends, first, len(offs) - 1)


def word_hashes(found: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: the sum of a random value per place and byte, mixed."""
    starts, ends = found.starts, found.ends
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    shift = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    where = place + np.repeat(starts - shift, lengths)
    place -= np.repeat(shift, lengths)
    letters = found.buf[where].astype(np.int64)
    far = lengths.max() > _POSITIONS
    if far:
        late = place >= _POSITIONS
        code = (np.minimum(place, _POSITIONS - 1) << 8) | letters
        values = _TABLES[seed][code]
        values[late] = mix((place[late].astype(np.uint64) << np.uint64(8) | letters[late].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + 77))
    else:
        values = _TABLES[seed][(place << 8) | letters]
    return mix(np.add.reduceat(values, shift) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; ``len(hashes) - width + 1`` values."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    n = len(hashes) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[k : k + n]
    return mix(out)
