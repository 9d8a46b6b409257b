"""Running top-k inside one task: scored pairs never leave it, winners do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from colloquy.operators.ranking import SCORE_DIGITS

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
# Scores held at once per task.
SCORE_BLOCK = 1 << 20
# Candidates that wait before they are sorted into the winners.
COMPACT_AT = 200_000


def _codes(values: np.ndarray) -> np.ndarray:
    """Integers that sort like the values."""
    return values if values.dtype.kind in "iu" else np.unique(values, return_inverse=True)[1]


def row_runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of whole rows whose sizes add up to ``limit`` at most, or of one larger row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


class LocalTopK:
    """Best ``k`` (question, node) pairs per question and optional group."""

    def __init__(self, names: list[tuple], name_types: list[str], node_type: str, k: int, group_type: str | None = None):
        self.names, self.name_types, self.node_type, self.k, self.group_type = names, name_types, node_type, k, group_type
        self.parts: tuple | None = None
        self.fresh: list[tuple] = []
        self.waiting = 0
        self.floor = np.full(len(names), -np.inf)

    def offer(self, scores: np.ndarray, ids: np.ndarray, groups: np.ndarray | None = None, positive: bool = False, allowed: np.ndarray | None = None) -> None:
        """Take a (nodes x questions) score block, optionally masked."""
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        exact, scores = scores, np.round(scores, SCORE_DIGITS)
        n = len(scores)
        if groups is None:
            low = self.floor
            if n > self.k:
                low = np.maximum(low, np.partition(scores, n - self.k, axis=0)[n - self.k])
            wanted = scores >= low
        else:
            wanted = np.ones(scores.shape, dtype=bool)
        if positive:
            wanted &= scores > 0
        elif allowed is not None:
            wanted &= allowed
        rows, q = np.nonzero(wanted)
        if not len(rows):
            return
        self.fresh.append((q, exact[rows, q], ids[rows], (groups[rows] if groups is not None else np.zeros(len(rows), dtype=np.int64))))
        self.waiting += len(q)
        if self.waiting > max(COMPACT_AT, self.k * len(self.names)):
            self._compact()

    def _compact(self) -> None:
        """Sort what waits into the winners; many questions are not re-sorted per block."""
        if not self.fresh:
            return
        blocks = ([self.parts] if self.parts is not None else []) + self.fresh
        q, x, i, g = (np.concatenate(columns) for columns in zip(*blocks))
        self.fresh, self.waiting = [], 0
        s = np.round(x, SCORE_DIGITS)
        order = np.lexsort((_codes(i), -s, _codes(g), q))
        qs, gs = q[order], _codes(g)[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (qs[1:] != qs[:-1]) | (gs[1:] != gs[:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        keep = order[place < self.k]
        self.parts = (q[keep], x[keep], i[keep], g[keep])
        if self.group_type is None:
            full = order[place == self.k - 1]
            self.floor[q[full]] = s[full]

    def batch(self, key_names: list[str]) -> pa.RecordBatch | None:
        self._compact()
        if self.parts is None:
            return None
        q, x, i, g = self.parts
        columns = [pa.array([self.names[j][c] for j in q], ARROW[t]) for c, t in enumerate(self.name_types)]
        columns += [pa.array(i.tolist(), ARROW[self.node_type]), pa.array(x)]
        fields = [*key_names, "node_id", "score"]
        if self.group_type:
            columns.append(pa.array(g.tolist(), ARROW[self.group_type]))
            fields.append("grp")
        return pa.RecordBatch.from_arrays(columns, names=fields)
