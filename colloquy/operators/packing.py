"""Sequential per-question algorithms: diverse packing, bundles, anchor packing.

Each call sees one question's candidates, whose number is set by channel depths,
never by the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GAIN_DIGITS = 12


def _xlogx(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v * np.log(np.maximum(v, 1)), 0.0)


def _effective(total: np.ndarray, clogc: np.ndarray) -> np.ndarray:
    """exp(entropy) of counts given their sum and sum of c ln c; zero when empty."""
    safe = np.maximum(total, 1)
    return np.where(total > 0, np.exp(np.log(safe) - clogc / safe), 0.0)


def diverse_selection(refs: list[list[str]], upper: list[bool], top_k: int, quota: int, expose_upper: bool) -> list[int]:
    """Indices in selection order.

    The first upper node leads, followed by at most ``quota`` rows that share its
    references; then rows that best mix rank, new references and low overlap.
    """
    n = len(refs)
    if top_k <= 0 or n == 0:
        return []
    names = {r: j for j, r in enumerate(dict.fromkeys(x for row in refs for x in row if x))}
    m = np.zeros((n, max(len(names), 1)))
    for i, row in enumerate(refs):
        for r in row:
            if r:
                m[i, names[r]] = 1.0
    size = m.sum(axis=1)
    shared = m @ m.T
    union = size[:, None] + size[None, :] - shared
    jaccard = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
    limit = top_k if expose_upper else top_k + 1
    counts = np.zeros(m.shape[1])
    overlap = np.zeros(n)
    free = np.ones(n, dtype=bool)
    chosen: list[int] = []

    def take(i: int) -> None:
        nonlocal counts, overlap
        chosen.append(i)
        free[i] = False
        counts = counts + m[i]
        overlap = np.maximum(overlap, jaccard[:, i])

    lead = next((i for i, u in enumerate(upper) if u), None)
    if lead is not None:
        take(lead)
        for i in np.flatnonzero(shared[lead] > 0):
            if len(chosen) >= limit or len(chosen) > quota:
                break
            if i != lead:
                take(int(i))
    relevance = 0.50 / (1.0 + np.arange(n))
    while len(chosen) < limit and free.any():
        novelty = np.where(size > 0, (m * (counts == 0)).sum(axis=1) / np.maximum(size, 1), 0.0)
        base = _xlogx(counts).sum()
        step = _xlogx(counts + 1) - _xlogx(counts)
        before = _effective(np.array(counts.sum()), base)
        after = _effective(counts.sum() + size, base + m @ step)
        spread = np.clip((after - before) / np.maximum(size, 1), -1.0, 1.0)
        gain = np.round(relevance + 0.25 * novelty + 0.25 * spread - 0.10 * np.where(size > 0, overlap, 0.0), GAIN_DIGITS)
        take(int(np.argmax(np.where(free, gain, -np.inf))))
    if not expose_upper:
        chosen = [i for i in chosen if not upper[i]][:top_k]
    return chosen


def pack_context(candidates: DataFrame, top_k: int = 30, expose_upper: bool = False, key: str = "query_id") -> DataFrame:
    """``(key, slot, node_id)`` from ``(key, idx, node_id, is_upper, refs, quota)``."""
    types = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx").drop_duplicates("node_id")
        order = diverse_selection([list(r) for r in pdf["refs"]], pdf["is_upper"].tolist(), top_k, int(pdf["quota"].iloc[0]), expose_upper)
        out = pdf.iloc[order][[key, "node_id"]]
        return out.assign(slot=np.arange(1, len(out) + 1, dtype=np.int32))[[key, "slot", "node_id"]]

    columns = candidates.select(key, "idx", "node_id", "is_upper", "refs", "quota")
    return columns.groupBy(key).applyInPandas(run, f"{key} {types[key]}, slot int, node_id {types['node_id']}")


def claim_groups(member_slots: dict[str, set[int]], ranks: dict[str, int]) -> list[list[int]]:
    """Groups of two to six rows, claimed greedily without sharing a row."""
    eligible = [(min(s), ranks[g], -len(s), g) for g, s in member_slots.items() if 2 <= len(s) <= 6]
    taken: set[int] = set()
    out = []
    for *_, g in sorted(eligible):
        left = sorted(member_slots[g] - taken)
        if len(left) >= 2:
            out.append(left)
            taken.update(left)
    return out


def evidence_bundles(context: DataFrame, key: str = "query_id") -> DataFrame:
    """``(key, new_slot, node_id, bundle)``: grouped rows made adjacent and chronological.

    ``context(key, slot, node_id, date_key, groups)`` where ``groups`` lists
    ``(group_id, source_rank)``; ``bundle`` is 0 for rows outside a group.
    """
    types = dict(context.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot").reset_index(drop=True)
        slots: dict[str, set[int]] = {}
        ranks: dict[str, int] = {}
        for i, groups in enumerate(pdf["groups"]):
            for g in groups:
                slots.setdefault(g["group_id"], set()).add(i)
                ranks[g["group_id"]] = min(ranks.get(g["group_id"], 2**31 - 1), g["source_rank"])
        home: dict[int, tuple[int, list[int]]] = {}
        for number, rows in enumerate(claim_groups(slots, ranks) if len(pdf) > 1 else [], 1):
            ordered = sorted(rows, key=lambda i: (pdf["date_key"][i], i))
            home.update({i: (number, ordered) for i in rows})
        order, bundle, done = [], [], set()
        for i in range(len(pdf)):
            number, rows = home.get(i, (0, [i]))
            if number and number in done:
                continue
            done.add(number)
            order += rows
            bundle += [number] * len(rows)
        out = pdf.iloc[order][[key, "node_id"]]
        return out.assign(new_slot=np.arange(1, len(out) + 1, dtype=np.int32), bundle=np.array(bundle, dtype=np.int32))[[key, "new_slot", "node_id", "bundle"]]

    return context.select(key, "slot", "node_id", "date_key", "groups").groupBy(key).applyInPandas(
        run, f"{key} {types[key]}, new_slot int, node_id {types['node_id']}, bundle int"
    )


def anchor_order(base: list[str], anchors: list[str], related: list[tuple[str, str]], state: list[str], top_k: int, prefix_len: int) -> list[str]:
    """A kept relevance prefix, anchors with their related rows, asker state, then filler."""
    base = list(dict.fromkeys(base))
    prefix = base[: min(prefix_len, top_k)]
    wanted: dict[str, str | None] = {}
    for node, owner in [(a, None) for a in anchors] + related + [(s, None) for s in state]:
        if node not in prefix and node not in wanted:
            wanted[node] = owner
    room = max(top_k - len(prefix), 0)
    extra = dict(list(wanted.items())[:room])
    packets: dict[str, list[str]] = {}
    for node, owner in extra.items():
        if owner is not None:
            packets.setdefault(owner, []).append(node)
    sequence: list[str] = []
    for node in prefix:
        sequence += [node, *packets.get(node, [])]
    for node in anchors:
        if node in extra:
            sequence += [node, *packets.get(node, [])]
    sequence += [n for n, owner in extra.items() if owner is None and n not in anchors]
    sequence += [n for rows in packets.values() for n in rows]
    filler = [n for n in base[len(prefix):] if n not in extra][: max(room - len(extra), 0)]
    return list(dict.fromkeys(sequence + filler))[:top_k]


def anchor_pack(rows: DataFrame, top_k: int = 30, prefix_len: int = 24, key: str = "query_id") -> DataFrame:
    """``(key, slot, node_id)`` from ``(key, part, pos, node_id, owner)``.

    ``part`` is ``base``, ``anchor``, ``related`` or ``state``.
    """
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pick = {p: g for p, g in pdf.groupby("part")}
        nodes = lambda p: pick[p]["node_id"].tolist() if p in pick else []
        related = list(zip(pick["related"]["node_id"], pick["related"]["owner"])) if "related" in pick else []
        order = anchor_order(nodes("base"), nodes("anchor"), related, nodes("state"), top_k, prefix_len)
        return pd.DataFrame({key: pdf[key].iloc[0], "slot": np.arange(1, len(order) + 1, dtype=np.int32), "node_id": order})

    return rows.select(key, "part", "pos", "node_id", "owner").groupBy(key).applyInPandas(run, f"{key} {types[key]}, slot int, node_id string")
