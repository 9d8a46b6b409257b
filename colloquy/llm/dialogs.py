"""Repair of conversations whose turns were dropped, blanked, cut, repeated or mislabelled.

Every turn is reduced to a signature of one letter: the initial of its role and its
fault.  What the cheapest repair of the rest of a conversation costs depends only on
the signatures from here to its end and on the state of the role grammar, so all
conversations share one automaton built from the end: the distinct signature strings,
sorted by their reversals, visit every shared suffix once.  A node keeps, per grammar
state, its cost-to-go and the first edit of the best audit from there; the four edits
have different initials, so ties for the least audit are settled at the node, and an
audit is read by walking the nodes.

Only signatures, a letter a turn as in the audit, are gathered per conversation.  Texts
pass once through a sorted stream, whatever a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.frames import long_of, stored

# [^\x20\x09-\x0D]: what is not one of these.
BLANKS = " \t\n\x0b\x0c\r"

# The grammar (s?(ua)+)?: start, after s, after u, after a; the first and last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Where a turn of the role that may be given or inserted leads, and that role.
FORCED = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
DELETE, INSERT, RELABEL, UNFINISHED = 2, 5, 1, 5
LEGAL = ("su", "ua", "au")

# A signature string held by at least this share of all conversations is joined by broadcast.
HOT_SHARE = 1 / 100


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` modulo 20 names.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4
    sets its role to user.  A null in any column counts as one space in key, role and text.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    chosen = rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return chosen.filter("kind <> 0").select("conv_id", "turn", "role", "text", copies).drop("col")


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns with the columns that fix their order: by turn, null first, then role, then a digest of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    plain = rows.select(long_of("conv_id").alias("conv_id"), long_of("turn").alias("turn"), role.alias("role"), text.alias("text"))
    return plain.withColumn("print", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order(*first: str) -> list[Column]:
    return [*map(F.col, first), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]


def _fault() -> Column:
    """First fault of a turn: blank, duplicate, truncated or none."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return (
        F.when(F.length(bare) == 0, "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature, gaps, blank, duplicate, truncated, illegal`` per conversation.

    A signature holds ``-`` for a turn that must go, else the role's initial (``x``
    unless it is s, u or a), as a capital if the turn is truncated.  A repeated turn
    is told by the earliest row of its conversation, role and text; such rows may be many, so
    they are numbered by a window, whose rows spill, and not held in a set.
    """
    seen = Window.partitionBy("conv_id", "print").orderBy(F.col("turn").asc_nulls_first())
    marked = _ordered(rows).withColumn("nth", F.row_number().over(seen)).withColumn("fault", _fault())
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    compact = marked.select("conv_id", "turn", "role", "print", "fault", symbol.alias("symbol"), known.alias("initial"))
    stream = compact.repartition("conv_id").sortWithinPartitions(*_order("conv_id")).select("conv_id", "turn", "fault", "symbol", "initial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns("conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")
        current, symbols = None, None
        for batch in batches:
            for conv, turn, fault, symbol, initial in zip(*(c.to_pylist() for c in batch.columns)):
                if symbols is None or conv != current:
                    if symbols is not None:
                        out.add(current, "".join(symbols), turns[1] - turns[0] + 1 - turns[2] if turns else 0, *faults, illegal)
                    current, symbols, turns, faults, illegal, last = conv, [], None, [0, 0, 0], 0, None
                symbols.append(symbol)
                if turn is not None:
                    turns = [turn, turn, 1] if turns is None else [turns[0], turn, turns[2] + (turn != turns[1])]
                if fault:
                    faults[("blank", "duplicate", "truncated").index(fault)] += 1
                illegal += last is not None and last + initial not in LEGAL
                last = initial
            yield from out.flushed(batch_rows=4096)
        if symbols is not None:
            out.add(current, "".join(symbols), turns[1] - turns[0] + 1 - turns[2] if turns else 0, *faults, illegal)
        yield from out.flushed()

    return stream.mapInArrow(run, "conv_id bigint, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")


class _Columns:
    """Rows collected by column for an Arrow batch."""

    def __init__(self, *names: str):
        self.names, self.types = names, {n: pa.string() if n in ("signature", "audit", "role", "text", "edit", "sha256") else pa.int64() for n in names}
        self.columns: list[list] = [[] for _ in names]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def flushed(self, batch_rows: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= batch_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=self.types[n]) for n, c in zip(self.names, self.columns)], names=list(self.names))
            self.columns = [[] for _ in self.names]


# Per grammar state: cost-to-go and first edit of the best audit, at the end of a conversation.
END = ((0, ""), (2 * INSERT, "I"), (INSERT, "I"), (0, ""))


def node(symbol: str, after: tuple) -> tuple:
    """A node's ``(cost, first edit)`` per grammar state, from its turn's symbol and the node after it."""
    role, extra = symbol.lower(), UNFINISHED if symbol.isupper() else 0
    plain = []
    for state in range(4):
        options = [(after[state][0] + DELETE, "D")]
        if symbol != "-":
            to = STEPS.get((state, role))
            if to is not None:
                options.append((after[to][0] + extra, "K"))
            options.append((after[FORCED[state]][0] + RELABEL + extra, "R"))
        plain.append(min(options))
    # An inserted turn leads to another state of the same node; a second one may follow it.
    best = list(plain)
    for state in (USER, ASSISTANT, START, SYSTEM):
        target = plain if state in (USER, ASSISTANT) else best
        best[state] = min(plain[state], (target[FORCED[state]][0] + INSERT, "I"))
    return tuple(best)


def walk(signature: str, nodes: list) -> str:
    """The best audit of a signature string; ``nodes[i]`` is the node of its last ``i`` turns."""
    out, state, left = [], START, len(nodes) - 1
    for symbol in signature:
        while (edit := nodes[left][state][1]) == "I":
            out.append(edit)
            state = FORCED[state]
        out.append(edit)
        if edit != "D":
            state = STEPS[state, symbol.lower()] if edit == "K" else FORCED[state]
        left -= 1
    while nodes[0][state][1]:
        out.append("I")
        state = FORCED[state]
    return "".join(out)


def audits(strings: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of distinct signature strings.

    Ranges of the strings sorted by their reversals share suffixes with their
    neighbours, so a task holds the nodes of one string at a time.
    """
    ranged = strings.select("signature", F.reverse("signature").alias("back")).repartitionByRange("back").sortWithinPartitions("back").select("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns("signature", "cost", "audit")
        last, nodes = "", [END]
        for batch in batches:
            for signature in batch.column(0).to_pylist():
                back = signature[::-1]
                shared = 0
                for a, b in zip(last, back):
                    if a != b:
                        break
                    shared += 1
                del nodes[shared + 1 :]
                for symbol in back[shared:]:
                    nodes.append(node(symbol, nodes[-1]))
                last = back
                out.add(signature, nodes[-1][START][0], walk(signature, nodes))
            yield from out.flushed()

    return ranged.mapInArrow(run, "signature string, cost bigint, audit string")


def diagnosed(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation of ``conv_id, turn, role, text``.

    Turns come by ``turn``, null first, ties by role and a digest of the text; a null role
    or text counts as one space.  A role without the initial s, u or a can't be kept.
    Conversations with a null id are one conversation.  Extra columns are ignored.
    """
    found = stored(signatures(rows), "signatures")
    strings = stored(found.groupBy("signature").agg(F.count("*").alias("n")), "strings")
    known = stored(audits(strings), "audits").join(strings, "signature")
    total = found.count()
    # At most as many strings as the share's inverse are hot, so they may be broadcast.
    hot = F.broadcast(known.filter(F.col("n") > total * HOT_SHARE).select("signature", "cost", "audit"))
    rest = known.filter(F.col("n") <= total * HOT_SHARE).select("signature", "cost", "audit")
    both = found.join(hot, "signature").unionByName(found.join(hot, "signature", "left_anti").join(rest, "signature"))
    return stored(both.drop("signature"), "diagnosed")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, edit`` of the repaired conversations, each in order within one partition.

    ``found`` is what :func:`diagnosed` says of the same rows.  Deleted turns are
    left out, inserted ones have an empty text and no turn.
    """
    turns = _ordered(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "print", "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("print"), F.col("audit").alias("text"))
    stream = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind")).select("conv_id", "kind", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns("conv_id", "place", "turn", "role", "text", "edit")
        conv, audit, at, state, place = None, "", 0, START, 0

        def inserts():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                place += 1
                out.add(conv, place, None, ROLES[state], "", "I")
                state, at = FORCED[state], at + 1

        for batch in batches:
            for now, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not kind:
                    inserts()
                    conv, audit, at, state, place = now, text, 0, START, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                place += 1
                out.add(conv, place, turn, role if edit == "K" else ROLES[state], text, edit)
                state = STEPS[state, role[:1]] if edit == "K" else FORCED[state]
            yield from out.flushed()
        inserts()
        yield from out.flushed()

    return stream.mapInArrow(run, "conv_id bigint, place bigint, turn bigint, role string, text string, edit string")


def transcripts(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the ``role:text`` lines of each conversation of :func:`repaired`, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Columns("conv_id", "sha256")
        conv, state = None, None
        for batch in batches:
            for now, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}".encode()
                if place == 1:
                    if state is not None:
                        out.add(conv, state.hexdigest())
                    conv, state = now, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield from out.flushed()
        if state is not None:
            out.add(conv, state.hexdigest())
        yield from out.flushed()

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id bigint, sha256 string")


def digest(original: DataFrame, found: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation of ``original``; zeros, no edits and the digest of nothing where no turn is left."""
    ids = original.select(long_of("conv_id").alias("conv_id")).distinct()
    hashed = transcripts(turns).withColumnRenamed("conv_id", "hashed_id")
    named = found.withColumnRenamed("conv_id", "found_id")
    joined = ids.join(named, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
