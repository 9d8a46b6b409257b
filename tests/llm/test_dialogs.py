import hashlib
import itertools
import random
import re
import zlib


from colloquy.llm import dialogs
from colloquy.llm.dialogs import END, audits, damaged, diagnosed, digest, node, repaired, walk

COLUMNS = "conv_id bigint, turn bigint, role string, text string, audit string, n bigint, place string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", 3, None) for row in rows], COLUMNS)


def brute_repair(turns):
    """Cheapest edits over all edit strings with at most four insertions, by trying every one."""
    best = None

    def go(i, roles, lines, cost, audit, spare):
        nonlocal best
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if best and cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", roles):
            return
        if spare:
            for role in ("user", "assistant"):
                go(i, roles + role[0], [*lines, f"{role}:"], cost + 5, audit + "I", spare - 1)
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, roles, lines, cost + 2, audit + "D", spare)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, roles + role[:1], [*lines, f"{role}:{text}"], cost + extra, audit + "K", spare)
                for other in ("user", "assistant"):
                    go(i + 1, roles + other[0], [*lines, f"{other}:{text}"], cost + extra + 1, audit + "R", spare)

    go(0, "", [], 0, "", 4)
    return best


def brute(rows, damage=True):
    after = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20 if damage else 9
        role, text = told[2:]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in after.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, judged, faults = set(), [], []
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
            faults.append(fault)
        known = [t for t, _, _ in turns if t is not None]
        initials = [role[:1] for role, _, _ in judged]
        cost, audit, lines = brute_repair(judged)
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(rows):
    seen = diagnosed(rows)
    got = digest(rows, seen, repaired(rows, seen)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def talks(seed, count, longest=6):
    pick = random.Random(seed)
    texts = ["Fine.", "Well!", "Cut off", "Why? ", "", " \t\n", "So. \x0b", "End…", None, "Été."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    return [(conv, pick.choice([t, t, t, 3 * t, None]) if conv % 3 == 0 else t, pick.choice(roles), pick.choice(texts)) for conv in range(count) for t in range(pick.randrange(1, longest))]


def test_nodes_give_the_cheapest_and_least_edits():
    """Every signature of up to four turns against all edit strings."""
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for length in range(5):
        for symbols in itertools.product("suax-UA", repeat=length):
            nodes = [END]
            for symbol in reversed(symbols):
                nodes.append(node(symbol, nodes[-1]))
            faults = ["blank" if s == "-" else "truncated" if s.isupper() else "" for s in symbols]
            want = brute_repair([(roles[s.lower()], "t", f) for s, f in zip(symbols, faults)])
            assert (nodes[-1][0][0], walk("".join(symbols), nodes)) == want[:2], symbols


def test_conversations_after_damage(spark):
    rows = [*talks(1, 45), (None, 1, "user", "Hello."), (None, None, "assistant", "There."), (1000, None, None, None)]
    assert found(damaged(frame(spark, rows))) == {conv: row for conv, row in brute(rows).items() if conv in {r.conv_id for r in damaged(frame(spark, rows)).collect()}}


def test_query_returns_every_original_conversation(spark):
    rows = [(conv, turn, "user" if turn % 2 == 0 else "assistant", f"Turn {turn}.") for conv in range(200) for turn in range(1 + conv % 2)]
    data = frame(spark, rows)
    broken = damaged(data)
    seen = diagnosed(broken)
    got = {r.conv_id: tuple(r)[1:] for r in digest(data, seen, repaired(broken, seen)).collect()}
    want = brute(rows)
    assert got == want
    empty = [row for row in want.values() if row[-2] == ""]
    assert empty and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in empty


def test_repaired_turns_keep_order_and_texts(spark):
    rows = frame(spark, [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "And"), (1, 4, "assistant", "Fine."), (1, 4, "assistant", "Fine."), (2, 0, "user", "Why?")])
    seen = diagnosed(rows)
    got = [(r.conv_id, r.place, r.turn, r.role, r.text, r.edit) for r in repaired(rows, seen).orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, 0, "system", "Be kind.", "K"), (1, 2, 1, "user", "Hello.", "R"), (1, 3, 4, "assistant", "Fine.", "K")]
    assert {r.conv_id: r.audit for r in seen.collect()} == {1: "KRDKD", 2: "D"}


def test_long_conversation_and_hot_signature(spark, monkeypatch):
    long = [(7, t, "user" if t % 2 == 0 else "assistant", "x" * (t % 50) + ("." if t % 11 else "")) for t in range(4000)]
    rows = long + [(100 + c, t, ("user", "assistant")[t], f"Same {t}.") for c in range(200) for t in range(2)]
    data = frame(spark, rows)
    got = found(data)
    assert all(got[100 + c][:-1] == (0, 0, 0, 0, 0, 0, "KK") for c in range(200))
    assert len(got[7][-2]) == 4000 + got[7][-2].count("I")
    monkeypatch.setattr(dialogs, "HOT_SHARE", 2.0)
    assert found(data) == got


def test_shared_suffixes_over_ranges(spark):
    pick = random.Random(3)
    strings = {"".join(pick.choice("suaUA-x") for _ in range(pick.randrange(12))) for _ in range(300)} | {""}
    got = audits(spark.createDataFrame([(s,) for s in strings], "signature string").repartition(3)).collect()
    assert len(got) == len(strings)
    for row in got:
        nodes = [END]
        for symbol in reversed(row.signature):
            nodes.append(node(symbol, nodes[-1]))
        assert (row.cost, row.audit) == (nodes[-1][0][0], walk(row.signature, nodes))


def test_empty_table(spark):
    assert found(frame(spark, [])) == {}
