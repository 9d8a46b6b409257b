import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.config import FragmentPolicy
from colloquy.operators.assignment import assign, assignments
from colloquy.operators import context, facts, fragments, graph, naming, speakers

TURN = "case_id string, session_id string, turn_idx int, cluster string, text string"


def dialogue(spark, rows):
    return spark.createDataFrame([("C", "S1", i, c, t) for i, (c, t) in enumerate(rows)], TURN)


def test_self_and_response_events(spark):
    t = dialogue(spark, [("A", "Hello, I'm Alice Chen."), ("B", "Alice, are you in?"), ("A", "Yes."), ("B", "Okay, then we go."), ("A", "Alice, and Bob, come"), ("B", "ok")])
    assert [(r.cluster, r.name) for r in naming.self_events(t).collect()] == [("A", "Alice Chen")]
    assert [(r.cluster, r.name, r.source_turn) for r in naming.response_events(t).collect()] == [("A", "Alice", 1)]


def test_hub_and_middle_vocatives(spark):
    t = dialogue(spark, [("H", "Well, Bob. what now"), ("B", "x"), ("H", "look, Cara: now"), ("C", "y"), ("H", "well then, Bob. again"), ("B", "z")])
    assert [r.cluster for r in naming.hub_clusters(t).collect()] == ["H"]
    got = {(r.cluster, r.name): r.accepted for r in naming.accepted_events(t).collect() if r.pattern == "mid_vocative"}
    assert got == {("B", "Bob"): True, ("C", "Cara"): False}


def test_cluster_names_and_identities(spark):
    events = spark.createDataFrame(
        [("C", "S1", "A", "Alice", "direct_response", "vocative", 1, 2, True, True), ("C", "S1", "A", "Bob Lee", "self_identification", "self", 3, 3, True, True),
         ("C", "S2", "B", "Bob", "direct_response", "vocative", 1, 2, True, True), ("C", "S2", "D", "Dana", "direct_response", "vocative", 4, 5, True, True),
         ("C", "S2", "D", "Eve", "direct_response", "vocative", 6, 7, True, True)],
        "case_id string, session_id string, cluster string, name string, event_type string, pattern string, source_turn int, speaker_turn int, valid boolean, accepted boolean",
    )
    clusters = spark.createDataFrame([("C", c) for c in "ABDZ"], "case_id string, cluster string")
    named = naming.cluster_names(events, clusters)
    got = {r.cluster: (r.name, r.status) for r in named.collect()}
    assert got == {"A": ("Bob Lee", "resolved"), "B": ("Bob", "resolved"), "D": (None, "conflict"), "Z": (None, "unknown")}
    ids = {r.cluster: (r.identity, r.name) for r in naming.stable_identities(named).collect()}
    assert ids["A"] == ids["B"] == ("IDENTITY_001", "Bob Lee") and ids["D"][0] == "IDENTITY_002"


def test_joint_assignment_equals_enumeration():
    rng = random.Random(2)
    for _ in range(80):
        ids, names = [f"s{i}" for i in range(rng.randint(1, 4))], "abc"
        scores = {s: {n: rng.randint(1, 3) * 100 for n in names if rng.random() < 0.6} for s in ids}
        best = None
        for pick in itertools.product(*[["", *scores[s]] for s in ids]):
            used = [p for p in pick if p]
            if len(used) == len(set(used)):
                key = (-sum(scores[s][p] for s, p in zip(ids, pick) if p), -len(used), pick)
                best = key if best is None or key < best else best
        assert assign(scores) == {s: p for s, p in zip(ids, best[2]) if p}


def test_assignment_of_forty_aliases(spark):
    """No state per subset: forty rivals for forty aliases, and what parts of a case share nothing."""
    rng = random.Random(4)
    ids, names = [f"s{i:02d}" for i in range(40)], [f"n{i:02d}" for i in range(40)]
    scores = {s: {n: rng.randint(1, 40) for n in rng.sample(names, 12)} for s in ids}
    chosen = assign(scores)
    assert len(set(chosen.values())) == len(chosen)
    # Subsets of partners still check a corner of it.
    corner = {s: {n: g for n, g in scores[s].items() if n in names[:12]} for s in ids[:12]}
    best = {0: 0}
    for row in corner.values():
        grown = dict(best)
        for used, value in best.items():
            for n, g in row.items():
                bit = 1 << names.index(n)
                if not used & bit:
                    grown[used | bit] = max(grown.get(used | bit, 0), value + g)
        best = grown
    assert sum(corner[s][n] for s, n in assign(corner).items()) == max(best.values())
    rows = [("C", s, n, g) for s, row in scores.items() for n, g in row.items()] + [("D", "x", "al", 5), ("D", "y", "al", 5), ("D", "z", "bo", 1)]
    got = {(r.case_id, r.stable): r.alias for r in assignments(spark.createDataFrame(rows, "case_id string, stable string, alias string, score bigint"), "case_id", "stable", "alias", "score").collect()}
    assert {s: a for (c, s), a in got.items() if c == "C"} == chosen
    # An equal claim leaves the first name open: the smallest choice.
    assert {s: a for (c, s), a in got.items() if c == "D"} == {"y": "al", "z": "bo"}


def test_alias_stages(spark):
    rows = [("C", "x", "al", "self_identification", "S1"), ("C", "y", "bo", "direct_response", "S1"), ("C", "y", "bo", "direct_response", "S2"),
            ("C", "z", "bo", "direct_response", "S1"), ("C", "z", "bo", "direct_response", "S1"), ("C", "w", "al", "direct_response", "S1"), ("C", "w", "al", "direct_response", "S2")]
    stats = naming.alias_stats(spark.createDataFrame(rows, "case_id string, stable string, alias string, event_type string, session_id string"))
    ids = spark.createDataFrame([("C", s, "cy" if s == "z" else "") for s in "xyzw"], "case_id string, stable string, current string")
    got = {r.stable: (r.alias, r.reason) for r in naming.resolve_aliases(stats, ids).collect()}
    assert got == {"x": ("al", "self_identification"), "y": ("bo", "global_one_to_one_direct_response"), "z": ("cy", "preserved_upstream_resolution")}


def test_alias_key(spark):
    df = spark.createDataFrame([("Dr.  Alice Chen",), ("ＢＯＢ!",), ("Mr",), ("",)], "n string")
    assert [r[0] for r in df.select(naming.alias_key("n")).collect()] == ["alice", "bob", "mr", ""]


def _components(v, t):
    n, seen, out = len(v), {}, []
    for i in range(n):
        if i in seen:
            continue
        stack, seen[i] = [i], len(out) + 1
        while stack:
            a = stack.pop()
            for b in range(n):
                if b not in seen and float(v[a] @ v[b]) >= t:
                    seen[b] = seen[i]
                    stack.append(b)
        out.append(i)
    return [seen[i] for i in range(n)]


@pytest.mark.parametrize("block", [graph.BLOCK, 7])
def test_components_with_blocks_and_copies(spark, monkeypatch, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 3))
    v[40:] = v[3]  # a third are copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    real = graph.block_pairs
    monkeypatch.setattr(graph, "block_pairs", lambda df, case, node: real(df, case, node, block))
    df = spark.createDataFrame([("C", i, v[i].tolist()) for i in range(60)], "case_id string, node_id bigint, vec array<double>")
    edges = graph.similar_edges(df, 0.9)
    assert edges.count() < 60 * 3
    got = {r.node_id: r.component for r in graph.numbered(graph.components(df, edges)).collect()}
    assert [got[i] for i in range(60)] == _components(v, 0.9)


def test_long_chain_closes(spark):
    edges = spark.createDataFrame([("C", i, i + 1) for i in range(150)], "case_id string, a bigint, b bigint")
    nodes = spark.createDataFrame([("C", i) for i in range(152)], "case_id string, node_id bigint")
    roots = {r.node_id: r.root for r in graph.components(nodes, edges).collect()}
    assert all(roots[i] == 0 for i in range(151)) and roots[151] == 151


def test_fragment_merges_into_its_speaker(spark):
    rng = np.random.default_rng(4)
    a, b = np.eye(16)[0], np.eye(16)[1]
    rows = []
    for i in range(30):
        base, label = (a, "A") if i < 12 else (b, "B") if i < 24 else (a, "frag")
        v = base + rng.normal(scale=0.05, size=16)
        rows.append(("C", f"S{i % 2}", f"n{i:02d}", label, (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame(rows, "case_id string, session_id string, node_id string, label string, vec array<double>")
    counts, sizes = graph.cosine_counts(df), fragments.cluster_sizes(df)
    got = {r.label: r.final for r in fragments.reconcile(counts, sizes, FragmentPolicy(max_size_ratio=0.6)).collect()}
    assert got["frag"] == got["A"] == "MERGED_001" and got["B"] == "B"


def test_registry_matches_updates_and_tiers(spark):
    reg = speakers.Registry(speakers.OnlinePolicy())
    assert reg.ingest(np.array([1.0, 0.0]))[:2] == ("ONLINE_SPK_001", True)
    assert reg.ingest(np.array([0.0, 1.0]))[:2] == ("ONLINE_SPK_002", True)
    name, created, cos, runner, updated = reg.ingest(np.array([0.8, 0.6]))
    assert (name, created, updated) == ("ONLINE_SPK_001", False, True) and (cos, runner) == (0.8, 0.6)
    blend = np.array([0.99, 0.03])
    assert np.allclose(reg.prototypes[0], blend / np.linalg.norm(blend))
    rows = [(q, r, n, s) for q, pair in {"hi": [("a", 1.0), ("b", 0.0)], "lo": [("a", 0.71), ("b", 0.70)], "no": [("a", -0.7), ("b", -0.7)]}.items() for r, (n, s) in enumerate(pair, 1)]
    out = speakers.asker_confidence(spark.createDataFrame(rows, "q string, rank int, node_id string, score double"), ["q"])
    assert {r.q: r.confidence for r in out.collect()} == {"hi": "high", "lo": "low", "no": "unresolved"}


def test_largest_assignment_equals_enumeration():
    rng = np.random.default_rng(8)
    for _ in range(60):
        w = rng.integers(1, 9, size=(rng.integers(1, 5), rng.integers(1, 5)))
        tall = w if w.shape[0] >= w.shape[1] else w.T
        best = max(sum(tall[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(tall.shape[0]), tall.shape[1]))
        pairs = assign({str(r): {str(c): int(w[r, c]) for c in range(w.shape[1])} for r in range(w.shape[0])})
        assert sum(w[int(r), int(c)] for r, c in pairs.items()) == best and len(pairs) == len(set(pairs.values())) == min(w.shape)


def test_hints_speakers_and_unanimity(spark):
    aliases = spark.createDataFrame([("P1", "Alice Chen"), ("P2", "Bob"), ("P3", "Alice Park")], "stable string, alias string")
    hints = spark.createDataFrame([(1, "@bob"), (2, "Alice"), (3, "alice  chen"), (4, "nobody")], "query_id int, hint string")
    got = {r.query_id: (r.stable, r.source) for r in facts.resolve_hints(hints, aliases).collect()}
    assert got == {1: ("P2", "exact_profile_alias"), 2: (None, "unresolved_or_ambiguous"), 3: ("P1", "exact_profile_alias"), 4: (None, "unresolved_or_ambiguous")}
    raw = spark.createDataFrame([("r1", "Una"), ("r2", "Mia"), ("r3", "una ")], "ref string, speaker string")
    asked = spark.createDataFrame([(1, "unknown", ["r1", "r3"]), (2, "@mia", ["r1", "r2"]), (3, "Zed", ["r1", "r2"]), (4, "Una", ["r9"])], "node_id int, proposed string, refer_ids array<string>")
    bound = {r.node_id: (r.speaker, r.source) for r in facts.bind_speakers(asked, raw).collect()}
    assert bound == {1: ("Una", "single_cited_speaker"), 2: ("Mia", "model_grounded_multi_speaker"), 3: (None, "not_a_cited_speaker"), 4: (None, "unknown_reference")}
    rows = spark.createDataFrame([("T1", "A"), ("T2", "A"), ("T3", "A")], "ref string, speaker_ref string")
    votes = spark.createDataFrame([("T1", "A", "Bob"), ("T1", "Z", "Eve"), ("T2", "A", "Bob"), ("T2", "A", "Cy")], "ref string, source_speaker_ref string, addressee string")
    assert {r.ref: r.addressee for r in context.unanimous_addressee(rows, votes).collect()} == {"T1": "Bob", "T2": "unknown", "T3": "unknown"}


def test_fact_checks_and_dedup(spark):
    none = F.array().cast("array<string>")
    base = spark.createDataFrame([("Lin chose it.", ["D1:1", "D1:2"], "human"), ("lin chose it", ["D1:2"], "user"), ("x", ["D9:99"], "user"), (" ", ["D1:1"], "user"), ("y", ["D1:1"], "robot")], "text string, refer_ids array<string>, source_role string")
    out = facts.normalise(base.withColumn("character", F.lit("Lin")).withColumn("image_ids", none).withColumn("context_operations", none).withColumn("valid_refs", F.array(F.lit("D1:1"), F.lit("D1:2"))).withColumn("valid_images", none))
    assert sorted(r.problem or "" for r in out.collect()) == ["", "", "empty_text", "invalid_refer_ids", "invalid_role"]
    kept = facts.deduplicate(out.filter("problem IS NULL")).collect()
    assert len(kept) == 1 and kept[0].refer_ids == ["D1:1", "D1:2"] and kept[0].copies == 2 and kept[0].context_operations == ["multi_turn_synthesis"]
    bound = spark.range(1).select(facts.bind_addressees(F.array(F.lit("@bob"), F.lit("nobody"), F.lit("BOB")), F.array(F.lit("Bob"), F.lit("Eve"))).alias("a"), facts.bind_addressees(F.array(F.lit("Bob"), F.lit("everyone")), F.array(F.lit("Bob"))).alias("g")).first()
    assert bound.a == ["Bob"] and bound.g == ["group"]


def test_components_follow_a_chain_of_any_length(spark):
    from colloquy.operators.graph import components

    edges = spark.createDataFrame([("c", i, i + 1) for i in range(400)], "case_id string, a int, b int")
    nodes = spark.createDataFrame([("c", i) for i in range(401)] + [("c", 900)], "case_id string, node_id int")
    assert {(r.node_id, r.root) for r in components(nodes, edges).collect()} == {(i, 0) for i in range(401)} | {(900, 900)}


def test_names_of_sessions_without_a_number(spark):
    from colloquy.operators.naming import cluster_names

    rows = [("c", s, "k", n, "self_identification", "self", 0, True) for s, n in (("session2", "Ann Lee"), ("S1", "Ann Lee"))]
    events = spark.createDataFrame(rows, "case_id string, session_id string, cluster string, name string, event_type string, pattern string, source_turn int, accepted boolean")
    got = cluster_names(events, events).collect()
    assert [(r.name, r.status, r.evidence) for r in got] == [("Ann Lee", "resolved", 2)]
