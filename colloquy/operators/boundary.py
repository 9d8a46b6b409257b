"""Identities re-resolved from everything heard so far, as at a session boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.config import BOUNDARY_FRAGMENTS, FragmentPolicy
from colloquy.operators import fragments, graph, naming


def resolve_seen(heard: DataFrame, policy: FragmentPolicy = BOUNDARY_FRAGMENTS) -> DataFrame:
    """``(case_id, label, cluster, stable, name)`` per acoustic label.

    ``heard(case_id, session_id, turn_idx, node_id, label, vec, text)``.  Fragments
    merge first, names are read on the merged clusters, and clusters of one name
    family share the smallest label as stable id.
    """
    merged = fragments.reconcile(graph.cosine_counts(heard), fragments.cluster_sizes(heard), policy)
    smallest = merged.groupBy("case_id", "final").agg(F.min("label").alias("cluster"))
    clusters = merged.join(smallest, ["case_id", "final"]).select("case_id", "label", "cluster")
    spoken = heard.join(clusters, ["case_id", "label"]).select("case_id", "session_id", "turn_idx", "cluster", "text")
    named = naming.stable_identities(naming.cluster_names(naming.accepted_events(spoken), clusters))
    heads = named.groupBy("case_id", "identity").agg(F.min("cluster").alias("stable"))
    return clusters.join(named, ["case_id", "cluster"]).join(heads, ["case_id", "identity"]).select("case_id", "label", "cluster", "stable", "name")
