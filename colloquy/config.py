"""Retrieval limits and policies (defaults are the published frozen values)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Fixed values.
RRF_K = 60
LAYER_WEIGHT = {"raw": 1.0, "fact": 0.75, "collection": 1.0}
DEFAULT_ROUND_BUDGETS = (30, 8, 5, 3, 2)
WINDOW_SIZE = 12
WINDOW_STRIDE = 6
TRUE_WORDS = frozenset({"1", "true", "yes", "on"})


def flag(settings: Mapping[str, str], name: str) -> bool:
    """A switch is on only when spelled out as one of the true words."""
    return str(settings.get(name, "")).strip().lower() in TRUE_WORDS


def _int(value, default: int) -> int:
    try:
        return int(str(value).strip())
    except ValueError:
        return default


@dataclass(frozen=True)
class RoundLimits:
    """How many retrieval rounds run and how many rows each may admit."""

    max_rounds: int = 5
    budgets: tuple[int, ...] = DEFAULT_ROUND_BUDGETS
    top_k: int = 30

    @classmethod
    def parse(cls, settings: Mapping[str, str]) -> "RoundLimits":
        rounds = min(5, max(1, _int(settings.get("max_rounds", "5"), 5)))
        listed = [part.strip() for part in str(settings.get("round_budgets", "")).split(",")]
        budgets = [max(1, int(part)) for part in listed if part.lstrip("+-").isdigit()]
        budgets = budgets or list(DEFAULT_ROUND_BUDGETS)
        while len(budgets) < rounds:
            budgets.append(max(1, budgets[-1] // 2))
        # A later round never looks at more rows than the one before it.
        running = budgets[0]
        capped = []
        for value in budgets[:rounds]:
            running = min(running, value)
            capped.append(running)
        top_k = min(60, max(10, _int(settings.get("final_top_k", "30"), 30)))
        return cls(rounds, tuple(capped), top_k)


@dataclass(frozen=True)
class ExecutorProfile:
    """The three benchmark executors differ only in these settings."""

    candidate_k: int = 30
    top_k: int = 30
    neighbor_radius: int = 1
    adjacent_weight: float = 0.35
    consensus: bool = True
    member_facts: int = 8
    quota_floor: int = 2
    quota_cap: int = 8
    # A collection stands for the turns it cites, in order, instead of for its best member facts.
    promote_refs: bool = False


GALLERY = ExecutorProfile(promote_refs=True)
MULTI_PARTY = ExecutorProfile()
AUDIO = ExecutorProfile(neighbor_radius=0, consensus=False, quota_cap=2)


@dataclass(frozen=True)
class OnlinePolicy:
    """One-pass prototype matching."""

    match_cosine: float = 0.35
    update_cosine: float = 0.40
    alpha: float = 0.05


@dataclass(frozen=True)
class FragmentPolicy:
    """Offline reconciliation of small acoustic fragments."""

    graph_cosine: float = 0.55
    max_size_ratio: float = 1.0 / 3.0
    top_pairs: int = 5
    min_separation: float = 1.50
    min_cohesion: float = 0.70
    min_session_overlap: float = 0.50
    min_singleton_target: int = 10
    min_singleton_mean: float = 0.35
    min_singleton_margin: float = 0.075
    min_singleton_separation: float = 1.25


BOUNDARY_FRAGMENTS = FragmentPolicy(min_separation=1.25, min_cohesion=0.50)


@dataclass(frozen=True)
class AskerPolicy:
    """Confidence tiers of a question's voice against the registry."""

    match: float = 0.35
    high: float = 0.40
    margin: float = 0.02
