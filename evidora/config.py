"""Budgets, weights and limits of a run (UDF-04), with their declared defaults.

A knob that is not set has its declared default: an unset value never becomes 0.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    profile: str = "consumer_precision"
    elapsed_ms: int = 14000
    attempts: int = 8
    guarantee_extra_attempts: int = 1
    reasoner_timeout_ms: int = 3600
    reasoner_calls: int = 1
    phase_limits: tuple[tuple[str, int], ...] = (("primary", 3), ("fallback", 2), ("rescue", 1), ("micro", 1), ("revolving", 1), ("browse", 1))
    rrf_k: int = 60
    semantic_top_k: int = 24
    lexical_top_k: int = 18
    vector_top_k_cap: int = 80
    dominance_cap: float = 0.82
    min_relevance: float = 0.18
    max_results: int = 20
    min_chunk_chars: int = 450
    max_chunk_chars: int = 1400
    embedding_dim: int = 192
    max_per_fingerprint: int = 1
    max_per_court_day: int = 1
    recall_threshold: float = 0.55
    rate_limit: int = 40
    rate_window_s: int = 60
    cache_ttl_s: int = 300
    blocked_threshold: int = 3


# Declared (default, cap, least) budgets of the four profiles (fixed values).
PROFILES = {
    "consumer_precision": {"elapsed_ms": (14000, 20000, 5000), "attempts": (8, 10, 5), "guarantee_extra_attempts": (1, 2, 1), "reasoner_timeout_ms": (3600, 4500, 200), "reasoner_calls": (1, 1, 0), "phases": (3, 2, 1, 1, 1, 1)},
    "fast_balanced": {"elapsed_ms": (12000, 12000, 5000), "attempts": (6, 6, 4), "guarantee_extra_attempts": (1, 1, 1), "reasoner_timeout_ms": (3500, 3500, 200), "reasoner_calls": (1, 1, 0), "phases": (2, 2, 1, 1, 1, 1)},
    "recall_max": {"elapsed_ms": (20000, 35000, 5000), "attempts": (10, 14, 4), "guarantee_extra_attempts": (2, 4, 1), "reasoner_timeout_ms": (5500, 8000, 200), "reasoner_calls": (2, 2, 0), "phases": (3, 3, 2, 1, 1, 1)},
    "latency_first": {"elapsed_ms": (8000, 10000, 5000), "attempts": (5, 5, 4), "guarantee_extra_attempts": (1, 1, 1), "reasoner_timeout_ms": (2400, 2800, 200), "reasoner_calls": (1, 1, 0), "phases": (2, 1, 1, 1, 1, 1)},
}
_PHASES = ("primary", "fallback", "rescue", "micro", "revolving", "browse")


def parse_flag(value: str | None, default: bool) -> bool:
    """A boolean from text; anything unknown is the default."""
    word = (value or "").strip().lower()
    if word in {"1", "true", "yes", "on"}:
        return True
    if word in {"0", "false", "no", "off"}:
        return False
    return default


def profile_config(name: str = "consumer_precision", settings: Mapping[str, str] | None = None) -> Config:
    """The configuration of a profile; settings are texts by knob, held between a budget's least value and its cap."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}")
    budgets = PROFILES[name]
    config = Config(profile=name, phase_limits=tuple(zip(_PHASES, budgets["phases"])), **{k: v[0] for k, v in budgets.items() if k != "phases"})
    changed = {}
    for f in fields(Config):
        text = (settings or {}).get(f.name)
        if text is None or not str(text).strip():
            continue
        kind = type(getattr(config, f.name))
        if kind in (int, float):
            value = kind(float(text))
            if f.name in budgets:
                _, cap, least = budgets[f.name]
                value = min(cap, max(least, value))
            changed[f.name] = value
    return replace(config, **changed)
