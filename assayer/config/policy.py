"""The linear scoring policy and the parameter steps a sweep may try."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Feature order, weights, thresholds and signal words.
FEATURES = (
    "retrieval_score",
    "matched_keyword_count",
    "title_protocol_hits",
    "title_experimental_hits",
    "abstract_protocol_hits",
    "abstract_outcome_hits",
    "negative_signal_hits",
    "doi_present",
    "journal_present",
    "recent_year",
    "discovery_ranking_score",
    "discovery_relevance_score",
    "authority_score",
    "source_diversity_score",
    "multi_source_evidence",
    "full_text_link",
    "open_access_full_text",
)
WEIGHTS = {
    "bias": -0.2,
    "retrieval_score": 2.4,
    "matched_keyword_count": 1.0,
    "title_protocol_hits": 0.95,
    "title_experimental_hits": 0.9,
    "abstract_protocol_hits": 0.65,
    "abstract_outcome_hits": 0.0,
    "negative_signal_hits": -1.3,
    "doi_present": 0.3,
    "journal_present": 0.2,
    "recent_year": 0.05,
    "discovery_ranking_score": 2.1,
    "discovery_relevance_score": 1.8,
    "authority_score": 1.8,
    "source_diversity_score": 0.4,
    "multi_source_evidence": 1.6,
    "full_text_link": 0.8,
    "open_access_full_text": 0.8,
}
PROTOCOL_SIGNALS = (
    "cryopreservation", "cryopreserved", "vitrification", "vitrified", "freeze",
    "freezing", "frozen", "warming", "thaw", "preservation",
)
EXPERIMENTAL_SIGNALS = (
    "effect", "effects", "evaluation", "compare", "comparison", "improves", "improved",
    "viability", "function", "functional", "morphology", "survival", "ultrastructure",
)
OUTCOME_SIGNALS = (
    "viability", "function", "functional", "morphology", "survival",
    "fertility", "follicle", "follicular", "insulin", "transplant",
)
NEGATIVE_SIGNALS = (
    "review", "mini-review", "commentary", "book chapter", "editorial", "opinion", "freeze-all", "fibroblast",
)
# Fixed values: (parameter, step, lowest, highest) of the sweep.
STEPS = (
    ("bias", 0.2, -3.0, 3.0),
    ("retrieval_score", 0.2, -1.0, 5.0),
    ("matched_keyword_count", 0.15, -1.0, 4.0),
    ("title_protocol_hits", 0.15, -2.0, 4.0),
    ("title_experimental_hits", 0.15, -2.0, 4.0),
    ("abstract_protocol_hits", 0.15, -2.0, 4.0),
    ("abstract_outcome_hits", 0.15, -2.0, 4.0),
    ("negative_signal_hits", 0.2, -5.0, 1.0),
    ("doi_present", 0.1, -1.0, 2.0),
    ("journal_present", 0.1, -1.0, 2.0),
    ("recent_year", 0.1, -2.0, 2.0),
    ("promote", 0.15, 0.0, 8.0),
    ("review", 0.15, 0.0, 8.0),
)
# What a sweep must reach to accept a variant.
MIN_SCORE_DELTA = 0.001
MIN_PROMOTE_PRECISION = 0.75
MIN_PROMOTE_RECALL = 0.02


@dataclass(frozen=True)
class Policy:
    policy_id: str = "base"
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    promote: float = 5.2
    review: float = 2.2
    protocol_signals: tuple[str, ...] = PROTOCOL_SIGNALS
    experimental_signals: tuple[str, ...] = EXPERIMENTAL_SIGNALS
    outcome_signals: tuple[str, ...] = OUTCOME_SIGNALS
    negative_signals: tuple[str, ...] = NEGATIVE_SIGNALS

    def value(self, name: str) -> float:
        if name in ("promote", "review"):
            return getattr(self, name)
        return self.weights[name]

    def with_value(self, name: str, value: float, policy_id: str) -> Policy:
        if name in ("promote", "review"):
            return replace(self, policy_id=policy_id, **{name: value})
        if name not in self.weights:
            raise KeyError(f"no policy parameter {name!r}")
        return replace(self, policy_id=policy_id, weights={**self.weights, name: value})

    def variants(self) -> list[Policy]:
        """Every single-parameter step that stays inside its bounds."""
        out = []
        for name, step, low, high in STEPS:
            for sign in (1, -1):
                value = round(self.value(name) + sign * step, 4)
                if low <= value <= high:
                    out.append(self.with_value(name, value, f"{name}:{value:g}"))
        return out


DEFAULT_POLICY = Policy()
