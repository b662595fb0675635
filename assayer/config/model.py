"""What a subject area is: word lists, patterns and thresholds.

A registry is small, fixed configuration. It is compiled into literal column
expressions (so patterns compile once per task) and can be stored as, and
loaded from, plain rows: ``(domain, kind, position, label, value, weight)``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = "domain string, kind string, position int, label string, value string, weight double"

#: A registry larger than this is data, not configuration.
MAX_CONFIG_ROWS = 20_000


@dataclass(frozen=True)
class Concept:
    """A label that holds when any phrase occurs as whole words."""

    label: str
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class Specimen:
    label: str
    pattern: str
    weight: float


@dataclass(frozen=True)
class OutcomeRule:
    outcome_class: str
    strength: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class Alias:
    name: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class PhaseRule:
    phase: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class SharedRules:
    """Rules common to all domains."""

    chemicals: tuple[Alias, ...]
    species: tuple[tuple[str, str], ...]
    phases: tuple[PhaseRule, ...]
    required_concepts: tuple[Concept, ...]
    temperature: str
    duration: str
    concentration: str
    rate: str
    review_patterns: tuple[str, ...]
    methods_patterns: tuple[str, ...]
    commentary_patterns: tuple[str, ...]
    experimental_patterns: tuple[str, ...]
    study_terms: str
    preserving_terms: str
    process_context: str
    stepwise: str
    vitrification: str
    slow_freezing: str


@dataclass(frozen=True)
class Group:
    """Which papers a template counts under one name; unset tests do not apply."""

    experimental: bool = False
    specimen: str | None = None
    chemicals: tuple[str, ...] = ()
    family: str | None = None
    outcomes: tuple[str, ...] = ()
    title: str | None = None
    phase: str | None = None
    sparse: bool = False


@dataclass(frozen=True)
class Pick:
    """Values a template reports: a fixed list, or the distinct values of its groups."""

    groups: tuple[str, ...] = ()
    limit: int | None = None
    fixed: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """A hypothesis with the rule that says whether the corpus supports it.

    ``rule`` is a SQL boolean over the group names, which stand for counts.
    """

    title: str
    category: str
    confidence: float
    groups: tuple[tuple[str, Group], ...]
    rule: str
    chemicals: Pick
    specimens: Pick
    families: Pick
    titles: Pick
    claim: str = ""


@dataclass(frozen=True)
class DomainProfile:
    id: str
    label: str
    ingest_anchors: tuple[str, ...] = ()
    ingest_supporting: tuple[str, ...] = ()
    anchors: tuple[Concept, ...] = ()
    extra_required: tuple[Concept, ...] = ()
    context: tuple[Concept, ...] = ()
    title_methods: tuple[Concept, ...] = ()
    blocked: tuple[Concept, ...] = ()
    min_title_required: int = 1
    min_title_methods: int = 0
    text_prefix: str = "Source context"
    extra_chemicals: tuple[Alias, ...] = ()
    specimens: tuple[Specimen, ...] = ()
    outcomes: tuple[OutcomeRule, ...] = ()
    outcome_terms: str | None = None
    assessment: tuple[str, ...] = ()
    extra_review: tuple[str, ...] = ()
    extra_methods: tuple[str, ...] = ()
    extra_experimental: tuple[str, ...] = ()
    #: each rule is a list of patterns that must all occur in title + abstract
    experimental_rules: tuple[tuple[str, ...], ...] = ()
    templates: tuple[Template, ...] = ()
    generic_specimens: tuple[str, ...] = ()
    resolution_bonus: tuple[tuple[str, float], ...] = ()
    preferred_title: str | None = None
    benchmark_needs_both_families: bool = False
    commercial_bonus: float = 0.0


_TUPLE_FIELDS = {
    "anchor": ("anchors", Concept),
    "required": ("extra_required", Concept),
    "context": ("context", Concept),
    "title_method": ("title_methods", Concept),
    "blocked_title": ("blocked", Concept),
    "chemical": ("extra_chemicals", Alias),
}
_TEXT_FIELDS = {
    "ingest_anchor": "ingest_anchors",
    "ingest_supporting": "ingest_supporting",
    "assessment": "assessment",
    "review": "extra_review",
    "methods": "extra_methods",
    "experimental": "extra_experimental",
    "generic_specimen": "generic_specimens",
}
_SETTINGS = (
    "label",
    "min_title_required",
    "min_title_methods",
    "text_prefix",
    "outcome_terms",
    "preferred_title",
    "benchmark_needs_both_families",
    "commercial_bonus",
)


@dataclass(frozen=True)
class Registry:
    """All domains a job should handle, plus the rules they share."""

    domains: tuple[DomainProfile, ...]
    shared: SharedRules = field(repr=False)

    def ids(self) -> list[str]:
        return [d.id for d in self.domains]

    def get(self, domain: str) -> DomainProfile:
        for profile in self.domains:
            if profile.id == domain:
                return profile
        raise KeyError(f"unknown domain {domain!r}; known: {', '.join(self.ids())}")

    def with_domain(self, profile: DomainProfile) -> Registry:
        kept = tuple(d for d in self.domains if d.id != profile.id)
        return replace(self, domains=(*kept, profile))

    def chemicals(self, profile: DomainProfile) -> tuple[Alias, ...]:
        return (*self.shared.chemicals, *profile.extra_chemicals)

    def required(self, profile: DomainProfile) -> tuple[Concept, ...]:
        return (*self.shared.required_concepts, *profile.extra_required)

    def phases(self, profile: DomainProfile) -> tuple[PhaseRule, ...]:
        return tuple(
            replace(rule, patterns=(*rule.patterns, *profile.assessment)) if rule.phase == "assessment" else rule
            for rule in self.shared.phases
        )

    def by_domain(self, domain: Column, build: Callable[[DomainProfile], Column]) -> Column:
        """One expression that picks the domain's own rule set per row."""
        out = None
        for profile in self.domains:
            hit = domain == profile.id
            out = F.when(hit, build(profile)) if out is None else out.when(hit, build(profile))
        if out is None:
            raise ValueError("the registry has no domains")
        return out

    # -- configuration tables ------------------------------------------------

    def rows(self) -> list[tuple]:
        out: list[tuple] = []

        def add(domain: str, kind: str, items: Iterable[tuple[str | None, str, float | None]]) -> None:
            out.extend((domain, kind, i, label, value, weight) for i, (label, value, weight) in enumerate(items))

        for d in self.domains:
            for name in _SETTINGS:
                value = getattr(d, name)
                if value is not None:
                    add(d.id, f"setting:{name}", [(name, json.dumps(value), None)])
            for kind, (attr, _) in _TUPLE_FIELDS.items():
                add(
                    d.id,
                    kind,
                    [
                        (c.label if isinstance(c, Concept) else c.name, p, None)
                        for c in getattr(d, attr)
                        for p in (c.phrases if isinstance(c, Concept) else c.aliases)
                    ],
                )
            for kind, attr in _TEXT_FIELDS.items():
                add(d.id, kind, [(None, v, None) for v in getattr(d, attr)])
            add(d.id, "specimen", [(s.label, s.pattern, s.weight) for s in d.specimens])
            add(d.id, "outcome", [(f"{o.outcome_class}/{o.strength}", p, None) for o in d.outcomes for p in o.patterns])
            add(d.id, "experimental_rule", [(None, json.dumps(r), None) for r in d.experimental_rules])
            add(d.id, "resolution_bonus", [(s, s, b) for s, b in d.resolution_bonus])
            add(d.id, "template", [(t.title, json.dumps(_template_dict(t)), t.confidence) for t in d.templates])
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), ROW_SCHEMA)

    @staticmethod
    def from_frame(rows: DataFrame, shared: SharedRules) -> Registry:
        """Build a registry from configuration rows (a new domain is new rows)."""
        taken = rows.limit(MAX_CONFIG_ROWS + 1).collect()
        if len(taken) > MAX_CONFIG_ROWS:
            raise ValueError(f"a registry holds at most {MAX_CONFIG_ROWS} rows")
        found: dict[str, dict[str, list]] = {}
        for row in sorted(taken, key=lambda r: (r.domain, r.kind, r.position)):
            found.setdefault(row.domain, {}).setdefault(row.kind, []).append(row)
        domains = []
        for domain, kinds in found.items():
            values: dict[str, object] = {"id": domain, "label": domain}
            for kind, items in kinds.items():
                if kind.startswith("setting:"):
                    values[kind.split(":", 1)[1]] = json.loads(items[0].value)
                elif kind in _TUPLE_FIELDS:
                    attr, make = _TUPLE_FIELDS[kind]
                    grouped: dict[str, list[str]] = {}
                    for r in items:
                        grouped.setdefault(r.label, []).append(r.value)
                    values[attr] = tuple(make(k, tuple(v)) for k, v in grouped.items())
                elif kind in _TEXT_FIELDS:
                    values[_TEXT_FIELDS[kind]] = tuple(r.value for r in items)
                elif kind == "specimen":
                    values["specimens"] = tuple(Specimen(r.label, r.value, r.weight) for r in items)
                elif kind == "outcome":
                    rules: dict[str, list[str]] = {}
                    for r in items:
                        rules.setdefault(r.label, []).append(r.value)
                    values["outcomes"] = tuple(OutcomeRule(*k.split("/", 1), tuple(v)) for k, v in rules.items())
                elif kind == "experimental_rule":
                    values["experimental_rules"] = tuple(tuple(json.loads(r.value)) for r in items)
                elif kind == "resolution_bonus":
                    values["resolution_bonus"] = tuple((r.value, r.weight) for r in items)
                elif kind == "template":
                    values["templates"] = tuple(_template_from(json.loads(r.value)) for r in items)
                else:
                    raise ValueError(f"unknown configuration kind {kind!r}")
            domains.append(DomainProfile(**values))
        return Registry(tuple(domains), shared)


def _template_dict(t: Template) -> dict:
    out = {k: v for k, v in vars(t).items() if k not in ("groups", "chemicals", "specimens", "families", "titles")}
    out["groups"] = [[name, vars(g)] for name, g in t.groups]
    for name in ("chemicals", "specimens", "families", "titles"):
        out[name] = vars(getattr(t, name))
    return out


def _tuples(values: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}


def _template_from(raw: dict) -> Template:
    picks = {n: Pick(**_tuples(raw.pop(n))) for n in ("chemicals", "specimens", "families", "titles")}
    groups = tuple((name, Group(**_tuples(g))) for name, g in raw.pop("groups"))
    return Template(groups=groups, **picks, **raw)
