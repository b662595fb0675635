"""Keyword and concept matching, the candidate gate, and row-level predicates.

Everything here is a narrow projection: word lists become literal patterns, so a
scan is gated before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Concept, DomainProfile, Group, Registry
from ..config.defaults import SPARSE_IGNORED_PHASES
from ..functions.arrays import has_all, labels_where, string_array
from ..functions.numbers import fixed
from ..functions.text import matches, matches_any, phrase_pattern

# Relevance weights and gate minimums.
ANCHOR_WEIGHT, REQUIRED_WEIGHT, CONTEXT_WEIGHT = 7.0, 5.0, 2.0
MIN_TITLE_ANCHORS = MIN_ANCHORS = MIN_REQUIRED = 1


def keyword_domain_match(papers: DataFrame, registry: Registry) -> DataFrame:
    """One row per (paper, domain) with at least one anchor keyword as a substring.

    Each paper is tested against every domain inside its own row; only the hits
    are emitted.
    """
    hay = F.lower(F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))))

    def hits(words: Iterable[str], text: Column) -> Column:
        return F.filter(string_array(list(words)), lambda w: F.contains(text, w))

    text = F.col("_hay")
    per_domain = F.array(
        *[
            F.struct(
                F.lit(d.id).alias("domain"),
                hits(d.ingest_anchors, text).alias("anchors"),
                hits(d.ingest_supporting, text).alias("supporting"),
            )
            for d in registry.domains
        ]
    )
    keep = [c for c in papers.columns if c != "domain"]
    return (
        papers.withColumn("_hay", hay)
        .withColumn("_m", F.explode(F.filter(per_domain, lambda m: F.size(m.anchors) > 0)))
        .select(
            F.col("_m.domain").alias("domain"),
            *keep,
            (F.size("_m.anchors") * 2 + F.size("_m.supporting")).alias("score"),
            F.concat("_m.anchors", "_m.supporting").alias("matched_keywords"),
        )
    )


def concept_labels(lowered: Column, concepts: Iterable[Concept]) -> Column:
    """Labels of the concepts with a phrase in the lower-cased text, in configuration order."""
    return labels_where(
        [(c.label, matches_any(lowered, [phrase_pattern(p) for p in c.phrases], lowered)) for c in concepts]
    )


def concept_match(df: DataFrame, registry: Registry, text: str, kind: str, out: str) -> DataFrame:
    """Concept labels of the row's own domain; ``kind`` is a profile list such as ``anchors``."""

    def pick(d: DomainProfile) -> Column:
        concepts = registry.required(d) if kind == "required" else getattr(d, kind)
        return concept_labels(F.lower(F.col(text)), concepts)

    return df.withColumn(out, registry.by_domain(F.col("domain"), pick))


def coverage_relevance(records: DataFrame, registry: Registry) -> DataFrame:
    """Concept matches, relevance and the keep flag for each record's domain.

    Adds ``m`` (a struct of label arrays), ``matched_keywords``,
    ``relevance_score`` and ``keep``.
    """
    title = F.lower("title")
    hay = F.lower(F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))))

    def found(d: DomainProfile, title: Column, hay: Column) -> Column:
        required = registry.required(d)
        return F.struct(
            concept_labels(title, d.anchors).alias("title_anchors"),
            concept_labels(title, required).alias("title_required"),
            concept_labels(title, d.context).alias("title_context"),
            concept_labels(title, d.title_methods).alias("title_methods"),
            concept_labels(title, d.blocked).alias("blocked"),
            concept_labels(hay, d.anchors).alias("anchors"),
            concept_labels(hay, required).alias("required"),
            concept_labels(hay, d.context).alias("context"),
        )

    def relevance(d: DomainProfile, m: Column) -> Column:
        parts = [
            (ANCHOR_WEIGHT, m.anchors, len(d.anchors)),
            (REQUIRED_WEIGHT, m.required, len(registry.required(d))),
            (CONTEXT_WEIGHT, m.context, len(d.context)),
        ]
        total = F.lit(0.0)
        for weight, labels, size in parts:
            if size:
                total = total + F.size(labels) / F.lit(float(size)) * F.lit(weight)
        return fixed(total, 3)

    def keep(d: DomainProfile, m: Column) -> Column:
        return (
            (F.size(m.blocked) == 0)
            & (F.size(m.title_anchors) >= MIN_TITLE_ANCHORS)
            & (F.size(m.title_required) >= d.min_title_required)
            & (F.size(m.title_methods) >= d.min_title_methods)
            & (F.size(m.anchors) >= MIN_ANCHORS)
            & (F.size(m.required) >= MIN_REQUIRED)
        )

    def judge(d: DomainProfile) -> Column:
        # one-element arrays bind a value once; the generator above them stops a
        # later filter from being pushed down as a second copy of every pattern
        texts = F.array(F.struct(title.alias("title"), hay.alias("hay")))
        return F.transform(
            F.transform(texts, lambda t: found(d, t.title, t.hay)),
            lambda m: F.struct(
                m.alias("m"),
                F.array_union(F.array_union(m.anchors, m.required), m.context).alias("matched_keywords"),
                relevance(d, m).alias("relevance_score"),
                keep(d, m).alias("keep"),
            ),
        )

    return records.select("*", F.inline(registry.by_domain(F.col("domain"), judge)))


def title_gate(title: Column, registry: Registry) -> Column:
    """What the gate asks of a title alone.

    The lower-cased title is bound once, in an array of one; else it would be computed again for each pattern.
    """

    def hits(lowered: Column, concepts: Iterable[Concept]) -> Column:
        return F.size(concept_labels(lowered, concepts))

    def passes(d: DomainProfile) -> Column:
        return F.exists(
            F.array(F.lower(title)),
            lambda t: (hits(t, d.anchors) >= MIN_TITLE_ANCHORS)
            & (hits(t, registry.required(d)) >= d.min_title_required)
            & (hits(t, d.title_methods) >= d.min_title_methods)
            & (hits(t, d.blocked) == 0),
        )

    return F.coalesce(registry.by_domain(F.col("domain"), passes), F.lit(False))


def candidate_gate(records: DataFrame, registry: Registry) -> DataFrame:
    """Records worth keeping, with their keywords and relevance.

    Most records fail by their title; only the others' bodies are searched.
    """
    titled = records.where(title_gate(F.col("title"), registry))
    return coverage_relevance(titled, registry).where("keep").drop("m", "keep")


def meaningful_phases(phases: Column) -> Column:
    return F.array_except(F.array_distinct(phases), string_array(SPARSE_IGNORED_PHASES))


def in_group(group: Group) -> Column:
    """Selector over the evidence columns of an extraction row."""
    tests = []
    if group.experimental:
        tests.append(F.col("paper_type") == "experimental")
    if group.specimen:
        tests.append(F.array_contains("specimens", group.specimen))
    if group.chemicals:
        tests.append(has_all(F.col("chemicals"), string_array(group.chemicals)))
    if group.family:
        tests.append(F.col("family") == group.family)
    if group.outcomes:
        tests.append(F.arrays_overlap("outcomes", string_array(group.outcomes)))
    if group.title:
        tests.append(matches(F.col("title"), group.title))
    if group.phase:
        tests.append(F.array_contains("phases", group.phase))
    if group.sparse:
        named = F.array_except(F.array_distinct("phases"), string_array(["unknown"]))
        tests.append(F.size(named) == 1)
    out = F.lit(True)
    for test in tests:
        out = out & test
    return F.coalesce(out, F.lit(False))


def corpus_selectors(evidence: DataFrame, group: Group) -> DataFrame:
    return evidence.where(in_group(group))


def resolution_reasons(evidence: DataFrame) -> DataFrame:
    """Why a row still needs a person; rows without a reason drop out."""
    unknown_family = F.col("family") == "unknown"
    return evidence.withColumn(
        "reasons",
        labels_where(
            [
                ("unknown-protocol-family", unknown_family),
                ("unknown-paper-type", F.col("paper_type") == "unknown"),
                ("low-confidence", F.col("confidence") < 0.7),
                ("experimental-unknown-family", (F.col("paper_type") == "experimental") & unknown_family),
            ]
        ),
    ).where(F.size("reasons") > 0)


def resolution_priority(reasoned: DataFrame, registry: Registry) -> DataFrame:
    """Weighted reasons plus specimen bonuses plus a confidence term, one decimal."""
    # Points per reason.
    points = {
        "experimental-unknown-family": 6,
        "unknown-protocol-family": 4,
        "unknown-paper-type": 2,
        "low-confidence": 2,
    }
    score = F.lit(0.0)
    for reason, value in points.items():
        score = score + F.when(F.array_contains("reasons", reason), float(value)).otherwise(0.0)

    def bonus(d: DomainProfile) -> Column:
        total = F.lit(0.0)
        for specimen, value in d.resolution_bonus:
            total = total + F.when(F.array_contains("specimens", specimen), float(value)).otherwise(0.0)
        return total

    score = (
        score
        + registry.by_domain(F.col("domain"), bonus)
        + F.when(F.size("chemicals") > 0, 1.0).otherwise(0.0)
        + F.floor((1 - F.col("confidence")) * 10 + 0.5) / 10.0
    )
    action = (
        F.when(F.col("family") == "unknown", "resolve-family")
        .when(F.col("paper_type") == "unknown", "classify-paper-type")
        .otherwise("review-low-confidence")
    )
    return reasoned.withColumn("priority_score", fixed(score, 1)).withColumn("suggested_action", action)


# Wording that states an outcome, and wording that only hints at one.
EXPLICIT_OUTCOME_PATTERNS = (
    r"(?i)\bviability\b", r"(?i)\bsurvival\b", r"(?i)\brecovery\b", r"(?i)\byield\b",
    r"(?i)\bfunction(?:al|ality)?\b", r"(?i)\binsulin secretion\b", r"(?i)\binsulin release\b",
    r"(?i)\bmorpholog(?:y|ical)\b", r"(?i)\bhistolog(?:y|ical)\b", r"(?i)\btransplant(?:ation|ed)?\b",
    r"(?i)\bgraft(?:ed|s)?\b", r"(?i)\bnormoglyc", r"(?i)\beuglyc",
)
AMBIGUOUS_RESULT_PATTERNS = (
    r"(?i)\bsuccess(?:ful|fully)?\b", r"(?i)\bimprov(?:e|ed|ement)\b", r"(?i)\benhanc(?:e|ed|ement)\b",
    r"(?i)\bpreserv(?:e|ed|ation)\b", r"(?i)\bprolong(?:ed|ation)?\b", r"(?i)\bprotective effect\b",
    r"(?i)\bnovel cryoprotectant\b", r"(?i)\bcomparison\b", r"(?i)\bcompare\b",
)


def missing_evidence_status(present: Column, outcome_count: Column, title: Column, abstract: Column) -> Column:
    """Why a reviewed row has no outcome label; the first rule that applies wins."""
    text = F.concat(title, F.lit(". "), F.coalesce(abstract, F.lit("")))
    low = F.lower(text)

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    return (
        F.when(~present, verdict("evidence-thin", "no-extraction"))
        .when(outcome_count > 0, verdict("extractor-gap", "outcome-extracted-but-unlabeled"))
        .when(
            matches_any(text, EXPLICIT_OUTCOME_PATTERNS, low), verdict("extractor-gap", "explicit-outcome-language")
        )
        .when(matches_any(text, AMBIGUOUS_RESULT_PATTERNS, low), verdict("ambiguous-evidence", "result-hinted"))
        .otherwise(verdict("evidence-thin", "procedural-text"))
    )


def promotion_risks(candidates: DataFrame) -> DataFrame:
    """Risk and checklist flags of a candidate."""
    single = F.size("source_types") < 2
    closed = F.col("full_text_availability") != "open-access-full-text"
    risks = labels_where(
        [
            ("single-source", single),
            ("no-open-full-text", closed),
            ("missing-abstract", F.trim(F.coalesce("abstract", F.lit(""))) == ""),
            ("weak-authority", F.col("authority_score") < 0.2),
        ]
    )
    checklist = labels_where(
        [
            ("confirm-outside-current-slice", F.lit(True)),
            ("verify-from-full-text", F.lit(True)),
            ("check-new-family-or-endpoint", F.lit(True)),
            ("locate-full-text", closed),
            ("find-second-source", single),
        ]
    )
    return candidates.withColumn("promotion_risks", risks).withColumn("review_checklist", checklist)
