"""The evidence batch: papers to ranked hypotheses, as stages over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Registry
from ..operators import research
from ..operators.extract import assemble_extraction, attach_reviewed_enrichment
from ..operators.normalize import normalize_extraction
from ..operators.quality import gate_summary, gold_join, subset_metrics
from ..operators.review import apply_overrides
from ..session import cut


@dataclass
class Evidence:
    extraction: DataFrame
    resolved: DataFrame
    normalized: DataFrame


def build_evidence(papers: DataFrame, enrichment: DataFrame, overrides: DataFrame, registry: Registry) -> Evidence:
    """Extract once, store it, then patch and normalise from the stored table."""
    extraction = cut(assemble_extraction(attach_reviewed_enrichment(papers, enrichment), registry), "extraction")
    resolved = cut(apply_overrides(extraction, overrides), "resolved")
    return Evidence(extraction, resolved, cut(normalize_extraction(extraction), "normalized"))


@dataclass
class Findings:
    contradictions: DataFrame
    claims: DataFrame
    titles: DataFrame
    support: DataFrame
    hypotheses: DataFrame
    wedges: DataFrame


def find(evidence: DataFrame, registry: Registry) -> Findings:
    """Contradictions, hypotheses and the chosen wedge of a stored evidence table."""
    contradictions = cut(research.contradiction_pairs(evidence, registry), "contradictions")
    claims = cut(research.hypothesis_templates(evidence, registry).withColumnRenamed("template", "claim_id"), "claims")
    titles = cut(research.template_titles(evidence, registry).withColumnRenamed("template", "claim_id"), "titles")
    support = cut(research.support_with_fallback(research.slim(evidence), claims, titles), "support")
    hypotheses = cut(research.hypothesis_evidence(claims, support, contradictions, registry), "hypotheses")
    return Findings(
        contradictions, claims, titles, support, hypotheses, research.select_wedge(hypotheses, registry)
    )


def wedge_support(findings: Findings) -> DataFrame:
    """Papers supporting each domain's wedge."""
    chosen = findings.wedges.select("domain", "claim_id")
    return findings.support.join(chosen, ["domain", "claim_id"])


@dataclass
class Batch:
    evidence: Evidence
    findings: Findings
    metrics: DataFrame
    gates: DataFrame


def run_batch(
    papers: DataFrame, enrichment: DataFrame, overrides: DataFrame, gold: Callable[[DataFrame], DataFrame], registry: Registry
) -> Batch:
    """The evidence batch as one job: extract, patch, normalise, find, and hold the result against the labels.

    ``gold`` makes the gold rows of the stored extraction, which no second extraction is needed for.
    """
    evidence = build_evidence(papers, enrichment, overrides, registry)
    metrics = cut(subset_metrics(gold_join(gold(evidence.extraction), evidence.resolved)), "metrics")
    return Batch(evidence, find(evidence.resolved, registry), metrics, gate_summary(metrics))
