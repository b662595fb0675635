"""Corpus-level findings: facets, hotspots, contradictions, hypotheses and the wedge.

Input is the evidence table (one row per paper, label arrays). Everything here
reduces papers to counts or label signatures before it groups or joins, because
labels come from fixed dictionaries while papers grow.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DomainProfile, Registry
from ..config.defaults import BASE_CHEMICALS
from ..config.model import Pick
from ..functions.arrays import first_per, labels_where, or_empty, string_array
from ..functions.numbers import clamp, fixed
from ..functions.text import matches, slug
from .match import in_group, meaningful_phases

FACET_LIMIT, HOTSPOT_LIMIT, PAIR_LIMIT, TEMPLATE_LIMIT = 12, 12, 20, 5
#: What signatures meet in, in the search for contradictions; how many of each domain and family
#: meet first; and rows of a block beyond which it is dealt by salt.
BLOCK = ("domain", "in_chem", "in_spec", "in_outcome")
HEADS, HOT_BLOCK = 256, 2048


def ranked(df: DataFrame, keys: Sequence[str], *order: Column | str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def top_per(df: DataFrame, keys: Sequence[str], limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows per key; Spark limits inside each partition first."""
    return ranked(df, keys, *order).where(F.col("rank") <= limit)


# -- facets -------------------------------------------------------------------


def facet_counts(evidence: DataFrame, limit: int = FACET_LIMIT) -> DataFrame:
    """Top labels per facet; families are listed in full."""

    def labels(facet: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("label")))

    every = F.concat(
        labels("chemical", F.array_distinct("chemicals")),
        labels("specimen", F.col("specimens")),
        labels("outcome", F.col("outcomes")),
        labels("phase", F.col("phases")),
        labels("family", F.array("family")),
    )
    counts = evidence.select("domain", F.inline(every)).groupBy("domain", "facet", "label").agg(F.count("*").alias("n"))
    placed = ranked(counts, ["domain", "facet"], F.desc("n"), "label")
    return placed.where((F.col("rank") <= limit) | (F.col("facet") == "family"))


def family_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("domain", "family").agg(F.count("*").alias("papers"))


def hotspots(evidence: DataFrame, limit: int = HOTSPOT_LIMIT) -> DataFrame:
    """(family, chemical, specimen) groups with several papers and mixed outcomes."""
    specimens = F.when(F.size("specimens") > 0, F.col("specimens")).otherwise(F.array(F.lit("unspecified")))
    grouped = (
        evidence.select("domain", "family", "outcomes", "specimens", F.explode("chemicals").alias("chemical"))
        .select("domain", "family", "chemical", "outcomes", F.explode(specimens).alias("specimen"))
        .groupBy("domain", "family", "chemical", "specimen")
        .agg(
            F.count("*").alias("papers"),
            # outcome classes are a fixed enum: a set of sets stays small
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("outcomes")))).alias("outcomes"),
        )
        .where((F.col("papers") >= 2) & (F.size("outcomes") >= 2))
    )
    return top_per(grouped, ["domain"], limit, F.desc("papers"), "chemical", "family", "specimen")


def hotspot_titles(evidence: DataFrame, spots: DataFrame) -> DataFrame:
    """Distinct titles behind the reported hotspots, as rows."""
    specimens = F.when(F.size("specimens") > 0, F.col("specimens")).otherwise(F.array(F.lit("unspecified")))
    long = evidence.select(
        "domain", "family", "title", F.explode("chemicals").alias("chemical"), specimens.alias("specimens")
    ).select("domain", "family", "chemical", F.explode("specimens").alias("specimen"), "title")
    chosen = spots.select("domain", "family", "chemical", "specimen", "rank")
    # at most HOTSPOT_LIMIT rows per registered domain
    return long.join(chosen, ["domain", "family", "chemical", "specimen"]).select(
        "domain", "rank", "title"
    ).distinct()


def quality_signals(evidence: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    unknown = F.count_if(F.col("family") == "unknown")
    kinds = [F.count_if(F.col("paper_type") == t).alias(f"{t}_papers")
             for t in ("experimental", "methods", "review", "commentary")]
    return evidence.groupBy(*keys).agg(
        F.count("*").alias("papers"),
        unknown.alias("unknown_family"),
        fixed(unknown / F.count("*").cast("double"), 2).alias("unknown_family_rate"),
        F.sum(F.size(F.filter("phases", lambda p: p == "unknown"))).alias("unknown_phases"),
        *kinds,
    )


def override_impact(baseline: DataFrame, resolved: DataFrame, overrides: DataFrame) -> DataFrame:
    """Baseline minus resolved for each quality signal, plus what the overrides did."""
    both = baseline.withColumn("stage", F.lit("baseline")).unionByName(
        resolved.withColumn("stage", F.lit("resolved")), allowMissingColumns=True
    )
    signals = quality_signals(both, ("domain", "stage"))

    def change(col: str) -> Column:
        def at(stage: str) -> Column:
            return F.coalesce(F.max(F.when(F.col("stage") == stage, F.col(col))), F.lit(0))

        return at("baseline") - at("resolved")

    delta = signals.groupBy("domain").agg(
        change("unknown_family").alias("unknown_families_resolved"),
        fixed(change("unknown_family_rate"), 2).alias("unknown_family_rate_delta"),
        change("unknown_phases").alias("unknown_phase_delta"),
        (-change("experimental_papers")).alias("experimental_delta"),
        (-change("methods_papers")).alias("methods_delta"),
        (-change("review_papers")).alias("review_delta"),
        (-change("commentary_papers")).alias("commentary_delta"),
    )
    applied = overrides.groupBy("domain").agg(
        F.count("*").alias("overrides_applied"),
        F.count_if(F.coalesce("excluded", F.lit(False))).alias("excluded_papers"),
    )
    return delta.join(applied, "domain", "left").fillna(0, ["overrides_applied", "excluded_papers"])


# -- contradictions -----------------------------------------------------------


def contradiction_pairs(evidence: DataFrame, registry: Registry, limit: int = PAIR_LIMIT, hot: int = HOT_BLOCK) -> DataFrame:
    """The ``limit`` strongest contradicting pairs per domain, exactly.

    Two experimental papers contradict when they share a chemical, a specimen and
    an outcome, are compatible in species, specific specimens and phases, and
    report different known preservation families. Order: shared chemicals
    descending, then corpus order of the pair.

    Papers with equal labels behave alike, so they collapse into one signature with the order of its first paper.
    Signatures meet in blocks, one for each (domain, chemical, specimen, outcome) they share; a pair counts only in the
    smallest block it shares. Three rules keep blocks small without losing a pair of the result:

    * The ``HEADS`` signatures of each family with most chemicals meet first. The number of chemicals that ``limit`` of
      their pairs reach is a bound for the domain: pairs below it cannot be among the strongest.
    * Under a bound of ``n`` chemicals, a signature needs no block for its last ``n - 1`` chemicals: two that share ``n`` still share one of the others.
    * Of signatures that behave alike inside a block only the first ``limit`` can be in a winning pair.

    The larger side of a block of over ``hot`` rows is dealt by salt. Only the winning signatures are joined with their papers.
    """

    def generic(d: DomainProfile) -> Column:
        return string_array(d.generic_specimens)

    labels = ["chem", "spec", "specific", "species", "phases", "outcomes"]
    signature = ["domain", "family", *labels]
    papers = evidence.where(
        (F.col("paper_type") == "experimental")
        & ~F.col("family").isin("unknown", "comparative")
        & (F.size("chemicals") > 0)
        & (F.size("specimens") > 0)
        & (F.size("outcomes") > 0)
    ).select(
        "domain", "ord", "title", "family",
        F.array_sort(F.array_distinct("chemicals")).alias("chem"),
        F.array_sort(F.array_distinct("specimens")).alias("spec"),
        F.array_sort(F.array_except("specimens", registry.by_domain(F.col("domain"), generic))).alias("specific"),
        F.array_sort("species").alias("species"),
        F.array_sort(meaningful_phases(F.col("phases"))).alias("phases"),
        F.array_sort(F.array_distinct("outcomes")).alias("outcomes"),
    )
    signed = papers.withColumn("sig", F.sha2(F.to_json(F.struct(*signature)), 256))
    signatures = signed.groupBy("sig", *signature).agg(F.min("ord").alias("first"))

    # the domain's bound, from pairs of the signatures with most chemicals
    heads = top_per(signatures, ["domain", "family"], HEADS, F.desc(F.size("chem")), "first", "sig").drop("rank")
    heads = heads.withColumn("least", F.lit(1))
    met = _pairs(heads.alias("a").join(heads.alias("b"), (F.col("a.domain") == F.col("b.domain")) & _contradict()))
    reached = top_per(met, ["domain"], limit, F.desc("shared")).groupBy("domain").agg(
        F.when(F.count("*") >= limit, F.min("shared")).otherwise(1).alias("least")
    )
    bounded = signatures.join(reached, "domain", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    able = _blocks(bounded.where(F.size("chem") >= F.col("least")))
    alike = [*BLOCK, "family", "chem", "specific", "species", "phases"]
    able = able.withColumn("rows", F.count("*").over(W.partitionBy(*BLOCK)))
    able = top_per(able, alike, limit, "first", "sig").drop("rank")
    winners = top_per(_meets(able, hot), ["domain"], limit, F.desc("shared"), "first_a", "first_b").drop("rank")

    # no later paper of a signature than its first ``limit`` can enter the result
    sides = ("ord", "title", "family", "outcomes")
    members = top_per(signed.select("sig", *sides), ["sig"], limit, "ord").select("sig", F.struct(*sides).alias("paper"))
    shown = ["domain", "sig_a", "sig_b", "shared_chemicals", "shared_specimens", "shared_species"]
    both = winners.select(*shown, F.explode(F.array("sig_a", "sig_b")).alias("sig")).join(members, "sig").groupBy(*shown)
    pairs = (
        both.agg(*[F.collect_list(F.when(F.col("sig") == F.col(f"sig_{i}"), F.col("paper"))).alias(o) for i, o in zip("ab", "xy")])
        .withColumn("x", F.explode("x"))
        .withColumn("y", F.explode("y"))
    )
    ordered = pairs.withColumn("_pair", F.array_sort(F.array("x", "y"))).select(
        "domain", "shared_chemicals", "shared_specimens",
        F.when((F.col("shared_species") > 0) & (F.size("shared_chemicals") >= 2), 0.85).otherwise(0.72).alias("confidence"),
        *[F.col("_pair")[i][c].alias(f"{c}_{s}") for i, s in enumerate("ab") for c in sides],
    )
    return top_per(ordered, ["domain"], limit, F.desc(F.size("shared_chemicals")), "ord_a", "ord_b")


def _blocks(signatures: DataFrame) -> DataFrame:
    """A row for each block of a signature; two that share ``least`` chemicals meet in one of them."""
    return (
        signatures.withColumn("prefix", F.slice("chem", F.lit(1), F.size("chem") - F.col("least") + 1))
        .withColumn("in_chem", F.explode("prefix"))
        .withColumn("in_spec", F.explode("spec"))
        .withColumn("in_outcome", F.explode("outcomes"))
    )


def _shared(label: str) -> Column:
    return F.array_intersect(f"a.{label}", f"b.{label}")


def _contradict() -> Column:
    """Signature a stands before b, and the two contradict."""

    def compatible(label: str) -> Column:
        either_empty = (F.size(f"a.{label}") == 0) | (F.size(f"b.{label}") == 0)
        return either_empty | F.arrays_overlap(f"a.{label}", f"b.{label}")

    specific = (
        (F.size("a.specific") == 0) & (F.size("b.specific") == 0)
    ) | F.arrays_overlap("a.specific", "b.specific")
    condition = (F.col("a.family") != F.col("b.family")) & (F.struct("a.first", "a.sig") < F.struct("b.first", "b.sig"))
    condition &= F.arrays_overlap("a.spec", "b.spec") & F.arrays_overlap("a.outcomes", "b.outcomes")
    for test in (compatible("species"), compatible("phases"), specific, F.size(_shared("chem")) >= F.col("a.least")):
        condition &= test
    return condition


def _meets(rows: DataFrame, hot: int) -> DataFrame:
    """Contradicting signature pairs of the blocks in ``rows``, each once, in the smallest block both are in."""
    salted = rows.withColumn("salts", F.ceil(F.col("rows") / hot).cast("int"))
    a = salted.withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int")).alias("a")
    b = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    condition = _contradict()
    for col in (*BLOCK, "salt"):
        condition &= F.col(f"a.{col}") == F.col(f"b.{col}")
    for col, held in (("in_chem", "prefix"), ("in_spec", "spec"), ("in_outcome", "outcomes")):
        condition &= F.col(f"a.{col}") == F.array_min(_shared(held))
    return _pairs(a.join(b, condition))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(
        F.col("a.domain").alias("domain"), F.col("a.sig").alias("sig_a"), F.col("b.sig").alias("sig_b"),
        F.col("a.first").alias("first_a"), F.col("b.first").alias("first_b"),
        _shared("chem").alias("shared_chemicals"), _shared("spec").alias("shared_specimens"),
        F.size(_shared("species")).alias("shared_species"), F.size(_shared("chem")).alias("shared"),
    )


# -- hypotheses ---------------------------------------------------------------

PICKS = ("chemicals", "specimens", "families", "titles")


def _memberships(evidence: DataFrame, registry: Registry) -> DataFrame:
    """(domain, template, kind, group, rank, …): how each paper serves each template."""

    def entry(template: int, kind: str, group: str, rank: int) -> Column:
        return F.struct(
            F.lit(template).alias("template"), F.lit(kind).alias("kind"), F.lit(group).alias("group"),
            F.lit(rank).alias("rank"),
        )

    def uses(d: DomainProfile) -> Column:
        parts = []
        for i, t in enumerate(d.templates):
            for name, group in t.groups:
                entries = [entry(i, "count", name, 0)]
                for kind in PICKS:
                    pick: Pick = getattr(t, kind)
                    if name in pick.groups:
                        entries.append(entry(i, kind, "", pick.groups.index(name)))
                parts.append(F.when(in_group(group), F.array(*entries)))
        if not parts:
            return F.array().cast("array<struct<template:int,kind:string,group:string,rank:int>>")
        return F.flatten(F.array_compact(F.array(*parts)))

    return evidence.withColumn("_uses", registry.by_domain(F.col("domain"), uses))


def _template_values(members: DataFrame) -> DataFrame:
    """Distinct reported values with the place they are first seen."""
    use = F.col("_use")
    values = (
        F.when(use.kind == "chemicals", F.col("chemicals"))
        .when(use.kind == "specimens", F.col("specimens"))
        .when(use.kind == "families", F.array("family"))
        .when(use.kind == "titles", F.array("title"))
    )
    return (
        members.select("domain", "ord", "chemicals", "specimens", "family", "title", F.explode("_uses").alias("_use"))
        .where(F.col("_use.kind") != "count")
        .select("domain", "ord", F.col("_use.*"), F.posexplode(values).alias("pos", "value"))
        .groupBy("domain", "template", "kind", "value")
        .agg(F.min(F.struct("rank", "ord", "pos")).alias("seen"))
    )


def _supported(members: DataFrame, registry: Registry, limit: int) -> DataFrame:
    """(domain, template) whose count rule holds; at most ``limit`` per domain, in order."""
    counts = (
        members.select("domain", F.inline("_uses"))
        .where("kind = 'count'")
        .groupBy("domain", "template", "group")
        .agg(F.count("*").alias("n"))
        .groupBy("domain", "template")
        .agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("counts"))
    )

    def rule(d: DomainProfile) -> Column:
        out = F.lit(False)
        for i, t in enumerate(d.templates):
            text = t.rule
            for name, _ in t.groups:
                text = re.sub(rf"\b{name}\b", f"coalesce(counts['{name}'], 0)", text)
            out = F.when(F.col("template") == i, F.expr(text)).otherwise(out)
        return out

    held = counts.where(registry.by_domain(F.col("domain"), rule))
    return top_per(held, ["domain"], limit, "template").select("domain", "template", "counts")


def hypothesis_templates(evidence: DataFrame, registry: Registry, limit: int = TEMPLATE_LIMIT) -> DataFrame:
    """Supported templates with their chemicals, specimens and families.

    Titles can be unlimited, so they stay rows: see ``template_titles``.
    """
    members = _memberships(evidence, registry)
    held = _supported(members, registry, limit)
    small = ranked(_template_values(members).where("kind <> 'titles'"), ["domain", "template", "kind"], "seen")

    def spec(d: DomainProfile) -> Column:
        def pick(p: Pick) -> Column:
            return F.struct(
                F.lit(p.limit).cast("int").alias("limit"), string_array(p.fixed).alias("fixed"),
                string_array(p.drop).alias("drop"),
            )

        return F.array(
            *[
                F.struct(
                    F.lit(t.title).alias("title"), F.lit(t.category).alias("category"),
                    F.lit(t.confidence).alias("confidence"),
                    *[pick(getattr(t, k)).alias(k) for k in PICKS[:3]],
                )
                for t in d.templates
            ]
        )

    # label values come from the dictionaries, so these lists are bounded by them
    lists = (
        small.groupBy("domain", "template")
        .pivot("kind", list(PICKS[:3]))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))))
    )
    out = held.join(lists, ["domain", "template"], "left").withColumn(
        "t", F.get(registry.by_domain(F.col("domain"), spec), F.col("template"))
    )

    def chosen(kind: str) -> Column:
        found = F.transform(
            F.coalesce(F.col(kind), F.array().cast("array<struct<rank:int,value:string>>")), lambda v: v.value
        )
        kept = F.array_except(found, F.col(f"t.{kind}.drop"))
        limit = F.coalesce(F.col(f"t.{kind}.limit"), F.size(kept))  # without a limit all are kept
        return F.when(F.size(f"t.{kind}.fixed") > 0, F.col(f"t.{kind}.fixed")).otherwise(F.slice(kept, F.lit(1), limit))

    return out.select(
        "domain", "template", F.col("t.title").alias("title"), F.col("t.category").alias("category"),
        F.col("t.confidence").alias("confidence"), *[chosen(k).alias(k) for k in PICKS[:3]],
    )


def template_titles(evidence: DataFrame, registry: Registry, limit: int = TEMPLATE_LIMIT) -> DataFrame:
    """(domain, template, title, place) of the papers a supported template names."""
    members = _memberships(evidence, registry)
    held = _supported(members, registry, limit).select("domain", "template")
    titles = _template_values(members).where("kind = 'titles'").join(held, ["domain", "template"])

    def own_limit(d: DomainProfile) -> Column:
        out = F.lit(None).cast("int")
        for i, t in enumerate(d.templates):
            out = F.when(F.col("template") == i, F.lit(t.titles.limit).cast("int")).otherwise(out)
        return out

    marked = titles.withColumn("_limit", registry.by_domain(F.col("domain"), own_limit))
    most = max((t.titles.limit or 0 for d in registry.domains for t in d.templates), default=0)
    limited = top_per(marked.where("_limit is not null"), ["domain", "template"], max(most, 1), "seen").where(
        F.col("rank") <= F.col("_limit")
    )
    whole = marked.where("_limit is null").withColumn("rank", F.lit(None).cast("int"))
    return limited.unionByName(whole).select("domain", "template", F.col("value").alias("title"), "rank", "seen")


def slim(evidence: DataFrame) -> DataFrame:
    """What findings read of a paper: identity, labels and counts.

    Its texts, steps and snippets are most of a row's bytes; they stay in the stored evidence, where ``paper_id`` finds them.
    """
    texts = ("abstract", "excerpts", "reviewer_notes", "source_text", "chemical_mentions", "steps", "temperatures", "durations", "evidence")
    strengths = F.transform("outcome_mentions", lambda o: F.struct(o.outcome_class.alias("outcome_class"), o.strength.alias("strength")))
    return evidence.drop(*texts).withColumn("outcome_mentions", strengths)


def support_with_fallback(evidence: DataFrame, claims: DataFrame, titles: DataFrame) -> DataFrame:
    """(claim_id, paper) pairs: papers named by title, or by context if none is named.

    ``claims``: domain, claim_id, chemicals, specimens, families — a handful per
    domain. ``titles``: domain, claim_id, title. A paper's row is compared with
    the few claims of its domain in place; no pair table is built first.
    """
    named = titles.groupBy("domain", "title").agg(F.collect_set("claim_id").alias("_named"))
    # claims are few: which of them any paper is named by is known before a paper's row is touched, so no row travels by claim
    present = evidence.select("domain", "title").distinct()
    stated = titles.join(present, ["domain", "title"], "left_semi").select("domain", "claim_id").distinct()
    per_domain = (
        claims.join(stated.withColumn("_any", F.lit(True)), ["domain", "claim_id"], "left")
        .groupBy("domain")
        .agg(F.collect_list(F.struct(
            "claim_id", "chemicals", "specimens", "families", F.coalesce("_any", F.lit(False)).alias("stated"))).alias("_claims"))
    )
    rows = evidence.join(named, ["domain", "title"], "left").join(F.broadcast(per_domain), "domain")
    tested = F.transform(
        "_claims",
        lambda c: F.struct(
            c.claim_id.alias("claim_id"),
            F.array_contains(or_empty(F.col("_named")), c.claim_id).alias("exact"),
            (
                ~c.stated
                & F.arrays_overlap("specimens", c.specimens)
                & (F.arrays_overlap("chemicals", c.chemicals) | F.array_contains(c.families, F.col("family")))
            ).alias("overlap"),
        ),
    )
    return rows.withColumn("_t", F.explode(F.filter(tested, lambda t: t.exact | t.overlap))).select(
        *evidence.columns, F.col("_t.claim_id").alias("claim_id"), F.col("_t.exact").alias("exact")
    )


def any_exact_fallback(df: DataFrame, keys: Sequence[str], exact: str) -> DataFrame:
    """Exact rows where a group has any, otherwise all of its rows."""
    has = df.groupBy(*keys).agg(F.bool_or(exact).alias("_any"))
    return df.join(has, list(keys)).where(F.col(exact) | ~F.col("_any")).drop("_any")


# Actionability per category; wording that later steps search.
ACTIONABILITY = {"workflow-gap": 0.92, "benchmark": 0.84, "endpoint-upgrade": 0.8, "scale-up": 0.72}
BLOCKERS = {
    "unknown": " relevant papers still have unknown preservation family labels",
    "sparse": " relevant papers still have sparse step structure",
    "contradictions": " unresolved contradictions remain in the relevant evidence slice",
    "no_endpoint": "No transplantation endpoint is present in the directly supporting slice yet",
    "light_scale": "Scale-up evidence is still light on strong post-warm outcomes",
    "unbalanced": "Benchmark still lacks balanced evidence from both vitrification and slow-freezing",
}


def has_strength(strength: str) -> Column:
    return F.exists("outcome_mentions", lambda o: o.strength == strength)


def contradiction_titles(contradictions: DataFrame) -> DataFrame:
    """(domain, pair, title) for both sides of the reported pairs (a bounded list)."""
    return contradictions.select(
        "domain", F.col("rank").alias("pair"), F.explode(F.array_distinct(F.array("title_a", "title_b"))).alias("title")
    )


def hypothesis_evidence(
    claims: DataFrame, support: DataFrame, contradictions: DataFrame, registry: Registry
) -> DataFrame:
    """Counts, scores and blockers per hypothesis, ranked by priority inside a domain."""
    species = [F.bool_or(F.array_contains("species", s)).cast("int").alias(f"_s{i}")
               for i, (s, _) in enumerate(registry.shared.species)]
    keys = ["domain", "claim_id"]
    counts = support.groupBy(*keys).agg(
        F.count("*").alias("papers"),
        F.count_if(F.col("paper_type") == "experimental").alias("experimental"),
        F.count_if(F.col("family") == "comparative").alias("comparative"),
        F.count_if(has_strength("strong")).alias("strong_outcome"),
        F.count_if(F.array_contains("outcomes", "transplantation")).alias("transplantation"),
        F.count_if(F.size(meaningful_phases(F.col("phases"))) <= 1).alias("sparse"),
        F.count_if(F.col("family") == "unknown").alias("unknown"),
        F.count_if(F.col("family") == "vitrification").alias("_vitrified"),
        F.count_if(F.col("family") == "slow-freezing").alias("_slow"),
        *species,
    )
    touched = (
        support.select(*keys, "title")
        .join(contradiction_titles(contradictions), ["domain", "title"])
        .groupBy(*keys)
        .agg(F.count_distinct("pair").alias("contradictions"))
    )
    joined = claims.join(counts, keys, "left").join(touched, keys, "left")
    n_species = sum((F.coalesce(F.col(f"_s{i}"), F.lit(0)) for i in range(len(species))), F.lit(0))
    numbers = ["papers", "experimental", "comparative", "strong_outcome", "transplantation", "sparse", "unknown",
               "contradictions", "_vitrified", "_slow"]
    filled = joined.withColumn("distinct_species", n_species).fillna(0, numbers)
    share = F.col("papers").cast("double")

    def rate(col: str) -> Column:
        return F.coalesce(F.try_divide(F.col(col).cast("double"), share), F.lit(0.0))

    evidence_score = clamp(
        F.col("experimental") / 6 * 0.4
        + F.col("distinct_species") / 3 * 0.2
        + F.col("strong_outcome") / 3 * 0.2
        + F.least("comparative", F.lit(1)) * 0.1
        + F.col("transplantation") / 2 * 0.1
    )
    uncertainty = clamp(F.col("contradictions") / 3 * 0.35 + rate("unknown") * 0.35 + rate("sparse") * 0.3)
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONABILITY.items() for x in kv]), F.col("category"))
    needs_both = registry.by_domain(F.col("domain"), lambda d: F.lit(d.benchmark_needs_both_families))

    def counted(col: str) -> Column:
        return F.when(F.col(col) > 0, F.concat(F.col(col).cast("string"), F.lit(BLOCKERS[col])))

    category = F.col("category")
    blockers = F.array_compact(
        F.array(
            counted("unknown"),
            counted("sparse"),
            counted("contradictions"),
            F.when((category == "endpoint-upgrade") & (F.col("transplantation") == 0), F.lit(BLOCKERS["no_endpoint"])),
            F.when((category == "scale-up") & (F.col("strong_outcome") == 0), F.lit(BLOCKERS["light_scale"])),
            F.when(
                needs_both & (category == "benchmark") & ((F.col("_vitrified") == 0) | (F.col("_slow") == 0)),
                F.lit(BLOCKERS["unbalanced"]),
            ),
        )
    )
    scored = filled.withColumns(
        {"_e": evidence_score, "_u": uncertainty, "actionability_score": action, "blockers": blockers}
    ).withColumns(
        {
            "evidence_score": fixed(F.col("_e"), 3),
            "uncertainty_score": fixed(F.col("_u"), 3),
            "priority_score": fixed(
                clamp(F.col("_e") * 0.35 + F.col("_u") * 0.25 + F.col("actionability_score") * 0.4), 3
            ),
            "hypothesis_id": F.concat_ws(":", "domain", slug(F.col("title"))),
        }
    )
    out = scored.drop("_e", "_u", "_vitrified", "_slow", *[f"_s{i}" for i in range(len(species))])
    return ranked(out, ["domain"], F.desc("priority_score"), "claim_id")


# -- the wedge ----------------------------------------------------------------

# Profile, signal and strength weights.
AUTHORITY_WEIGHT = {"primary-backed": 1.0, "secondary-backed": 0.75, "manual-curation-backed": 0.6,
                    "abstract-only": 0.35}
SIGNAL_WEIGHT = {"clinically adjacent": 1.0, "transplant relevant": 0.85, "preclinical": 0.6, "research only": 0.35}
STRENGTH_WEIGHT = {"strong": 1.0, "moderate": 0.7, "limited": 0.4}
ADDITIVE_TITLE = r"(?i)additive-assisted"
INFERRED_ADJUNCT = ("p38 MAPK inhibitor", r"(?i)p38 mapk inhibitor")
RELEVANT_TITLE = r"transplant|normoglycemic|clinical trial|banking"
EXCLUDED_ADJUNCTS = ("Glycerol", "Polyethylene Glycol")


def lookup(weights: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), key)


def authority_profile(evidence: DataFrame, reviewed_titles: DataFrame) -> DataFrame:
    """Adds authority_profile, evidence_strength, translational_signal and weights.

    ``reviewed_titles``: distinct (domain, title) of reviewed curated records.
    ``evidence`` carries the ``authority`` counts.
    """
    known = reviewed_titles.select("domain", "title").distinct().withColumn("_reviewed", F.lit(True))
    marked = evidence.join(known, ["domain", "title"], "left")
    reviewed = F.coalesce("_reviewed", F.lit(False))
    primary = (F.col("authority.primary_direct") > 0) | (F.col("authority.primary_indirect") > 0)
    profile = (
        F.when(~reviewed, "abstract-only")
        .when(primary, "primary-backed")
        .when(F.col("authority.secondary") > 0, "secondary-backed")
        .otherwise("manual-curation-backed")
    )
    strong, moderate = has_strength("strong"), has_strength("moderate")
    strength = F.when(strong & reviewed, "strong").when(strong | moderate, "moderate").otherwise("limited")
    title = F.lower("title")
    signal = (
        F.when(F.array_contains("species", "human"), "clinically adjacent")
        .when(F.array_contains("outcomes", "transplantation") | matches(title, RELEVANT_TITLE, title),
              "transplant relevant")
        .when(F.size("outcomes") > 0, "preclinical")
        .otherwise("research only")
    )
    return marked.withColumns(
        {"authority_profile": profile, "evidence_strength": strength, "translational_signal": signal,
         "primary_backed": primary}
    ).drop("_reviewed")


def adjuncts() -> Column:
    """Chemicals beyond the base mix, an inferred one from the title first."""
    label, pattern = INFERRED_ADJUNCT
    inferred = F.when(matches(F.col("title"), pattern, F.lower("title")), F.array(F.lit(label))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_distinct(F.concat(inferred, F.array_except("chemicals", string_array(BASE_CHEMICALS))))


def adjunct_scores(profiled: DataFrame) -> DataFrame:
    """Adjuncts of the supporting papers by weighted mentions, per domain."""
    score = (
        F.lit(1.0)
        + F.when(F.array_contains("species", "human"), 1.0).otherwise(0.0)
        + F.when(F.col("primary_backed"), 1.0).otherwise(0.0)
        + F.when(has_strength("strong"), 1.0).otherwise(0.0)
        + F.when(F.array_contains("outcomes", "function"), 0.5).otherwise(0.0)
    )
    long = profiled.select("domain", score.alias("_score"), F.explode(adjuncts()).alias("adjunct"))
    totals = long.where(~F.col("adjunct").isin(*EXCLUDED_ADJUNCTS)).groupBy("domain", "adjunct").agg(
        F.sum("_score").alias("score")
    )
    return ranked(totals, ["domain"], F.desc("score"), "adjunct")


def select_wedge(hypotheses: DataFrame, registry: Registry) -> DataFrame:
    """One hypothesis per domain: preferred title, first benchmark, first that is not a
    workflow gap, else the first."""

    def preferred(d: DomainProfile) -> Column:
        return matches(F.col("title"), d.preferred_title) if d.preferred_title else F.lit(False)

    order = (
        F.when(registry.by_domain(F.col("domain"), preferred), 0)
        .when(F.col("category") == "benchmark", 1)
        .when(F.col("category") != "workflow-gap", 2)
        .otherwise(3)
    )
    best = ranked(hypotheses.withColumn("_pref", order), ["domain"], "_pref", "rank", out="_place")
    return best.where("_place = 1").drop("_pref", "_place")


def wedge_scores(
    wedge: DataFrame, profiled: DataFrame, coverage: DataFrame, titles: DataFrame, enrichment: DataFrame,
    adjunct_ranking: DataFrame,
) -> DataFrame:
    """The wedge row of each domain.

    ``wedge`` from ``select_wedge``; ``profiled`` its supporting papers with
    ``authority_profile``; ``coverage``: domain, outcome_coverage, phase_coverage;
    ``titles`` of the wedge; ``enrichment``: domain, title, status.
    """
    counts = profiled.groupBy("domain").agg(
        F.count("*").alias("support"),
        *[F.count_if(F.col("authority_profile") == p).alias(n) for n, p in (
            ("primary_backed", "primary-backed"), ("secondary_backed", "secondary-backed"),
            ("abstract_only", "abstract-only"))],
        fixed(F.avg(lookup(SIGNAL_WEIGHT, F.col("translational_signal")).cast("decimal(9,4)")).cast("double"), 3)
        .alias("translational_potential"),
    )
    # wedge titles are unlimited for one template; both sides are distinct by title
    own = enrichment.join(titles.select("domain", "title").distinct(), ["domain", "title"], "left_semi")
    work = own.groupBy("domain").agg(
        F.count_if(F.col("status").isin("pending", "in-progress")).alias("pending_enrichment"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed_enrichment"),
    )
    top = adjunct_ranking.where("rank <= 5").groupBy("domain").agg(
        F.array_sort(F.collect_list(F.struct("rank", "adjunct"))).alias("_adjuncts")
    )
    out = (
        wedge.drop("rank").join(counts, "domain", "left").join(work, "domain", "left").join(coverage, "domain", "left")
        .join(top, "domain", "left")
        .fillna(0, ["support", "primary_backed", "secondary_backed", "abstract_only", "pending_enrichment",
                    "reviewed_enrichment"])
        .fillna(0.0, ["translational_potential", "outcome_coverage", "phase_coverage"])
    )
    authority = F.coalesce(
        F.try_divide(F.col("primary_backed") + F.col("secondary_backed") * 0.7, F.col("support").cast("double")),
        F.lit(0.0),
    )
    ranked_adjuncts = F.transform(
        F.coalesce("_adjuncts", F.array().cast("array<struct<rank:int,adjunct:string>>")), lambda x: x.adjunct
    )
    dominant = F.when(
        matches(F.col("title"), ADDITIVE_TITLE), F.slice(F.concat(F.array(F.lit("Dimethyl Sulfoxide")), ranked_adjuncts), 1, 6)
    ).otherwise(F.slice(F.array_distinct("chemicals"), 1, 6))
    scored = out.withColumns(
        {
            "scientific_relevance": fixed(clamp(F.col("evidence_score") * 0.65 + F.col("actionability_score") * 0.35), 3),
            "company_relevance": fixed(
                clamp(F.col("actionability_score") * 0.5 + F.col("translational_potential") * 0.5), 3
            ),
            "evidence_confidence": fixed(
                clamp(
                    F.col("outcome_coverage") * 0.25 + F.col("phase_coverage") * 0.25 + authority * 0.25
                    + (1 - F.col("uncertainty_score")) * 0.25
                ),
                3,
            ),
            "dominant_chemicals": dominant,
            "key_uncertainties": F.slice("blockers", 1, 5),
        }
    )
    return scored.withColumn("current_read", current_read()).drop("_adjuncts")


# The standing read per state, which gap scoring searches for words.
READS = {
    "additive": "Best current wedge in islets. The literature is strong enough to justify a focused additive "
    "benchmark, but not strong enough to claim a winning adjunct yet.",
    "strong": "Best current wedge. The evidence is strong enough for serious scientific and company-entry "
    "conversations, with the main uncertainties still explicit.",
    "pending": "Best current wedge, but still limited by wedge-relevant source enrichment and thin authority support.",
    "open": "Best current wedge, but still better treated as a proving ground than a committed entry point.",
}


def current_read() -> Column:
    confidence = F.col("evidence_confidence")
    return (
        F.when(matches(F.col("title"), ADDITIVE_TITLE) & (confidence >= 0.75), READS["additive"])
        .when((confidence >= 0.78) & (F.col("company_relevance") >= 0.7), READS["strong"])
        .when(F.col("pending_enrichment") > 0, READS["pending"])
        .otherwise(READS["open"])
    )


# -- benchmark matrix ---------------------------------------------------------


def confound_flags(category: Column, families: Column) -> Column:
    return labels_where(
        [
            ("unknown-family", F.col("family") == "unknown"),
            ("sparse-protocol", F.size(meaningful_phases(F.col("phases"))) <= 1),
            ("unlabeled-endpoint", F.size("outcomes") == 0),
            (
                "missing-transplant-endpoint",
                (category == "endpoint-upgrade") & ~F.array_contains("outcomes", "transplantation"),
            ),
            (
                "out-of-benchmark-family",
                (category == "benchmark") & (F.col("family") != "comparative")
                & ~F.array_contains(families, F.col("family")),
            ),
        ]
    )


def matrix_rows(profiled: DataFrame, wedges: DataFrame) -> DataFrame:
    """One row per paper relevant to its domain's wedge.

    ``profiled`` carries ``exact`` (named by the wedge) from the support step.
    """
    w = wedges.select(
        "domain", F.col("category").alias("_cat"), F.col("families").alias("_fam"),
        F.col("dominant_chemicals").alias("_chem"), F.col("specimens").alias("_spec"),
    )
    rows = profiled.join(F.broadcast(w), "domain")  # one row per domain
    flags = confound_flags(F.col("_cat"), F.col("_fam"))
    base = F.array_intersect(F.array_distinct("chemicals"), string_array(BASE_CHEMICALS))
    rows = rows.withColumns(
        {
            "confounds": flags,
            "backbone": F.when(F.size(base) > 0, F.array_join(base, " + ")).otherwise("unspecified"),
            "adjuncts": adjuncts(),
        }
    )

    def when(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    relevance = (
        F.when(F.col("exact"), 0.28).otherwise(0.12)
        + when(F.array_contains("_fam", F.col("family")), 0.2)
        + when(F.arrays_overlap("chemicals", "_chem"), 0.14)
        + when(F.arrays_overlap(F.col("specimens"), F.col("_spec")), 0.08)
        + lookup(AUTHORITY_WEIGHT, F.col("authority_profile")) * 0.16
        + lookup(SIGNAL_WEIGHT, F.col("translational_signal")) * 0.08
        + lookup(STRENGTH_WEIGHT, F.col("evidence_strength")) * 0.08
        - F.size("confounds") * 0.07
    )
    signal = (
        F.when(F.size("adjuncts") > 0, F.get("adjuncts", 0))
        .when(F.col("backbone") == "unspecified", "base protocol only")
        .otherwise(F.concat(F.lit("base only ("), "backbone", F.lit(")")))
    )
    return rows.withColumns({"relevance": fixed(clamp(relevance), 3), "signal": signal}).drop(
        "_cat", "_fam", "_chem", "_spec"
    )


def matrix_order() -> list[Column]:
    return [F.desc("relevance"), F.col("title"), F.col("paper_id")]


def matrix_summary(rows: DataFrame) -> DataFrame:
    """First-seen backbones and adjuncts, strongest and most confounded rows, counts."""
    # decimal key: first place in (relevance desc, title) without numbering all rows
    place = F.struct((-F.col("relevance")).alias("r"), F.col("title").alias("t"), F.col("paper_id").alias("p"))

    def first_seen(values: DataFrame, limit: int, out: str) -> DataFrame:
        firsts = values.groupBy("domain", "value").agg(F.min("place").alias("place"))
        return top_per(firsts, ["domain"], limit, "place").groupBy("domain").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias(out)
        )

    backbones = rows.where("backbone <> 'unspecified'").select(
        "domain", F.col("backbone").alias("value"), F.struct(place.alias("a"), F.lit(0).alias("i")).alias("place")
    )
    listed = rows.select("domain", place.alias("a"), F.posexplode("adjuncts").alias("i", "value")).where(
        "value <> 'Polyethylene Glycol'"
    )
    listed = listed.select("domain", "value", F.struct("a", "i").alias("place"))

    def top_rows(cond: Column, out: str) -> DataFrame:
        return top_per(rows.where(cond), ["domain"], 5, *matrix_order()).groupBy("domain").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" via ", "signal", "title").alias("s")))),
                lambda x: x.s,
            ).alias(out)
        )

    strongest = (F.col("evidence_strength") == "strong") | (F.col("authority_profile") == "primary-backed")
    counts = rows.groupBy("domain").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("translational_signal") == "clinically adjacent").alias("human_relevant"),
        F.count_if(F.col("authority_profile") == "primary-backed").alias("primary_backed"),
        F.count_if(F.col("authority_profile") == "abstract-only").alias("abstract_only"),
    )
    out = counts
    for part in (
        first_seen(backbones, 4, "backbones"),
        first_seen(listed, 6, "adjuncts"),
        top_rows(strongest, "strongest"),
        top_rows(F.size("confounds") > 0, "most_confounded"),
    ):
        out = out.join(part, "domain", "left")
    return out


def best_row_per_group(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The most relevant row per signal, then the top signals of each domain."""
    best = top_per(rows, ["domain", "signal"], 1, *matrix_order()).drop("rank")
    return top_per(best, ["domain"], limit, F.desc("relevance"), "title", "signal")


def authority_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("domain").pivot("authority_profile", list(AUTHORITY_WEIGHT)).agg(F.count(F.lit(1))).fillna(0)


def endpoint_frequency(rows: DataFrame) -> DataFrame:
    return rows.select("domain", F.explode("outcomes").alias("endpoint")).groupBy("domain", "endpoint").agg(
        F.count("*").alias("rows")
    )


# -- family profiles ----------------------------------------------------------


def family_profile(normalized: DataFrame, resolved: DataFrame, limit: int = 3) -> DataFrame:
    """Top chemicals and outcomes per family.

    Chemicals come from normalised protocols; families without any fall back to
    raw mentions, where singletons are dropped if anything repeats.
    """
    keys = ["domain", "family"]
    clean = normalized.select(
        *keys, F.explode(F.array_distinct(F.transform("normalized_chemicals", lambda c: c["name"]))).alias("label")
    ).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    raw = resolved.select(*keys, F.explode("chemicals").alias("label")).groupBy(*keys, "label").agg(
        F.count("*").alias("n")
    )
    # counts per (family, dictionary label): a few hundred rows, windows are fine
    repeats = raw.withColumn("_max", F.max("n").over(W.partitionBy(*keys))).where(
        (F.col("_max") <= 1) | (F.col("n") > 1)
    ).drop("_max")

    def listed(counts: DataFrame, out: str) -> DataFrame:
        return top_per(counts, keys, limit, F.desc("n"), "label").groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label).alias(out)
        )

    outcomes = resolved.select(*keys, F.explode("outcome_mentions").alias("o")).groupBy(
        *keys, F.col("o.outcome_class").alias("label")
    ).agg(F.count("*").alias("n"))
    papers = resolved.groupBy(*keys).agg(F.count("*").alias("papers"))
    empty = F.array().cast("array<string>")
    return (
        papers.join(listed(clean, "_clean"), keys, "left")
        .join(listed(repeats, "_raw"), keys, "left")
        .join(listed(outcomes, "outcomes"), keys, "left")
        .select(*keys, "papers", F.coalesce("_clean", "_raw", empty).alias("chemicals"),
                F.coalesce("outcomes", empty).alias("outcomes"))
    )


def transition_frequency(labels: DataFrame, limit: int = 3) -> DataFrame:
    """Most frequent "phase -> next" per family, at least two papers.

    ``labels`` holds each label once per paper (``normalize.transition_labels``).
    """
    counts = labels.groupBy("domain", "family", "label").agg(F.count("*").alias("papers")).where("papers >= 2")
    return top_per(counts, ["domain", "family"], limit, F.desc("papers"), "label")


def condition_frequency(normalized: DataFrame, limit: int = 3, preferred: Column | None = None) -> DataFrame:
    """Most frequent conditions per family, once per paper, at least two papers.

    Conditions stated in steps replace mention-level ones inside a paper. The
    per-paper choice is made inside the row.
    """
    conditions = F.col("conditions")
    if preferred is not None:
        conditions = F.filter(conditions, lambda c: F.array_contains(preferred, c.chemical) | (F.size(preferred) == 0))
    stated = F.filter(conditions, lambda c: c.source == "step")
    weight = F.when(F.col("c.phase").isin("equilibration", "loading", "perfusion"), 3).when(
        F.col("c.phase").isin("cooling", "warming", "unloading"), 2
    ).otherwise(1)

    chosen = normalized.withColumn("_chosen", F.when(F.size(stated) > 0, stated).otherwise(conditions))
    counts = (
        chosen.select("domain", "family", F.explode(first_per(F.col("_chosen"), lambda c: c.label)).alias("c"))
        .groupBy("domain", "family", F.col("c.label").alias("label"))
        .agg(
            F.count("*").alias("papers"),
            F.count_if(F.col("c.source") == "step").alias("stated"),
            F.max(weight).alias("phase_weight"),
        )
        .where("papers >= 2")
    )
    return top_per(
        counts, ["domain", "family"], limit, F.desc("papers"), F.desc("stated"), F.desc("phase_weight"), "label"
    )
