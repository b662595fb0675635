"""The curated layer: overrides, gold rows, repair proposals and review queues.

Nulls mean "not stated"; an empty array is a statement and is kept as one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config.defaults import ENRICHMENT_PRIORITIES, ENRICHMENT_STATUS_RANK, PROCEDURE_PHASES
from ..functions.arrays import distinct_sorted, labels_where, or_empty, same_set, string_array
from ..functions.numbers import clamp, fixed
from ..functions.text import evidence_text, matches
from .match import missing_evidence_status
from .quality import gate_summary, gold_join, subset_metrics

PATCH_FIELDS = ("paper_type", "family", "species", "specimens", "outcomes", "phases", "confidence")
PROPOSAL_FIELDS = ("paper_type", "family", "species", "specimens", "outcomes", "phases")
# Thresholds and adjustments of proposal review.
MIN_DEPTH_CONFIDENCE, ACCEPT_CONFIDENCE = 0.78, 0.9
# Title wording that states an outcome.
TITLE_OUTCOMES = (
    r"(?i)(?:viability|survival|recovery|yield|function(?:al|ality)?|insulin secretion|insulin release"
    r"|transplant(?:ation|ed)?|graft function|morpholog(?:y|ical)|histolog(?:y|ical)|ultrastruct(?:ure|ural))"
)


def one_per_key(df: DataFrame, keys: Sequence[str], order: str = "ord", last: bool = True) -> DataFrame:
    """A single row per key (the last by default), as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r")).select(
        *keys, *[F.col("_r")[c].alias(c) for c in rest]
    )


def apply_overrides(extraction: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Drop excluded papers and patch the fields an override states.

    ``overrides``: keys, paper_id, excluded and nullable patch fields, one row
    per paper. ``outcomes`` and ``phases`` patch the flat label arrays.
    """
    keys = [*keys, "paper_id"]
    fields = [f for f in PATCH_FIELDS if f in overrides.columns and f in extraction.columns]
    patch = overrides.select(*keys, F.coalesce("excluded", F.lit(False)).alias("_out"),
                             *[F.col(f).alias(f"_{f}") for f in fields])
    joined = extraction.join(patch, keys, "left").where(~F.coalesce("_out", F.lit(False)))
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop("_out", *[f"_{f}" for f in fields])


def merge_overrides(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert patches: stated newer fields win; among newer rows the last statement.

    ``incoming`` carries ``ord``.
    """
    keys = ["domain", "paper_id"]
    fields = [c for c in base.columns if c not in keys]
    newest = incoming.groupBy(*keys).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f"_{f}") for f in fields]
    )
    return base.join(newest, keys, "full").select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def seed_gold(extraction: DataFrame, overrides: DataFrame) -> DataFrame:
    """Gold rows: reviewed ones from overrides, seeded ones from every other paper.

    An override without a paper is an error: see ``unknown_overrides``.
    """
    keys = ["domain", "paper_id"]
    excluded = F.coalesce("excluded", F.lit(False))
    o = overrides.select(*keys, excluded.alias("_x"), *[F.col(f).alias(f"o_{f}") for f in PROPOSAL_FIELDS])
    reviewed = extraction.select(*keys, "title").join(o, keys).select(
        *keys, "title", F.lit("reviewed").alias("review_status"), (~F.col("_x")).alias("expected_in"),
        *[
            F.when(
                ~F.col("_x"),
                F.col(f"o_{f}") if f in ("paper_type", "family") else distinct_sorted(F.col(f"o_{f}")),
            ).alias(f"expected_{f}")
            for f in PROPOSAL_FIELDS
        ],
    )
    seeded = extraction.join(o.select(*keys), keys, "left_anti").select(
        *keys, "title", F.lit("seeded").alias("review_status"), F.lit(True).alias("expected_in"),
        *[
            (F.col(f) if f in ("paper_type", "family") else distinct_sorted(F.col(f))).alias(f"expected_{f}")
            for f in PROPOSAL_FIELDS
        ],
    )
    return reviewed.unionByName(seeded)


def unknown_overrides(extraction: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(extraction.select("domain", "paper_id"), ["domain", "paper_id"], "left_anti").select(
        "domain", "paper_id"
    )


# -- missing depth ------------------------------------------------------------


def missing_depth(gold: DataFrame, resolved: DataFrame) -> DataFrame:
    """Reviewed in-scope rows lacking outcome or phase labels, with why.

    Joins on the provider's ``paper_id`` column of the extraction, which some
    sources leave empty; such papers count as having no extraction.
    """
    outcome = F.size(or_empty(F.col("expected_outcomes"))) == 0
    phase = F.size(or_empty(F.col("expected_phases"))) == 0
    rows = gold.where((F.col("review_status") == "reviewed") & F.col("expected_in") & (outcome | phase))
    facts = resolved.select(
        "domain", "paper_id", "doi", F.size("outcomes").alias("_n"), F.col("title").alias("_title"),
        F.col("abstract").alias("_abstract"), F.lit(True).alias("_present"),
    )
    joined = rows.select("domain", "paper_id", "title", outcome.alias("no_outcomes"), phase.alias("no_phases")).join(
        facts, ["domain", "paper_id"], "left"
    )
    status = missing_evidence_status(
        F.coalesce("_present", F.lit(False)), F.coalesce("_n", F.lit(0)), F.col("_title"), F.col("_abstract")
    )
    return joined.withColumn("_s", F.when(F.col("no_outcomes"), status)).select(
        "domain", "paper_id", "title", "doi", "no_outcomes", "no_phases",
        F.col("_s.status").alias("evidence_status"), F.col("_s.reason").alias("evidence_reason"),
    )


def missing_audit(missing: DataFrame) -> DataFrame:
    def count(status: str) -> Column:
        return F.count_if(F.col("evidence_status") == status)

    return missing.groupBy("domain").agg(
        F.count_if("no_outcomes").alias("missing_outcomes"),
        F.count_if("no_phases").alias("missing_phases"),
        count("extractor-gap").alias("extractor_gap"),
        count("ambiguous-evidence").alias("ambiguous_evidence"),
        count("evidence-thin").alias("evidence_thin"),
    )


def enrichment_queue_merge(missing: DataFrame, prior: DataFrame) -> DataFrame:
    """The next curation queue.

    Missing outcomes set the priority from the audit; missing phases add rows only
    where nothing stronger is queued; reviewed and rejected prior rows stay as they
    are; prior status, excerpts and notes are kept.
    """
    keys = ["domain", "paper_id"]
    p = prior.select(*keys, F.struct(*[c for c in prior.columns if c not in keys]).alias("p"))
    joined = missing.join(p, keys, "full")
    kept = F.col("p.status").isin("reviewed", "rejected")
    from_outcome = F.coalesce("no_outcomes", F.lit(False))
    phase_only = F.coalesce("no_phases", F.lit(False)) & ~from_outcome
    phase_ok = phase_only & (F.col("p").isNull() | (F.col("p.priority") == "step-phase-manual"))
    priority = (
        F.when(kept, F.col("p.priority"))
        .when(from_outcome, F.coalesce("evidence_status", F.lit("evidence-thin")))
        .when(phase_ok, F.lit("step-phase-manual"))
    )
    return (
        joined.withColumn("priority", priority)
        .where("priority is not null")
        .select(
            *keys,
            F.when(kept, F.col("p.title")).otherwise(F.coalesce("title", "p.title")).alias("title"),
            "priority",
            F.coalesce("p.status", F.lit("pending")).alias("status"),
            F.col("p.reviewer_notes").alias("reviewer_notes"),
            F.col("p.excerpts").alias("excerpts"),
        )
    )


def position(values: Sequence[str], col: Column) -> Column:
    return F.array_position(string_array(values), col)


def enrichment_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(
        position(ENRICHMENT_PRIORITIES, F.col("priority")), position(ENRICHMENT_STATUS_RANK, F.col("status")), "title",
        "paper_id",
    )


def attach_drafts(enrichment: DataFrame, drafts: DataFrame) -> DataFrame:
    """Landed draft rows beside their record; a triaged draft moves the status."""
    keys = ["domain", "paper_id"]
    d = drafts.select(*keys, F.col("draft_confidence"), F.col("safety_tier"), F.col("triaged"))
    return (
        enrichment.join(d, keys, "left")
        .withColumn("status", F.when(F.coalesce("triaged", F.lit(False)), "llm-triaged").otherwise(F.col("status")))
        .withColumn("drafted", F.col("draft_confidence").isNotNull())
        .drop("triaged")
    )


def draft_priority(enrichment: DataFrame, gaps: DataFrame, limit: int = 10) -> DataFrame:
    """Pending records by gap score, the first ``limit`` per domain."""
    scores = gaps.select("domain", "paper_id", F.col("impact").alias("gap_score"))
    todo = enrichment.where("status = 'pending'").join(scores, ["domain", "paper_id"], "left").fillna(0.0, ["gap_score"])
    order = W.partitionBy("domain").orderBy(F.desc("gap_score"), "title", "paper_id")
    return todo.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def draft_safety_tier(records: DataFrame) -> DataFrame:
    """Adds safety_tier and triage_ready from priority, gap score and draft confidence."""
    impact = F.col("gap_score")
    gap = F.col("priority") == "extractor-gap"
    tier = (
        F.when(impact > 0.6, "decision-changing")
        .when(gap & (impact.isNull() | (impact < 0.3)), "draftable")
        .otherwise("review-required")
    )
    return records.withColumn("safety_tier", tier).withColumn(
        "triage_ready",
        F.coalesce((F.col("safety_tier") == "draftable") & (F.col("draft_confidence") >= 0.85) & gap, F.lit(False)),
    )


# Signal categories looked for in curated and drafted text.
SIGNALS = {
    "protocol-detail": r"(?i)(?:freez|cool|warm|thaw|dmso|dimethyl sulfoxide|ethylene glycol|glycerol|cryoprotect"
    r"|vitrif|equilibrat|loading|perfus|culture|incubat|program|controlled.*rate|step.*wise)",
    "outcome-function": r"(?i)(?:function|insulin.*(?:secret|releas|stimulat)|glucose.stimulat|beta.cell"
    r"|islet.*function)",
    "outcome-viability": r"(?i)(?:viabil|surviv|recover|yield|intact|membrane.*integr|live.*dead|trypan)",
    "outcome-transplant": r"(?i)(?:transplant|graft|euglycemi|normoglycemi|revers.*diabet|C-peptide|engraft"
    r"|recipient)",
    "outcome-morphology": r"(?i)(?:morpholog|histolog|ultrastructur|electron.*microscop|tissue.*integr)",
    "comparison": r"(?i)(?:compar|versus|head.to.head|superior|inferior|outperform|relative.*to|contrast)",
    "species-specimen": r"(?i)(?:human|mouse|rat|pig|porc|canine|dog|chick|guinea|primate|islet|pancrea)",
}
CLEARS = 0.85


def signals_in(text: Column) -> Column:
    low = F.lower(text)
    return labels_where([(name, matches(text, pattern, low)) for name, pattern in SIGNALS.items()])


def agreement_pairs(reviewed: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per reviewed record: signals on both sides with precision, recall and F1.

    ``reviewed``: domain, paper_id, text; ``drafts``: domain, paper_id, draft_text.
    """
    joined = reviewed.join(drafts, ["domain", "paper_id"], "left").withColumns(
        {"want": signals_in(F.col("text")), "have": signals_in(F.coalesce("draft_text", F.lit("")))}
    )
    hit = F.size(F.array_intersect("want", "have")).cast("double")
    p = F.coalesce(F.try_divide(hit, F.size("have").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(hit, F.size("want").cast("double")), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return joined.withColumns({"precision": fixed(p, 3), "recall": fixed(r, 3), "f1": fixed(f1, 3)})


def agreement_metrics(pairs: DataFrame) -> DataFrame:
    """Per signal category: tp, fp, fn, ratios and whether it clears the bar."""
    every = F.array(
        *[
            F.struct(
                F.lit(s).alias("signal"),
                F.array_contains("want", s).alias("w"),
                F.array_contains("have", s).alias("h"),
            )
            for s in SIGNALS
        ]
    )
    counts = pairs.select("domain", F.inline(every)).groupBy("domain", "signal").agg(
        F.count_if(F.col("w") & F.col("h")).alias("tp"),
        F.count_if(~F.col("w") & F.col("h")).alias("fp"),
        F.count_if(F.col("w") & ~F.col("h")).alias("fn"),
    )
    tp = F.col("tp").cast("double")
    p = F.coalesce(F.try_divide(tp, (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return counts.withColumns(
        {"precision": fixed(p, 3), "recall": fixed(r, 3), "f1": fixed(f1, 3), "clears": f1 >= CLEARS}
    )


# -- proposals ----------------------------------------------------------------


def repair_proposals(gold: DataFrame, baseline: DataFrame, resolved: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Reviewed gold rows the resolved corpus disagrees with, as override patches.

    Out-of-scope rows that are present become exclusions; in-scope rows need a
    baseline paper. ``patchable_outcomes``/``patchable_phases`` in ``gold`` say
    whether a full patch for those fields is on file.
    """
    keys = list(keys)
    reviewed = gold.where("review_status = 'reviewed'")
    known = baseline.select(*keys, "paper_id").withColumn("_known", F.lit(True))
    pairs = gold_join(reviewed, resolved, keys).join(known, [*keys, "paper_id"], "left")
    scope, present = F.col("expected_in"), F.col("present")
    known_flag = F.coalesce("_known", F.lit(False))

    def stated(f: str) -> Column:
        return F.col(f"expected_{f}").isNotNull()

    def patchable(f: str) -> Column:
        name = f"patchable_{f}"
        return F.coalesce(F.col(name), F.lit(False)) if name in gold.columns else F.lit(True)

    tests = []
    for f in PROPOSAL_FIELDS:
        label, actual = F.col(f"expected_{f}"), F.col(f"actual_{f}")
        if f in ("paper_type", "family"):
            differs, absent = ~label.eqNullSafe(actual), F.lit(True)
        else:
            differs = ~same_set(label, or_empty(actual))
            absent = patchable(f) if f in ("outcomes", "phases") else F.lit(True)
        tests.append((f, F.coalesce(stated(f) & F.when(present, differs).otherwise(absent), F.lit(False))))
    fields = (
        F.when(~scope & present, F.array(F.lit("excluded")))
        .when(scope & known_flag, labels_where(tests))
        .otherwise(F.array().cast("array<string>"))
    )
    out = pairs.withColumn("fields", fields).where(F.size("fields") > 0)
    patch = {
        f: F.when(scope & F.array_contains("fields", f), F.col(f"expected_{f}")).alias(f) for f in PROPOSAL_FIELDS
    }
    return out.select(
        *keys, "paper_id", "title", "review_status",
        proposal_id("reviewed-benchmark-repair").alias("proposal_id"),
        F.lit("override").alias("target"),
        F.when(scope, "update-override").otherwise("exclude-paper").alias("action"),
        "fields", F.lit(1.0).alias("proposal_confidence"), (~scope).alias("excluded"), *patch.values(),
    )


def proposal_id(source: str) -> Column:
    return F.concat_ws(":", F.lit(source), "paper_id", F.array_join(F.array_sort("fields"), "+"))


def named_phases(phases: Column) -> Column:
    return distinct_sorted(F.filter(phases, lambda p: p != "unknown"))


def depth_proposals(gold: DataFrame, resolved: DataFrame) -> DataFrame:
    """Reviewed in-scope rows without labels where the resolved paper states them."""
    facts = resolved.select(
        "domain", "paper_id", *[F.col(c).alias(f"a_{c}") for c in (
            "paper_type", "confidence", "outcomes", "phases", "outcome_mentions", "steps")],
    )
    rows = gold.where("review_status = 'reviewed' and expected_in").join(facts, ["domain", "paper_id"]).where(
        F.col("a_confidence") >= MIN_DEPTH_CONFIDENCE
    )
    classes, phases = distinct_sorted(F.col("a_outcomes")), named_phases(F.col("a_phases"))
    fields = labels_where(
        [
            (
                "outcomes",
                (F.size(or_empty(F.col("expected_outcomes"))) == 0)
                & (F.col("a_paper_type") == "experimental")
                & (F.size(classes) > 0)
                & F.exists("a_outcome_mentions", lambda o: o.strength != "weak"),
            ),
            (
                "phases",
                (F.size(or_empty(F.col("expected_phases"))) == 0)
                & F.arrays_overlap(phases, string_array(PROCEDURE_PHASES)),
            ),
        ]
    )
    out = rows.withColumn("fields", fields).where(F.size("fields") > 0)
    n_outcomes = F.aggregate("a_outcome_mentions", F.lit(0), lambda acc, o: acc + F.size(o.sentences))
    use_o, use_p = F.array_contains("fields", "outcomes"), F.array_contains("fields", "phases")

    def hundredths(x: Column) -> Column:
        return F.round(x * 100).cast("long")

    # evidence confidences are whole hundredths, so the mean is taken over integers
    total = (
        hundredths(F.col("a_confidence"))
        + F.when(use_o, n_outcomes * 80).otherwise(0)
        + F.when(
            use_p, F.aggregate("a_steps", F.lit(0).cast("long"), lambda acc, s: acc + hundredths(s.confidence))
        ).otherwise(0)
    )
    count = F.lit(1) + F.when(use_o, n_outcomes).otherwise(0) + F.when(use_p, F.size("a_steps")).otherwise(0)
    summary = F.slice(
        F.array_sort(
            F.array_distinct(
                F.concat(
                    F.when(
                        use_o,
                        F.transform(
                            F.slice("a_outcome_mentions", 1, 3),
                            lambda o: F.concat(F.lit("outcome: "), o.outcome_class, F.lit(" ("), o.strength,
                                               F.lit(") | "), o.summary),
                        ),
                    ).otherwise(F.array().cast("array<string>")),
                    F.when(
                        use_p,
                        F.transform(
                            F.slice(F.filter("a_steps", lambda s: s.phase != "unknown"), 1, 3),
                            lambda s: F.concat(F.lit("step: "), s.phase, F.lit(" | "), s.summary),
                        ),
                    ).otherwise(F.array().cast("array<string>")),
                )
            )
        ),
        1,
        6,
    )
    return out.select(
        "domain", "paper_id", "title", "review_status",
        proposal_id("benchmark-depth-autofill").alias("proposal_id"),
        F.lit("benchmark").alias("target"), F.lit("update-benchmark").alias("action"), "fields",
        fixed(total / (count * F.lit(100.0)), 3).alias("proposal_confidence"),
        F.when(use_o, classes).alias("outcomes"), F.when(use_p, phases).alias("phases"),
        summary.alias("evidence_summary"),
    )


def proposal_recommendation(proposals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Accept or defer a depth proposal by small additive adjustments."""
    facts = resolved.select(
        "domain", "paper_id", F.col("paper_type").alias("_type"), F.col("confidence").alias("_conf"),
        F.col("outcome_mentions").alias("_out"), F.col("phases").alias("_phases"), F.col("title").alias("_title"),
    )
    rows = proposals.join(facts, ["domain", "paper_id"])
    single = F.size("fields") == 1
    use_o, use_p = F.array_contains("fields", "outcomes"), F.array_contains("fields", "phases")
    high = F.col("_conf") >= 0.9
    grounded = (F.col("_type") == "experimental") & F.exists("_out", lambda o: o.strength.isin("moderate", "strong"))
    title = evidence_text(F.col("_title"))
    explicit = (
        single
        & (F.size("_out") > 0)
        & F.forall(
            "_out",
            lambda o: F.exists(o.sentences, lambda s: (evidence_text(s) == title) & matches(s, TITLE_OUTCOMES)),
        )
    )
    named = F.filter("_phases", lambda p: p != "unknown")
    deep = (F.size(F.array_distinct(named)) >= 2) & (F.size(named) >= 2)

    def points(cond: Column, yes: int, no: int = 0) -> Column:
        return F.when(cond, yes).otherwise(no)

    thousandths = (
        F.round(F.col("proposal_confidence") * 1000)
        + points(high, 30)
        + points(single, 20, -20)
        + F.when(use_o, points(grounded, 30, -50) + points(explicit, 60)).otherwise(0)
        + F.when(use_p, points(deep, 30, -50)).otherwise(0)
    )
    confidence = F.round(clamp(thousandths / 1000.0), 3)
    reasons = labels_where(
        [
            ("deep-steps", use_p & deep),
            ("explicit-title-outcome", use_o & explicit),
            ("grounded-outcome", use_o & grounded),
            ("high-confidence", high),
            ("low-confidence", ~high),
            ("multi-field", ~single),
            ("single-field", single),
            ("sparse-steps", use_p & ~deep),
            ("ungrounded-outcome", use_o & ~grounded),
        ]
    )
    return rows.withColumns({"policy_confidence": confidence, "recommendation_reasons": reasons}).withColumn(
        "recommended", F.when(F.col("policy_confidence") >= ACCEPT_CONFIDENCE, "accept").otherwise("defer")
    ).drop("_type", "_conf", "_out", "_phases", "_title")


def proposal_order(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy("target", F.desc("proposal_confidence"), "title", "paper_id")


def carry_forward_by_id(proposals: DataFrame, prior: DataFrame) -> DataFrame:
    """Decision rows for the current benchmark proposals; vanished ones drop out."""
    p = prior.select(
        "domain", "proposal_id", F.col("decision").alias("_d"), "accepted_outcomes", "accepted_phases",
        F.col("reviewer_notes"),
    )
    current = proposals.where("target = 'benchmark'").select("domain", "proposal_id", "paper_id", "title")
    return (
        current.join(p, ["domain", "proposal_id"], "left")
        .withColumn("decision", F.coalesce("_d", F.lit("pending")))
        .drop("_d")
    )


def auto_accept(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Pending decisions accepted where a benchmark proposal is recommended strongly enough."""
    p = proposals.select("domain", "proposal_id", "target", "recommended", "policy_confidence")
    joined = decisions.join(p, ["domain", "proposal_id"], "left")
    ok = F.coalesce(
        (F.col("decision") == "pending") & (F.col("target") == "benchmark") & (F.col("recommended") == "accept")
        & (F.col("policy_confidence") >= ACCEPT_CONFIDENCE),
        F.lit(False),
    )
    return (
        joined.withColumn("auto_accepted", ok)
        .withColumn("decision", F.when(ok, "accept").otherwise(F.col("decision")))
        .withColumn(
            "reviewer_notes",
            F.when(ok, F.lit("auto-accepted by conservative policy")).otherwise(F.col("reviewer_notes")),
        )
        .drop("target", "recommended", "policy_confidence")
    )


def apply_accepted_patches(gold: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Write the first accepted proposal of each paper into its gold row.

    Decision subset first, then the proposal's labels, then what gold had; empty
    statements never replace labels. A note is added once.
    """
    accepted = decisions.where("decision = 'accept'").select(
        "domain", "proposal_id", "accepted_outcomes", "accepted_phases"
    )
    patches = (
        proposals.join(accepted, ["domain", "proposal_id"])
        .groupBy("domain", "paper_id")
        .agg(
            F.min_by(
                F.struct("proposal_id", "outcomes", "phases", "accepted_outcomes", "accepted_phases"), "proposal_id"
            ).alias("p")
        )
    )

    def choose(kind: str) -> Column:
        empty = F.array().cast("array<string>")
        chosen = F.coalesce(F.col(f"p.accepted_{kind}"), F.col(f"p.{kind}"), F.col(f"expected_{kind}"), empty)
        return F.when(F.col("p").isNotNull() & (F.size(chosen) > 0), chosen).otherwise(F.col(f"expected_{kind}"))

    note = F.concat(F.lit("Accepted benchmark autofill proposal "), F.col("p.proposal_id"), F.lit("."))
    notes = (
        F.when(F.col("p").isNull() | F.contains(F.coalesce("notes", F.lit("")), note), F.col("notes"))
        .otherwise(F.concat_ws(" ", F.nullif(F.col("notes"), F.lit("")), note))
    )
    return gold.join(patches, ["domain", "paper_id"], "left").withColumns(
        {"expected_outcomes": choose("outcomes"), "expected_phases": choose("phases"), "notes": notes}
    ).drop("p")


def stage_metrics(gold: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several corpus versions in one aggregation, keyed by stage."""
    cols = ("domain", "paper_id", "paper_type", "family", "species", "specimens", "outcomes", "phases", "confidence")
    tagged = [f.select(*cols).withColumn("stage", F.lit(name)) for name, f in stages.items()]
    corpus = reduce(lambda a, b: a.unionByName(b), tagged)
    names = F.array(*[F.lit(n) for n in stages])
    pairs = gold_join(gold.withColumn("stage", F.explode(names)), corpus, ("domain", "stage"))
    return subset_metrics(pairs, ("domain", "stage"))


def candidate_evaluation(metrics: DataFrame, proposals: DataFrame, current: str = "resolved", candidate: str = "candidate") -> DataFrame:
    """Whether merging the override proposals is safe, per domain."""
    summary = gate_summary(metrics, ("domain", "stage")).select("domain", "stage", "passes_all_gates")
    wide = metrics.where("subset = 'reviewed'").join(summary, ["domain", "stage"])

    def at(stage: str, col: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    checks = [at(candidate, m) >= at(current, m) for m in ("inclusion_f1", "family_accuracy", "paper_type_accuracy")]
    steady = reduce(lambda a, b: a & b, checks)
    verdict = wide.groupBy("domain").agg(
        at(candidate, "passes_all_gates").alias("_gates"), steady.alias("_steady"),
        at(current, "inclusion_f1").alias("current_f1"), at(candidate, "inclusion_f1").alias("candidate_f1"),
    )
    counts = proposals.where("target = 'override'").groupBy("domain").agg(
        F.count("*").alias("override_proposals"), F.bool_and(F.col("review_status") == "reviewed").alias("_reviewed")
    )
    return verdict.join(counts, "domain", "left").select(
        "domain", F.coalesce("override_proposals", F.lit(0)).alias("override_proposals"), "current_f1", "candidate_f1",
        F.coalesce(F.col("_gates") & F.col("_steady") & F.col("_reviewed"), F.lit(False)).alias("auto_apply_safe"),
    )


def regression_scenarios(
    scenarios: DataFrame, overrides: DataFrame, extraction: DataFrame, gold: DataFrame
) -> DataFrame:
    """Corrupt one override per scenario, propose repairs, and check what comes back.

    ``scenarios`` (a handful per domain): domain, scenario_id, paper_id, kind
    (remove-override | replace-override), patch columns ``patch_*``, the
    expected fields and the least metric gains ``min_*``. The scenario is one more
    key, so all of them run in a single pass. Metrics and repairs look at labelled papers
    only, so those alone are repeated for each scenario, not the corpus.
    """
    key = ("domain", "scenario_id")
    labelled = gold.select("domain", "paper_id").distinct()
    extraction = extraction.join(labelled, ["domain", "paper_id"], "left_semi")
    overrides = overrides.join(labelled, ["domain", "paper_id"], "left_semi")
    target = F.col("paper_id") == F.col("_target")
    every = overrides.join(scenarios.withColumnRenamed("paper_id", "_target"), "domain")
    replaced = (F.col("kind") == "replace-override") & target
    corrupted = every.where(~((F.col("kind") == "remove-override") & target)).select(
        *key, "paper_id", "excluded",
        *[F.when(replaced, F.coalesce(f"patch_{f}", f)).otherwise(F.col(f)).alias(f) for f in PROPOSAL_FIELDS],
    )
    ids = scenarios.select(*key)
    cols = ("domain", "paper_id", *PROPOSAL_FIELDS, "confidence")
    papers = extraction.select(*cols).join(ids, "domain")
    labels = gold.join(ids, "domain")
    current = apply_overrides(papers, corrupted, key)
    proposals = repair_proposals(labels, papers, current, key)
    merged = merge_scenario_overrides(corrupted, proposals)
    candidate = apply_overrides(papers, merged, key)
    keys = [*key, "stage"]
    corpus = current.withColumn("stage", F.lit("current")).unionByName(candidate.withColumn("stage", F.lit("candidate")))
    staged = labels.withColumn("stage", F.explode(F.array(F.lit("current"), F.lit("candidate"))))
    metrics = subset_metrics(gold_join(staged, corpus, keys), keys)
    gates = gate_summary(metrics, keys).where("stage = 'candidate'").select(*key, "passes_all_gates")
    wide = metrics.where("subset = 'reviewed'")
    watched = ("inclusion_f1", "family_accuracy", "paper_type_accuracy", "outcomes_f1", "phases_f1")

    def at(stage: str, col: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    gains = wide.groupBy(*key).agg(
        *[fixed(at("candidate", m) - at("current", m), 3).alias(f"gain_{m}") for m in watched]
    )
    repair = proposals.groupBy(*key).agg(
        F.count("*").alias("proposals"), F.bool_and(F.col("review_status") == "reviewed").alias("_reviewed")
    )
    own = proposals.select(*key, "paper_id", F.col("fields").alias("found_fields"))
    out = (
        scenarios.join(own, [*key, "paper_id"], "left").join(repair, list(key), "left")
        .join(gains, list(key), "left").join(gates, list(key), "left")
    )
    found = F.col("found_fields").isNotNull()
    matched = F.array_intersect("expected_fields", or_empty(F.col("found_fields")))
    enough = F.lit(True)
    for m in watched:
        enough = enough & (F.col(f"min_{m}").isNull() | (F.col(f"gain_{m}") >= F.col(f"min_{m}")))
    steady = F.lit(True)
    for m in watched[:3]:
        steady = steady & (F.col(f"gain_{m}") >= 0)
    safe = F.coalesce(F.col("passes_all_gates") & F.col("_reviewed") & steady, F.lit(False))
    complete = F.size(matched) == F.size("expected_fields")
    return out.select(
        *key, F.coalesce("proposals", F.lit(0)).alias("proposals"), found.alias("proposal_found"),
        matched.alias("matched_fields"), *[f"gain_{m}" for m in watched], safe.alias("auto_apply_safe"),
        F.coalesce(found & complete & enough & safe, F.lit(False)).alias("passed"),
    )


def merge_scenario_overrides(overrides: DataFrame, proposals: DataFrame) -> DataFrame:
    """Overrides with the proposed patches on top, per scenario and paper."""
    keys = ["domain", "scenario_id", "paper_id"]
    fields = ["excluded", *PROPOSAL_FIELDS]
    p = proposals.select(
        *keys, F.when(F.col("excluded"), True).alias("_excluded"), *[F.col(f).alias(f"_{f}") for f in PROPOSAL_FIELDS]
    )
    return overrides.join(p, keys, "full").select(*keys, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


