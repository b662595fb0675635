"""From findings to what to do next: gaps, packets, boards, health and run deltas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import labels_where, or_empty, same_set, string_array
from ..functions.numbers import clamp, fixed, ratio
from ..functions.text import matches, title_words, words_found
from .match import meaningful_phases
from .research import ADDITIVE_TITLE, ranked, top_per
from .sequence import previous_value

REPORT_LIMIT, PACKET_LIMIT, HISTORY_LIMIT = 8, 3, 50
MATCHED_TITLE = r"(?i)matched-species"


# -- contradictions and the wedge ---------------------------------------------


def contradiction_confounds(
    pairs: DataFrame, evidence: DataFrame, wedges: DataFrame, titles: DataFrame, limit: int = REPORT_LIMIT
) -> DataFrame:
    """Wedge-relevant contradictions with their likely confounds, at most ``limit`` per domain.

    ``pairs`` is the bounded contradiction list. Where titles repeat, the last
    paper of a title counts.
    """
    w = wedges.select("domain", "category", "dominant_chemicals")
    named = titles.select("domain", "title").distinct()
    flags = (
        pairs.select("domain", F.col("rank").alias("pair"), F.explode(F.array("title_a", "title_b")).alias("title"))
        .join(named, ["domain", "title"], "left_semi")
        .select("domain", "pair")
        .distinct()
        .withColumn("_direct", F.lit(True))
    )
    rows = (
        pairs.withColumnRenamed("rank", "pair").join(flags, ["domain", "pair"], "left").join(w, "domain")
        .withColumn("_direct", F.coalesce("_direct", F.lit(False)))
        .withColumn("_context", F.arrays_overlap("shared_chemicals", "dominant_chemicals"))
    )
    any_direct = rows.groupBy("domain").agg(F.bool_or("_direct").alias("_any"))
    chosen = rows.join(any_direct, "domain").where(F.col("_direct") | (~F.col("_any") & F.col("_context")))
    top = top_per(chosen, ["domain"], limit, "pair")
    # only the few reported titles are looked up, so this side is tiny
    wanted = top.select("domain", F.explode(F.array("title_a", "title_b")).alias("title")).distinct()
    facts = (
        evidence.join(wanted, ["domain", "title"], "left_semi")
        .groupBy("domain", "title")
        .agg(F.max_by(F.struct("species", F.size("outcomes").alias("o"), F.size("phases").alias("n")), "ord").alias("f"))
    )

    def side(s: str) -> DataFrame:
        return facts.select("domain", F.col("title").alias(f"title_{s}"), F.col("f").alias(f"f_{s}"))

    joined = top.join(side("a"), ["domain", "title_a"], "left").join(side("b"), ["domain", "title_b"], "left")
    known = [F.size(F.coalesce(F.col(f"f_{s}.species"), F.array().cast("array<string>"))) > 0 for s in "ab"]
    confounds = labels_where(
        [
            ("species mismatch", known[0] & known[1] & ~F.arrays_overlap("f_a.species", "f_b.species")),
            (
                "endpoint mismatch",
                (F.col("f_a.o") > 0) & (F.col("f_b.o") > 0) & ~same_set(F.col("outcomes_a"), F.col("outcomes_b")),
            ),
            (
                "sparse protocol detail",
                (F.coalesce("f_a.n", F.lit(0)) <= 1) | (F.coalesce("f_b.n", F.lit(0)) <= 1),
            ),
        ]
    )
    out = joined.withColumn("_c", confounds)
    clear = ~F.array_contains("_c", "species mismatch") & ~F.array_contains("_c", "endpoint mismatch")
    impact = (
        F.when((F.col("category") == "benchmark") & clear, "high")
        .when(F.array_contains("_c", "sparse protocol detail"), "medium")
        .otherwise("low")
    )
    return out.withColumn("decision_impact", impact).withColumn(
        "confounds",
        F.when(F.size("_c") > 0, F.col("_c")).otherwise(
            F.array(F.lit("preservation family disagreement under similar context"))
        ),
    ).drop("_c", "_direct", "_context", "_any", "f_a", "f_b", "category", "dominant_chemicals")


# -- packets ------------------------------------------------------------------


def top_packets(hypotheses: DataFrame, wedges: DataFrame, limit: int = PACKET_LIMIT) -> DataFrame:
    """Up to ``limit`` experiments per domain: the selected hypothesis, then by priority."""
    chosen = wedges.select("domain", F.col("claim_id").alias("_selected"), F.col("dominant_chemicals").alias("_chem"))
    rows = hypotheses.where("category <> 'workflow-gap'").join(chosen, "domain", "left").withColumn(
        "selected", F.col("claim_id") == F.col("_selected")
    )
    return top_per(
        rows.drop("rank"), ["domain"], limit, F.desc("selected"), F.desc("priority_score"), "claim_id"
    ).drop("_selected")


# Arms, readouts and fixed variables by kind of experiment.
NON_ARMS = ("Dimethyl Sulfoxide", "Ethylene Glycol", "Sucrose", "Glycerol", "Polyethylene Glycol")
BASE_VARIABLES = ("assessment window", "specimen handling", "post-thaw evaluation rubric")
ADDITIVE_VARIABLES = ("base CPA backbone",)
BENCHMARK_VARIABLES = ("species", "specimen format")
BASE_ARM = "base cryomix only"
ADDITIVE_ARM = "base cryomix + "
FAMILY_ARM = " arm"
ARMS = {
    "matched": ("slow-freezing arm", "vitrification arm"),
    "endpoint-upgrade": ("current standard protocol", "top reported protocol with transplantation endpoint"),
    "scale-up": ("current handling workflow", "workflow with staged loading/unloading controls"),
    "other": ("benchmark arm A", "benchmark arm B"),
}
PRIMARY_READOUTS = {
    "endpoint-upgrade": ("transplantation", "function"),
    "scale-up": ("post-thaw recovery", "workflow reproducibility"),
    "other": ("function", "viability"),
}
SECONDARY_READOUTS = {
    "additive": ("yield", "transplantation"),
    "matched": ("transplantation", "yield", "morphology"),
    "scale-up": ("viability", "yield", "handling loss"),
    "other": ("viability", "yield", "morphology"),
}
# Fixed values end.


def packet_fields(packets: DataFrame) -> DataFrame:
    """Adds comparison arms, readouts and fixed variables."""
    title, category = F.col("title"), F.col("category")
    additive, matched = matches(title, ADDITIVE_TITLE), matches(title, MATCHED_TITLE)
    pool = F.when(F.col("selected"), F.col("_chem")).otherwise(F.col("chemicals"))
    extra = F.slice(F.filter(pool, lambda c: ~c.isin(*NON_ARMS)), 1, 4)
    families = F.filter("families", lambda f: f != "unknown")
    arms = (
        F.when(additive, F.concat(F.array(F.lit(BASE_ARM)), F.transform(extra, lambda c: F.concat(F.lit(ADDITIVE_ARM), c))))
        .when(matched, string_array(ARMS["matched"]))
        .when(category == "endpoint-upgrade", string_array(ARMS["endpoint-upgrade"]))
        .when(category == "scale-up", string_array(ARMS["scale-up"]))
        .when(F.size(families) > 0, F.transform(families, lambda f: F.concat(f, F.lit(FAMILY_ARM))))
        .otherwise(string_array(ARMS["other"]))
    )
    primary = (
        F.when(additive | matched, string_array(PRIMARY_READOUTS["other"]))
        .when(category == "endpoint-upgrade", string_array(PRIMARY_READOUTS["endpoint-upgrade"]))
        .when(category == "scale-up", string_array(PRIMARY_READOUTS["scale-up"]))
        .when(F.col("transplantation") > 0, string_array(PRIMARY_READOUTS["endpoint-upgrade"]))
        .otherwise(string_array(PRIMARY_READOUTS["other"]))
    )
    secondary = (
        F.when(additive, string_array(SECONDARY_READOUTS["additive"]))
        .when(matched, string_array(SECONDARY_READOUTS["matched"]))
        .when(category == "scale-up", string_array(SECONDARY_READOUTS["scale-up"]))
        .otherwise(string_array(SECONDARY_READOUTS["other"]))
    )
    none = F.array().cast("array<string>")
    fixed_vars = F.concat(
        F.when(additive, string_array(ADDITIVE_VARIABLES)).otherwise(none),
        F.when(category == "benchmark", string_array(BENCHMARK_VARIABLES)).otherwise(none),
        string_array(BASE_VARIABLES),
    )
    return packets.withColumns(
        {"comparison_arms": arms, "primary_readouts": primary, "secondary_readouts": secondary,
         "fixed_variables": fixed_vars}
    ).drop("_chem")


def distinct_blocker(packets: DataFrame) -> DataFrame:
    """Per packet the first blocker no sibling in its domain shares, else its first."""
    long = packets.select("domain", "claim_id", F.posexplode("blockers").alias("pos", "blocker"))
    shared = long.groupBy("domain", "blocker").agg(F.count_distinct("claim_id").alias("_n"))
    best = (
        long.join(shared, ["domain", "blocker"])
        .groupBy("domain", "claim_id")
        .agg(F.min_by("blocker", F.struct((F.col("_n") > 1).alias("s"), "pos")).alias("watch_out"))
    )
    return packets.join(best, ["domain", "claim_id"], "left")


def packet_board(packets: DataFrame, decisions: DataFrame) -> DataFrame:
    """All packets: the lead domain's first packet, its others, then by priority."""
    lead = ranked(decisions, [F.lit(1)], F.desc("recommendation_score"), "domain").where("rank = 1").select(
        F.col("domain").alias("_lead")
    )
    rows = packets.join(lead, F.col("domain") == F.col("_lead"), "left")
    return rows.withColumn(
        "board_order",
        F.when(F.col("_lead").isNotNull() & (F.col("rank") == 1), 0).when(F.col("_lead").isNotNull(), 1).otherwise(2),
    ).drop("_lead").orderBy("board_order", F.desc("priority_score"), "domain", "claim_id")


# -- evidence gaps ------------------------------------------------------------


def lookup_with_fallback(enrichment: DataFrame, extraction: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Curated records with their paper: by id, else by title (the last of a title)."""
    facts = F.struct(*columns)
    by_id = extraction.select("domain", "paper_id", facts.alias("_id"))
    # the curated set is small beside the corpus: only its titles are grouped
    wanted = extraction.join(enrichment.select("domain", "title").distinct(), ["domain", "title"], "left_semi")
    by_title = wanted.groupBy("domain", "title").agg(F.max_by(facts, "ord").alias("_title"))
    joined = enrichment.join(by_id, ["domain", "paper_id"], "left").join(by_title, ["domain", "title"], "left")
    return joined.withColumn("paper", F.coalesce("_id", "_title")).drop("_id", "_title")


def gap_impact(
    enrichment: DataFrame, profiled: DataFrame, wedges: DataFrame, wedge_titles: DataFrame, missing: DataFrame,
    packets: DataFrame, packet_titles: DataFrame, report: DataFrame,
) -> DataFrame:
    """Open curated records scored by what resolving them would change.

    ``profiled``: evidence with ``authority_profile``; ``packet_titles``: domain,
    claim_id, title; ``report``: the bounded contradiction report.
    """
    columns = ["chemicals", "specimens", "family", "phases", "authority_profile", "translational_signal"]
    keys = ["domain", "title"]
    named = wedge_titles.select(*keys).distinct().withColumn("_named", F.lit(True))
    rows = enrichment.join(named, keys, "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
    rows = rows.where(F.col("status").isin("pending", "in-progress") | F.col("_named"))
    rows = lookup_with_fallback(rows, profiled, columns)
    depth = missing.select("domain", "paper_id", "no_outcomes", "no_phases")
    # the first packet naming a title, the first contradiction naming it
    in_packet = (
        packet_titles.select("domain", "claim_id", "title")
        .join(packets.select("domain", "claim_id", "rank", "priority_score"), ["domain", "claim_id"])
        .groupBy(*keys)
        .agg(F.min_by("priority_score", "rank").alias("_packet"))
    )
    weight = F.when(F.col("decision_impact") == "high", 1.0).when(F.col("decision_impact") == "medium", 0.6).otherwise(0.3)
    in_report = (
        report.select("domain", "pair", (weight * F.col("confidence")).alias("_v"),
                      F.explode(F.array("title_a", "title_b")).alias("title"))
        .groupBy(*keys)
        .agg(F.min_by("_v", "pair").alias("_contradiction"))
    )
    w = wedges.select(
        "domain", F.col("dominant_chemicals").alias("_chem"), F.col("specimens").alias("_spec"),
        F.col("families").alias("_fam"),
        F.lower(F.concat_ws(" ", "current_read", "key_uncertainties")).alias("_blockers"),
    )
    rows = (
        rows.join(depth, ["domain", "paper_id"], "left").join(in_packet, keys, "left").join(in_report, keys, "left")
        .join(w, "domain")
    )

    def plus(cond: Column, value: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), value).otherwise(0.0)

    profile = F.coalesce("paper.authority_profile", F.lit("abstract-only"))
    signal = F.coalesce("paper.translational_signal", F.lit("research only"))
    relevance = fixed(
        clamp(
            F.when(F.col("_named"), 0.55).otherwise(0.25)
            + plus(F.arrays_overlap("paper.chemicals", "_chem"), 0.15)
            + plus(F.arrays_overlap("paper.specimens", "_spec"), 0.15)
            + plus(F.array_contains("_fam", F.col("paper.family")), 0.15)
        ),
        3,
    )
    missing_fields = labels_where(
        [
            ("outcomes", F.coalesce("no_outcomes", F.lit(False))),
            ("phases", F.coalesce("no_phases", F.lit(False))),
            ("authority", profile == "abstract-only"),
            ("protocol-detail", F.size(meaningful_phases(F.col("paper.phases"))) <= 1),
        ]
    )
    overlap = words_found(F.col("title"), F.col("_blockers"))
    proximity = F.when(overlap >= 3, fixed(clamp(overlap / 6.0), 3)).when(
        overlap >= 1, fixed(clamp(overlap / 8.0), 3)
    ).otherwise(0.0)
    scored = rows.withColumns(
        {
            "authority_profile": profile,
            "translational_signal": signal,
            "relevance": relevance,
            "_missing": missing_fields,
            "blocker_proximity": proximity,
            "packet_effect": fixed(clamp(F.coalesce("_packet", F.lit(0.0))), 3),
            # "secondary" is not a profile name, so only abstract-only earns uplift
            "authority_uplift": F.when(profile == "abstract-only", 0.7).when(profile == "secondary", 0.3).otherwise(0.0),
            "contradiction_effect": fixed(clamp(F.coalesce("_contradiction", F.lit(0.0))), 3),
        }
    )
    impact = fixed(
        clamp(
            F.col("relevance") * 0.3 + F.col("blocker_proximity") * 0.25 + F.col("packet_effect") * 0.2
            + F.col("authority_uplift") * 0.15 + F.col("contradiction_effect") * 0.1
        ),
        3,
    )
    near = F.col("translational_signal").isin("clinically adjacent", "transplant relevant")
    tier = (
        F.when((F.col("relevance") >= 0.8) & near, "high")
        .when((F.col("relevance") >= 0.55) | (F.size("_missing") >= 2), "medium")
        .otherwise("low")
    )
    return scored.withColumns(
        {
            "impact": impact,
            "tier": tier,
            "missing_fields": F.when(F.size("_missing") > 0, F.col("_missing")).otherwise(F.array(F.lit("authority"))),
        }
    ).select(
        "domain", "paper_id", "title", "priority", "status", "impact", "tier", "relevance", "blocker_proximity",
        "packet_effect", "authority_uplift", "contradiction_effect", "missing_fields", "authority_profile",
        "translational_signal",
    )


def tier_rank(col: Column) -> Column:
    return F.when(col == "high", 3).when(col == "medium", 2).otherwise(1)


def gap_queue_order(gaps: DataFrame) -> DataFrame:
    """Impact in steps of 0.01, then tier, relevance and title.

    Scores closer than 0.01 count as equal; a fixed step makes that a total order.
    """
    return gaps.orderBy(
        F.floor(F.col("impact") * 100 + 1e-9).desc(), tier_rank(F.col("tier")).desc(), F.desc("relevance"), "title",
        "paper_id",
    )


def evidence_board(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(tier_rank(F.col("tier")).desc(), F.desc("relevance"), "domain", "title", "paper_id")


# -- links and drill-down -----------------------------------------------------


def paper_href() -> Column:
    """URL, DOI, PMC id or PubMed id, whichever comes first."""

    def link(col: str, before: str, after: str = "") -> Column:
        value = F.nullif(F.col(col), F.lit(""))
        return F.concat(F.lit(before), value, F.lit(after))

    return F.coalesce(
        F.nullif(F.col("paper_url"), F.lit("")),
        link("doi", "https://doi.org/"),
        link("pmcid", "https://pmc.ncbi.nlm.nih.gov/articles/", "/"),
        link("pmid", "https://pubmed.ncbi.nlm.nih.gov/", "/"),
    )


def resolve_links(papers: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Adds ``href``; a curated record's own URL goes first."""
    curated = enrichment.groupBy("domain", "paper_id").agg(
        F.min_by(F.nullif(F.col("paper_url"), F.lit("")), "ord").alias("_curated")
    )
    return papers.join(curated, ["domain", "paper_id"], "left").withColumn(
        "href", F.coalesce("_curated", paper_href())
    ).drop("_curated")


def links_by_title(titles: DataFrame, linked: DataFrame) -> DataFrame:
    """Resolve titles through the first paper with the same normalised title."""
    by_key = linked.groupBy("domain", title_words(F.col("title")).alias("key")).agg(
        F.min_by(F.struct("paper_id", "href"), "ord").alias("p")
    )
    keyed = titles.withColumn("key", title_words(F.col("title")))
    return keyed.join(by_key, ["domain", "key"], "left").select(
        *titles.columns, F.col("p.paper_id").alias("paper_id"), F.col("p.href").alias("href")
    )


def supporting_papers(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The best distinct papers of a matrix."""
    rank = F.when(F.col("authority_profile") == "primary-backed", 0).when(
        F.col("authority_profile") == "manual-curation-backed", 1
    ).when(F.col("authority_profile") == "secondary-backed", 2).otherwise(3)
    best = rows.groupBy("domain", "paper_id").agg(
        F.min(F.struct((-F.col("relevance")).alias("r"), rank.alias("a"), F.col("title").alias("title"))).alias("o")
    )
    return top_per(best, ["domain"], limit, "o", "paper_id").select("domain", "rank", "paper_id", F.col("o.title").alias("title"))


def paper_drilldown(baseline: DataFrame, resolved: DataFrame, normalized: DataFrame, gold: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One row per normalised paper with what each layer says about it."""
    keys = ["domain", "paper_id"]

    def part(df: DataFrame, **cols: Column | str) -> DataFrame:
        return df.select(*keys, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])

    base = part(baseline, baseline_family="family", baseline_type="paper_type", baseline_outcomes=F.size("outcomes"))
    res = part(resolved, resolved_family="family", resolved_type="paper_type", resolved_outcomes=F.size("outcomes"))
    norm = part(
        normalized, title="title", warning_count=F.size("warnings"), condition_count=F.size("conditions"),
        step_count=F.size("normalized_steps"), normalization_confidence="normalization_confidence",
    )
    labels = part(gold, review_status="review_status", expected_in="expected_in")
    first = enrichment.groupBy(*keys).agg(F.min_by(F.struct("status", "priority"), "ord").alias("e"))
    return (
        norm.join(base, keys, "left").join(res, keys, "left").join(labels, keys, "left").join(first, keys, "left")
        .withColumn("enrichment_status", F.col("e.status")).withColumn("enrichment_priority", F.col("e.priority"))
        .drop("e")
    )


# -- decisions and health -----------------------------------------------------


def worst_state(states: Column) -> Column:
    names = string_array(["healthy", "stalled-enrichment-gate", "needs-attention"])
    return F.get(names, (F.max(F.array_position(names, states)) - 1).cast("int"))


def domain_health(health: DataFrame) -> DataFrame:
    """Adds health_state and alerts to one joined row per domain."""
    failing = ~F.col("gates_pass") | ~F.col("regressions_pass")
    unsafe = F.col("stop_reason") == "unsafe-override-proposals"
    state = (
        F.when(failing | ~F.col("depth_ready") | (F.col("pending_proposals") > 0) | unsafe, "needs-attention")
        .when(
            (F.col("pending_enrichment") > 0) | (F.col("stop_reason") == "pending-source-enrichment"),
            "stalled-enrichment-gate",
        )
        .otherwise("healthy")
    )
    alerts = labels_where(
        [
            ("gates-failing", ~F.col("gates_pass")),
            ("regressions-failing", ~F.col("regressions_pass")),
            ("depth-not-ready", ~F.col("depth_ready")),
            ("pending-review", F.col("pending_proposals") > 0),
            ("unsafe-overrides", unsafe),
            ("pending-enrichment", F.col("pending_enrichment") > 0),
            ("normalization-warnings", F.col("warned") > 0),
            ("missing-outcomes", F.col("missing_outcomes") > 0),
            ("missing-phases", F.col("missing_phases") > 0),
        ]
    )
    return health.withColumns({"health_state": state, "alerts": alerts})


def domain_health_join(required: Sequence[DataFrame], optional: Sequence[DataFrame] = ()) -> DataFrame:
    """One row per domain present in every required table."""
    out = reduce(lambda a, b: a.join(b, "domain"), required)
    return reduce(lambda a, b: a.join(b, "domain", "left"), optional, out)


def missing_domains(registered: DataFrame, reported: DataFrame) -> DataFrame:
    return registered.join(reported.select("domain").distinct(), "domain", "left_anti")


def health_rollup(health: DataFrame) -> DataFrame:
    """Overall state, totals and the recommended lane of a health table."""
    totals = health.agg(
        worst_state(F.col("health_state")).alias("overall_state"),
        F.count("*").alias("domains"),
        F.coalesce(F.sum("pending_proposals"), F.lit(0)).alias("pending_proposals"),
        F.coalesce(F.sum("pending_enrichment"), F.lit(0)).alias("pending_enrichment"),
        F.coalesce(F.sum("protocols"), F.lit(0)).alias("protocols"),
        F.count_if(F.col("health_state") == "needs-attention").alias("_attention"),
        F.count_if(F.col("pending_enrichment") > 0).alias("_waiting"),
    )
    lane = (
        F.when(F.col("_attention") > 0, "investigate-health")
        .when(F.col("_waiting") > 0, "clear-enrichment")
        .otherwise("within-guardrails")
    )
    return totals.withColumn("recommendation", lane).drop("_attention", "_waiting")


def decision_rank(wedges: DataFrame) -> DataFrame:
    """Adds recommendation score, confidence band, signal band and class.

    Needs the four wedge scores, pending_enrichment, high_gaps, contradictions,
    outcome_coverage, phase_coverage and a ``read`` text.
    """
    base = (
        F.col("evidence_confidence") * 0.38 + F.col("company_relevance") * 0.24
        + F.col("scientific_relevance") * 0.2 + F.col("translational_potential") * 0.18
    )
    penalty = F.col("pending_enrichment") * 0.01 + F.col("high_gaps") * 0.03 + F.col("contradictions") * 0.02
    confidence, company, potential = (
        F.col("evidence_confidence"), F.col("company_relevance"), F.col("translational_potential")
    )
    read = F.lower(F.coalesce("read", F.lit("")))
    plausible = (
        (company >= 0.72) & (confidence >= 0.68) & (F.col("outcome_coverage") >= 0.6) & (F.col("phase_coverage") >= 0.6)
    )
    kind = (
        F.when(F.contains(read, F.lit("watchlist")), "watchlist")
        .when(F.contains(read, F.lit("proving ground")), "proving ground")
        .when((company >= 0.86) & (potential >= 0.82) & (confidence >= 0.8), "long-term platform wedge")
        .when(
            F.contains(read, F.lit("company-entry")) | F.contains(read, F.lit("entry point")) | plausible,
            "plausible first company wedge",
        )
        .when(confidence < 0.45, "watchlist")
        .otherwise("proving ground")
    )
    return wedges.withColumns(
        {
            "recommendation_score": fixed(F.greatest(F.lit(0.0), base - penalty), 6),
            "confidence_band": F.when(confidence >= 0.78, "high").when(confidence >= 0.55, "medium").otherwise("low"),
            "signal_band": F.when(potential >= 0.8, "clinically adjacent").when(potential >= 0.6, "transplant relevant")
            .when(potential >= 0.4, "preclinical").otherwise("research only"),
            "wedge_class": kind,
        }
    )


def decision_board(decisions: DataFrame) -> DataFrame:
    return decisions.orderBy(F.desc("recommendation_score"), "domain")


def main_confound(rows: DataFrame, report: DataFrame, gaps: DataFrame) -> DataFrame:
    """The first confound that applies per domain, as label and detail."""
    first_pair = report.groupBy("domain").agg(F.min_by(F.array_join("confounds", ", "), "pair").alias("_pair"))
    place = F.struct((-F.col("relevance")).alias("r"), F.col("title").alias("t"), F.col("paper_id").alias("p"))
    only_shape = (
        F.array_contains("outcomes", "morphology") & ~F.array_contains("outcomes", "transplantation")
        & ~F.array_contains("outcomes", "function")
    )
    matrix = rows.groupBy("domain").agg(
        F.min_by(F.col("title"), F.when(F.size("confounds") > 0, place)).alias("_row"),
        F.count("*").alias("_n"),
        F.count_if(only_shape).alias("_shape"),
    )
    gap_place = F.struct(
        (-F.floor(F.col("impact") * 100 + 1e-9)).alias("i"), (-tier_rank(F.col("tier"))).alias("t"),
        (-F.col("relevance")).alias("r"), F.col("title").alias("n"), F.col("paper_id").alias("p"),
    )
    top_gap = gaps.groupBy("domain").agg(F.min_by("title", gap_place).alias("_gap"))
    out = matrix.join(first_pair, "domain", "full").join(top_gap, "domain", "full")
    heavy = (F.col("_n") > 0) & (F.col("_shape") >= F.ceil(F.col("_n") / 2))
    return out.select(
        "domain",
        F.when(F.col("_pair").isNotNull(), "contradiction").when(F.col("_row").isNotNull(), "flagged-row")
        .when(heavy, "morphology-heavy").when(F.col("_gap").isNotNull(), "evidence-gap").otherwise("none")
        .alias("confound"),
        F.coalesce("_pair", "_row", F.when(heavy, F.lit("")), "_gap", F.lit("")).alias("detail"),
    )


def opportunity_scores(rollup: DataFrame) -> DataFrame:
    """Readiness, evidence and commercial scores per domain, ranked."""

    def part(col: str, weight: float) -> Column:
        return F.col(col) * weight

    def headroom(col: str) -> Column:
        return 1 - F.least(F.lit(1.0), F.col(col) / 20.0)

    readiness = (
        part("evidence_confidence", 0.4) + part("outcome_coverage", 0.25) + part("phase_coverage", 0.2)
        + F.when(F.col("passes_all_gates"), 0.15).otherwise(0.0)
    )
    evidence = part("evidence_confidence", 0.5) + headroom("pending_enrichment") * 0.3 + headroom("missing_outcomes") * 0.2
    commercial = (
        part("company_relevance", 0.45) + part("translational_potential", 0.25)
        + F.when(F.col("dominant_family") != "unknown", 0.2).otherwise(0.08)
        + F.when(F.col("outcome_coverage") >= 0.5, 0.1).otherwise(0.04)
    )
    scored = rollup.withColumns(
        {
            "readiness_score": fixed(readiness, 3), "opportunity_evidence": fixed(evidence, 3),
            "commercial_score": fixed(F.least(F.lit(1.0), commercial), 3),
        }
    )
    # one row per registered domain
    return ranked(scored, [F.lit(1)], F.desc("readiness_score"), F.desc("opportunity_evidence"), "domain")


def readiness_cards(batch: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Overview card per domain: its opportunity row, else scores from coverage signals.

    ``batch`` carries ``market_signal`` (the bonus found in its market text).
    """
    o = opportunities.select("domain", *[F.col(c).alias(f"_{c}") for c in (
        "readiness_score", "opportunity_evidence", "commercial_score")])
    covered = (F.col("outcome_coverage") + F.col("phase_coverage")) / 2
    protocol = clamp(F.col("protocols") / 40.0)
    enriched = clamp(F.col("reviewed_enrichment") / 10.0)
    waiting = clamp(F.col("pending_enrichment") / 12.0, 0.0, 0.22)
    return batch.join(o, "domain", "left").withColumns(
        {
            "readiness_score": F.coalesce(
                "_readiness_score", fixed(clamp(covered * 0.5 + protocol * 0.25 + enriched * 0.15 - waiting), 6)
            ),
            "evidence_score": F.coalesce(
                "_opportunity_evidence", fixed(clamp(covered * 0.7 + protocol * 0.2 + enriched * 0.1), 6)
            ),
            "commercial_score": F.coalesce("_commercial_score", fixed(clamp(0.5 + F.col("market_signal")), 6)),
            "ready": (F.col("outcome_coverage") >= 0.4) & (F.col("phase_coverage") >= 0.4),
        }
    ).drop("_readiness_score", "_opportunity_evidence", "_commercial_score")


def evidence_quality_rollup(gold: DataFrame, extraction: DataFrame, enrichment: DataFrame, normalized: DataFrame) -> DataFrame:
    """Per domain: support behind reviewed rows, curation state, normalised and warned."""
    from .extract import SECONDARY_NOTES

    reviewed = gold.where("review_status = 'reviewed' and expected_in").select("domain", "paper_id")
    a = "authority."
    primary = (F.col(a + "primary_direct") > 0) | (F.col(a + "primary_indirect") > 0)
    secondary = F.col(a + "secondary") > 0
    support = extraction.join(reviewed, ["domain", "paper_id"], "left_semi").groupBy("domain").agg(
        F.count_if(primary).alias("primary_supported"), F.count_if(secondary).alias("secondary_supported"),
        F.count_if((F.col(a + "manual_curation") > 0) & ~primary & ~secondary).alias("manual_only"),
    )
    notes = F.coalesce("reviewer_notes", F.lit(""))
    work = enrichment.groupBy("domain").agg(
        F.count_if(F.col("status").isin("pending", "in-progress")).alias("pending"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed"),
        F.count_if((F.col("status") == "reviewed") & matches(notes, SECONDARY_NOTES)).alias("secondary_reviewed"),
    )
    protocols = normalized.groupBy("domain").agg(
        F.count("*").alias("protocols"), F.count_if(F.size("warnings") > 0).alias("warned")
    )
    out = protocols.join(support, "domain", "full").join(work, "domain", "full")
    return out.fillna(0)


def status_counts(rows: DataFrame, column: str, values: Sequence[str], domains: DataFrame) -> DataFrame:
    """Counts per domain over a fixed list of states, zero where none."""
    counts = rows.groupBy("domain", F.col(column).alias("state")).agg(F.count("*").alias("n"))
    every = domains.select("domain", F.explode(string_array(values)).alias("state"))
    return every.join(counts, ["domain", "state"], "left").fillna(0, ["n"])


def lane_tops(rows: DataFrame, limit: int) -> DataFrame:
    """Best ranked rows per domain; equal scores by title from the end."""
    return top_per(rows, ["domain"], limit, F.desc("ranking_score"), F.desc("title"), "dedupe_key")


def batch_summary(extraction: DataFrame, resolved: DataFrame, normalized: DataFrame, gold: DataFrame, enrichment: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts and coverage of one evidence batch per domain."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("domain").agg(F.count("*").alias(name))

    scope = gold.where("review_status = 'reviewed' and expected_in").groupBy("domain").agg(
        F.count("*").alias("_scope"),
        F.count_if(F.size(or_empty(F.col("expected_outcomes"))) > 0).alias("_o"),
        F.count_if(F.size(or_empty(F.col("expected_phases"))) > 0).alias("_p"),
    )
    warned = normalized.groupBy("domain").agg(
        F.count("*").alias("protocols"), F.count_if(F.size("warnings") > 0).alias("warned")
    )
    work = enrichment.groupBy("domain").agg(
        F.count_if(F.col("status").isin("pending", "in-progress")).alias("pending_enrichment"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed_enrichment"),
    )
    open_rows = decisions.groupBy("domain").agg(F.count_if(F.col("decision") == "pending").alias("pending_proposals"))
    parts = [count(extraction, "extracted"), count(resolved, "resolved"), warned, scope, work, open_rows]
    out = reduce(lambda a, b: a.join(b, "domain", "left"), parts).fillna(0)
    return out.withColumns(
        {"outcome_coverage": ratio(F.col("_o"), F.col("_scope")), "phase_coverage": ratio(F.col("_p"), F.col("_scope"))}
    ).withColumn(
        "depth_ready", (F.col("outcome_coverage") >= 0.4) & (F.col("phase_coverage") >= 0.4)
    ).drop("_scope", "_o", "_p")


def coverage_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only."""
    keys = ["domain", "paper_id"]
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full").select(
        *keys, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").alias("problem")
    ).where("problem is not null")


def domain_compare(cards: DataFrame, health: DataFrame, corpus: DataFrame) -> DataFrame:
    """Side-by-side domains: cards, health, corpus counts, match rate, top paper.

    ``corpus``: domain, title, score, matched.
    """
    counts = corpus.groupBy("domain").agg(
        F.count("*").alias("fetched"), F.count_if("matched").alias("matched_papers"),
        F.max(F.when(F.col("matched"), F.struct("score", "title"))).alias("_top"),
    )
    return cards.join(health, "domain").join(counts, "domain").withColumns(
        {"match_rate": ratio(F.col("matched_papers"), F.col("fetched"), 6), "top_title": F.col("_top.title")}
    ).drop("_top")


# -- runs ---------------------------------------------------------------------


def cycle_state_change(cycles: DataFrame, chunk: Column) -> DataFrame:
    """Adds the hash before each cycle and whether the cycle changed it."""
    out = previous_value(cycles, ["domain"], chunk, "cycle", "state_hash", "state_before")
    return out.withColumn("changed", ~F.col("state_before").eqNullSafe(F.col("state_hash")))


def stop_reason(cycles: DataFrame, max_cycles: int, allow_pending: bool = False) -> DataFrame:
    """Why a loop stops after a cycle; null while it goes on."""
    label = (
        F.when(F.col("changed") & (F.col("cycle") >= max_cycles), "max-cycles-reached")
        .when(F.col("changed"), None)
        .when(F.col("pending_proposals") > 0, "pending-benchmark-review")
        .when((F.col("override_proposals") > 0) & ~F.col("auto_apply_safe"), "unsafe-override-proposals")
        .when((F.col("pending_enrichment") > 0) & F.lit(not allow_pending), "pending-source-enrichment")
        .otherwise("converged")
    )
    return cycles.withColumn("stop_reason", label)


def capped_history(deltas: DataFrame, *ties: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The latest rows per domain; rows of one moment are ordered by ``ties``."""
    return top_per(deltas, ["domain"], limit, F.desc("run_ts"), *ties).drop("rank")


def run_history(health: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each domain's health row beside its cycles, one row per cycle.

    Cycles stay rows: a long-lived domain has more of them than one row should hold.
    """
    return health.join(cycles, "domain", "left")


SCORES = ("scientific_relevance", "company_relevance", "evidence_confidence", "translational_potential")


def gaps_closed(before: DataFrame, after: DataFrame) -> DataFrame:
    """High-impact gaps of the earlier run that the later run no longer lists."""
    return before.where("tier = 'high'").join(after.select("domain", "paper_id"), ["domain", "paper_id"], "left_anti")


def run_delta(before: DataFrame, after: DataFrame, closed: DataFrame) -> DataFrame:
    """What changed between two runs, per domain.

    ``before``/``after``: domain, wedge_id, the four scores, support, high_gaps,
    top_packet, pending_enrichment, drafted, triaged, decision_changing.
    """
    cols = ["wedge_id", *SCORES, "support", "high_gaps", "top_packet", "pending_enrichment", "drafted", "triaged",
            "decision_changing"]

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("domain", *[F.col(c).alias(f"{p}_{c}") for c in cols])

    n_closed = closed.groupBy("domain").agg(F.count("*").alias("gaps_closed"))
    rows = side(before, "b").join(side(after, "a"), "domain", "full").join(n_closed, "domain", "left")

    def diff(c: str) -> Column:
        return F.coalesce(F.col(f"a_{c}"), F.lit(0)) - F.coalesce(F.col(f"b_{c}"), F.lit(0))

    rows = rows.withColumns(
        {
            **{f"{s}_delta": fixed(diff(s), 3) for s in SCORES},
            "support_delta": diff("support"),
            "high_gap_change": diff("high_gaps"),
            "pending_change": diff("pending_enrichment"),
            "drafts_generated": F.greatest(F.lit(0), diff("drafted")),
            "triaged_change": F.greatest(F.lit(0), diff("triaged")),
            "decision_changing_pending": F.coalesce("a_decision_changing", F.lit(0)),
            "gaps_closed": F.coalesce("gaps_closed", F.lit(0)),
            "wedge_changed": ~F.col("b_wedge_id").eqNullSafe(F.col("a_wedge_id")),
            "packet_changed": ~F.col("b_top_packet").eqNullSafe(F.col("a_top_packet")),
        }
    )
    deltas = [F.col(f"{s}_delta") for s in SCORES]
    moved = reduce(lambda a, b: a | b, [F.abs(d) >= 0.01 for d in deltas])
    worse = reduce(lambda a, b: a | b, [d < -0.02 for d in deltas]) | (F.col("high_gap_change") > 0)
    gaps = (F.col("high_gap_change") < 0) | (F.col("gaps_closed") > 0)
    curated = F.col("pending_change") < 0
    progress = (
        F.when(worse & ~gaps & ~curated, "regressed")
        .when(moved | gaps | curated | F.col("wedge_changed") | F.col("packet_changed"), "improved")
        .otherwise("flat")
    )
    productive = (progress == "improved") & (gaps | moved | F.col("wedge_changed") | curated)
    return rows.withColumns({"progress": progress, "productive": productive}).drop(
        *[f"{p}_{c}" for p in "ab" for c in cols]
    )
