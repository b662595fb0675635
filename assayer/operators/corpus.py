"""Provider records to ranked candidates, and decisions carried from run to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Registry
from ..config.defaults import DIVERSITY_SOURCES
from ..functions.arrays import labels_where, or_empty, string_array
from ..functions.keys import dedupe_key, fingerprint, identity_hints
from ..functions.numbers import fixed
from ..functions.text import title_key
from .match import candidate_gate
from .skew import first_by_key, last_by_key, placed

#: Text fields where the longest value across providers is kept.
LONGEST_FIELDS = ("title", "abstract", "doi", "pmid", "pmcid", "journal", "authors_flat")
#: The one of them that is long: it is fetched after the merge.
LATE_FIELD = "abstract"
STALE = "evidence or recommendation changed since the previous review state"


def record_key() -> Column:
    return dedupe_key(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title"))


def record_hints(*extra: Column) -> Column:
    return identity_hints(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title"), *extra)


def source_union(*frames: DataFrame) -> DataFrame:
    """Live, imported and manual records as one table."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def dedupe_merge_records(
    records: DataFrame, order: Sequence[str] = ("ord",), baseline: Sequence[str] = DIVERSITY_SOURCES, late: bool = False
) -> DataFrame:
    """Merge records of the same paper into one candidate row.

    The key is the strongest identity a record has; it is deliberately not
    transitive. Inside a key, the first record per provider counts, so a merged
    row never holds more records than there are providers, however many copies
    were delivered. ``late`` is for records that lie in a table and whose ``order`` is one number that tells
    them apart: abstracts then stay out of every sort and aggregate; only their lengths and places compete, and the
    winners' are fetched at the end.
    """
    for field in LONGEST_FIELDS:
        if field not in records.columns:
            records = records.withColumn(field, F.lit(None).cast("string"))
    if late and len(order) != 1:
        raise ValueError("late texts are found again by one number")
    keyed = records.withColumn("dedupe_key", record_key()).withColumn("_ord", F.struct(*order))
    keyed = keyed.withColumn(LATE_FIELD, F.nullif(F.trim(F.col(LATE_FIELD)), F.lit("")))
    narrow = keyed.withColumn("_length", F.length(LATE_FIELD))
    if late:
        narrow = narrow.drop(LATE_FIELD)
        firsts = placed(narrow, ["domain", "dedupe_key", "source"], order[0])
    else:
        firsts = first_by_key(narrow, ["domain", "dedupe_key", "source"], "_ord")
    # longest first, earliest among equals; a null ordering keeps blanks out
    longest = []
    for field in LONGEST_FIELDS:
        if field != LATE_FIELD:
            value = F.nullif(F.trim(F.col(field)), F.lit(""))
            longest.append(F.min_by(value, F.when(value.isNotNull(), F.struct(-F.length(value), F.col("_ord")))).alias(field))
    place = F.when(F.col("_length").isNotNull(), F.struct(-F.col("_length"), F.col("_ord")))
    longest.append(F.min_by(order[0], place).alias("_at") if late else F.min_by(LATE_FIELD, place).alias(LATE_FIELD))
    merged = firsts.groupBy("domain", "dedupe_key").agg(
        *longest,
        F.max("published_year").alias("published_year"),
        F.count("*").alias("record_count"),
        F.array_sort(F.collect_set("source")).alias("source_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_keywords")))).alias("matched_keywords"),
        F.max("relevance_score").alias("_relevance"),
        F.max("citation_count").alias("_citations"),
        F.bool_or(F.col("full_text_availability") == "open-access-full-text").alias("_open"),
        F.bool_or(F.col("full_text_availability") == "full-text-link").alias("_link"),
        F.bool_or(F.col("full_text_availability") == "abstract-only").alias("_abstract"),
        F.min("_ord").alias("first_seen"),
        F.array_sort(
            F.collect_list(F.struct("_ord", "source", "source_id", "full_text_availability"))
        ).alias("_sources"),
    )
    if late:
        # the abstracts of the winners, fetched once: they stream past the merged rows
        texts = keyed.where(F.col(LATE_FIELD).isNotNull()).select(
            F.col("domain").alias("_domain"), F.col("dedupe_key").alias("_key"), F.col(order[0]).alias("_place"), LATE_FIELD
        )
        own = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("dedupe_key").eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_place"))
        merged = merged.hint("shuffle_hash").join(texts, own, "left").drop("_domain", "_key", "_place", "_at")
    availability = (
        F.when(F.col("_open"), "open-access-full-text")
        .when(F.col("_link"), "full-text-link")
        .when(F.col("_abstract"), "abstract-only")
        .otherwise("unknown")
    )
    merged = (
        merged.withColumn("title", F.coalesce("title", F.lit("untitled")))
        .withColumn("source_count", F.size("source_types"))
        .withColumn("full_text_availability", availability)
        .withColumn(
            "sources",
            F.transform(
                "_sources",
                lambda s: F.struct(s.source.alias("source"), s.source_id.alias("source_id"),
                                   s.full_text_availability.alias("full_text_availability")),
            ),
        )
    )
    return candidate_scores(merged, baseline).drop(
        "_relevance", "_citations", "_open", "_link", "_abstract", "_sources"
    )


def candidate_scores(merged: DataFrame, baseline: Sequence[str] = DIVERSITY_SOURCES) -> DataFrame:
    """Relevance, authority, diversity and their sum, three decimals each."""
    known = F.size(F.array_intersect("source_types", string_array(baseline)))
    cited = F.least(F.lit(1.0), F.coalesce("_citations", F.lit(0)) / 100.0)
    bonus = F.when(F.col("_open"), 0.3).when(F.col("_link"), 0.15).otherwise(0.0)
    return (
        merged.withColumn(
            "relevance_score", fixed(F.greatest(F.col("_relevance"), F.lit(0.0)) + F.size("matched_keywords") * 0.1, 3)
        )
        .withColumn("authority_score", fixed(cited + bonus, 3))
        .withColumn("source_diversity_score", fixed(known / float(len(baseline)), 3))
        .withColumn(
            "ranking_score",
            fixed(F.col("relevance_score") + F.col("authority_score") + F.col("source_diversity_score"), 3),
        )
    )


def top_candidates(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranking, sources, year (missing as 0), title; a limit becomes a top-k."""
    ordered = candidates.orderBy(
        F.desc("ranking_score"),
        F.desc("source_count"),
        F.desc(F.coalesce("published_year", F.lit(0))),
        "title",
        "dedupe_key",
    )
    return ordered if limit is None else ordered.limit(limit)


def provider_stats(records: DataFrame, fetch_log: DataFrame | None = None, passed: DataFrame | None = None) -> DataFrame:
    """Fetched and accepted per provider; failures and totals come from the fetch log.

    ``records`` carries domain, kind, source and the gate's ``keep`` flag, or no flag if ``passed`` holds
    those of them that the gate let through.
    """
    keys = ["domain", "kind", "source"]
    if passed is None:
        counts = records.groupBy(*keys).agg(F.count("*").alias("fetched"), F.count_if("keep").alias("accepted"))
    else:
        accepted = passed.groupBy(*keys).agg(F.count("*").alias("accepted"))
        counts = records.groupBy(*keys).agg(F.count("*").alias("fetched")).join(accepted, keys, "left")
        counts = counts.withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    if fetch_log is None:
        return counts.withColumn("failed", F.lit(False)).withColumn("truncated", F.lit(False))
    return (
        counts.join(fetch_log, ["domain", "kind", "source"], "full")
        .withColumn("fetched", F.coalesce("fetched", F.lit(0)))
        .withColumn("accepted", F.coalesce("accepted", F.lit(0)))
        .withColumn("failed", F.coalesce("failed", F.lit(False)))
        .withColumn("truncated", ~F.col("failed") & F.coalesce(F.col("fetched") < F.col("total_hits"), F.lit(False)))
        .drop("total_hits")
    )


def degradation_state(providers: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Per domain the reasons a refresh is not complete.

    ``imports`` (domain, reasons) adds the import stage's own reasons.
    """
    live = providers.where("kind = 'live-provider'")

    def named(flag: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(flag), F.col("source")))), ",")

    state = live.groupBy("domain").agg(
        named("failed").alias("_failed"),
        named("truncated").alias("_truncated"),
        F.bool_and("failed").alias("_all_failed"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_failed") != "", F.concat(F.lit("live-provider-failures:"), "_failed")),
            F.when(F.col("_truncated") != "", F.concat(F.lit("live-provider-truncation:"), "_truncated")),
            F.when(F.col("_all_failed"), F.lit("all-live-providers-failed")),
        )
    )
    if imports is None:
        state = state.withColumn("reasons", reasons)
    else:
        state = state.join(imports.withColumnRenamed("reasons", "_imports"), "domain", "full").withColumn(
            "reasons",
            F.array_distinct(
                F.concat(
                    or_empty(reasons), F.transform(or_empty(F.col("_imports")), lambda r: F.concat(F.lit("imports:"), r))
                )
            ),
        )
    return state.select("domain", "reasons", (F.size("reasons") > 0).alias("is_degraded"))


def import_dedupe(imports: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """One record per (provider, identity): the last delivered one wins."""
    keyed = imports.withColumn("identity", record_key())
    return last_by_key(keyed, ["domain", "source", "identity"], *order)


def import_breakdown(merged: DataFrame) -> DataFrame:
    return merged.groupBy("domain", "source").agg(F.count("*").alias("records"))


def import_corpus(imports: DataFrame, registry: Registry, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Tracked papers from gated import records; the first record of an id counts."""
    present = F.nullif(F.col("pmid"), F.lit(""))
    paper_id = F.coalesce(
        F.concat(F.lit("pubmed:"), present),
        F.concat(F.lit("doi:"), F.lower(F.nullif(F.col("doi"), F.lit("")))),
        F.concat_ws(":", "source", "source_id"),
    )
    gated = candidate_gate(imports, registry).drop("matched_keywords", "relevance_score")
    papers = first_by_key(gated.withColumn("paper_id", paper_id), ["domain", "paper_id"], *order)
    hay = F.lower(F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))))

    def keywords(d) -> Column:
        def hit(words: Sequence[str]) -> Column:
            return F.filter(string_array(words), lambda w: F.contains(hay, w))

        return F.struct(hit(d.ingest_anchors).alias("a"), hit(d.ingest_supporting).alias("s"))

    return (
        papers.withColumn("_k", registry.by_domain(F.col("domain"), keywords))
        .where(F.size("_k.a") > 0)
        .withColumn("score", F.size("_k.a") * 2 + F.size("_k.s"))
        .withColumn("matched_keywords", F.concat("_k.a", "_k.s"))
        .drop("_k")
    )


# -- novelty ------------------------------------------------------------------


def tracked_hints(papers: DataFrame) -> DataFrame:
    """Distinct identities of the tracked corpus."""
    extra = [F.concat(F.lit("paper:"), F.col("paper_id"))] if "paper_id" in papers.columns else []
    return papers.select("domain", F.explode(record_hints(*extra)).alias("hint")).distinct()


def _hint_flags(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """(domain, dedupe_key, hint, tracked) for every identity of every candidate."""
    own = candidates.select("domain", "dedupe_key", F.explode(record_hints()).alias("hint"))
    known = tracked_hints(papers).withColumn("tracked", F.lit(True))
    return own.join(known, ["domain", "hint"], "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def novelty_split(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Adds ``tracked``: any identity of the candidate is already in the corpus."""
    flags = _hint_flags(candidates, papers).groupBy("domain", "dedupe_key").agg(F.bool_or("tracked").alias("tracked"))
    return candidates.join(flags, ["domain", "dedupe_key"])


def novelty_basis(candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """Adds ``novelty_basis``: which identities the corpus does not know yet."""
    flags = _hint_flags(candidates, papers)

    def new(prefix: str) -> Column:
        return F.coalesce(F.bool_or(F.col("hint").startswith(prefix) & ~F.col("tracked")), F.lit(False))

    basis = flags.groupBy("domain", "dedupe_key").agg(
        labels_where(
            [
                ("doi-not-in-current-slice", new("doi:")),
                ("pmid-not-in-current-slice", new("pmid:")),
                ("pmcid-not-in-current-slice", new("pmcid:")),
                ("title-not-in-current-slice", new("title:")),
                ("pmid-available-for-review", F.bool_or(F.col("hint").startswith("pmid:"))),
            ]
        ).alias("_basis")
    )
    return candidates.join(basis, ["domain", "dedupe_key"]).withColumn(
        "novelty_basis",
        F.when(F.size("_basis") > 0, F.col("_basis")).otherwise(F.array(F.lit("novelty-requires-manual-confirmation"))),
    ).drop("_basis")


def evidence_fingerprint(recommendation: Column, source_types: Column, prefix: str = "") -> Column:
    def col(name: str) -> Column:
        return F.col(prefix + name)

    return fingerprint(
        recommendation.alias("recommendation"),
        fixed(col("ranking_score"), 3).alias("ranking"),
        fixed(col("relevance_score"), 3).alias("relevance"),
        fixed(col("authority_score"), 3).alias("authority"),
        fixed(col("source_diversity_score"), 3).alias("diversity"),
        F.array_sort(source_types).alias("sources"),
        col("record_count").cast("long").alias("records"),
        col("source_count").cast("long").alias("source_count"),
        col("full_text_availability").alias("availability"),
    )


DECISION_STATE = (
    "decision", "recommendation", "ranking_score", "relevance_score", "authority_score", "source_diversity_score",
    "source_types", "record_count", "source_count", "full_text_availability", "reviewer_notes", "decided_at",
)


def carry_forward_decisions(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """Give each candidate the decision of the first prior row sharing an identity.

    ``candidates`` carries its new ``recommendation``; ``prior`` carries ``ord``.
    A decided row whose evidence changed goes back to pending and is marked stale;
    notes and dates are kept. Prior rows are reduced to one per identity before the
    join, so a heavily repeated identity is not multiplied out.
    """
    hints = record_hints(F.col("dedupe_key"), F.coalesce("title_key", title_key(F.col("title"))))
    state = F.struct(*DECISION_STATE)
    by_hint = (
        prior.select("domain", "ord", state.alias("p"), F.explode(hints).alias("hint"))
        .groupBy("domain", "hint")
        .agg(F.min("ord").alias("prior_ord"), F.min_by("p", "ord").alias("p"))
    )
    own = candidates.select("domain", "dedupe_key", F.explode(record_hints()).alias("hint"))
    found = (
        own.join(by_hint, ["domain", "hint"])
        .groupBy("domain", "dedupe_key")
        .agg(F.min_by("p", "prior_ord").alias("p"))
    )
    joined = candidates.join(found, ["domain", "dedupe_key"], "left")
    now = evidence_fingerprint(F.col("recommendation"), F.col("source_types"))
    before = evidence_fingerprint(F.col("p.recommendation"), F.col("p.source_types"), "p.")
    stale = F.col("p").isNotNull() & (now != before)
    reset = stale & (F.col("p.decision") != "pending")
    return (
        joined.withColumn("stale_evidence", F.coalesce(stale, F.lit(False)))
        .withColumn("decision", F.when(reset, "pending").otherwise(F.coalesce("p.decision", F.lit("pending"))))
        .withColumn("stale_reason", F.when(F.col("stale_evidence"), STALE))
        .withColumn("reviewer_notes", F.col("p.reviewer_notes"))
        .withColumn("decided_at", F.col("p.decided_at"))
        .withColumn("title_key", title_key(F.col("title")))
        .drop("p")
    )


def packet_join(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions worth a review with their candidate: by key, else by any identity.

    ``candidates`` carries ``ord``. A row whose candidate is missing keeps a null
    ``candidate_key``; ``packet_missing`` lists those.
    """
    open_rows = decisions.where("recommendation <> 'defer'")
    facts = [c for c in candidates.columns if c not in ("domain", "dedupe_key", "ord")]
    slim = candidates.select(
        "domain", "ord", F.col("dedupe_key").alias("candidate_key"), F.struct(*facts).alias("candidate"),
        *[F.col(c) for c in ("doi", "pmid", "pmcid", "title")],
    )
    exact = open_rows.join(
        slim.select("domain", F.col("candidate_key").alias("dedupe_key"), "candidate_key", "candidate"),
        ["domain", "dedupe_key"],
        "left",
    )
    settled = exact.where("candidate_key is not null")
    rest = exact.where("candidate_key is null").drop("candidate_key", "candidate")
    by_hint = (
        slim.select("domain", "ord", "candidate_key", F.explode(record_hints()).alias("hint"))
        .groupBy("domain", "hint")
        .agg(F.min(F.struct("ord", "candidate_key")).alias("c"))
    )
    own = rest.select(
        "domain", "dedupe_key", F.explode(record_hints(F.col("dedupe_key"), F.col("title_key"))).alias("hint")
    )
    found = (
        own.join(by_hint, ["domain", "hint"])
        .groupBy("domain", "dedupe_key")
        .agg(F.min("c").alias("c"))
        .select("domain", "dedupe_key", F.col("c.candidate_key").alias("candidate_key"))
    )
    fallback = rest.join(found, ["domain", "dedupe_key"], "left").join(
        slim.select("domain", "candidate_key", "candidate"), ["domain", "candidate_key"], "left"
    )
    return settled.unionByName(fallback)


def packet_missing(packet: DataFrame) -> DataFrame:
    return packet.where("candidate_key is null").select("domain", "dedupe_key", "title")


def cross_artifact_checks(artifacts: DataFrame, decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Violations and warnings between the tables of one refresh; no failures means valid.

    ``artifacts``: domain, artifact (imports, snapshot, queue, packet),
    generated_at, snapshot_at, queue_at, item_count, reasons.
    """
    reason = F.col("reason")
    degraded = artifacts.select("domain", "artifact", F.explode("reasons").alias("reason")).select(
        "domain",
        F.when(reason.startswith("live-provider-truncation:"), "warning").otherwise("failure").alias("severity"),
        F.concat(F.col("artifact"), F.lit("-degraded")).alias("check"),
        reason.alias("detail"),
    )
    by_kind = artifacts.groupBy("domain").pivot("artifact", ["snapshot", "queue", "packet"]).agg(
        F.first(F.struct("generated_at", "snapshot_at", "queue_at", "item_count"))
    )
    counted = by_kind.join(items.groupBy("domain").agg(F.count("*").alias("_items")), "domain", "left")
    rules = [
        ("queue-snapshot-time", F.col("queue.snapshot_at") != F.col("snapshot.generated_at")),
        ("packet-snapshot-time", F.col("packet.snapshot_at") != F.col("snapshot.generated_at")),
        ("packet-queue-time", F.col("packet.queue_at") != F.col("queue.generated_at")),
        ("packet-item-count", F.col("packet.item_count") != F.coalesce("_items", F.lit(0))),
    ]
    lined_up = counted.select("domain", F.explode(labels_where(rules)).alias("check")).select(
        "domain", F.lit("failure").alias("severity"), "check", F.lit("").alias("detail")
    )
    # records that share an identity can leave several decisions under one key; an item is held against its own one
    queue = decisions.groupBy("domain", "dedupe_key").agg(F.collect_set("recommendation").alias("_q"))
    checked = items.select("domain", "dedupe_key", "recommendation").join(queue, ["domain", "dedupe_key"], "left")
    missing = F.coalesce(F.size("_q"), F.lit(0)) == 0
    same = F.array_contains("_q", F.col("recommendation"))
    rules = [
        ("item-without-decision", missing),
        ("deferred-item", F.when(same, F.col("recommendation") == "defer").otherwise(F.array_contains("_q", "defer"))),
        ("recommendation-mismatch", ~missing & ~same),
    ]
    per_item = checked.select("domain", "dedupe_key", F.explode(labels_where(rules)).alias("check")).select(
        "domain", F.lit("failure").alias("severity"), "check", F.col("dedupe_key").alias("detail")
    )
    return degraded.unionByName(lined_up).unionByName(per_item)
