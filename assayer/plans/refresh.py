"""The corpus refresh: provider records to a reviewed queue, stage by stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_POLICY, Policy, Registry
from ..config.defaults import DIVERSITY_SOURCES
from ..functions.text import title_key
from ..operators import corpus, match, policy as scoring
from ..session import cut
from ..sources.landing import corpus_as_source, retain_prior_on_empty


def rank_candidates(
    records: DataFrame, registry: Registry, order: Sequence[str] = ("ord",), baseline: Sequence[str] = DIVERSITY_SOURCES
) -> DataFrame:
    """Gate, merge and score provider records; one shuffle of the kept records."""
    return corpus.dedupe_merge_records(match.candidate_gate(records, registry), order, baseline)


def review_queue(
    candidates: DataFrame, papers: DataFrame, prior: DataFrame, scoring_policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Novel candidates with a recommendation and any decision they already had.

    ``candidates`` and ``papers`` should be stored stages: identities are read
    several times.
    """
    novel = corpus.novelty_split(candidates, papers).where(~F.col("tracked")).drop("tracked")
    scored = scoring.score_candidates(novel, scoring_policy).drop("features", "contributions")
    return corpus.carry_forward_decisions(scored, prior)


def refresh(
    live: DataFrame,
    imports: DataFrame,
    papers: DataFrame,
    prior: DataFrame,
    registry: Registry,
    run_at: str,
    prior_imports: DataFrame | None = None,
    fetch_log: DataFrame | None = None,
    own_corpus: bool = True,
    baseline: Sequence[str] = DIVERSITY_SOURCES,
    scoring_policy: Policy = DEFAULT_POLICY,
) -> dict[str, DataFrame]:
    """All tables of one refresh; every stage is stored in the shared folder.

    ``live`` are the providers' records, ``imports`` the delivered ones: of an identity that was delivered twice
    the last counts, and if nothing was delivered the prior set stays, with the reason on record. The
    tracked papers are one more source unless ``own_corpus`` is off. ``run_at`` stamps the tables, so
    that ``checks`` can tell whether they belong together.
    """
    merged = corpus.import_dedupe(imports).drop("identity")
    kept = cut(merged.withColumn("reason", F.lit(None).cast("string")) if prior_imports is None else retain_prior_on_empty(merged, prior_imports), "imports")
    outside = corpus.source_union(
        live.withColumn("kind", F.lit("live-provider")), kept.drop("reason").withColumn("kind", F.lit("import")))
    # bodies are searched only where the title passes, and only what passes both is stored
    passed = match.candidate_gate(outside, registry)
    if own_corpus:
        passed = corpus.source_union(passed, corpus_as_source(papers, registry).withColumn("kind", F.lit("corpus")))
    accepted = cut(passed, "records")
    origin = ("domain", "kind", "source")
    fetched = outside.select(*origin).unionByName(accepted.where("kind = 'corpus'").select(*origin))
    providers = corpus.provider_stats(fetched, fetch_log, accepted)
    reasons = kept.where("reason is not null").select("domain", "reason").distinct()
    import_state = reasons.groupBy("domain").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    degradation = cut(corpus.degradation_state(providers, import_state), "degradation")

    candidates = cut(corpus.dedupe_merge_records(accepted.drop("kind"), baseline=baseline), "candidates")
    queue = cut(review_queue(candidates, papers, prior, scoring_policy), "queue")
    ordered = candidates.withColumn("ord", F.col("first_seen.ord"))
    packet = cut(corpus.packet_join(queue.withColumn("title_key", title_key(F.col("title"))), ordered), "packet")

    stamp = F.lit(run_at).cast("timestamp")
    items = packet.groupBy("domain").agg(F.count("*").alias("item_count"))
    domains = queue.select("domain").distinct().join(items, "domain", "left").join(degradation.select("domain", "reasons"), "domain", "left")
    none = F.array().cast("array<string>")
    artifacts = domains.select(
        "domain",
        F.explode(F.array(*[F.lit(a) for a in ("imports", "snapshot", "queue", "packet")])).alias("artifact"),
        stamp.alias("generated_at"), stamp.alias("snapshot_at"), stamp.alias("queue_at"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"), "reasons",
    ).withColumn("reasons", F.when(F.col("artifact") == "snapshot", F.coalesce("reasons", none)).otherwise(none))
    checks = corpus.cross_artifact_checks(artifacts, queue, packet)
    return {
        "imports": kept, "providers": providers, "degradation": degradation, "candidates": candidates, "queue": queue,
        "packet": packet, "checks": checks,
    }
