"""Decisions, sources, sinks and streaming on small literal tables."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from assayer.config import DEFAULT_POLICY, default_registry
from assayer.operators import corpus, policy, quality, review
from assayer.session import shared_dir
from assayer.sources import landing, sinks, validated
from assayer.streaming import decisions, incremental

REGISTRY = default_registry()
RECORD = (
    "domain string, ord int, source string, source_id string, title string, abstract string, doi string, pmid string, "
    "pmcid string, journal string, published_year int, citation_count bigint, full_text_availability string, "
    "matched_keywords array<string>, relevance_score double"
)


def record(ord, source, **kw):
    base = {
        "domain": "islets", "ord": ord, "source": source, "source_id": f"{source}:{ord}", "title": "T", "abstract": None,
        "doi": None, "pmid": None, "pmcid": None, "journal": None, "published_year": 2020, "citation_count": 10,
        "full_text_availability": "abstract-only", "matched_keywords": ["islets"], "relevance_score": 5.0,
    }
    return tuple({**base, **kw}.values())


def test_same_doi_from_two_providers_is_one_candidate(spark):
    df = spark.createDataFrame(
        [
            record(0, "pubmed", doi="10.1/A", title="Short", matched_keywords=["thaw"]),
            record(1, "openalex", doi="10.1/a", title="A longer title", full_text_availability="open-access-full-text"),
            record(2, "openalex", doi="10.1/A", title="An even longer repeated title"),
            record(3, "pubmed", pmid="7", title="Other"),
        ],
        RECORD,
    )
    rows = {r.dedupe_key: r for r in corpus.dedupe_merge_records(df).collect()}
    merged = rows["doi:10.1/a"]
    assert (merged.record_count, merged.source_count, merged.title) == (2, 2, "A longer title")
    assert merged.matched_keywords == ["islets", "thaw"]
    assert merged.full_text_availability == "open-access-full-text"
    assert merged.authority_score == 0.4 and merged.source_diversity_score == 0.333
    assert merged.relevance_score == 5.2 and merged.ranking_score == 5.933
    assert set(rows) == {"doi:10.1/a", "pmid:7"}


CANDIDATE = (
    "domain string, dedupe_key string, title string, doi string, pmid string, pmcid string, recommendation string, "
    "ranking_score double, relevance_score double, authority_score double, source_diversity_score double, "
    "source_types array<string>, record_count int, source_count int, full_text_availability string"
)
PRIOR = (
    "domain string, ord int, dedupe_key string, title string, doi string, pmid string, pmcid string, title_key string, "
    "decision string, recommendation string, ranking_score double, relevance_score double, authority_score double, "
    "source_diversity_score double, source_types array<string>, record_count int, source_count int, "
    "full_text_availability string, reviewer_notes string, decided_at timestamp"
)


def test_decision_survives_a_key_change_and_goes_stale(spark):
    now = spark.createDataFrame(
        [("islets", "doi:10.1/x", "Paper", "10.1/x", "9", None, "defer", 1.0, 1.0, 0.0, 0.1, ["pubmed"], 1, 1, "unknown"),
         ("islets", "title:new", "New", None, None, None, "review", 1.0, 1.0, 0.0, 0.1, ["pubmed"], 1, 1, "unknown")],
        CANDIDATE,
    )
    prior = spark.createDataFrame(
        [("islets", 0, "pmid:9", "Paper", None, "9", None, "title:paper", "promote", "promote", 9.0, 8.0, 0.6, 0.1,
          ["pubmed"], 1, 1, "open-access-full-text", "keep this note", None)],
        PRIOR,
    )
    rows = {r.dedupe_key: r for r in corpus.carry_forward_decisions(now, prior).collect()}
    moved = rows["doi:10.1/x"]
    assert (moved.decision, moved.recommendation, moved.stale_evidence) == ("pending", "defer", True)
    assert moved.reviewer_notes == "keep this note" and moved.stale_reason == corpus.STALE
    assert (rows["title:new"].decision, rows["title:new"].stale_evidence) == ("pending", False)


def test_unchanged_decision_is_kept(spark):
    state = ("promote", 9.0, 8.0, 0.6, 0.1, ["pubmed"], 1, 1, "unknown")
    now = spark.createDataFrame([("islets", "doi:10.1/x", "Paper", "10.1/x", None, None, *state)], CANDIDATE)
    prior = spark.createDataFrame(
        [("islets", 0, "doi:10.1/x", "Paper", "10.1/x", None, None, "title:paper", "promote", *state, None, None)], PRIOR
    )
    row = corpus.carry_forward_decisions(now, prior).first()
    assert (row.decision, row.stale_evidence) == ("promote", False)
    # a second run over the result changes nothing
    again = corpus.carry_forward_decisions(now, corpus.carry_forward_decisions(now, prior).withColumn("ord", F.lit(0)))
    assert (again.first().decision, again.first().stale_evidence) == ("promote", False)


def test_missing_reviewed_gold_raises(spark):
    gold = spark.createDataFrame([("islets", "p1", "T", "reviewed")], "domain string, paper_id string, title string, review_status string")
    papers = spark.createDataFrame([("islets", "p2")], "domain string, paper_id string")
    with pytest.raises(ValueError, match="islets:p1"):
        policy.require_coverage(gold, papers)
    policy.require_coverage(gold, papers.withColumn("paper_id", F.lit("p1")))


ARTIFACT = ("domain string, artifact string, generated_at int, snapshot_at int, queue_at int, item_count int, "
            "reasons array<string>")


def artifacts(spark, reasons=(), packet_queue_at=2):
    return spark.createDataFrame(
        [("islets", "snapshot", 1, 1, 1, 1, list(reasons)), ("islets", "queue", 2, 1, 2, 1, []),
         ("islets", "packet", 3, 1, packet_queue_at, 1, [])],
        ARTIFACT,
    )


def test_cross_artifact_checks(spark):
    decisions = spark.createDataFrame([("islets", "k", "promote")], "domain string, dedupe_key string, recommendation string")

    def check(a, items=decisions):
        return [(r.severity, r["check"]) for r in corpus.cross_artifact_checks(a, decisions, items).collect()]

    assert check(artifacts(spark)) == []
    assert check(artifacts(spark, ["live-provider-truncation:openalex"])) == [("warning", "snapshot-degraded")]
    assert check(artifacts(spark, ["live-provider-failures:crossref"])) == [("failure", "snapshot-degraded")]
    assert check(artifacts(spark, packet_queue_at=9)) == [("failure", "packet-queue-time")]
    deferred = decisions.withColumn("recommendation", F.lit("defer"))
    assert ("failure", "recommendation-mismatch") in check(artifacts(spark), deferred)


def test_an_item_is_checked_against_its_own_decision(spark):
    kind = "domain string, dedupe_key string, recommendation string"
    queue = spark.createDataFrame([("islets", "k", "promote"), ("islets", "k", "review"), ("islets", "d", "defer"), ("islets", "d", "review")], kind)
    none = artifacts(spark).limit(0)

    def check(items):
        return sorted((r["check"], r.detail) for r in corpus.cross_artifact_checks(none, queue, spark.createDataFrame(items, kind)).collect())

    assert check([("islets", "k", "promote"), ("islets", "k", "review"), ("islets", "d", "review")]) == []
    assert check([("islets", "d", "defer")]) == [("deferred-item", "d")]
    assert check([("islets", "k", "defer"), ("islets", "x", "review")]) == [("item-without-decision", "x"), ("recommendation-mismatch", "k")]
    assert check([("islets", "d", "promote")]) == [("deferred-item", "d"), ("recommendation-mismatch", "d")]


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_write_if_changed_ignores_run_time_and_order(spark):
    target = folder(spark, "t")
    df = spark.createDataFrame([(1, None, {"a": 1}), (2, "x", {})], "id int, v string, m map<string,int>")
    assert sinks.write_if_changed(df.withColumn("generated_at", F.lit(1)), target)
    assert not sinks.write_if_changed(df.orderBy(F.desc("id")).withColumn("generated_at", F.lit(2)), target)
    assert sinks.write_if_changed(df.fillna("").withColumn("generated_at", F.lit(3)), target)
    assert sinks.VersionedTable(spark, target).versions() == [0, 1]


def test_write_if_changed_sees_empty_tables_types_and_repeated_rows(spark):
    target = folder(spark, "t")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "id int, v string")
    empty = spark.createDataFrame([], "id int, v string")
    steps = [empty, empty.where("id > 1"), df, df.repartition(3), df.distinct(), df.withColumn("id", F.col("id").cast("long")), df.limit(0), empty]
    written = [sinks.write_if_changed(step, target) for step in steps]
    assert written == [True, False, True, False, True, True, True, False]
    assert sinks.VersionedTable(spark, target).read().count() == 0


def test_write_if_changed_reads_its_input_once_and_no_version(spark):
    target = folder(spark, "t")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(counted, "id long")
    assert sinks.write_if_changed(df, target)
    assert read.value == 1000
    # with its files gone, the stored version could not be read; its fingerprint can
    table = sinks.VersionedTable(spark, target)
    for part in [x.getPath() for x in table._fs.listStatus(table._new_path(f"{target}/v0")) if x.getPath().getName().startswith("part-")]:
        table._fs.delete(part, False)
    assert not sinks.write_if_changed(df, target)
    assert read.value == 2000


def write_import(spark, path, domain, records):
    body = json.dumps({"domain": domain, "source": "pubmed", "generated_at": "2024-01-01T00:00:00Z", "records": records})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("append").text(path)


KEPT = {
    "source": "pubmed", "source_id": "1", "doi": "10.1/z", "full_text_availability": "abstract-only",
    "title": "Cryopreservation of pancreatic islets after thaw", "abstract": "Vitrification of islets.",
}


def test_import_of_another_domain_is_refused(spark):
    path = folder(spark, "imports")
    write_import(spark, path, "hepatocytes", [KEPT])
    assert landing.scan_import_files(spark, path, "hepatocytes").count() == 1
    with pytest.raises(Exception, match="expected islets"):
        landing.scan_import_files(spark, path, "islets").collect()


def test_incremental_import_reads_each_file_once(spark):
    path, state, checkpoint = folder(spark, "in"), folder(spark, "state"), folder(spark, "cp")
    write_import(spark, path, "islets", [KEPT, {**KEPT, "source": "crossref", "source_id": "2"}])

    def run():
        incremental.incremental_import(spark, path, state, checkpoint, REGISTRY).awaitTermination()
        return incremental.current_candidates(spark, state).collect()

    first = run()
    assert [(r.dedupe_key, r.record_count) for r in first] == [("doi:10.1/z", 2)]
    assert [(r.dedupe_key, r.record_count) for r in run()] == [("doi:10.1/z", 2)]
    write_import(spark, path, "islets", [{**KEPT, "source": "openalex", "source_id": "3"}, {**KEPT, "title": "off topic"}])
    assert [(r.dedupe_key, r.record_count) for r in run()] == [("doi:10.1/z", 3)]


def test_of_many_documents_in_a_file_the_earlier_one_wins(spark):
    path, state = folder(spark, "in"), folder(spark, "state")
    keyless = {**KEPT, "doi": None}

    def line(day, abstract):
        return (json.dumps({"domain": "islets", "source": "pubmed", "generated_at": f"2024-01-0{day}T00:00:00Z",
                            "records": [{**keyless, "source_id": str(9 - day), "abstract": abstract}]}),)

    lines = [line(3, "Vitrification of islets, later."), line(1, "Vitrification of islets."), line(2, "Vitrification of islets, in between.")]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    incremental.incremental_import(spark, path, state, folder(spark, "cp"), REGISTRY).awaitTermination()
    assert [r.abstract for r in incremental.current_candidates(spark, state).collect()] == ["Vitrification of islets."]


def test_batches_stored_without_a_time_are_still_read(spark):
    path, state, checkpoint = folder(spark, "in"), folder(spark, "state"), folder(spark, "cp")
    write_import(spark, path, "islets", [KEPT])
    incremental.incremental_import(spark, path, state, checkpoint, REGISTRY).awaitTermination()
    old = folder(spark, "state")
    spark.read.parquet(f"{state}/records").drop("generated_at").write.partitionBy("run", "batch").parquet(f"{old}/records")
    assert [r.dedupe_key for r in incremental.current_candidates(spark, old).collect()] == ["doi:10.1/z"]


def decided(spark, state):
    """Current candidates with a fixed recommendation, and the decisions carried onto them."""
    rows = incremental.current_candidates(spark, state).withColumn(
        "recommendation", F.when(F.col("record_count") > 1, "promote").otherwise("review")
    )
    return incremental.refresh_decisions(rows, state)


def test_decisions_are_carried_over_two_runs(spark):
    path, state, checkpoint = folder(spark, "in"), folder(spark, "state"), folder(spark, "cp")

    def run():
        incremental.incremental_import(spark, path, state, checkpoint, REGISTRY).awaitTermination()
        return {r.dedupe_key: r for r in decided(spark, state).collect()}

    other = {**KEPT, "doi": None, "pmid": "77", "title": "Slow freezing and thawing of islets in cryobags"}
    write_import(spark, path, "islets", [{**KEPT, "doi": None, "pmid": "5"}, other])
    first = run()
    assert {r.decision for r in first.values()} == {"pending"} and not any(r.stale_evidence for r in first.values())
    # a reviewer decides both
    table = sinks.VersionedTable(spark, f"{state}/decisions")
    table.write(table.read().withColumns({"decision": F.lit("promote"), "reviewer_notes": F.concat(F.lit("note "), "pmid")}))
    # the first is delivered again under a DOI, by another provider: a new key and other evidence
    write_import(spark, path, "islets", [{**KEPT, "pmid": "5", "source": "crossref", "source_id": "9"}])
    again = run()
    kept, changed = again["pmid:77"], again["doi:10.1/z"]
    assert (kept.decision, kept.stale_evidence, kept.reviewer_notes) == ("promote", False, "note 77")
    assert (changed.decision, changed.stale_evidence, changed.reviewer_notes) == ("pending", True, "note 5")
    # a third run without news changes nothing
    assert {(r.dedupe_key, r.decision, r.reviewer_notes) for r in run().values()} == {
        (r.dedupe_key, r.decision, r.reviewer_notes) for r in again.values()
    }


def test_a_new_checkpoint_keeps_what_is_stored(spark):
    state = folder(spark, "state")
    paths = [folder(spark, "in") for _ in range(2)]
    write_import(spark, paths[0], "islets", [KEPT])
    write_import(spark, paths[1], "islets", [{**KEPT, "doi": "10.1/other", "title": "Cryopreservation of islets on a chip"}])
    for path in paths:  # batch ids start at 0 in both
        incremental.incremental_import(spark, path, state, folder(spark, "cp"), REGISTRY).awaitTermination()
    assert {r.dedupe_key for r in incremental.current_candidates(spark, state).collect()} == {"doi:10.1/z", "doi:10.1/other"}


def test_compaction_changes_no_candidate(spark):
    path, state, checkpoint = folder(spark, "in"), folder(spark, "state"), folder(spark, "cp")

    def run(records):
        write_import(spark, path, "islets", records)
        incremental.incremental_import(spark, path, state, checkpoint, REGISTRY).awaitTermination()

    def now():
        return sorted((r.dedupe_key, r.record_count, r.title) for r in incremental.current_candidates(spark, state).collect())

    run([KEPT, {**KEPT, "title": "Cryopreservation of islets, again", "source_id": "4"}])
    run([{**KEPT, "source": "crossref", "source_id": "2"}, {**KEPT, "title": "Later cryopreservation of islets", "source_id": "5"}])
    before = now()
    incremental.compact(spark, state)
    assert now() == before
    base = sinks.VersionedTable(spark, f"{state}/base").read()
    assert base.count() == 2  # one row for each provider of the one paper
    run([{**KEPT, "source": "openalex", "source_id": "3"}])
    assert [n for _, n, _ in now()] == [3]
    incremental.compact(spark, state)
    assert [n for _, n, _ in now()] == [3]


def test_rules_split_valid_and_rejected(spark):
    df = spark.createDataFrame(
        [("pubmed", "1", "T", 3, None, 1.0), ("web", "2", None, -1, "open", -2.0)],
        "source string, source_id string, title string, citation_count int, full_text_availability string, relevance_score double",
    )
    valid, rejects = validated.split_valid(validated.check_rules(df, validated.RECORD_RULES))
    assert [(r.source_id, r.full_text_availability) for r in valid.collect()] == [("1", "unknown")]
    assert len(rejects.first().problems) == 5


GOLD = (
    "domain string, paper_id string, title string, review_status string, expected_in boolean, expected_paper_type string, "
    "expected_family string, expected_species array<string>, expected_specimens array<string>, "
    "expected_outcomes array<string>, expected_phases array<string>, ord int"
)
PAPER = (
    "domain string, paper_id string, paper_type string, family string, species array<string>, specimens array<string>, "
    "outcomes array<string>, phases array<string>, confidence double"
)


def test_empty_sets_and_missing_rows(spark):
    gold = spark.createDataFrame(
        [("islets", "a", "A", "reviewed", True, "experimental", "vitrification", ["rat"], [], None, None, 0),
         ("islets", "b", "B", "reviewed", True, None, "unknown", None, None, None, None, 1),
         ("islets", "c", "C", "seeded", False, None, None, None, None, None, None, 2)],
        GOLD,
    )
    papers = spark.createDataFrame(
        [("islets", "a", "experimental", "slow-freezing", ["rat", "human"], [], ["viability"], [], 0.8),
         ("islets", "c", "review", "unknown", [], [], [], [], 0.5)],
        PAPER,
    )
    rows = {r.subset: r for r in quality.subset_metrics(quality.gold_join(gold, papers)).collect()}
    everything = rows["all"]
    assert (everything.tp, everything.fn, everything.fp, everything.tn) == (1, 1, 1, 0)
    assert (everything.inclusion_precision, everything.inclusion_f1) == (0.5, 0.5)
    assert everything.family_accuracy == 0.0 and everything.paper_type_accuracy == 1.0
    assert everything.species_f1 == 0.667
    # labelled empty against empty: precision 0, recall 1, yet an exact match
    assert (everything.specimens_precision, everything.specimens_recall, everything.specimens_f1) == (0.0, 1.0, 0.0)
    assert everything.specimens_exact == 1
    assert rows["reviewed"].entries == 2 and rows["seeded"].fp == 1
    for r in rows.values():
        assert 0 <= r.inclusion_f1 <= 1 and 0 <= r.species_f1 <= 1


def test_override_null_is_not_an_empty_statement(spark):
    papers = spark.createDataFrame([("islets", "a", "review", "unknown", ["rat"], ["x"], ["o"], ["p"], 0.5),
                                    ("islets", "b", "review", "unknown", ["rat"], ["x"], ["o"], ["p"], 0.5)], PAPER)
    overrides = spark.createDataFrame(
        [("islets", "a", None, "vitrification", [], None), ("islets", "b", True, None, None, None)],
        "domain string, paper_id string, excluded boolean, family string, species array<string>, specimens array<string>",
    )
    row = review.apply_overrides(papers, overrides).collect()
    assert [(r.paper_id, r.family, r.species, r.specimens) for r in row] == [("a", "vitrification", [], ["x"])]


SCENARIO = (
    "domain string, scenario_id string, paper_id string, kind string, patch_paper_type string, patch_family string, "
    "patch_species array<string>, patch_specimens array<string>, patch_outcomes array<string>, "
    "patch_phases array<string>, expected_fields array<string>, min_inclusion_f1 double, min_family_accuracy double, "
    "min_paper_type_accuracy double, min_outcomes_f1 double, min_phases_f1 double"
)


def test_regression_scenarios_find_the_repair(spark):
    labels = ["experimental", "vitrification", ["rat"], ["islets"], ["viability"], ["cooling"]]
    gold = spark.createDataFrame(
        [("islets", "a", "A", "reviewed", True, *labels, 0), ("islets", "b", "B", "reviewed", True, *labels, 1),
         ("islets", "x", "X", "reviewed", False, None, None, None, None, None, None, 2)],
        GOLD,
    )
    raw = ["unknown", "unknown", ["rat"], ["islets"], ["viability"], ["cooling"], 0.9]
    papers = spark.createDataFrame([("islets", p, *raw) for p in "abx"], PAPER)
    overrides = spark.createDataFrame(
        [("islets", "a", None, *labels), ("islets", "b", None, *labels), ("islets", "x", True, *[None] * 6)],
        "domain string, paper_id string, excluded boolean, paper_type string, family string, species array<string>, "
        "specimens array<string>, outcomes array<string>, phases array<string>",
    )
    scenarios = spark.createDataFrame(
        [("islets", "leak", "x", "remove-override", *[None] * 6, ["excluded"], 0.05, None, None, None, None),
         ("islets", "labels", "a", "replace-override", "unknown", "unknown", None, None, None, None,
          ["paper_type", "family"], None, 0.1, 0.1, None, None),
         ("islets", "outcome", "b", "replace-override", None, None, None, None, [], None, ["outcomes"], None, None, None, 0.1,
          None),
         ("islets", "asks-too-much", "b", "replace-override", None, None, None, None, [], None, ["family"], None, None, None,
          None, None)],
        SCENARIO,
    )
    rows = {r.scenario_id: r for r in review.regression_scenarios(scenarios, overrides, papers, gold).collect()}
    assert rows["leak"].passed and rows["leak"].matched_fields == ["excluded"]
    assert rows["labels"].passed and rows["labels"].gain_family_accuracy == 0.5
    assert rows["outcome"].passed and rows["outcome"].gain_outcomes_f1 == 0.5
    assert not rows["asks-too-much"].passed


def test_recommendation_and_reasons(spark):
    strong = ("Cryopreservation vitrification freezing thaw effect viability", "vitrification warming", ["a"] * 8, "10.1/x",
              "J", 2022, 8.9, 8.1, 0.6, 0.5, 2, "open-access-full-text")
    weak = ("Retrospective note", "", [], None, None, None, 0.4, 0.3, 0.0, 0.1, 1, "unknown")
    df = spark.createDataFrame(
        [strong, weak],
        "title string, abstract string, matched_keywords array<string>, doi string, journal string, published_year int, "
        "ranking_score double, relevance_score double, authority_score double, source_diversity_score double, "
        "source_count int, full_text_availability string",
    )
    a, b = policy.score_candidates(df, DEFAULT_POLICY).collect()
    assert a.recommendation == "promote" and "multi-source" in a.reasons and "strong-authority" in a.reasons
    assert b.recommendation == "defer" and b.reasons == ["score-defer", "single-source-low-authority"]
    assert abs(sum(a.contributions.values()) - a.score) < 1e-5


def judged(rows):
    return rows.withColumn("recommendation", F.when(F.col("record_count") > 1, "promote").otherwise("review"))


def test_stream_decisions_touch_only_their_identities(spark):
    path, state, checkpoint = folder(spark, "in"), folder(spark, "state"), folder(spark, "cp")

    def run(records, **kw):
        write_import(spark, path, "islets", records)
        decisions.incremental_decisions(spark, path, state, checkpoint, REGISTRY, judged, **kw).awaitTermination()
        return {r.dedupe_key: r for r in decisions.current_decisions(spark, state).collect()}

    def opened():
        """Buckets of decisions and records that were written so far."""
        store = decisions.DecisionState(spark, state)
        return store, store.spark.read.parquet(f"{state}/decided")

    other = {**KEPT, "doi": None, "pmid": "77", "title": "Slow freezing and thawing of islets in cryobags"}
    first = run([{**KEPT, "doi": None, "pmid": "5"}, other], buckets=1009)
    assert set(first) == {"pmid:5", "pmid:77"}
    assert {(r.decision, r.stale_evidence) for r in first.values()} == {("pending", False)}
    done = [(d, k, "promote", f"note {k}", None) for d, k in (("islets", "pmid:5"), ("islets", "pmid:77"), ("islets", "pmid:none"))]
    decisions.record_reviews(spark, state, spark.createDataFrame(
        done, "domain string, dedupe_key string, decision string, reviewer_notes string, decided_at timestamp"))
    # one bucket in a thousand each, so that a look into the other's would show: its decisions are made unreadable
    store, log = opened()
    touched = {r.bucket for r in log.where("dedupe_key = 'pmid:5'").select("bucket").distinct().collect()}
    spoiled = [r.bucket for r in log.where("dedupe_key = 'pmid:77'").select("bucket").distinct().collect()]
    assert touched.isdisjoint(spoiled)
    files = [f for f in log.inputFiles() if any(f"bucket={b}/" in f for b in spoiled)]
    kept = {}
    for f in files:
        name = f.removeprefix("file://").removeprefix("file:")
        with open(name, "rb") as fh:
            kept[name] = fh.read()
        with open(name, "wb") as fh:
            fh.write(b"spoiled")
    # delivered again under a DOI, by another provider, with another title: a new key and other evidence
    write_import(spark, path, "islets", [{**KEPT, "pmid": "5", "source": "crossref", "source_id": "9"}])
    decisions.incremental_decisions(spark, path, state, checkpoint, REGISTRY, judged).awaitTermination()
    for name, body in kept.items():
        with open(name, "wb") as fh:
            fh.write(body)
    again = {r.dedupe_key: r for r in decisions.current_decisions(spark, state).collect()}
    assert set(again) == {"pmid:5", "pmid:77", "doi:10.1/z"}
    assert (again["pmid:77"].decision, again["pmid:77"].reviewer_notes) == ("promote", "note pmid:77")
    assert (again["pmid:5"].decision, again["pmid:5"].stale_evidence) == ("promote", False)
    new = again["doi:10.1/z"]
    assert (new.decision, new.stale_evidence, new.reviewer_notes) == ("pending", True, "note pmid:5")
    with pytest.raises(ValueError, match="1009 buckets"):
        decisions.DecisionState(spark, state, 8)


def test_a_decision_batch_run_again_changes_nothing(spark):
    state = folder(spark, "state")
    store = decisions.DecisionState(spark, state, 8)
    columns = "domain string, file string, pos int, source string, source_id string, title string, abstract string, doi string, pmid string, " \
              "pmcid string, journal string, published_year int, authors_flat string, citation_count bigint, full_text_availability string"

    def batch(*rows):
        base = {"domain": "islets", "file": "f", "pos": 0, "source": "pubmed", "source_id": "1", "title": KEPT["title"], "abstract": KEPT["abstract"],
                "doi": "10.1/z", "pmid": None, "pmcid": None, "journal": None, "published_year": 2020, "authors_flat": None,
                "citation_count": 3, "full_text_availability": "abstract-only"}
        return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], columns)

    def now():
        return sorted((r.dedupe_key, r.decision, r.record_count, r.stale_evidence) for r in decisions.current_decisions(spark, state).collect())

    def decide(number, *rows):
        decisions.decide_batch(store, batch(*rows), "run=000000-x", number, REGISTRY, judged)

    assert decisions.current_decisions(spark, state) is None
    decide(0, {"title": "unrelated", "abstract": None})  # nothing passes the gate
    assert decisions.current_decisions(spark, state) is None
    decide(1, {}, {"source": "web", "pos": 1, "source_id": "7"}, {"pos": 2})
    before = now()
    assert before == [("doi:10.1/z", "pending", 2, False)]
    # a longer title replaces the old one, which is no identity of the candidate any more
    longer = KEPT["title"] + ", revisited at length"
    decide(2, {"source": "crossref", "title": longer})
    after = now()
    assert after == [("doi:10.1/z", "pending", 3, True)]
    decide(3, {"doi": "10.1/else", "source_id": "8"})  # has the old title
    decide(2, {"source": "crossref", "title": longer})
    assert now() == [("doi:10.1/else", "pending", 1, False), *after]
