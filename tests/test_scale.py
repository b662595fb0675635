"""Skew-safe and chunked operators against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assayer.config import default_registry
from assayer.config.policy import DEFAULT_POLICY, FEATURES
from assayer.operators import corpus, policy, research, sequence, skew

REGISTRY = default_registry()


def test_first_and_last_by_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z"), ("a", 3, "y")], "k string, o int, v string")
    assert sorted(map(tuple, skew.first_by_key(df, ["k"], "o").collect())) == [("a", 1, None), ("b", 5, "z")]
    assert sorted(map(tuple, skew.last_by_key(df, ["k"], "o").collect())) == [("a", 3, "y"), ("b", 5, "z")]


def test_rows_found_by_their_place(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), (None, 5, "z"), ("a", 3, "y"), (None, 7, "w")], "k string, o int, v string")
    assert sorted(map(tuple, skew.placed(df, ["k"], "o").collect()), key=repr) == [("a", 1, None), (None, 5, "z")]
    assert sorted(map(tuple, skew.placed(df, ["k"], "o", last=True).collect()), key=repr) == [("a", 3, "y"), (None, 7, "w")]


def test_late_texts_change_no_candidate(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "short", "equally long a", "equally long b", "the longest of all of them"]
    rows = [
        (rng.choice(["islets", None]), rng.choice(["10.1/a", "10.1/b", "10.1/c"]), rng.choice(["pubmed", "crossref", "web"]), str(i), f"t{i % 5}",
         rng.choice(texts), i, ["k"], 1.0 * i, 2000 + i % 7, i, "abstract-only")
        for i in range(60)
    ]
    df = spark.createDataFrame(rows, "domain string, doi string, source string, source_id string, title string, abstract string, ord int, "
                               "matched_keywords array<string>, relevance_score double, published_year int, citation_count int, full_text_availability string")
    df = df.withColumn("pmid", F.lit(None).cast("string")).withColumn("pmcid", F.lit(None).cast("string"))
    plain = corpus.dedupe_merge_records(df)
    late = corpus.dedupe_merge_records(df, late=True)
    assert sorted(late.columns) == sorted(plain.columns)
    assert sorted(map(repr, late.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


RANKS = {"p": 1, "q": 2, "r": 2, "s": 3}


def _next(seq):
    out = []
    for i, (phase, live) in enumerate(seq):
        hit = None
        if live and phase in RANKS:
            for later, ok in seq[i + 1:]:
                if ok and later in RANKS and later != phase and RANKS[later] >= RANKS[phase]:
                    hit = later
                    break
        out.append(hit)
    return out


def test_chunked_transitions_match_a_plain_scan(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for key in range(4):
        seq = [(rng.choice(["p", "q", "r", "s", "noise"]), rng.random() < 0.8) for _ in range(120)]
        seq = [(p, live and p != "noise") for p, live in seq]
        for i, hit in enumerate(_next(seq)):
            want[(key, i)] = hit
        rows += [(key, i, p, live) for i, (p, live) in enumerate(seq)]
    df = spark.createDataFrame(rows, "k int, i int, phase string, structural boolean")
    for size in (1, 7, 1000):
        out = sequence.phase_transitions(df, ["k"], F.floor(F.col("i") / size), "i", ranks=RANKS)
        assert {(r.k, r.i): r.next_phase for r in out.collect()} == want


def test_chunked_numbering_and_previous_value(spark):
    df = spark.createDataFrame([(k, i * 3, f"{k}-{i}") for k in range(3) for i in range(50)], "k int, i int, v string")
    chunk = F.floor(F.col("i") / 11)
    numbered = sequence.step_ordinals(df, ["k"], chunk, "i")
    assert all(r.order == r.i // 3 for r in numbered.collect())
    prev = sequence.previous_value(df, ["k"], chunk, "i", "v", "before")
    assert all(r.before == (None if r.i == 0 else f"{r.k}-{r.i // 3 - 1}") for r in prev.collect())


def test_golden_policy_metrics(spark):
    rows = [
        ("islets", "promote", 1.0), ("islets", "defer", 0.0), ("ovarian-tissue", "promote", 0.5),
        ("ovarian-tissue", "promote", 0.4), ("ovarian-tissue", "defer", 0.9),
    ]
    df = spark.createDataFrame(rows, "domain string, label string, score double").withColumn(
        "recommendation", policy.recommendation(F.col("score"), F.lit(0.9), F.lit(0.4))
    )
    m = policy.policy_metrics(df).where("domain = 'all'").first()
    assert (m.ranking_accuracy, m.promote_precision, m.promote_recall) == (0.6667, 0.5, 0.3333)
    assert (m.review_or_promote_recall, m.defer_precision, m.objective) == (1.0, 1.0, 0.6333)


def test_planning_policy_metrics_starts_no_job(spark):
    names = ", ".join(f"{f}: double" for f in FEATURES)
    rows = [("islets", "promote" if i % 3 else "defer", tuple((i * j % 7) / 7 for j in range(1, len(FEATURES) + 1))) for i in range(40)]
    df = spark.createDataFrame(rows, f"domain string, label string, features struct<{names}>")
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        swept = policy.policy_sweep(df, DEFAULT_POLICY)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = swept.collect()
    # vectors are counted once: what the other uses need is the same shuffle
    assert "ReusedExchange" in swept._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 1 + len(DEFAULT_POLICY.variants())
    assert [r.score_delta for r in rows if r.policy_id == DEFAULT_POLICY.policy_id] == [0.0]


def test_a_row_without_a_score_is_counted_and_ranks_lowest(spark):
    rows = [("d", "promote", "promote", 0.9), ("d", "defer", "defer", None), ("d", None, "review", 0.5)]
    df = spark.createDataFrame(rows, "domain string, label string, recommendation string, score double")
    m = policy.policy_metrics(df).where("domain = 'all'").first()
    assert (m.candidates, m.positives, m.negatives, m.reviewed, m.ranking_accuracy) == (3, 1, 1, 1, 1.0)


def test_sweep_scores_like_single_policies(spark):
    rng = random.Random(3)
    rows = [("islets", rng.choice(["promote", "defer"]), tuple(round(rng.random(), 1) for _ in FEATURES)) for _ in range(80)]
    schema = "domain string, label string, features struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"
    df = spark.createDataFrame(rows, schema)
    variants = DEFAULT_POLICY.variants()
    assert len(variants) == 26
    swept = {r.policy_id: r for r in policy.policy_sweep(df, DEFAULT_POLICY, variants[:3]).collect()}
    for p in [DEFAULT_POLICY, *variants[:3]]:
        one = policy.policy_metrics(policy.recommend(policy.linear_score(df, p), p)).where("domain = 'all'").first()
        assert swept[p.policy_id].objective == one.objective
        assert swept[p.policy_id].promoted == one.promoted


def test_weight_importance(spark):
    rows = policy.weight_importance(policy.policy_weights(spark, [DEFAULT_POLICY]), 3).orderBy("rank").collect()
    assert [r.feature for r in rows] == ["retrieval_score", "discovery_ranking_score", "authority_score"]


def _conflict(a, b, generic):
    chem = set(a["chemicals"]) & set(b["chemicals"])
    spec = set(a["specimens"]) & set(b["specimens"])
    fams = (a["family"], b["family"])
    if a["paper_type"] != "experimental" or b["paper_type"] != "experimental" or not chem or not spec:
        return None
    if a["species"] and b["species"] and not set(a["species"]) & set(b["species"]):
        return None
    sa, sb = set(a["specimens"]) - generic, set(b["specimens"]) - generic
    if (sa or sb) and not sa & sb:
        return None
    skip = {"unknown", "assessment", "culture"}
    pa, pb = set(a["phases"]) - skip, set(b["phases"]) - skip
    if pa and pb and not pa & pb:
        return None
    if fams[0] == fams[1] or {"unknown", "comparative"} & set(fams) or not set(a["outcomes"]) & set(b["outcomes"]):
        return None
    return len(chem)


def test_contradictions_match_all_pairs(spark):
    rng = random.Random(11)

    def some(values, low=0):
        return rng.sample(values, rng.randint(low, len(values)))

    papers = [
        {
            "domain": "islets", "ord": i, "title": f"t{i}", "paper_type": rng.choice(["experimental"] * 4 + ["review"]),
            "family": rng.choice(["vitrification", "slow-freezing", "slow-freezing", "comparative", "unknown"]),
            "chemicals": some(["a", "b", "c"]), "specimens": some(["islets", "beta cells", "islet grafts"]),
            "species": some(["human", "rat"]), "phases": some(["cooling", "warming", "assessment"]),
            "outcomes": some(["viability", "function"]),
        }
        for i in range(150)
    ]
    schema = ("domain string, ord int, title string, paper_type string, family string, chemicals array<string>, "
              "specimens array<string>, species array<string>, phases array<string>, outcomes array<string>")
    generic = {"islets", "pancreatic islets"}
    pairs = [
        (-n, a["ord"], b["ord"]) for i, a in enumerate(papers) for b in papers[i + 1:] if (n := _conflict(a, b, generic))
    ]
    df = spark.createDataFrame([tuple(p.values()) for p in papers], schema)
    for limit in (5, 20):
        got = research.contradiction_pairs(df, REGISTRY, limit=limit).orderBy("rank").collect()
        assert [(-len(r.shared_chemicals), r.ord_a, r.ord_b) for r in got] == sorted(pairs)[:limit]


def _papers(spark, n, seed, families, labels):
    """Papers with many different signatures."""
    rng = random.Random(seed)

    def some(values, low=0, high=3):
        return rng.sample(values, min(len(values), rng.randint(low, high)))

    rows = [
        ("islets", i, f"t{i}", "experimental", families(i), some(labels["chemicals"], 1), some(["islets", "beta cells", "islet grafts"], 1),
         labels["species"](i), some(["cooling", "warming", "loading", "storage"]), some(["viability", "function", "yield"], 1))
        for i in range(n)
    ]
    schema = ("domain string, ord int, title string, paper_type string, family string, chemicals array<string>, "
              "specimens array<string>, species array<string>, phases array<string>, outcomes array<string>")
    return rows, spark.createDataFrame(rows, schema)


def _brute(rows, limit):
    names = ("domain", "ord", "title", "paper_type", "family", "chemicals", "specimens", "species", "phases", "outcomes")
    papers = [dict(zip(names, r)) for r in rows]
    generic = {"islets", "pancreatic islets"}
    return sorted((-n, a["ord"], b["ord"]) for i, a in enumerate(papers) for b in papers[i + 1:] if (n := _conflict(a, b, generic)))[:limit]


def test_contradictions_where_few_papers_contradict(spark):
    """One paper of another family, or species that keep the families apart: nearly every signature has to be ruled out."""
    chemicals = [f"c{i}" for i in range(12)]
    lone = {"chemicals": chemicals, "species": lambda i: ["human"]}
    apart = {"chemicals": chemicals, "species": lambda i: ["human"] if i % 2 else ["rat"]}
    for families, labels in (
        (lambda i: "vitrification" if i == 300 else "slow-freezing", lone),
        (lambda i: "vitrification" if i % 2 else "slow-freezing", apart),
    ):
        rows, df = _papers(spark, 400, 5, families, labels)
        for hot in (7, research.HOT_BLOCK):
            got = research.contradiction_pairs(df, REGISTRY, hot=hot).orderBy("rank").collect()
            assert [(-len(r.shared_chemicals), r.ord_a, r.ord_b) for r in got] == _brute(rows, 20)


def test_contradictions_plan_starts_no_job(spark):
    _, df = _papers(spark, 30, 1, lambda i: ("vitrification", "slow-freezing")[i % 2], {"chemicals": ["a", "b"], "species": lambda i: []})
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    plan = research.contradiction_pairs(df, REGISTRY)
    assert plan.columns and set(tracker.getJobIdsForGroup(None)) == before


def _supporting(spark):
    row = {"abstract": "long", "outcome_mentions": [("viability", "strong", ["long"])], "chemicals": ["DMSO"], "family": "vitrification"}
    kinds = ("domain string, ord int, title string, specimens array<string>, chemicals array<string>, family string, abstract string, "
             "outcome_mentions array<struct<outcome_class:string,strength:string,sentences:array<string>>>")
    rows = [("islets", 1, "a", ["islet"]), ("islets", 2, "b", ["islet"]), ("islets", 3, "c", []), ("ovary", 4, "a", ["islet"])]
    evidence = spark.createDataFrame(
        [(*r, row["chemicals"], row["family"], row["abstract"], row["outcome_mentions"]) for r in rows], kinds)
    claims = spark.createDataFrame(
        [("islets", 0, ["DMSO"], ["islet"], []), ("islets", 1, [], ["islet"], ["vitrification"]), ("ovary", 0, ["DMSO"], ["islet"], [])],
        "domain string, claim_id int, chemicals array<string>, specimens array<string>, families array<string>")
    titles = spark.createDataFrame([("islets", 0, "c"), ("ovary", 0, "not there")], "domain string, claim_id int, title string")
    return evidence, claims, titles


def test_support_moves_no_paper_by_claim(spark):
    evidence, claims, titles = _supporting(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = research.support_with_fallback(research.slim(evidence), claims, titles)
        got = sorted((r.domain, r.ord, r.claim_id, r.exact) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # claim 0 of islets is named by paper 3; claim 1 by none; claim 0 of ovary names a paper that is not there
    assert got == [("islets", 1, 1, False), ("islets", 2, 1, False), ("islets", 3, 0, True), ("ovary", 4, 0, False)]
    assert "Exchange" not in plan.split("Generate explode(")[0].replace("BroadcastExchange", "")
    assert "abstract" not in out.columns and out.select("outcome_mentions").first()[0][0].asDict() == {"outcome_class": "viability", "strength": "strong"}


def test_documents_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    from assayer.queries import corpus as tables

    monkeypatch.setattr(tables, "SHARE", 32 << 10, raising=False)
    most = {}
    for times in (1, 4):
        sf = str(tmp_path / f"x{times}")
        text = F.concat_ws("\n", *[F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")), 256) for i in range(16)])
        rows = spark.range(400 * times, numPartitions=1).select(
            F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("n_chars"))
        rows.write.parquet(f"{sf}/documents.parquet")
        dealt = tables.records(spark, sf).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
        assert sum(r.n for r in dealt) == 400 * times
        most[times] = max(r.n for r in dealt)
    assert most[4] < 2 * most[1]  # four times the rows, more tasks and not larger ones
