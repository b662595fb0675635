"""Linear scoring policies: features, scores, metrics and the sweep."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config.policy import FEATURES, MIN_PROMOTE_PRECISION, MIN_PROMOTE_RECALL, MIN_SCORE_DELTA, Policy
from ..functions.arrays import labels_where
from ..functions.numbers import clamp, fixed, ratio, unit_share, year_scale
from ..functions.text import contains_count
from .sequence import running_total

# Feature levels worth a reason.
STRONG_AUTHORITY, MODERATE_AUTHORITY = 0.5, 0.2
HIGH_RELEVANCE, MEDIUM_RELEVANCE, STRONG_DIVERSITY = 8 / 15, 5 / 15, 0.5


def feature_vector(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Adds the 17 features. Missing input columns count as absent."""

    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in candidates.columns else F.lit(default)

    def present(name: str) -> Column:
        return F.when(col(name, "") != "", 1.0).otherwise(0.0)

    title, abstract = F.lower("title"), F.lower(F.coalesce("abstract", F.lit("")))
    both = F.concat(title, F.lit(" "), abstract)
    access = col("full_text_availability", "unknown")
    features = {
        "retrieval_score": fixed(col("retrieval", 0.0).cast("double"), 4),
        "matched_keyword_count": unit_share(F.size("matched_keywords"), 10),
        "title_protocol_hits": unit_share(contains_count(title, policy.protocol_signals), 5),
        "title_experimental_hits": unit_share(contains_count(title, policy.experimental_signals), 5),
        "abstract_protocol_hits": unit_share(contains_count(abstract, policy.protocol_signals), 6),
        "abstract_outcome_hits": unit_share(contains_count(abstract, policy.outcome_signals), 6),
        "negative_signal_hits": unit_share(contains_count(both, policy.negative_signals), 4),
        "doi_present": present("doi"),
        "journal_present": present("journal"),
        "recent_year": year_scale(col("published_year", 0)),
        "discovery_ranking_score": unit_share(col("ranking_score", 0.0), 15),
        "discovery_relevance_score": unit_share(col("relevance_score", 0.0), 15),
        "f_authority": fixed(clamp(col("authority_score", 0.0).cast("double")), 4),
        "f_diversity": fixed(clamp(col("source_diversity_score", 0.0).cast("double")), 4),
        "multi_source_evidence": F.when(col("source_count", 0) >= 2, 1.0).otherwise(0.0),
        "full_text_link": F.when(access.isin("open-access-full-text", "full-text-link"), 1.0).otherwise(0.0),
        "open_access_full_text": F.when(access == "open-access-full-text", 1.0).otherwise(0.0),
    }
    # authority and diversity keep their input columns, so the vector is one struct
    names = dict(zip(features, FEATURES, strict=True))
    return candidates.withColumn("features", F.struct(*[v.alias(names[k]) for k, v in features.items()]))


def gold_features(gold: DataFrame, papers: DataFrame, policy: Policy) -> DataFrame:
    """Labelled candidates from reviewed gold rows and the tracked corpus.

    The corpus has no discovery scores, so they are approximated from the match
    score and the metadata. Check coverage first with ``require_coverage``.
    """
    reviewed = gold.where("review_status = 'reviewed'").select("domain", "paper_id", "expected_in")
    retrieval = fixed(clamp(F.col("score") / 20.0), 4)
    density = fixed(clamp(F.size("matched_keywords") / 10.0), 4)
    metadata = (
        F.when(F.coalesce("doi", F.lit("")) != "", 0.15).otherwise(0.0)
        + F.when(F.coalesce("journal", F.lit("")) != "", 0.1).otherwise(0.0)
        + F.when(F.coalesce("published_year", F.lit(0)) >= 2015, 0.05).otherwise(0.0)
    )
    joined = papers.join(reviewed, ["domain", "paper_id"])
    proxies = (
        joined.withColumn("retrieval", retrieval)
        .withColumn("ranking_score", fixed(retrieval * 15, 4))
        .withColumn("relevance_score", fixed(density * 15, 4))
        .withColumn("authority_score", fixed(F.least(F.lit(1.0), metadata), 4))
        .drop("source_count", "source_diversity_score", "full_text_availability")
    )
    return feature_vector(proxies, policy).withColumn("label", F.when(F.col("expected_in"), "promote").otherwise("defer"))


def missing_reviewed(gold: DataFrame, papers: DataFrame) -> DataFrame:
    """Reviewed gold rows without a paper."""
    return gold.where("review_status = 'reviewed'").join(papers, ["domain", "paper_id"], "left_anti").select(
        "domain", "paper_id", "title"
    )


def require_coverage(gold: DataFrame, papers: DataFrame) -> None:
    """Raise, naming examples, unless every reviewed gold row has a paper."""
    missing = missing_reviewed(gold, papers)
    named = missing.limit(20).collect()
    if named:
        more = missing.count() - len(named)
        listed = ", ".join(f"{r.domain}:{r.paper_id}" for r in named) + (f" and {more} more" if more else "")
        raise ValueError(f"reviewed gold rows missing from the corpus: {listed}")


def linear_score(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``contributions`` (map) and ``score``, six decimals each."""
    parts = {f: fixed(F.col(f"features.{f}") * policy.weights[f], 6) for f in FEATURES}
    total = reduce(lambda acc, p: acc + p, parts.values(), F.lit(policy.weights["bias"]))
    pairs = [F.lit("bias"), F.lit(policy.weights["bias"])]
    for name, part in parts.items():
        pairs += [F.lit(name), part]
    return df.withColumn("contributions", F.create_map(*pairs)).withColumn("score", fixed(total, 6))


def recommendation(score: Column, promote: Column, review: Column) -> Column:
    return F.when(score >= promote, "promote").when(score >= review, "review").otherwise("defer")


def recommend(scored: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``recommendation`` and ``reasons``."""
    f = "features."
    authority, relevance = F.col(f + "authority_score"), F.col(f + "discovery_relevance_score")
    out = scored.withColumn(
        "recommendation", recommendation(F.col("score"), F.lit(policy.promote), F.lit(policy.review))
    )
    explained = labels_where(
        [
            ("multi-source", F.col(f + "multi_source_evidence") >= 1),
            ("open-access-full-text", F.col(f + "open_access_full_text") >= 1),
            ("full-text-link", (F.col(f + "open_access_full_text") < 1) & (F.col(f + "full_text_link") >= 1)),
            ("strong-authority", authority >= STRONG_AUTHORITY),
            ("moderate-authority", (authority < STRONG_AUTHORITY) & (authority >= MODERATE_AUTHORITY)),
            ("high-relevance", relevance >= HIGH_RELEVANCE),
            ("medium-relevance", (relevance < HIGH_RELEVANCE) & (relevance >= MEDIUM_RELEVANCE)),
            ("source-diversity", F.col(f + "source_diversity_score") >= STRONG_DIVERSITY),
        ]
    )
    threshold = F.concat(F.lit("score-"), F.col("recommendation"))
    lonely = F.array(F.lit("single-source-low-authority"))
    return (
        out.withColumn("_why", explained)
        .withColumn(
            "reasons",
            F.concat(
                F.array(threshold),
                F.when((F.col("recommendation") == "defer") & (F.size("_why") == 0), lonely).otherwise(F.col("_why")),
            ),
        )
        .drop("_why")
    )


def score_candidates(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Candidates with features, score, recommendation and reasons."""
    return recommend(linear_score(feature_vector(candidates, policy), policy), policy)


def _by_score(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and distinct score: outcome counts, and the negatives below the score.

    ``n`` weights a row; a row without a score ranks lowest. The running number is built in two levels, so
    no task sees all scores of a key.
    """
    n = F.col("n") if "n" in scored.columns else F.lit(1)
    label, rec = F.col("label"), F.col("recommendation") if "recommendation" in scored.columns else F.lit(None)

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    positive, negative = label == "promote", label == "defer"
    by_score = scored.groupBy(*keys, "score").agg(
        F.sum(n).alias("candidates"),
        count(positive).alias("positives"),
        count(negative).alias("negatives"),
        count(rec == "promote").alias("promoted"),
        count(rec == "review").alias("reviewed"),
        count(rec == "defer").alias("deferred"),
        count(positive & (rec == "promote")).alias("_pp"),
        count(positive & (rec != "defer")).alias("_prp"),
        count(negative & (rec == "promote")).alias("_np"),
        count(negative & (rec == "defer")).alias("_nd"),
    )
    level = F.coalesce(F.floor(F.col("score") * 20), F.lit(-(1 << 62)))
    return running_total(by_score, keys, level, "score", "negatives", "_below")


def _ranked() -> Column:
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    wins2 = F.sum(F.col("positives") * (2 * F.col("_below") + F.col("negatives"))).cast("double")
    return ratio(wins2, pairs * 2, 4).alias("ranking_accuracy")


def ranking_accuracy(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties half; counted per distinct score, never as pairs."""
    keys = list(keys)
    return _by_score(scored, keys).groupBy(*keys).agg(_ranked())


def policy_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics per domain and for all domains together (``domain`` = 'all').

    Ratios of the whole come from summed counts. ``keys`` adds e.g. a policy id. Planning starts no job:
    outcomes are counted per distinct score first, and that shuffle feeds both levels of the running count.
    """
    keys = [*keys, "domain"]
    n = F.col("n") if "n" in scored.columns else F.lit(1)
    # rows are counted before each is doubled for the whole
    small = scored.groupBy(*keys, "label", "recommendation", "score").agg(F.sum(n).alias("n"))
    both = small.withColumn("domain", F.explode(F.array(F.col("domain"), F.lit("all"))))
    summed = ("candidates", "positives", "negatives", "promoted", "reviewed", "deferred", "_pp", "_prp", "_np", "_nd")
    metrics = _by_score(both, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in summed], _ranked()).withColumns(
        {
            "promote_precision": ratio(F.col("_pp"), F.col("promoted"), 4),
            "promote_recall": ratio(F.col("_pp"), F.col("positives"), 4),
            "review_or_promote_recall": ratio(F.col("_prp"), F.col("positives"), 4),
            "defer_precision": ratio(F.col("_nd"), F.col("deferred"), 4),
            "negative_promote_rate": ratio(F.col("_np"), F.col("negatives"), 4),
        }
    )
    objective = (
        F.col("ranking_accuracy") * 0.4
        + F.col("promote_precision") * 0.2
        + F.col("promote_recall") * 0.2
        + F.col("review_or_promote_recall") * 0.15
        + F.col("defer_precision") * 0.05
    )
    return metrics.withColumn("objective", fixed(objective, 4)).drop("_pp", "_prp", "_np", "_nd")


def policy_sweep(
    labelled: DataFrame,
    base: Policy,
    variants: Sequence[Policy] | None = None,
    min_delta: float = MIN_SCORE_DELTA,
    min_precision: float = MIN_PROMOTE_PRECISION,
    min_recall: float = MIN_PROMOTE_RECALL,
) -> DataFrame:
    """Metrics of every policy variant in one pass, with its change and verdict.

    Candidates are first counted per distinct feature vector; the variants are
    then scored on those few rows, so a sweep costs one scan whatever its width.
    """
    policies = [base, *(base.variants() if variants is None else variants)]
    vectors = labelled.groupBy("domain", "label", "features").agg(F.count("*").alias("n"))
    table = F.array(
        *[
            F.struct(
                F.lit(p.policy_id).alias("policy_id"),
                F.lit(float(p.weights["bias"])).alias("bias"),
                F.array(*[F.lit(float(p.weights[f])) for f in FEATURES]).alias("weights"),
                F.lit(float(p.promote)).alias("promote"),
                F.lit(float(p.review)).alias("review"),
            )
            for p in policies
        ]
    )
    values = F.array(*[F.col(f"features.{f}") for f in FEATURES])
    scored = (
        vectors.withColumn("_v", values)
        .withColumn("_p", F.explode(table))
        .withColumn(
            "score",
            fixed(
                F.aggregate(
                    F.zip_with("_v", "_p.weights", lambda v, w: fixed(v * w, 6)),
                    F.col("_p.bias"),
                    lambda acc, x: acc + x,
                ),
                6,
            ),
        )
        .select(
            F.col("_p.policy_id").alias("policy_id"),
            "domain",
            "label",
            "n",
            "score",
            recommendation(F.col("score"), F.col("_p.promote"), F.col("_p.review")).alias("recommendation"),
        )
    )
    metrics = policy_metrics(scored, ["policy_id"]).where("domain = 'all'")
    # one row per policy
    reference = F.max(F.when(F.col("policy_id") == base.policy_id, F.col("objective"))).over(W.partitionBy("domain"))
    delta = fixed(F.col("objective") - reference, 4)
    has_positives = F.col("positives") > 0
    precise = ~has_positives | ((F.col("promoted") > 0) & (F.col("promote_precision") >= min_precision))
    recalled = ~has_positives | (F.col("promote_recall") >= min_recall)
    verdict = (
        F.when((F.col("score_delta") >= min_delta) & precise & recalled, "accepted")
        .when(F.col("score_delta") < min_delta, "objective")
        .when(~precise, "precision")
        .otherwise("recall")
    )
    return metrics.withColumn("score_delta", delta).withColumn("verdict", verdict).drop("domain")


def policy_error_lists(scored: DataFrame, limit: int = 10) -> DataFrame:
    """False promotes by score from the top, missed positives from the bottom."""
    label, rec = F.col("label"), F.col("recommendation")
    kind = F.when((label == "defer") & (rec == "promote"), "false-promote").when(
        (label == "promote") & (rec == "defer"), "missed-positive"
    )
    errors = scored.withColumn("kind", kind).where("kind is not null")
    signed = F.when(F.col("kind") == "false-promote", -F.col("score")).otherwise(F.col("score"))
    order = W.partitionBy("kind").orderBy(signed, "domain", "paper_id")
    return errors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def policy_weights(spark: SparkSession, policies: Sequence[Policy]) -> DataFrame:
    """Policies as rows: policy_id, feature, weight."""
    rows = [(p.policy_id, name, float(w)) for p in policies for name, w in p.weights.items()]
    return spark.createDataFrame(rows, "policy_id string, feature string, weight double")


def weight_importance(weights: DataFrame, limit: int = 8) -> DataFrame:
    """The largest absolute weights of each policy."""
    order = W.partitionBy("policy_id").orderBy(F.abs("weight").desc(), "feature")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
