"""Policy queries: features, scores, metrics and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config.policy import (
    DEFAULT_POLICY,
    FEATURES,
    MIN_PROMOTE_PRECISION,
    MIN_PROMOTE_RECALL,
    MIN_SCORE_DELTA,
    Policy,
)
from ..operators import match, policy
from ..session import cut
from . import corpus, sql
from .corpus import REGISTRY, per_session
from .matching import CAND
from .registry import query
from .sql import CURATED, clamp, fx, ratio, with_

P = DEFAULT_POLICY


def _hits(text: str, signals, full: int) -> str:
    total = " + ".join(f"contains({text}, {sql.q(s)})::INT" for s in signals)
    return fx(clamp(f"({total}) / {full}e0"), 4)


def features_sql(source: str, name: str = "feat", retrieval: str = "0e0", authority: str = "authority_score",
                 diversity: str = "source_diversity_score", sources: str = "source_count",
                 access: str = "full_text_availability") -> str:
    values = {
        "retrieval_score": fx(retrieval, 4),
        "matched_keyword_count": fx(clamp("len(matched_keywords) / 10e0"), 4),
        "title_protocol_hits": _hits("lt", P.protocol_signals, 5),
        "title_experimental_hits": _hits("lt", P.experimental_signals, 5),
        "abstract_protocol_hits": _hits("la", P.protocol_signals, 6),
        "abstract_outcome_hits": _hits("la", P.outcome_signals, 6),
        "negative_signal_hits": _hits("lt || ' ' || la", P.negative_signals, 4),
        "doi_present": "case when coalesce(doi, '') <> '' then 1e0 else 0e0 end",
        "journal_present": "case when coalesce(journal, '') <> '' then 1e0 else 0e0 end",
        "recent_year": f"case when coalesce(published_year, 0) = 0 then 0e0 else {fx(clamp('(published_year - 1990e0) / 40e0'), 4)} end",
        "discovery_ranking_score": fx(clamp("ranking_score / 15e0"), 4),
        "discovery_relevance_score": fx(clamp("relevance_score / 15e0"), 4),
        "authority_score": fx(clamp(authority), 4),
        "source_diversity_score": fx(clamp(diversity), 4),
        "multi_source_evidence": f"case when {sources} >= 2 then 1e0 else 0e0 end",
        "full_text_link": f"case when {access} in ('open-access-full-text', 'full-text-link') then 1e0 else 0e0 end",
        "open_access_full_text": f"case when {access} = 'open-access-full-text' then 1e0 else 0e0 end",
    }
    cols = ", ".join(f"{v} as f_{k}" for k, v in values.items())
    return f"""{name} as materialized (select *, {cols} from (
      select *, lower(title) as lt, lower(coalesce(abstract, '')) as la from {source}))"""


def score_sql(p: Policy) -> str:
    terms = " + ".join([f"({p.weights['bias']}e0)"] + [fx(f"f_{f} * ({p.weights[f]}e0)", 6) for f in FEATURES])
    return fx(terms, 6)


def verdict_sql(score: str, promote: str, review: str) -> str:
    return f"case when {score} >= {promote} then 'promote' when {score} >= {review} then 'review' else 'defer' end"


FEAT = (*CAND, features_sql("cand"))


@query("feature_vector", with_(*FEAT, "select domain, dedupe_key, " + ", ".join(f"f_{f} as {f}" for f in FEATURES) + " from feat"))
def feature_vector(spark, sf):
    out = policy.feature_vector(corpus.candidates(spark, sf), P)
    return out.select("domain", "dedupe_key", *[F.col(f"features.{f}").alias(f) for f in FEATURES])


_TOP = ("matched_keyword_count", "discovery_relevance_score", "negative_signal_hits")


@query(
    "linear_score",
    with_(*FEAT, f"select domain, dedupe_key, {score_sql(P)} as score, "
          + ", ".join(f"{fx(f'f_{f} * ({P.weights[f]}e0)', 6)} as {f}" for f in _TOP) + " from feat"),
)
def linear_score(spark, sf):
    out = policy.linear_score(policy.feature_vector(corpus.candidates(spark, sf), P), P)
    return out.select("domain", "dedupe_key", "score", *[F.element_at("contributions", f).alias(f) for f in _TOP])


_EXPLAIN = sql.labels([
    ("multi-source", "f_multi_source_evidence >= 1"), ("open-access-full-text", "f_open_access_full_text >= 1"),
    ("full-text-link", "f_open_access_full_text < 1 and f_full_text_link >= 1"),
    ("strong-authority", "f_authority_score >= 0.5e0"),
    ("moderate-authority", "f_authority_score < 0.5e0 and f_authority_score >= 0.2e0"),
    ("high-relevance", "f_discovery_relevance_score >= 8 / 15e0"),
    ("medium-relevance", "f_discovery_relevance_score < 8 / 15e0 and f_discovery_relevance_score >= 5 / 15e0"),
    ("source-diversity", "f_source_diversity_score >= 0.5e0")])
RECO = f"""judged as materialized (select *, {verdict_sql('score', f'{P.promote}e0', f'{P.review}e0')} as recommendation,
  {_EXPLAIN} as why from (select *, {score_sql(P)} as score from feat))"""


@query(
    "recommend",
    with_(*FEAT, RECO, """select domain, dedupe_key, recommendation, array_to_string(list_concat(['score-' || recommendation],
      case when recommendation = 'defer' and len(why) = 0 then ['single-source-low-authority'] else why end), '|') as reasons
      from judged"""),
)
def recommend(spark, sf):
    out = policy.score_candidates(corpus.candidates(spark, sf), P)
    return out.select("domain", "dedupe_key", "recommendation", F.array_join("reasons", "|").alias("reasons"))


# -- labelled candidates ------------------------------------------------------

_WORDS = " union all ".join(
    f"""select rec.* exclude (domain), {sql.q(d.id)} as domain, list_filter({sql.strings(d.ingest_anchors)}, lambda w: contains(hay, w)) as a,
      list_filter({sql.strings(d.ingest_supporting)}, lambda w: contains(hay, w)) as s
      from (select *, lower(title || ' ' || coalesce(abstract, '')) as hay from rec) rec"""
    for d in REGISTRY.domains
)
_META = """least(1e0, case when coalesce(doi, '') <> '' then 0.15e0 else 0e0 end + case when coalesce(journal, '') <> ''
  then 0.1e0 else 0e0 end + case when coalesce(published_year, 0) >= 2015 then 0.05e0 else 0e0 end)"""
CORPUS = f"corpus_papers as materialized (select *, len(a) * 2 + len(s) as score, list_concat(a, s) as matched_keywords from ({_WORDS}) where len(a) > 0)"
LABELLED = f"""lab as materialized (select p.*, g.expected_in, {fx(clamp('p.score / 20e0'), 4)} as retrieval,
    {fx(clamp('len(p.matched_keywords) / 10e0'), 4)} as density, {fx(_META, 4)} as meta
  from corpus_papers p join gold g on g.domain = p.domain and g.paper_id = p.paper_id and g.review_status = 'reviewed'),
lab2 as (select * exclude (score), {fx('retrieval * 15', 4)} as ranking_score, {fx('density * 15', 4)} as relevance_score from lab)"""
LAB = (*CURATED, CORPUS, LABELLED, features_sql(
    "lab2", retrieval="retrieval", authority="meta", diversity="0e0", sources="0", access="'unknown'"))
SCORED = f"""sc as materialized (select *, case when expected_in then 'promote' else 'defer' end as label,
  {verdict_sql('score', f'{P.promote}e0', f'{P.review}e0')} as recommendation from (select *, {score_sql(P)} as score from feat))"""


@per_session
def corpus_papers(spark, sf):
    """Documents matched to every domain by keyword: the tracked corpus."""
    return cut(match.keyword_domain_match(corpus.records(spark, sf), REGISTRY), "corpus")


@per_session
def labelled(spark, sf):
    return policy.gold_features(corpus.gold(spark, sf), corpus_papers(spark, sf), P)


def scored(spark, sf):
    return policy.recommend(policy.linear_score(labelled(spark, sf).drop("score"), P), P)


@query(
    "gold_features",
    with_(*LAB, "select domain, paper_id, expected_in, " + ", ".join(f"f_{f} as {f}" for f in FEATURES) + " from feat"),
)
def gold_features(spark, sf):
    return labelled(spark, sf).select(
        "domain", "paper_id", "expected_in", *[F.col(f"features.{f}").alias(f) for f in FEATURES])


@query(
    "require_coverage",
    with_(*CURATED, CORPUS, """select domain, paper_id from gold g where review_status = 'reviewed' and not exists (
      select 1 from corpus_papers p where p.domain = g.domain and p.paper_id = g.paper_id)"""),
)
def require_coverage(spark, sf):
    return policy.missing_reviewed(corpus.gold(spark, sf), corpus_papers(spark, sf)).select("domain", "paper_id")


def metrics_sql(source: str, keys: str = "") -> str:
    """Counts, pairwise ranking and objective by brute force over pairs of score groups."""
    k = f"{keys}, " if keys else ""
    on = " and ".join([f"b.{c.strip()} = a.{c.strip()}" for c in keys.split(",")] + ["b.domain = a.domain"]) if keys else "b.domain = a.domain"
    return f"""both_d as (select {k}domain, label, recommendation, score, count(*) as n from (
    select {k}domain, label, recommendation, score from {source} union all
    select {k}'all', label, recommendation, score from {source}) group by all),
by_label as (select {k}domain, label, score, sum(n) as n from both_d group by all),
wins as (select {', '.join('a.' + c.strip() for c in keys.split(',')) + ', ' if keys else ''}a.domain,
    sum(a.n * b.n * case when a.score > b.score then 2 when a.score = b.score then 1 else 0 end) as w2, sum(a.n * b.n) as pairs
  from by_label a join by_label b on {on} and a.label = 'promote' and b.label = 'defer' group by all),
counts as (select {k}domain, sum(n) as candidates, {', '.join(
    f"coalesce(sum(n) filter (where {c}), 0) as {a}" for a, c in (
        ('positives', "label = 'promote'"), ('negatives', "label = 'defer'"), ('promoted', "recommendation = 'promote'"),
        ('reviewed', "recommendation = 'review'"), ('deferred', "recommendation = 'defer'"),
        ('pp', "label = 'promote' and recommendation = 'promote'"),
        ('prp', "label = 'promote' and recommendation <> 'defer'"),
        ('np', "label = 'defer' and recommendation = 'promote'"), ('nd', "label = 'defer' and recommendation = 'defer'")))}
  from both_d group by all),
pm as (select counts.*, {ratio('coalesce(w2, 0)', 'coalesce(pairs, 0) * 2', 4)} as ranking_accuracy,
    {ratio('pp', 'promoted', 4)} as promote_precision, {ratio('pp', 'positives', 4)} as promote_recall,
    {ratio('prp', 'positives', 4)} as review_or_promote_recall, {ratio('nd', 'deferred', 4)} as defer_precision,
    {ratio('np', 'negatives', 4)} as negative_promote_rate
  from counts left join wins using ({k}domain)),
pmo as materialized (select *, {fx('ranking_accuracy * 0.4e0 + promote_precision * 0.2e0 + promote_recall * 0.2e0 + review_or_promote_recall * 0.15e0 + defer_precision * 0.05e0', 4)} as objective from pm)"""


_METRICS = ("candidates", "positives", "negatives", "promoted", "reviewed", "deferred", "ranking_accuracy",
            "promote_precision", "promote_recall", "review_or_promote_recall", "defer_precision",
            "negative_promote_rate", "objective")


@query("policy_metrics", with_(*LAB, SCORED, metrics_sql("sc"), f"select domain, {', '.join(_METRICS)} from pmo"))
def policy_metrics(spark, sf):
    return policy.policy_metrics(scored(spark, sf)).select("domain", *_METRICS)


@query("ranking_accuracy", with_(*LAB, SCORED, metrics_sql("sc"), "select domain, ranking_accuracy from pmo where domain <> 'all'"))
def ranking_accuracy(spark, sf):
    return policy.ranking_accuracy(scored(spark, sf), ["domain"])


_VARIANTS = [P, *P.variants()]
_SWEPT = "swept as (" + " union all ".join(
    f"""select {sql.q(v.policy_id)} as policy_id, domain, label, score, {verdict_sql('score', f'{v.promote}e0', f'{v.review}e0')}
      as recommendation from (select domain, case when expected_in then 'promote' else 'defer' end as label,
      {score_sql(v)} as score from feat)"""
    for v in _VARIANTS
) + ")"
_PRECISE = f"(positives = 0 or (promoted > 0 and promote_precision >= {MIN_PROMOTE_PRECISION}e0))"
_RECALLED = f"(positives = 0 or promote_recall >= {MIN_PROMOTE_RECALL}e0)"


@query(
    "policy_sweep",
    with_(*LAB, _SWEPT, metrics_sql("swept", "policy_id"), f"""select policy_id, objective, promoted, promote_precision, promote_recall, ranking_accuracy,
      score_delta, case when score_delta >= {MIN_SCORE_DELTA}e0 and {_PRECISE} and {_RECALLED} then 'accepted'
        when score_delta < {MIN_SCORE_DELTA}e0 then 'objective' when not {_PRECISE} then 'precision' else 'recall' end as verdict
      from (select *, {fx("objective - (select objective from pmo where policy_id = 'base' and domain = 'all')", 4)} as score_delta
        from pmo where domain = 'all')"""),
)
def policy_sweep(spark, sf):
    out = policy.policy_sweep(labelled(spark, sf), P)
    return out.select("policy_id", "objective", "promoted", "promote_precision", "promote_recall", "ranking_accuracy",
                      "score_delta", "verdict")


@query(
    "policy_error_lists",
    with_(*LAB, SCORED, """select kind, domain, paper_id, score, row_number() over (partition by kind
      order by case kind when 'false-promote' then -score else score end, domain, paper_id) as rank from (
        select *, case when label = 'defer' and recommendation = 'promote' then 'false-promote'
          when label = 'promote' and recommendation = 'defer' then 'missed-positive' end as kind from sc)
      where kind is not null qualify row_number() over (partition by kind
        order by case kind when 'false-promote' then -score else score end, domain, paper_id) <= 10"""),
)
def policy_error_lists(spark, sf):
    return policy.policy_error_lists(scored(spark, sf)).select("kind", "domain", "paper_id", "score", "rank")


_WEIGHTS = " union all ".join(
    f"select {sql.q(v.policy_id)} as policy_id, {sql.q(k)} as feature, {float(w)}::DOUBLE as weight"
    for v in _VARIANTS for k, w in v.weights.items())


@query(
    "weight_importance",
    with_(*LAB, _SWEPT, metrics_sql("swept", "policy_id"), f"weights as ({_WEIGHTS})", """select policy_id, feature, weight,
      row_number() over (partition by policy_id order by abs(weight) desc, feature) as rank from weights
      where policy_id in (select policy_id from pmo where domain = 'all' and objective >= (
        select objective from pmo where policy_id = 'base' and domain = 'all'))
      qualify row_number() over (partition by policy_id order by abs(weight) desc, feature) <= 8"""),
)
def weight_importance(spark, sf):
    """Leading weights of the policies that do at least as well as the current one."""
    good = policy.policy_sweep(labelled(spark, sf), P).where("score_delta >= 0").select("policy_id")
    return policy.weight_importance(policy.policy_weights(spark, _VARIANTS).join(good, "policy_id", "left_semi"))
