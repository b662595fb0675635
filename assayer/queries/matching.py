"""Keyword, concept and gate queries, and the merged candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as merge
from ..operators import match
from . import corpus, sql
from .corpus import REGISTRY
from .registry import query
from .sql import GATE, REC, candidates_sql, joined, q, strings, with_
from .vocabulary import DIVERSITY_SOURCES

_DOMAIN_WORDS = " union all ".join(
    f"select ord, title, {q(d.id)} as domain, list_filter({strings(d.ingest_anchors)}, lambda w: contains(hay, w)) as a,"
    f" list_filter({strings(d.ingest_supporting)}, lambda w: contains(hay, w)) as s from hay"
    for d in REGISTRY.domains
)
HAY = "hay as (select ord, title, lower(title || ' ' || coalesce(abstract, '')) as hay from rec)"
CAND = (REC, GATE, candidates_sql("gated", DIVERSITY_SOURCES))


def pipe(col: str):
    return F.array_join(F.col(col), "|").alias(col)


@query(
    "keyword_domain_match",
    with_(REC, HAY, f"select domain, ord, len(a) * 2 + len(s) as score, {joined('list_concat(a, s)')} as keywords "
          f"from ({_DOMAIN_WORDS}) where len(a) > 0"),
)
def keyword_domain_match(spark, sf):
    out = match.keyword_domain_match(corpus.records(spark, sf).select("ord", "title", "abstract"), REGISTRY)
    return out.select("domain", "ord", "score", F.array_join("matched_keywords", "|").alias("keywords"))


@query(
    "concept_match",
    with_(REC, f"select domain, ord, {joined(sql.by_domain(lambda d: sql.concepts('lower(title)', d.anchors)))} as anchors,"
          f" {joined(sql.by_domain(lambda d: sql.concepts('lower(title)', REGISTRY.required(d))))} as required from rec"),
)
def concept_match(spark, sf):
    out = match.concept_match(corpus.records(spark, sf), REGISTRY, "title", "anchors", "anchors")
    out = match.concept_match(out, REGISTRY, "title", "required", "required")
    return out.select("domain", "ord", pipe("anchors"), pipe("required"))


@query(
    "coverage_relevance",
    with_(REC, GATE, f"select domain, ord, relevance_score, {joined('matched_keywords')} as matched_keywords,"
          f" {joined('m.title_context')} as title_context, {joined('m.title_methods')} as title_methods from scored"),
)
def coverage_relevance(spark, sf):
    out = match.coverage_relevance(corpus.records(spark, sf), REGISTRY)
    return out.select(
        "domain", "ord", "relevance_score", pipe("matched_keywords"),
        F.array_join("m.title_context", "|").alias("title_context"),
        F.array_join("m.title_methods", "|").alias("title_methods"),
    )


@query(
    "candidate_gate",
    with_(REC, GATE, f"select domain, ord, relevance_score, {joined('matched_keywords')} as matched_keywords from gated"),
)
def candidate_gate(spark, sf):
    out = match.candidate_gate(corpus.records(spark, sf), REGISTRY)
    return out.select("domain", "ord", "relevance_score", pipe("matched_keywords"))


@query(
    "dedupe_merge_records",
    with_(*CAND, f"""select domain, dedupe_key, title, md5(coalesce(abstract, '')) as abstract_md5, doi, pmid, pmcid,
      journal, published_year, record_count, source_count, {joined('source_types')} as source_types,
      {joined('matched_keywords')} as matched_keywords, full_text_availability from cand"""),
)
def dedupe_merge_records(spark, sf):
    out = merge.dedupe_merge_records(corpus.gated(spark, sf), baseline=DIVERSITY_SOURCES, late=True)
    return out.select(
        "domain", "dedupe_key", "title", F.md5(F.coalesce("abstract", F.lit("")).cast("binary")).alias("abstract_md5"),
        "doi", "pmid", "pmcid", "journal", "published_year", "record_count", "source_count", pipe("source_types"),
        pipe("matched_keywords"), "full_text_availability",
    )


SCORES = ("relevance_score", "authority_score", "source_diversity_score", "ranking_score")


@query("candidate_scores", with_(*CAND, f"select domain, dedupe_key, {', '.join(SCORES)} from cand"))
def candidate_scores(spark, sf):
    return corpus.candidates(spark, sf).select("domain", "dedupe_key", *SCORES)


_RANK = "ranking_score desc, source_count desc, coalesce(published_year, 0) desc, title, dedupe_key"


@query(
    "top_candidates",
    with_(*CAND, f"select domain, dedupe_key, title, ranking_score, source_count, published_year from cand order by {_RANK}"),
)
def top_candidates(spark, sf):
    """The flagship: merge, score and rank what passed the gate, which is a stored stage."""
    ranked = merge.top_candidates(merge.dedupe_merge_records(corpus.gated(spark, sf), baseline=DIVERSITY_SOURCES, late=True))
    return ranked.select("domain", "dedupe_key", "title", "ranking_score", "source_count", "published_year")


@query(
    "promotion_risks",
    with_(*CAND, f"""select domain, dedupe_key, {joined(sql.labels([
        ('single-source', 'len(source_types) < 2'),
        ('no-open-full-text', "full_text_availability <> 'open-access-full-text'"),
        ('missing-abstract', "trim(coalesce(abstract, '')) = ''"),
        ('weak-authority', 'authority_score < 0.2e0')]))} as risks,
      3 + (full_text_availability <> 'open-access-full-text')::INT + (len(source_types) < 2)::INT as checks from cand"""),
)
def promotion_risks(spark, sf):
    out = match.promotion_risks(corpus.candidates(spark, sf))
    return out.select(
        "domain", "dedupe_key", F.array_join("promotion_risks", "|").alias("risks"),
        F.size("review_checklist").alias("checks"),
    )


TRACKED = """tracked_papers as (
  select r.domain, r.ord, r.paper_id, r.title, r.abstract, r.doi, r.pmid, r.pmcid, r.journal, r.published_year,
    r.full_text_availability, l.quality, l.toxic
  from rec r join labels l on l.doc_id = r.ord)"""
HINTS = """list_distinct(list_filter(['doi:' || lower(nullif(doi, '')), 'pmid:' || nullif(pmid, ''),
  'pmcid:' || nullif(pmcid, ''), 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))],
  lambda h: h is not null))"""
NOVEL = f"""known as (select distinct domain, unnest({HINTS}) as hint from tracked_papers),
own as (select domain, dedupe_key, unnest({HINTS}) as hint from cand),
flagged as (select o.domain, o.dedupe_key, o.hint, k.hint is not null as tracked
  from own o left join known k on k.domain = o.domain and k.hint = o.hint)"""


def tracked(spark, sf):
    """Labelled documents are the tracked corpus."""
    labels = corpus.table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    return corpus.records(spark, sf).join(labels, "ord")


@query(
    "novelty_split",
    with_(*CAND, TRACKED, NOVEL, "select domain, dedupe_key, bool_or(tracked) as tracked from flagged group by 1, 2"),
)
def novelty_split(spark, sf):
    return merge.novelty_split(corpus.candidates(spark, sf), tracked(spark, sf)).select("domain", "dedupe_key", "tracked")


def _new(prefix: str) -> str:
    return f"bool_or(starts_with(hint, '{prefix}') and not tracked)"


@query(
    "novelty_basis",
    with_(*CAND, TRACKED, NOVEL, f"""select domain, dedupe_key,
      case when len(b) > 0 then array_to_string(b, '|') else 'novelty-requires-manual-confirmation' end as basis
      from (select domain, dedupe_key, {sql.labels([
          ('doi-not-in-current-slice', _new('doi:')), ('pmid-not-in-current-slice', _new('pmid:')),
          ('pmcid-not-in-current-slice', _new('pmcid:')), ('title-not-in-current-slice', _new('title:')),
          ('pmid-available-for-review', "bool_or(starts_with(hint, 'pmid:'))")])} as b
      from flagged group by 1, 2)"""),
)
def novelty_basis(spark, sf):
    out = merge.novelty_basis(corpus.candidates(spark, sf), tracked(spark, sf))
    return out.select("domain", "dedupe_key", F.array_join("novelty_basis", "|").alias("basis"))


