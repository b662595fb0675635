"""Queries over refresh state: decisions, packets, providers and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import title_key
from ..operators import corpus as merge
from ..operators import decide, match, policy
from ..plans import refresh as plan
from ..session import cut
from ..sources import landing
from . import corpus
from .corpus import REGISTRY, per_session
from .corpus import DIVERSITY_SOURCES
from .matching import HINTS, NOVEL, TRACKED, pipe, tracked
from .policies import FEAT, P, RECO, features_sql
from .registry import query
from .sql import GATE, REC, SAME, candidates_sql, joined, renamed, with_

#: Earlier decisions: one per labelled document, scored a little differently.
PRIOR = """prior as materialized (
  select t.domain, t.ord, 'doi:' || coalesce(lower(t.doi), '') as dedupe_key, t.title, t.doi, t.pmid, t.pmcid,
    'title:' || trim(regexp_replace(lower(t.title), '[^a-z0-9]+', ' ', 'g')) as title_key,
    case when quality = 1 and toxic = 0 then 'promote' when quality = 1 then 'pending' else 'reject' end as decision,
    coalesce(c.recommendation, 'review') as recommendation, coalesce(c.ranking_score, 0e0) as ranking_score,
    coalesce(c.relevance_score, 0e0) as relevance_score, coalesce(c.authority_score, 0e0) as authority_score,
    coalesce(c.source_diversity_score, 0e0) as source_diversity_score, [t.source] as source_types, 1 as record_count,
    1 as source_count, coalesce(c.full_text_availability, 'unknown') as full_text_availability,
    case when toxic = 1 then 'flagged' end as reviewer_notes
  from (select r.*, l.quality, l.toxic from rec r join labels l on l.doc_id = r.ord) t
    left join judged c on c.domain = t.domain and c.ord = t.ord)"""


@per_session
def recommended(spark, sf):
    """Candidates with their recommendation, as a stored stage."""
    return cut(policy.score_candidates(corpus.candidates(spark, sf), P).drop("features", "contributions"), "recommended")


@per_session
def prior(spark, sf):
    now = recommended(spark, sf).select(
        "domain", "ord", *[F.col(c).alias(f"_{c}") for c in (
            "recommendation", "ranking_score", "relevance_score", "authority_score", "source_diversity_score",
            "full_text_availability")])
    rows = tracked(spark, sf).drop("full_text_availability").join(now, ["domain", "ord"], "left")
    good = F.col("quality") == 1
    return cut(rows.select(
        "domain", "ord", F.concat(F.lit("doi:"), F.coalesce(F.lower("doi"), F.lit(""))).alias("dedupe_key"), "title",
        "doi", "pmid", "pmcid", title_key(F.col("title")).alias("title_key"),
        F.when(good & (F.col("toxic") == 0), "promote").when(good, "pending").otherwise("reject").alias("decision"),
        F.coalesce("_recommendation", F.lit("review")).alias("recommendation"),
        *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in (
            "ranking_score", "relevance_score", "authority_score", "source_diversity_score")],
        F.array("source").alias("source_types"), F.lit(1).alias("record_count"), F.lit(1).alias("source_count"),
        F.coalesce("_full_text_availability", F.lit("unknown")).alias("full_text_availability"),
        F.when(F.col("toxic") == 1, "flagged").alias("reviewer_notes"), F.lit(None).cast("timestamp").alias("decided_at"),
    ), "prior")


_P_HINTS = HINTS.replace("list_filter([", "list_filter([dedupe_key, title_key, ", 1)
CARRIED = f"""p_hint as (select domain, ord, unnest({_P_HINTS}) as hint from prior),
c_hint as (select domain, dedupe_key, unnest({HINTS}) as hint from judged),
found as (select c.domain, c.dedupe_key, min(p.ord) as p_ord from c_hint c join p_hint p
  on p.domain = c.domain and p.hint = c.hint group by 1, 2),
carried as materialized (
  select c.domain, c.dedupe_key, c.title, c.doi, c.pmid, c.pmcid, c.recommendation, c.ranking_score,
    p.ord is not null and not ({SAME}) as stale_evidence,
    case when p.ord is not null and not ({SAME}) and p.decision <> 'pending' then 'pending'
      else coalesce(p.decision, 'pending') end as decision, p.reviewer_notes,
    'title:' || trim(regexp_replace(lower(c.title), '[^a-z0-9]+', ' ', 'g')) as title_key
  from judged c left join found f on f.domain = c.domain and f.dedupe_key = c.dedupe_key
    left join prior p on p.ord = f.p_ord and p.domain = f.domain)"""
DECIDED = (*FEAT, RECO, PRIOR, CARRIED)


@per_session
def decisions(spark, sf):
    """Candidates with carried decisions, as a stored stage."""
    return cut(merge.carry_forward_decisions(recommended(spark, sf), prior(spark, sf)), "decisions")


@query(
    "carry_forward_decisions",
    with_(*DECIDED, "select domain, dedupe_key, decision, recommendation, stale_evidence, reviewer_notes from carried"),
)
def carry_forward_decisions(spark, sf):
    out = merge.carry_forward_decisions(recommended(spark, sf), prior(spark, sf))
    return out.select("domain", "dedupe_key", "decision", "recommendation", "stale_evidence", "reviewer_notes")


@query(
    "evidence_fingerprint",
    with_(*DECIDED, f"""select c.domain, c.dedupe_key, {SAME} as unchanged from judged c join found f
      on f.domain = c.domain and f.dedupe_key = c.dedupe_key join prior p on p.ord = f.p_ord and p.domain = f.domain"""),
)
def evidence_fingerprint(spark, sf):
    out = merge.carry_forward_decisions(recommended(spark, sf), prior(spark, sf))
    known = prior(spark, sf).select("domain", F.explode(merge.record_hints(F.col("dedupe_key"), F.col("title_key"))).alias("hint")).distinct()
    own = recommended(spark, sf).select("domain", "dedupe_key", F.explode(merge.record_hints()).alias("hint"))
    matched = own.join(known, ["domain", "hint"], "left_semi").select("domain", "dedupe_key").distinct()
    return out.join(matched, ["domain", "dedupe_key"], "left_semi").select(
        "domain", "dedupe_key", (~F.col("stale_evidence")).alias("unchanged"))


#: Half of the decisions keep a key their candidate no longer has.
_OLD_KEY = "case when pmid is not null and doi is not null then 'pmid:' || pmid else dedupe_key end"


def queue_rows(spark, sf):
    """Decisions under the key of an earlier run, when the record had no DOI yet."""
    both = F.col("pmid").isNotNull() & F.col("doi").isNotNull()
    return decisions(spark, sf).select(
        "domain", F.when(both, F.concat(F.lit("pmid:"), "pmid")).otherwise(F.col("dedupe_key")).alias("dedupe_key"),
        "title", "doi", "pmid", "pmcid", "title_key", "decision", "recommendation", "ranking_score")


PACKET = f"""queue_rows as (select * replace ({_OLD_KEY} as dedupe_key) from carried),
q_open as (select * from queue_rows where recommendation <> 'defer'),
q_hint as (select domain, dedupe_key, unnest({_P_HINTS}) as hint from q_open),
cand_hint as (select domain, ord, dedupe_key, unnest({HINTS}) as hint from cand),
by_hint as (select domain, hint, arg_min(dedupe_key, ord) as k, min(ord) as ord from cand_hint group by 1, 2),
fall as (select q.domain, q.dedupe_key, arg_min(h.k, (h.ord, h.k)) as k from q_hint q join by_hint h using (domain, hint) group by 1, 2),
packet as materialized (select q.domain, q.dedupe_key, q.title, q.recommendation, coalesce(c.dedupe_key, f.k) as candidate_key
  from q_open q left join cand c on c.domain = q.domain and c.dedupe_key = q.dedupe_key
    left join fall f on f.domain = q.domain and f.dedupe_key = q.dedupe_key)"""


def packet(spark, sf):
    return merge.packet_join(queue_rows(spark, sf), corpus.candidates(spark, sf))


@query(
    "packet_join",
    with_(*DECIDED, PACKET, """select p.domain, p.dedupe_key, p.candidate_key, p.recommendation, c.record_count
      from packet p left join cand c on c.domain = p.domain and c.dedupe_key = p.candidate_key"""),
)
def packet_join(spark, sf):
    return packet(spark, sf).select(
        "domain", "dedupe_key", "candidate_key", "recommendation", F.col("candidate.record_count").alias("record_count"))


@query(
    "cross_artifact_checks",
    with_(*DECIDED, PACKET, """listed as (select domain, dedupe_key, recommendation from queue_rows
        where decision <> 'reject'),
      item_count as (select domain, count(*) as n from listed group by 1),
      promoted as (select domain, count(*) as n from queue_rows where recommendation = 'promote' group by 1)""", """select domain, severity, "check", detail from (
        select domain, 'failure' as severity, 'packet-item-count' as "check", '' as detail
          from item_count i left join promoted p using (domain) where i.n <> coalesce(p.n, 0)
        union all select domain, 'warning', 'snapshot-degraded', 'live-provider-truncation:' || source from (
          select distinct domain, source from rec where source = 'src3')
        union all select i.domain, 'failure', 'deferred-item', i.dedupe_key from listed i where recommendation = 'defer')"""),
)
def cross_artifact_checks(spark, sf):
    rows = queue_rows(spark, sf)
    items = rows.where("decision <> 'reject'").select("domain", "dedupe_key", "recommendation")
    promoted = rows.groupBy("domain").agg(F.count_if(F.col("recommendation") == "promote").alias("item_count"))
    cut_short = corpus.records(spark, sf).groupBy("domain").agg(
        F.array_compact(F.collect_set(F.when(F.col("source") == "src3", F.concat(F.lit("live-provider-truncation:"), "source")))).alias("reasons"))
    base = promoted.join(cut_short, "domain")
    at = F.lit("2024-01-01").cast("timestamp")
    kinds = F.explode(F.array(F.lit("snapshot"), F.lit("queue"), F.lit("packet")))
    artifacts = base.withColumn("artifact", kinds).select(
        "domain", "artifact", at.alias("generated_at"), at.alias("snapshot_at"), at.alias("queue_at"), "item_count",
        F.when(F.col("artifact") == "snapshot", F.col("reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return merge.cross_artifact_checks(artifacts, rows, items)


_DECISION_TOPS = "order by ranking_score desc, title desc, dedupe_key"


@query(
    "lane_tops",
    with_(*DECIDED, f"""select domain, dedupe_key, row_number() over (partition by domain {_DECISION_TOPS}) as rank from carried
      qualify row_number() over (partition by domain {_DECISION_TOPS}) <= 5"""),
)
def lane_tops(spark, sf):
    return decide.lane_tops(decisions(spark, sf), 5).select("domain", "dedupe_key", "rank")


# -- providers and imports ----------------------------------------------------

_KIND = """case when source in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') then 'live-provider'
  when source in ('src8', 'src9', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15') then 'import' else 'manual' end"""
_LIVE = tuple(f"src{i}" for i in range(8))
_IMPORT = tuple(f"src{i}" for i in range(8, 16))


def _kind():
    return F.when(F.col("source").isin(*_LIVE), "live-provider").when(F.col("source").isin(*_IMPORT), "import").otherwise("manual")


PROVIDERS = f"""prov as materialized (
  select domain, {_KIND} as kind, source, count(*) as fetched, count(*) filter (where keep) as accepted,
    false as failed, count(*) < max(case when published_year > 2020 then 30 else 5 end) as truncated
  from scored group by all)"""


def provider_rows(spark, sf):
    judged = match.coverage_relevance(corpus.records(spark, sf), REGISTRY).withColumn("kind", _kind())
    slim = judged.select("domain", "kind", "source", "keep")
    log = corpus.records(spark, sf).withColumn("kind", _kind()).groupBy("domain", "kind", "source").agg(
        F.lit(False).alias("failed"), F.max(F.when(F.col("published_year") > 2020, 30).otherwise(5)).alias("total_hits"))
    return merge.provider_stats(slim, log)


@query("provider_stats", with_(REC, GATE, PROVIDERS, "select * from prov"))
def provider_stats(spark, sf):
    return provider_rows(spark, sf)


@query(
    "degradation_state",
    with_(REC, GATE, PROVIDERS, """select domain, array_to_string(list_filter([
        case when count(*) filter (where truncated) > 0 then 'live-provider-truncation:' ||
          string_agg(source, ',' order by source) filter (where truncated) end], lambda x: x is not null), '|') as reasons,
      count(*) filter (where truncated) > 0 as is_degraded from prov where kind = 'live-provider' group by domain"""),
)
def degradation_state(spark, sf):
    return merge.degradation_state(provider_rows(spark, sf)).select("domain", pipe("reasons"), "is_degraded")


_IDENTITY = """coalesce('doi:' || lower(nullif(doi, '')), 'pmid:' || nullif(pmid, ''), 'pmcid:' || nullif(pmcid, ''),
  'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')))"""


@query(
    "import_dedupe",
    with_(REC, f"""select domain, source, identity, ord, title from (select *, {_IDENTITY} as identity from rec)
      qualify row_number() over (partition by domain, source, identity order by ord desc) = 1"""),
)
def import_dedupe(spark, sf):
    return merge.import_dedupe(corpus.records(spark, sf)).select("domain", "source", "identity", "ord", "title")


@query(
    "import_breakdown",
    with_(REC, f"""select domain, source, count(distinct {_IDENTITY}) as records from rec group by 1, 2"""),
)
def import_breakdown(spark, sf):
    return merge.import_breakdown(merge.import_dedupe(corpus.records(spark, sf)))


def _own(kind: str) -> str:
    from .sql import by_domain, strings

    return by_domain(lambda d: f"list_filter({strings(getattr(d, kind))}, lambda w: contains(hay, w))")


@query(
    "import_corpus",
    with_(REC, GATE, f"""select domain, pid as paper_id, ord, len(a) * 2 + len(s) as score, {joined('list_concat(a, s)')} as keywords from (
      select *, {_own('ingest_anchors')} as a, {_own('ingest_supporting')} as s from (
        select *, coalesce('pubmed:' || nullif(pmid, ''), 'doi:' || lower(nullif(doi, '')), source || ':' || source_id) as pid
        from gated) qualify row_number() over (partition by domain, pid order by ord) = 1) where len(a) > 0"""),
)
def import_corpus(spark, sf):
    out = merge.import_corpus(corpus.records(spark, sf).drop("paper_id"), REGISTRY)
    return out.select("domain", "paper_id", "ord", "score", F.array_join("matched_keywords", "|").alias("keywords"))


@query(
    "top_domain_papers",
    with_(REC, GATE, f"""select domain, ord, score, title from (select domain, ord, title, len({_own('ingest_anchors')}) * 2
      + len({_own('ingest_supporting')}) as score, len({_own('ingest_anchors')}) as n from scored) where n > 0
      order by score desc, title, ord"""),
)
def top_domain_papers(spark, sf):
    matched = match.keyword_domain_match(
        corpus.records(spark, sf).select(F.col("domain").alias("own"), "ord", "title", "abstract"), REGISTRY)
    return matched.where("own = domain").orderBy(F.desc("score"), "title", "ord").select("domain", "ord", "score", "title")


@query(
    "corpus_as_source",
    with_(REC, GATE, """select domain, 'cryodb' as source, paper_id as source_id, relevance_score,
      case when pmcid is not null then 'full-text-link' else 'abstract-only' end as availability from gated"""),
)
def corpus_as_source(spark, sf):
    url = F.concat(F.lit("https://papers.example/"), "pmcid")
    out = landing.corpus_as_source(corpus.records(spark, sf).withColumn("paper_url", url), REGISTRY)
    return out.select("domain", "source", "source_id", "relevance_score", F.col("full_text_availability").alias("availability"))


@query(
    "source_union",
    with_(REC, f"select domain, {_KIND} as kind, count(*) as records, count(doi) as with_doi from rec group by all"),
)
def source_union(spark, sf):
    records = corpus.records(spark, sf).withColumn("kind", _kind())
    parts = [records.where(F.col("kind") == k) for k in ("live-provider", "import")]
    manual = records.where(F.col("kind") == "manual").drop("doi", "journal")
    return merge.source_union(*parts, manual.withColumn("doi", F.lit(None).cast("string"))).groupBy("domain", "kind").agg(
        F.count("*").alias("records"), F.count("doi").alias("with_doi"))



# -- the refresh as one job ---------------------------------------------------


@per_session
def refreshed(spark, sf):
    """A refresh to which no import file was delivered: the prior import set stays."""
    rows = corpus.records(spark, sf).withColumn("kind", _kind())
    live = rows.where(F.col("kind") != "import").drop("kind", "paper_id")
    prior_imports = rows.where(F.col("kind") == "import").drop("kind", "paper_id")
    return plan.refresh(
        live, prior_imports.where("false"), tracked(spark, sf), prior(spark, sf), REGISTRY, "2024-01-01 00:00:00",
        prior_imports=prior_imports, own_corpus=False, baseline=DIVERSITY_SOURCES, scoring_policy=P)


@query(
    "refresh_queue",
    with_(*DECIDED, TRACKED, NOVEL, """select c.domain, c.dedupe_key, c.decision, c.recommendation, c.stale_evidence from carried c
      join (select domain, dedupe_key, bool_or(tracked) as t from flagged group by 1, 2) f using (domain, dedupe_key) where not f.t"""),
)
def refresh_queue(spark, sf):
    return refreshed(spark, sf)["queue"].select("domain", "dedupe_key", "decision", "recommendation", "stale_evidence")


@query(
    "refresh_degradation",
    with_(REC, f"""select domain, 'imports:{landing.KEPT_PRIOR}' as reasons, true as is_degraded from rec
      where {_KIND} = 'import' group by domain"""),
)
def refresh_degradation(spark, sf):
    return refreshed(spark, sf)["degradation"].select("domain", pipe("reasons"), "is_degraded")


@per_session
def delivered(spark, sf):
    """A refresh with delivered imports, the tracked papers as one more source and a log of what providers hold."""
    rows = corpus.records(spark, sf).withColumn("kind", _kind())
    live = rows.where(F.col("kind") != "import").drop("kind", "paper_id")
    imports = rows.where(F.col("kind") == "import").drop("kind", "paper_id")
    log = live.groupBy("domain", F.lit("live-provider").alias("kind"), "source").agg(
        F.lit(False).alias("failed"), F.max(F.when(F.col("published_year") > 2020, 30).otherwise(5)).alias("total_hits"))
    papers = tracked(spark, sf).withColumn("paper_url", F.concat(F.lit("https://papers.example/"), "pmcid"))
    return plan.refresh(
        live, imports, papers, prior(spark, sf), REGISTRY, "2024-01-01 00:00:00", fetch_log=log, baseline=DIVERSITY_SOURCES, scoring_policy=P)


#: The records of that refresh: the last import of an identity, everything else, and the tracked papers.
_ARRIVED = f"""last_import as (select ord from (select *, {_IDENTITY} as identity from rec where {_KIND} = 'import')
  qualify row_number() over (partition by domain, source, identity order by ord desc) = 1),
fetched as materialized (select *, case when {_KIND} = 'import' then 'import' else 'live-provider' end as kind from scored
  where {_KIND} <> 'import' or ord in (select ord from last_import)),
corpus_rows as materialized (select * replace ('cryodb' as source, paper_id as source_id, cast(null as varchar) as pmid, cast(null as varchar) as pmcid,
    cast(null as bigint) as citation_count, case when pmcid is not null then 'full-text-link' else 'abstract-only' end as full_text_availability)
  from gated where ord in (select doc_id from labels)),
arrived as materialized (select * exclude (kind) from fetched where keep union all by name select * from corpus_rows)"""
_REFRESH = (
    *FEAT, RECO, PRIOR, _ARRIVED, renamed(candidates_sql("arrived", DIVERSITY_SOURCES), "_r"), renamed(features_sql("cand"), "_r"), renamed(RECO, "_r"),
    renamed(CARRIED, "_r"), TRACKED, renamed(NOVEL, "_r"),
    """queue_r as materialized (select c.* from carried c
      join (select domain, dedupe_key, bool_or(tracked) as t from flagged group by 1, 2) f using (domain, dedupe_key) where not f.t)""")
_PROVIDERS_R = """prov_r as materialized (select domain, kind, source, count(*) as fetched, count(*) filter (where keep) as accepted, false as failed,
    bool_and(kind = 'live-provider') and count(*) < max(case when published_year > 2020 then 30 else 5 end) as truncated
  from fetched group by all union all select domain, 'corpus', source, count(*), count(*), false, false from corpus_rows group by all)"""


@query("refresh_delivered", with_(*_REFRESH, "select domain, dedupe_key, decision, recommendation, stale_evidence, ranking_score from queue_r"))
def refresh_delivered(spark, sf):
    return delivered(spark, sf)["queue"].select("domain", "dedupe_key", "decision", "recommendation", "stale_evidence", "ranking_score")


@query(
    "refresh_packet",
    with_(*_REFRESH, f"""select q.domain, q.dedupe_key, c.dedupe_key as candidate_key, q.recommendation, c.record_count,
        {joined('c.source_types')} as source_types from queue_r q join cand_r c on c.domain = q.domain and c.dedupe_key = q.dedupe_key
      where q.recommendation <> 'defer'"""),
)
def refresh_packet(spark, sf):
    return delivered(spark, sf)["packet"].select(
        "domain", "dedupe_key", "candidate_key", "recommendation", F.col("candidate.record_count").alias("record_count"),
        F.array_join("candidate.source_types", "|").alias("source_types"))


@query("refresh_providers", with_(REC, GATE, _ARRIVED, _PROVIDERS_R, "select * from prov_r"))
def refresh_providers(spark, sf):
    return delivered(spark, sf)["providers"].select("domain", "kind", "source", "fetched", "accepted", "failed", "truncated")


@query(
    "refresh_checks",
    with_(*_REFRESH, _PROVIDERS_R, """select domain, 'warning' as severity, 'snapshot-degraded' as "check",
        'live-provider-truncation:' || string_agg(source, ',' order by source) as detail
      from prov_r where truncated and domain in (select domain from queue_r) group by domain"""),
)
def refresh_checks(spark, sf):
    """The tables of one refresh agree, so only what its providers cut short is left to report."""
    return delivered(spark, sf)["checks"].select("domain", "severity", "check", "detail")
