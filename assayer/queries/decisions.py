"""Gap, packet, board, health and run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, quality, research, review
from ..session import cut
from . import corpus, sql
from .corpus import per_session
from .curation import DEPTH, MISSING, REPAIR, depth, missing, repairs
from .extraction import _CHEM, OUTCOME
from .findings import MALL, WALL, _overlap, found, matrix, profiled, wedges
from .matching import pipe
from .normalization import CONDITION, NORM, QUALITY, STRUCT
from .registry import query
from .scoring import pairs
from .sequences import _CYCLES, block, cycles
from .sql import CURATED, PASSED, clamp, fx, in_list, joined, metrics_sql, pairs_sql, q, ratio, with_

# -- contradictions of the wedge ----------------------------------------------

REPORT = f"""rep_named as (select distinct t.domain, t.title from titles t join wedge w on w.domain = t.domain and w.claim_id = t.claim_id),
rep0 as (select c.*, w.category, exists (select 1 from rep_named n where n.domain = c.domain and n.title in (c.title_a, c.title_b)) as direct,
    {_overlap('c.shared', 'w.dominant_chemicals')} as ctx from contra c join wedge w on w.domain = c.domain),
rep1 as (select *, bool_or(direct) over (partition by domain) as any_direct from rep0),
rep2 as (select * from rep1 where direct or (not any_direct and ctx) qualify row_number() over (partition by domain order by rank) <= 8),
by_t as (select domain, title, arg_max(species, ord) as sp, arg_max(len(outcomes), ord) as no, arg_max(len(phases), ord) as np from res group by 1, 2),
rep as materialized (select r.domain, r.rank as pair, r.title_a, r.title_b, r.confidence, c,
    case when r.category = 'benchmark' and not list_contains(c, 'species mismatch') and not list_contains(c, 'endpoint mismatch') then 'high'
      when list_contains(c, 'sparse protocol detail') then 'medium' else 'low' end as decision_impact,
    case when len(c) > 0 then c else ['preservation family disagreement under similar context'] end as confounds
  from (select r.*, {sql.labels([
    ('species mismatch', f"len(a.sp) > 0 and len(b.sp) > 0 and not ({_overlap('a.sp', 'b.sp')})"),
    ('endpoint mismatch', 'a.no > 0 and b.no > 0 and list_sort(r.outcomes_a) <> list_sort(r.outcomes_b)'),
    ('sparse protocol detail', 'coalesce(a.np, 0) <= 1 or coalesce(b.np, 0) <= 1')])} as c
    from rep2 r left join by_t a on a.domain = r.domain and a.title = r.title_a left join by_t b on b.domain = r.domain and b.title = r.title_b) r)"""
REP = (*WALL, REPORT)


def wedge_titles(spark, sf):
    return found(spark, sf).titles.join(wedges(spark, sf).select("domain", "claim_id"), ["domain", "claim_id"])


@per_session
def report(spark, sf):
    return cut(decide.contradiction_confounds(
        found(spark, sf).contradictions, corpus.resolved(spark, sf), wedges(spark, sf), wedge_titles(spark, sf)), "report")


@query("contradiction_confounds", with_(*REP, f"select domain, pair, title_a, title_b, {joined('confounds')} as confounds, decision_impact from rep"))
def contradiction_confounds(spark, sf):
    out = decide.contradiction_confounds(
        found(spark, sf).contradictions, corpus.resolved(spark, sf), wedges(spark, sf), wedge_titles(spark, sf))
    return out.select("domain", "pair", "title_a", "title_b", pipe("confounds"), "decision_impact")


# -- packets ------------------------------------------------------------------

PACKETS = f"""pk as materialized (select h.* exclude (rank), h.claim_id = w.claim_id as selected, w.dominant_chemicals as pool,
    row_number() over (partition by h.domain order by h.claim_id = w.claim_id desc, h.priority_score desc, h.claim_id) as rank
  from hyp h left join wedge w on w.domain = h.domain where h.category <> 'workflow-gap'
  qualify row_number() over (partition by h.domain order by h.claim_id = w.claim_id desc, h.priority_score desc, h.claim_id) <= 3)"""


def packets(spark, sf):
    return decide.top_packets(found(spark, sf).hypotheses, wedges(spark, sf))


@query("top_packets", with_(*WALL, PACKETS, "select domain, rank, claim_id, selected from pk"))
def top_packets(spark, sf):
    return packets(spark, sf).select("domain", "rank", "claim_id", "selected")


_ADD, _MATCHED = sql.rx("title", research.ADDITIVE_TITLE), sql.rx("title", decide.MATCHED_TITLE)


def _listed(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_EXTRA = f"list_filter(case when selected then pool else chemicals end, lambda c: c not in {in_list(decide.NON_ARMS)})[1:4]"


@query(
    "packet_fields",
    with_(*WALL, PACKETS, f"""select domain, claim_id, {joined(f'''case when {_ADD} then list_concat(['{decide.BASE_ARM}'],
        list_transform({_EXTRA}, lambda c: '{decide.ADDITIVE_ARM}' || c))
      when {_MATCHED} then {_listed(decide.ARMS["matched"])}
      when category = 'endpoint-upgrade' then {_listed(decide.ARMS["endpoint-upgrade"])}
      when category = 'scale-up' then {_listed(decide.ARMS["scale-up"])}
      when len(list_filter(families, lambda f: f <> 'unknown')) > 0 then list_transform(list_filter(families, lambda f: f <> 'unknown'), lambda f: f || '{decide.FAMILY_ARM}')
      else {_listed(decide.ARMS["other"])} end''')} as arms,
      {joined(f'''case when {_ADD} or {_MATCHED} then {_listed(decide.PRIMARY_READOUTS["other"])}
        when category = 'endpoint-upgrade' then {_listed(decide.PRIMARY_READOUTS["endpoint-upgrade"])}
        when category = 'scale-up' then {_listed(decide.PRIMARY_READOUTS["scale-up"])}
        when transplantation > 0 then {_listed(decide.PRIMARY_READOUTS["endpoint-upgrade"])} else {_listed(decide.PRIMARY_READOUTS["other"])} end''')} as primary_readouts,
      {joined(f'''list_concat(list_concat(case when {_ADD} then {_listed(decide.ADDITIVE_VARIABLES)} else [] end,
        case when category = 'benchmark' then {_listed(decide.BENCHMARK_VARIABLES)} else [] end), {_listed(decide.BASE_VARIABLES)})''')} as fixed_variables from pk"""),
)
def packet_fields(spark, sf):
    out = decide.packet_fields(packets(spark, sf))
    return out.select("domain", "claim_id", F.array_join("comparison_arms", "|").alias("arms"), pipe("primary_readouts"),
                      pipe("fixed_variables"))


@query(
    "distinct_blocker",
    with_(*WALL, PACKETS, """select p.domain, p.claim_id, (select arg_min(b, (n > 1, i)) from (
        select unnest(p.blockers) as b, generate_subscripts(p.blockers, 1) as i) x,
        lateral (select count(*) as n from pk s where s.domain = p.domain and list_contains(s.blockers, x.b))) as watch_out from pk p"""),
)
def distinct_blocker(spark, sf):
    return decide.distinct_blocker(packets(spark, sf)).select("domain", "claim_id", "watch_out")


# -- gaps ---------------------------------------------------------------------

_T_RANK = "case tier when 'high' then 3 when 'medium' then 2 else 1 end"
GAPS = f"""gnamed as (select e.*, n.title is not null as named from enr e left join rep_named n on n.domain = e.domain and n.title = e.title),
gt as (select domain, title, arg_max(ord, ord) as ord from prof group by 1, 2),
g0 as (select g.domain, g.paper_id, g.title, g.priority, g.status, g.named, p.chemicals, p.specimens, p.family, p.phases,
    coalesce(p.authority_profile, 'abstract-only') as authority_profile, coalesce(p.translational_signal, 'research only') as translational_signal,
    p.paper_id is not null as present, coalesce(m.no_outcomes, false) as no_o, coalesce(m.no_phases, false) as no_p,
    w.dominant_chemicals, w.specimens as w_spec, w.families as w_fam,
    lower(array_to_string(list_concat([w.current_read], w.key_uncertainties), ' ')) as blockers,
    (select arg_min(k.priority_score, k.rank) from pk k join titles t on t.domain = k.domain and t.claim_id = k.claim_id
      where k.domain = g.domain and t.title = g.title) as packet,
    (select arg_min((case r.decision_impact when 'high' then 1e0 when 'medium' then 0.6e0 else 0.3e0 end) * r.confidence, r.pair)
      from rep r where r.domain = g.domain and g.title in (r.title_a, r.title_b)) as contradiction
  from gnamed g left join prof pi on pi.domain = g.domain and pi.paper_id = g.paper_id
    left join gt on gt.domain = g.domain and gt.title = g.title
    left join prof p on p.ord = coalesce(pi.ord, gt.ord) and p.domain = g.domain
    left join missing m on m.domain = g.domain and m.paper_id = g.paper_id join wedge w on w.domain = g.domain
  where g.status in ('pending', 'in-progress') or g.named),
g1 as (select *, {fx(clamp(f'''case when named then 0.55e0 else 0.25e0 end + case when {_overlap('chemicals', 'dominant_chemicals')} then 0.15e0 else 0e0 end
      + case when {_overlap('specimens', 'w_spec')} then 0.15e0 else 0e0 end + case when list_contains(w_fam, family) then 0.15e0 else 0e0 end'''), 3)} as relevance,
    len(list_filter(string_split_regex(lower(title), '\\s+'), lambda w: length(w) > 3 and contains(blockers, w))) as words,
    {sql.labels([('outcomes', 'no_o'), ('phases', 'no_p'), ('authority', "authority_profile = 'abstract-only'"),
      ('protocol-detail', "present and len(list_distinct(list_filter(phases, lambda p: p not in ('unknown', 'assessment', 'culture')))) <= 1")])} as miss from g0),
g2 as (select *, case when words >= 3 then {fx(clamp('words / 6e0'), 3)} when words >= 1 then {fx(clamp('words / 8e0'), 3)} else 0e0 end as blocker_proximity,
    {fx(clamp('coalesce(packet, 0e0)'), 3)} as packet_effect, case when authority_profile = 'abstract-only' then 0.7e0 else 0e0 end as authority_uplift,
    {fx(clamp('coalesce(contradiction, 0e0)'), 3)} as contradiction_effect from g1),
gaps as materialized (select *, {fx(clamp('relevance * 0.3e0 + blocker_proximity * 0.25e0 + packet_effect * 0.2e0 + authority_uplift * 0.15e0 + contradiction_effect * 0.1e0'), 3)} as impact,
    case when relevance >= 0.8e0 and translational_signal in ('clinically adjacent', 'transplant relevant') then 'high'
      when relevance >= 0.55e0 or len(miss) >= 2 then 'medium' else 'low' end as tier from g2)"""
GALL = (*REP, PACKETS, MISSING, GAPS)


@per_session
def gaps(spark, sf):
    f = found(spark, sf)
    return cut(decide.gap_impact(
        corpus.enrichment(spark, sf).select("domain", "paper_id", "title", "priority", "status"), profiled(spark, sf),
        wedges(spark, sf), wedge_titles(spark, sf), missing(spark, sf), packets(spark, sf), f.titles, report(spark, sf)), "gaps")


@query(
    "gap_impact",
    with_(*GALL, f"""select domain, paper_id, impact, tier, relevance, blocker_proximity, packet_effect, authority_uplift, contradiction_effect,
      {joined("case when len(miss) > 0 then miss else ['authority'] end")} as missing_fields, authority_profile from gaps"""),
)
def gap_impact(spark, sf):
    return gaps(spark, sf).select("domain", "paper_id", "impact", "tier", "relevance", "blocker_proximity", "packet_effect",
                                  "authority_uplift", "contradiction_effect", pipe("missing_fields"), "authority_profile")


@query(
    "gap_queue_order",
    with_(*GALL, f"select domain, paper_id, tier, relevance from gaps order by floor(impact * 100 + 1e-9) desc, {_T_RANK} desc, relevance desc, title, paper_id"),
)
def gap_queue_order(spark, sf):
    return decide.gap_queue_order(gaps(spark, sf)).select("domain", "paper_id", "tier", "relevance")


@query(
    "evidence_board",
    with_(*GALL, f"select domain, paper_id, tier, impact from gaps order by {_T_RANK} desc, relevance desc, domain, title, paper_id"),
)
def evidence_board(spark, sf):
    return decide.evidence_board(gaps(spark, sf)).select("domain", "paper_id", "tier", "impact")


@query(
    "lookup_with_fallback",
    with_(*CURATED, """select e.domain, e.paper_id, coalesce(r.ord, t.ord) as found from enr e left join res r on r.domain = e.domain and r.paper_id = e.paper_id
      left join (select domain, title, max(ord) as ord from res group by 1, 2) t on t.domain = e.domain and t.title = e.title"""),
)
def lookup_with_fallback(spark, sf):
    out = decide.lookup_with_fallback(
        corpus.enrichment(spark, sf).select("domain", "paper_id", "title"), corpus.resolved(spark, sf), ["ord"])
    return out.select("domain", "paper_id", F.col("paper.ord").alias("found"))


# -- drafts -------------------------------------------------------------------

DRAFTS = """draft as (select e.domain, e.paper_id, case when e.published_year % 2 = 0 then 0.9e0 else 0.7e0 end as draft_confidence,
  e.published_year % 2 = 0 and e.priority = 'extractor-gap' as triaged, r.source_text_src as draft_text
  from enr e join (select ord, coalesce(abstract, title) as source_text_src from rec) r using (ord) where e.quality = 1)"""


def drafts(spark, sf):
    """Drafted excerpts that landed for the records judged good."""
    year = F.col("published_year")
    texts = corpus.records(spark, sf).select("ord", F.coalesce("abstract", "title").alias("draft_text"))
    return corpus.enrichment(spark, sf).where("quality = 1").join(texts, "ord").select(
        "domain", "paper_id", F.when(year % 2 == 0, 0.9).otherwise(0.7).alias("draft_confidence"),
        F.lit("review-required").alias("safety_tier"),
        ((year % 2 == 0) & (F.col("priority") == "extractor-gap")).alias("triaged"), "draft_text")


@query(
    "attach_drafts",
    with_(sql.REC, sql.ENRICH, DRAFTS, """select e.domain, e.paper_id, case when d.triaged then 'llm-triaged' else e.status end as status,
      d.draft_confidence, d.paper_id is not null as drafted from enr e left join draft d using (domain, paper_id)"""),
)
def attach_drafts(spark, sf):
    out = review.attach_drafts(corpus.enrichment(spark, sf).select("domain", "paper_id", "status"), drafts(spark, sf))
    return out.select("domain", "paper_id", "status", "draft_confidence", "drafted")


@query(
    "draft_priority",
    with_(*GALL, """select e.domain, e.paper_id, coalesce(g.impact, 0e0) as gap_score, row_number() over (partition by e.domain
      order by coalesce(g.impact, 0e0) desc, e.title, e.paper_id) as rank from enr e left join gaps g using (domain, paper_id)
      where e.status = 'pending' qualify row_number() over (partition by e.domain order by coalesce(g.impact, 0e0) desc, e.title, e.paper_id) <= 10"""),
)
def draft_priority(spark, sf):
    out = review.draft_priority(corpus.enrichment(spark, sf).select("domain", "paper_id", "title", "status"), gaps(spark, sf))
    return out.select("domain", "paper_id", "gap_score", "rank")


@query(
    "draft_safety_tier",
    with_(*GALL, DRAFTS, """select domain, paper_id, tier2 as safety_tier, coalesce(tier2 = 'draftable' and draft_confidence >= 0.85e0 and priority = 'extractor-gap', false) as triage_ready
      from (select e.domain, e.paper_id, e.priority, d.draft_confidence, case when g.impact > 0.6e0 then 'decision-changing'
        when e.priority = 'extractor-gap' and (g.impact is null or g.impact < 0.3e0) then 'draftable' else 'review-required' end as tier2
      from enr e left join gaps g using (domain, paper_id) left join draft d using (domain, paper_id))"""),
)
def draft_safety_tier(spark, sf):
    rows = corpus.enrichment(spark, sf).select("domain", "paper_id", "priority").join(
        gaps(spark, sf).select("domain", "paper_id", F.col("impact").alias("gap_score")), ["domain", "paper_id"], "left"
    ).join(drafts(spark, sf).select("domain", "paper_id", "draft_confidence"), ["domain", "paper_id"], "left")
    return review.draft_safety_tier(rows).select("domain", "paper_id", "safety_tier", "triage_ready")


def _signals(text: str) -> str:
    return sql.labels((k, sql.rx(text, p)) for k, p in review.SIGNALS.items())


AGREE = f"""agree as materialized (select e.domain, e.paper_id, {_signals("e.ex_label || ': ' || e.ex_text")} as want, {_signals("coalesce(d.draft_text, '')")} as have
  from enr e left join draft d using (domain, paper_id) where e.status = 'reviewed')"""


def agreement(spark, sf):
    reviewed = corpus.enrichment(spark, sf).where("status = 'reviewed'").select(
        "domain", "paper_id", F.concat(F.get("excerpts", 0).label, F.lit(": "), F.get("excerpts", 0).text).alias("text"))
    return review.agreement_pairs(reviewed, drafts(spark, sf).select("domain", "paper_id", "draft_text"))


@query(
    "agreement_pairs",
    with_(sql.REC, sql.ENRICH, DRAFTS, AGREE, f"""select domain, paper_id, {joined('want')} as want, {joined('have')} as have, {fx('p', 3)} as precision, {fx('r', 3)} as recall,
      {fx('case when p + r = 0 then 0e0 else 2 * p * r / (p + r) end', 3)} as f1 from (select *, case when len(have) = 0 then 0e0 else hit / len(have) end as p,
        case when len(want) = 0 then 1e0 else hit / len(want) end as r from (select *, len(list_filter(want, lambda v: list_contains(have, v)))::DOUBLE as hit from agree))"""),
)
def agreement_pairs(spark, sf):
    return agreement(spark, sf).select("domain", "paper_id", pipe("want"), pipe("have"), "precision", "recall", "f1")


_SIG_ROWS = " union all ".join(
    f"select domain, {q(s)} as signal, list_contains(want, {q(s)}) as w, list_contains(have, {q(s)}) as h from agree" for s in review.SIGNALS)


@query(
    "agreement_metrics",
    with_(sql.REC, sql.ENRICH, DRAFTS, AGREE, f"""sr as ({_SIG_ROWS}), sc2 as (select domain, signal, count(*) filter (where w and h) as tp,
      count(*) filter (where not w and h) as fp, count(*) filter (where w and not h) as fn from sr group by 1, 2),
      sp as (select *, case when tp + fp = 0 then 0e0 else tp / (tp + fp)::DOUBLE end as p, case when tp + fn = 0 then 0e0 else tp / (tp + fn)::DOUBLE end as r from sc2),
      sq as (select *, case when p + r = 0 then 0e0 else 2 * p * r / (p + r) end as f from sp)""",
          f"select domain, signal, tp, fp, fn, {fx('p', 3)} as precision, {fx('r', 3)} as recall, {fx('f', 3)} as f1, f >= 0.85e0 as clears from sq"),
)
def agreement_metrics(spark, sf):
    return review.agreement_metrics(agreement(spark, sf))


# -- links and drill-down -----------------------------------------------------

LINKS = """linked as materialized (select r.domain, r.ord, r.paper_id, r.title, coalesce(
    case when l.quality = 0 then 'https://curated.example/' || r.paper_id end, case when r.source = 'src19' then 'https://papers.example/' || r.paper_id end,
    'https://doi.org/' || nullif(doi, ''), 'https://pmc.ncbi.nlm.nih.gov/articles/' || nullif(pmcid, '') || '/',
    'https://pubmed.ncbi.nlm.nih.gov/' || nullif(pmid, '') || '/') as href from rec r left join labels l on l.doc_id = r.ord)"""


def linked(spark, sf):
    papers = corpus.records(spark, sf).withColumn(
        "paper_url", F.when(F.col("source") == "src19", F.concat(F.lit("https://papers.example/"), "paper_id")))
    curated = corpus.enrichment(spark, sf).select(
        "domain", "paper_id", "ord", F.when(F.col("quality") == 0, F.concat(F.lit("https://curated.example/"), "paper_id")).alias("paper_url"))
    return decide.resolve_links(papers, curated)


@query("resolve_links", with_(sql.REC, LINKS, "select domain, ord, href from linked"))
def resolve_links(spark, sf):
    return linked(spark, sf).select("domain", "ord", "href")


_TK = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "links_by_title",
    with_(sql.REC, sql.ENRICH, LINKS, f"""select e.domain, e.title, k.paper_id, k.href from (select domain, title, {_TK} as key from enr) e
      left join (select domain, {_TK} as key, arg_min(paper_id, ord) as paper_id, arg_min(coalesce(href, '-'), ord) as h,
        nullif(arg_min(coalesce(href, '-'), ord), '-') as href from linked group by 1, 2) k on k.domain = e.domain and k.key = e.key"""),
)
def links_by_title(spark, sf):
    return decide.links_by_title(corpus.enrichment(spark, sf).select("domain", "title"), linked(spark, sf))


@query(
    "paper_drilldown",
    with_(*NORM, sql.GOLD, sql.OVR, sql.RES, """select x.domain, x.paper_id, x.family as baseline_family, r.family as resolved_family, qq.warnings as warning_count,
      coalesce(c.n, 0) as condition_count, g.review_status, e.status as enrichment_status, e.priority as enrichment_priority
      from ex x left join res r using (ord) left join quality qq using (ord) left join (select ord, count(*) as n from cond group by 1) c using (ord)
      left join gold g using (ord) left join enr e using (ord)"""),
)
def paper_drilldown(spark, sf):
    out = decide.paper_drilldown(corpus.evidence(spark, sf), corpus.resolved(spark, sf), corpus.normalized(spark, sf),
                                 corpus.gold(spark, sf), corpus.enrichment(spark, sf))
    return out.select("domain", "paper_id", "baseline_family", "resolved_family", "warning_count", "condition_count",
                      "review_status", "enrichment_status", "enrichment_priority")


# -- health and decisions -----------------------------------------------------

BATCH = f"""batch as materialized (select x.domain, x.extracted, coalesce(r.resolved, 0) as resolved, n.protocols, n.warned,
    {ratio('coalesce(s.o, 0)', 'coalesce(s.sc, 0)')} as outcome_coverage, {ratio('coalesce(s.p, 0)', 'coalesce(s.sc, 0)')} as phase_coverage,
    coalesce(e.pe, 0) as pending_enrichment, coalesce(e.re, 0) as reviewed_enrichment, coalesce(d.n, 0) as pending_proposals
  from (select domain, count(*) as extracted from ex group by 1) x left join (select domain, count(*) as resolved from res group by 1) r using (domain)
    left join (select domain, count(*) as protocols, count(*) filter (where warnings > 0) as warned from quality group by 1) n using (domain)
    left join (select domain, count(*) as sc, count(*) filter (where len(expected_outcomes) > 0) as o, count(*) filter (where len(expected_phases) > 0) as p
      from gold where review_status = 'reviewed' and expected_in group by 1) s using (domain)
    left join (select domain, count(*) filter (where status in ('pending', 'in-progress')) as pe, count(*) filter (where status = 'reviewed') as re from enr group by 1) e using (domain)
    left join (select domain, count(*) as n from depth group by 1) d using (domain))"""
BALL = (*CURATED, STRUCT, _CHEM, CONDITION, QUALITY, OUTCOME, DEPTH, BATCH)


@per_session
def batch(spark, sf):
    open_rows = depth(spark, sf).select("domain", F.lit("pending").alias("decision"))
    return cut(decide.batch_summary(corpus.evidence(spark, sf), corpus.resolved(spark, sf), corpus.normalized(spark, sf),
                                    corpus.gold(spark, sf), corpus.enrichment(spark, sf), open_rows), "batch")


_BATCH = ("extracted", "resolved", "protocols", "warned", "outcome_coverage", "phase_coverage", "pending_enrichment",
          "reviewed_enrichment", "pending_proposals")


@query("batch_summary", with_(*BALL, f"select domain, {', '.join(_BATCH)}, outcome_coverage >= 0.4e0 and phase_coverage >= 0.4e0 as depth_ready from batch"))
def batch_summary(spark, sf):
    return batch(spark, sf).select("domain", *_BATCH, "depth_ready")


_STOP = "case when pending_proposals > 60 then 'unsafe-override-proposals' else 'pending-source-enrichment' end"
HEALTH = f"""audit as (select domain, count(*) filter (where no_outcomes) as missing_outcomes, count(*) filter (where no_phases) as missing_phases from missing group by 1),
health as materialized (select *, case when not gates_pass or not depth_ready or pending_proposals > 0 or stop_reason = 'unsafe-override-proposals' then 'needs-attention'
    when pending_enrichment > 0 or stop_reason = 'pending-source-enrichment' then 'stalled-enrichment-gate' else 'healthy' end as health_state
  from (select b.*, outcome_coverage >= 0.4e0 and phase_coverage >= 0.4e0 as depth_ready, {PASSED.replace('(', '(m.')} = 6 as gates_pass,
    {_STOP} as stop_reason, a.missing_outcomes, a.missing_phases from batch b join met m on m.domain = b.domain and m.subset = 'reviewed' join audit a on a.domain = b.domain))"""
HALL = (*BALL, pairs_sql("res"), metrics_sql(), MISSING, HEALTH)


def health(spark, sf):
    gates = quality.gate_summary(quality.subset_metrics(pairs(spark, sf))).select("domain", F.col("passes_all_gates").alias("gates_pass"))
    audit = review.missing_audit(missing(spark, sf)).select("domain", "missing_outcomes", "missing_phases")
    stop = batch(spark, sf).select("domain", F.when(F.col("pending_proposals") > 60, "unsafe-override-proposals")
                                   .otherwise("pending-source-enrichment").alias("stop_reason"))
    rows = decide.domain_health_join([batch(spark, sf), gates, audit, stop])
    return decide.domain_health(rows.withColumn("regressions_pass", F.lit(True)))


@query(
    "domain_health_join",
    with_(*HALL, f"""select domain, health_state, {joined(sql.labels([('gates-failing', 'not gates_pass'), ('depth-not-ready', 'not depth_ready'),
      ('pending-review', 'pending_proposals > 0'), ('unsafe-overrides', "stop_reason = 'unsafe-override-proposals'"),
      ('pending-enrichment', 'pending_enrichment > 0'), ('normalization-warnings', 'warned > 0'),
      ('missing-outcomes', 'missing_outcomes > 0'), ('missing-phases', 'missing_phases > 0')]))} as alerts from health"""),
)
def domain_health_join(spark, sf):
    return health(spark, sf).select("domain", "health_state", pipe("alerts"))


@query(
    "health_rollup",
    with_(*HALL, """select case when bool_or(health_state = 'needs-attention') then 'needs-attention' when bool_or(health_state = 'stalled-enrichment-gate')
      then 'stalled-enrichment-gate' else 'healthy' end as overall_state, count(*) as domains, sum(pending_proposals) as pending_proposals,
      sum(pending_enrichment) as pending_enrichment, sum(protocols) as protocols, case when bool_or(health_state = 'needs-attention') then 'investigate-health'
        when bool_or(pending_enrichment > 0) then 'clear-enrichment' else 'within-guardrails' end as recommendation from health"""),
)
def health_rollup(spark, sf):
    return decide.health_rollup(health(spark, sf))


@query("missing_domains", with_(*CURATED, """select distinct domain from rec where domain not in (
  select domain from res where family = 'slow-freezing' group by domain having count(*) >= 100)"""))
def missing_domains(spark, sf):
    large = corpus.resolved(spark, sf).where("family = 'slow-freezing'").groupBy("domain").agg(F.count("*").alias("n")).where("n >= 100")
    return decide.missing_domains(corpus.records(spark, sf).select("domain").distinct(), large)


@query("id_reconcile", with_(*CURATED, """select x.domain, x.paper_id, 'missing' as problem from ex x left join res r using (ord) where r.ord is null
  union all select domain, 'gold-' || paper_id, 'unexpected' from gold where not expected_in"""))
def id_reconcile(spark, sf):
    extra = corpus.gold(spark, sf).where("not expected_in").select("domain", F.concat(F.lit("gold-"), "paper_id").alias("paper_id"))
    right = corpus.resolved(spark, sf).select("domain", "paper_id").unionByName(extra)
    return decide.coverage_reconcile(corpus.evidence(spark, sf), right)


@query("coverage_reconcile", with_(*CURATED, """select r.domain, r.paper_id, 'missing' as problem from rec r left join res x using (ord) where x.ord is null"""))
def coverage_reconcile(spark, sf):
    return decide.coverage_reconcile(corpus.records(spark, sf), corpus.resolved(spark, sf))


RANKED = f"""hg as (select domain, count(*) as high_gaps from gaps where tier = 'high' group by 1),
nc as (select domain, count(*) as contradictions from rep group by 1),
dec as materialized (select *, case when contains(rd, 'watchlist') then 'watchlist' when contains(rd, 'proving ground') then 'proving ground'
    when company_relevance >= 0.86e0 and translational_potential >= 0.82e0 and evidence_confidence >= 0.8e0 then 'long-term platform wedge'
    when contains(rd, 'company-entry') or contains(rd, 'entry point') or (company_relevance >= 0.72e0 and evidence_confidence >= 0.68e0
      and outcome_coverage >= 0.6e0 and phase_coverage >= 0.6e0) then 'plausible first company wedge'
    when evidence_confidence < 0.45e0 then 'watchlist' else 'proving ground' end as wedge_class,
    {fx('''greatest(0e0, evidence_confidence * 0.38e0 + company_relevance * 0.24e0 + scientific_relevance * 0.2e0 + translational_potential * 0.18e0
      - (pending_enrichment * 0.01e0 + coalesce(high_gaps, 0) * 0.03e0 + coalesce(contradictions2, 0) * 0.02e0))''', 6)} as recommendation_score
  from (select w.* exclude (contradictions), lower(current_read) as rd, high_gaps, nc.contradictions as contradictions2
    from wedge w left join hg using (domain) left join nc using (domain)))"""
DALL = (*GALL, RANKED)


def ranked(spark, sf):
    high = gaps(spark, sf).where("tier = 'high'").groupBy("domain").agg(F.count("*").alias("high_gaps"))
    pairs_ = report(spark, sf).groupBy("domain").agg(F.count("*").alias("contradictions"))
    rows = wedges(spark, sf).drop("contradictions").join(high, "domain", "left").join(pairs_, "domain", "left").fillna(
        0, ["high_gaps", "contradictions"]).withColumn("read", F.col("current_read"))
    return decide.decision_rank(rows)


@query(
    "decision_rank",
    with_(*DALL, """select domain, recommendation_score, wedge_class, case when evidence_confidence >= 0.78e0 then 'high' when evidence_confidence >= 0.55e0 then 'medium' else 'low' end as confidence_band,
      case when translational_potential >= 0.8e0 then 'clinically adjacent' when translational_potential >= 0.6e0 then 'transplant relevant'
        when translational_potential >= 0.4e0 then 'preclinical' else 'research only' end as signal_band from dec"""),
)
def decision_rank(spark, sf):
    return ranked(spark, sf).select("domain", "recommendation_score", "wedge_class", "confidence_band", "signal_band")


@query("decision_board", with_(*DALL, "select domain, title, recommendation_score from dec order by recommendation_score desc, domain"))
def decision_board(spark, sf):
    return decide.decision_board(ranked(spark, sf)).select("domain", "title", "recommendation_score")


@query(
    "packet_board",
    with_(*DALL, """select p.domain, p.claim_id, case when p.domain = l.domain and p.rank = 1 then 0 when p.domain = l.domain then 1 else 2 end as board_order,
      p.priority_score from pk p, (select domain from dec order by recommendation_score desc, domain limit 1) l order by 3, 4 desc, 1, 2"""),
)
def packet_board(spark, sf):
    return decide.packet_board(packets(spark, sf), ranked(spark, sf)).select("domain", "claim_id", "board_order", "priority_score")


@query(
    "main_confound",
    with_(*MALL, *GALL[len(WALL):], """select domain, case when pr is not null then 'contradiction' when rw is not null then 'flagged-row' when heavy then 'morphology-heavy'
      when gp is not null then 'evidence-gap' else 'none' end as confound, coalesce(pr, rw, case when heavy then '' end, gp, '') as detail from (
      select d.domain, (select arg_min(array_to_string(confounds, ', '), pair) from rep where rep.domain = d.domain) as pr,
        (select arg_min(title, (-relevance, title, paper_id)) from mx where mx.domain = d.domain and len(confounds) > 0) as rw,
        (select count(*) > 0 and count(*) filter (where list_contains(outcomes, 'morphology') and not list_contains(outcomes, 'transplantation')
          and not list_contains(outcomes, 'function')) >= ceil(count(*) / 2e0) from mx where mx.domain = d.domain) as heavy,
        (select arg_min(title, (-floor(impact * 100 + 1e-9), -case tier when 'high' then 3 when 'medium' then 2 else 1 end, -relevance, title, paper_id))
          from gaps where gaps.domain = d.domain) as gp from wedge d)"""),
)
def main_confound(spark, sf):
    return decide.main_confound(matrix(spark, sf), report(spark, sf), gaps(spark, sf))


OPP = f"""dom_fam as (select domain, family from (select domain, family, count(*) as n from res group by 1, 2) qualify row_number() over (partition by domain order by n desc, family) = 1),
opp as materialized (select *, row_number() over (order by readiness_score desc, opportunity_evidence desc, domain) as rank from (select w.domain,
    {fx(f"evidence_confidence * 0.4e0 + outcome_coverage * 0.25e0 + phase_coverage * 0.2e0 + case when {PASSED.replace('(', '(m.')} = 6 then 0.15e0 else 0e0 end", 3)} as readiness_score,
    {fx('evidence_confidence * 0.5e0 + (1 - least(1e0, pe / 20e0)) * 0.3e0 + (1 - least(1e0, mo / 20e0)) * 0.2e0', 3)} as opportunity_evidence,
    {fx("least(1e0, company_relevance * 0.45e0 + translational_potential * 0.25e0 + case when f.family <> 'unknown' then 0.2e0 else 0.08e0 end + case when outcome_coverage >= 0.5e0 then 0.1e0 else 0.04e0 end)", 3)} as commercial_score
  from wedge w join dom_fam f using (domain) join met m on m.domain = w.domain and m.subset = 'reviewed'
    join (select domain, count(*) filter (where status in ('pending', 'in-progress')) as pe from enr group by 1) e on e.domain = w.domain
    join (select domain, count(*) filter (where no_outcomes) as mo from missing group by 1) a on a.domain = w.domain))"""


def opportunities(spark, sf):
    families = research.top_per(research.family_counts(corpus.resolved(spark, sf)), ["domain"], 1, F.desc("papers"), "family").select(
        "domain", F.col("family").alias("dominant_family"))
    gates = quality.gate_summary(quality.subset_metrics(pairs(spark, sf))).select("domain", "passes_all_gates")
    audit = review.missing_audit(missing(spark, sf)).select("domain", "missing_outcomes")
    work = batch(spark, sf).select("domain", "pending_enrichment")
    rows = wedges(spark, sf).drop("pending_enrichment")
    for part in (families, gates, audit, work):
        rows = rows.join(part, "domain")
    return decide.opportunity_scores(rows)


OALL = (*WALL, MISSING, OPP)


@query("opportunity_scores", with_(*OALL, "select domain, rank, readiness_score, opportunity_evidence, commercial_score from opp"))
def opportunity_scores(spark, sf):
    return opportunities(spark, sf).select("domain", "rank", "readiness_score", "opportunity_evidence", "commercial_score")


@query(
    "readiness_cards",
    with_(*BALL, f"""select domain, {fx(clamp('cov * 0.5e0 + pr * 0.25e0 + en * 0.15e0 - least(0.22e0, greatest(0e0, pending_enrichment / 12e0))'), 6)} as readiness_score,
      {fx(clamp('cov * 0.7e0 + pr * 0.2e0 + en * 0.1e0'), 6)} as evidence_score, outcome_coverage >= 0.4e0 and phase_coverage >= 0.4e0 as ready
      from (select *, (outcome_coverage + phase_coverage) / 2 as cov, least(1e0, protocols / 40e0) as pr, least(1e0, reviewed_enrichment / 10e0) as en from batch)"""),
)
def readiness_cards(spark, sf):
    none = opportunities_schema(spark)
    rows = batch(spark, sf).withColumn("market_signal", F.lit(0.18))
    return decide.readiness_cards(rows, none).select("domain", "readiness_score", "evidence_score", "ready")


def opportunities_schema(spark):
    """No opportunity rows yet: every card is derived."""
    return spark.createDataFrame([], "domain string, readiness_score double, opportunity_evidence double, commercial_score double")


@query(
    "evidence_quality_rollup",
    with_(*CURATED, STRUCT, _CHEM, CONDITION, QUALITY, """select n.domain, n.protocols, n.warned, s.primary_supported, s.secondary_supported, s.manual_only,
      e.pending, e.reviewed, e.secondary_reviewed
      from (select domain, count(*) as protocols, count(*) filter (where warnings > 0) as warned from quality group by 1) n
      left join (select x.domain, count(*) filter (where prim) as primary_supported, count(*) filter (where sec) as secondary_supported,
        0 as manual_only from ex x join gold g using (ord) where g.review_status = 'reviewed' and g.expected_in group by 1) s using (domain)
      left join (select domain, count(*) filter (where status in ('pending', 'in-progress')) as pending, count(*) filter (where status = 'reviewed') as reviewed,
        count(*) filter (where status = 'reviewed' and reviewer_notes is not null) as secondary_reviewed from enr group by 1) e using (domain)"""),
)
def evidence_quality_rollup(spark, sf):
    return decide.evidence_quality_rollup(corpus.gold(spark, sf), corpus.evidence(spark, sf), corpus.enrichment(spark, sf),
                                          corpus.normalized(spark, sf))


@query(
    "domain_compare",
    with_(*BALL, f"""select b.domain, b.protocols, c.fetched, c.matched as matched_papers, {ratio('c.matched', 'c.fetched', 6)} as match_rate, c.top_title from batch b join (
      select domain, count(*) as fetched, count(*) filter (where confidence >= 0.7e0) as matched,
        arg_max(title, (confidence, title)) filter (where confidence >= 0.7e0) as top_title from ex group by 1) c using (domain)"""),
)
def domain_compare(spark, sf):
    corpus_rows = corpus.evidence(spark, sf).select(
        "domain", "title", F.col("confidence").alias("score"), (F.col("confidence") >= 0.7).alias("matched"))
    cards = batch(spark, sf).select("domain", "protocols")
    out = decide.domain_compare(cards, batch(spark, sf).select("domain", "depth_ready"), corpus_rows)
    return out.select("domain", "protocols", "fetched", "matched_papers", "match_rate", "top_title")


# -- runs ---------------------------------------------------------------------

_LOOP = f"""{_CYCLES}, loop as (select *, lag(state_hash) over (partition by domain order by cycle) is distinct from state_hash as changed,
  cycle % 3 as pending_proposals, cycle % 2 as override_proposals, cycle % 5 = 0 as auto_apply_safe, cycle % 7 as pending_enrichment from cycles)"""
_STOPPED = """case when changed and cycle >= 20 then 'max-cycles-reached' when changed then null when pending_proposals > 0 then 'pending-benchmark-review'
  when override_proposals > 0 and not auto_apply_safe then 'unsafe-override-proposals' when pending_enrichment > 0 then 'pending-source-enrichment' else 'converged' end"""


def loop(spark, sf):
    c = F.col("cycle")
    return decide.cycle_state_change(cycles(spark, sf), block("cycle", 8)).withColumns(
        {"pending_proposals": c % 3, "override_proposals": c % 2, "auto_apply_safe": c % 5 == 0, "pending_enrichment": c % 7})


@query("stop_reason", f"with {_LOOP} select domain, cycle, {_STOPPED} as stop_reason from loop")
def stop_reason(spark, sf):
    return decide.stop_reason(loop(spark, sf), 20).select("domain", "cycle", "stop_reason")


@query(
    "run_history",
    f"""with {_LOOP}, h as (select event_type as domain, count(*) as events from events group by 1)
    select h.domain, h.events, l.cycle, l.changed from h left join loop l using (domain)""",
)
def run_history(spark, sf):
    totals = corpus.table(spark, sf, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("events"))
    return decide.run_history(totals, loop(spark, sf).select("domain", "cycle", "changed"))


RUNS = f"""gap_b as (select domain, paper_id, case when published_year >= 2010 then 'high' else 'low' end as tier from enr where status <> 'reviewed'),
gap_a as (select domain, paper_id, case when published_year >= 2015 then 'high' else 'low' end as tier from enr where status = 'pending'),
closed as (select b.domain, b.paper_id from gap_b b where tier = 'high' and not exists (select 1 from gap_a a where a.domain = b.domain and a.paper_id = b.paper_id)),
fam_n as (select r.domain, r.family, count(*) as n, count(l.doc_id) as nl, sum(floor(confidence * 100 + 0.5)) as c, sum(case when l.doc_id is not null then floor(confidence * 100 + 0.5) end) as cl
  from res r left join labels l on l.doc_id = r.ord group by 1, 2),
run_b as (select domain, arg_max(family, (nl, family)) as wedge_id, sum(nl) as support, {fx('sum(cl) / (sum(nl) * 100e0)', 3)} as score from fam_n group by 1),
run_a as (select domain, arg_max(family, (n, family)) as wedge_id, sum(n) as support, {fx('sum(c) / (sum(n) * 100e0)', 3)} as score from fam_n group by 1)"""


def gap_frames(spark, sf):
    e = corpus.enrichment(spark, sf)

    def tier(year: int):
        return F.when(F.col("published_year") >= year, "high").otherwise("low").alias("tier")

    return (e.where("status <> 'reviewed'").select("domain", "paper_id", tier(2010)),
            e.where("status = 'pending'").select("domain", "paper_id", tier(2015)))


@query("gaps_closed", with_(*CURATED, RUNS, "select * from closed"))
def gaps_closed(spark, sf):
    before, after = gap_frames(spark, sf)
    return decide.gaps_closed(before, after).select("domain", "paper_id")


def run_frame(spark, sf, labelled_only: bool):
    labels = corpus.table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    rows = corpus.resolved(spark, sf).select("domain", "ord", "family", "confidence")
    if labelled_only:
        rows = rows.join(labels, "ord")
    by_family = rows.groupBy("domain", "family").agg(F.count("*").alias("n"), F.sum(F.round(F.col("confidence") * 100)).alias("c"))
    before, after = gap_frames(spark, sf)
    gap = before if labelled_only else after
    counts = gap.groupBy("domain").agg(F.count_if(F.col("tier") == "high").alias("high_gaps"), F.count("*").alias("pending_enrichment"))
    from ..functions.numbers import fixed

    score = fixed(F.sum("c") / (F.sum("n") * F.lit(100.0)), 3)
    return by_family.groupBy("domain").agg(
        F.max_by("family", F.struct("n", "family")).alias("wedge_id"), F.sum("n").alias("support"),
        *[score.alias(s) for s in decide.SCORES]).join(counts, "domain").withColumns({
            "top_packet": F.col("wedge_id"), "drafted": F.lit(0), "triaged": F.lit(0), "decision_changing": F.lit(0)})


@query(
    "run_delta",
    with_(*CURATED, RUNS, f"""rd as (select a.domain, {fx('a.score - b.score', 3)} as d, a.support - b.support as support_delta,
        (select count(*) from gap_a g where g.domain = a.domain and tier = 'high') - (select count(*) from gap_b g where g.domain = a.domain and tier = 'high') as high_gap_change,
        (select count(*) from gap_a g where g.domain = a.domain) - (select count(*) from gap_b g where g.domain = a.domain) as pending_change,
        (select count(*) from closed c where c.domain = a.domain) as gaps_closed, a.wedge_id is distinct from b.wedge_id as wedge_changed
      from run_a a full join run_b b using (domain)),
      rp as (select *, case when (d < -0.02e0 or high_gap_change > 0) and not (high_gap_change < 0 or gaps_closed > 0) and not pending_change < 0 then 'regressed'
        when abs(d) >= 0.01e0 or high_gap_change < 0 or gaps_closed > 0 or pending_change < 0 or wedge_changed then 'improved' else 'flat' end as progress from rd)""",
          """select domain, d as evidence_confidence_delta, support_delta, high_gap_change, pending_change, gaps_closed, wedge_changed, progress,
        progress = 'improved' and (high_gap_change < 0 or gaps_closed > 0 or abs(d) >= 0.01e0 or wedge_changed or pending_change < 0) as productive from rp"""),
)
def run_delta(spark, sf):
    before, after = gap_frames(spark, sf)
    out = decide.run_delta(run_frame(spark, sf, True), run_frame(spark, sf, False), decide.gaps_closed(before, after))
    return out.select("domain", "evidence_confidence_delta", "support_delta", "high_gap_change", "pending_change", "gaps_closed",
                      "wedge_changed", "progress", "productive")


# -- candidate evaluation and regressions --------------------------------------

FIELDS = ("paper_type", "family", "species", "specimens", "outcomes", "phases")
_PATCH = ", ".join(f"case when r.expected_in and list_contains(r.fields, '{f}') then r.expected_{f} end as p_{f}" for f in FIELDS)
MERGED = f"""patch as (select r.domain, r.paper_id, case when not r.expected_in then true end as p_excluded, {_PATCH} from repair r),
merged as materialized (select coalesce(p.domain, o.domain) as domain, coalesce(p.paper_id, o.paper_id) as paper_id, coalesce(p_excluded, o.excluded) as excluded,
    {', '.join(f'coalesce(p_{f}, o.{f}) as {f}' for f in FIELDS)}, o.confidence from patch p full join ovr o on o.domain = p.domain and o.paper_id = p.paper_id),
candx as materialized (select x.* replace ({', '.join(f'coalesce(o.{f}, x.{f}) as {f}' for f in FIELDS)}, coalesce(o.confidence, x.confidence) as confidence)
  from ex x left join merged o on o.domain = x.domain and o.paper_id = x.paper_id where not coalesce(o.excluded, false)),
staged as materialized (select *, 'resolved' as stage from res union all by name select *, 'candidate' as stage from candx),
sgold as (select *, unnest(['resolved', 'candidate']) as stage from gold)"""
CEVAL = (*CURATED, pairs_sql("res"), REPAIR, MERGED, pairs_sql("staged", "spairs", "sgold", ("domain", "stage")),
         metrics_sql("spairs", "smet", ("domain", "stage")))


@query(
    "candidate_evaluation",
    with_(*CEVAL, f"""select r.domain, coalesce(n.n, 0) as override_proposals, r.inclusion_f1 as current_f1, c.inclusion_f1 as candidate_f1,
      coalesce({PASSED.replace('(', '(c.')} = 6 and c.inclusion_f1 >= r.inclusion_f1 and c.family_accuracy >= r.family_accuracy
        and c.paper_type_accuracy >= r.paper_type_accuracy and n.n > 0, false) as auto_apply_safe
      from smet r join smet c on c.domain = r.domain and c.stage = 'candidate' and c.subset = 'reviewed'
      left join (select domain, count(*) as n from repair group by 1) n on n.domain = r.domain where r.stage = 'resolved' and r.subset = 'reviewed'"""),
)
def candidate_evaluation(spark, sf):
    proposals = repairs(spark, sf)
    base = corpus.overrides(spark, sf).withColumn("scenario_id", F.lit("all"))
    patches = proposals.withColumn("scenario_id", F.lit("all"))
    merged = review.merge_scenario_overrides(base.drop("confidence", "ord"), patches).drop("scenario_id")
    merged = merged.join(corpus.overrides(spark, sf).select("domain", "paper_id", "confidence"), ["domain", "paper_id"], "left")
    candidate = review.apply_overrides(corpus.evidence(spark, sf), merged)
    metrics = review.stage_metrics(corpus.gold(spark, sf), {"resolved": corpus.resolved(spark, sf), "candidate": candidate})
    return review.candidate_evaluation(metrics, proposals)


def scenarios(spark, sf):
    """Two corruptions per domain, aimed at its first reviewed override that fits."""
    reviewed = corpus.gold(spark, sf).where("review_status = 'reviewed'").select("domain", "paper_id", "expected_family", "expected_in")
    own = corpus.overrides(spark, sf).select("domain", "paper_id", "ord").join(reviewed, ["domain", "paper_id"])
    none = F.lit(None).cast("array<string>")
    gains = {f"min_{m}": F.lit(None).cast("double") for m in ("inclusion_f1", "family_accuracy", "paper_type_accuracy", "outcomes_f1", "phases_f1")}
    first = own.groupBy("domain").agg(F.min_by("paper_id", "ord").alias("paper_id"))
    kinds = F.explode(F.array(F.lit("remove-override"), F.lit("replace-override")))
    return first.withColumn("kind", kinds).select(
        "domain", F.col("kind").alias("scenario_id"), "paper_id", "kind",
        F.when(F.col("kind") == "replace-override", "review").alias("patch_paper_type"),
        F.when(F.col("kind") == "replace-override", "unknown").alias("patch_family"),
        *[none.alias(f"patch_{f}") for f in FIELDS[2:]], F.array(F.lit("excluded")).alias("expected_fields"),
    ).withColumns(gains)


_SKEYS = ("domain", "scenario_id")
_S_FIELDS = sql.labels(
    (f, f"r.expected_{f} is not null and "
     + (f"(not r.present or r.expected_{f} is distinct from r.actual_{f})" if f in FIELDS[:2] else
        f"(not r.present or {sql.norm_set(f'r.expected_{f}')} <> {sql.norm_set(f'coalesce(r.actual_{f}, []::VARCHAR[])')})"))
    for f in FIELDS)
_S_PATCHED = ", ".join(f"coalesce(o.{f}, x.{f}) as {f}" for f in FIELDS)
_S_ON = "o.domain = x.domain and o.scenario_id = s.scenario_id and o.paper_id = x.paper_id"
SCENARIOS = f"""scen as materialized (select domain, kind as scenario_id, paper_id as target, kind from (
    select o.domain, arg_min(o.paper_id, o.ord) as paper_id from ovr o join gold g on g.domain = o.domain and g.paper_id = o.paper_id
    where g.review_status = 'reviewed' group by 1), (values ('remove-override'), ('replace-override')) as k(kind)),
sovr as (select o.domain, s.scenario_id, o.paper_id, o.excluded,
    case when kind = 'replace-override' and o.paper_id = target then 'review' else o.paper_type end as paper_type,
    case when kind = 'replace-override' and o.paper_id = target then 'unknown' else o.family end as family,
    o.species, o.specimens, o.outcomes, o.phases
  from ovr o join scen s on s.domain = o.domain where not (kind = 'remove-override' and o.paper_id = target)),
scur as materialized (select x.* replace ({_S_PATCHED}), s.scenario_id from ex x join scen s on s.domain = x.domain
  left join sovr o on {_S_ON} where not coalesce(o.excluded, false)),
sg as (select g.*, s.scenario_id from gold g join scen s on s.domain = g.domain)"""
S_REPAIR = f"""srep as materialized (select * from (select r.domain, r.scenario_id, r.paper_id, r.expected_in,
    case when not r.expected_in and r.present then ['excluded'] when r.expected_in then {_S_FIELDS} else []::VARCHAR[] end as fields,
    {', '.join(f'r.expected_{f}' for f in FIELDS)} from spr0 r where r.review_status = 'reviewed') where len(fields) > 0),
smrg as (select coalesce(p.domain, o.domain) as domain, coalesce(p.scenario_id, o.scenario_id) as scenario_id,
    coalesce(p.paper_id, o.paper_id) as paper_id, coalesce(case when not p.expected_in then true end, o.excluded) as excluded,
    {', '.join(f"coalesce(case when p.expected_in and list_contains(p.fields, '{f}') then p.expected_{f} end, o.{f}) as {f}" for f in FIELDS)}
  from srep p full join sovr o on o.domain = p.domain and o.scenario_id = p.scenario_id and o.paper_id = p.paper_id),
scan2 as materialized (select x.* replace ({_S_PATCHED}), s.scenario_id from ex x join scen s on s.domain = x.domain
  left join smrg o on {_S_ON} where not coalesce(o.excluded, false)),
sstaged as (select *, 'current' as stage from scur union all by name select *, 'candidate' as stage from scan2),
sg2 as (select *, unnest(['current', 'candidate']) as stage from sg)"""
_GAINS = ("inclusion_f1", "family_accuracy", "paper_type_accuracy", "outcomes_f1", "phases_f1")
_GAIN_SQL = ", ".join(fx(f"c.{m} - b.{m}", 3) + f" as gain_{m}" for m in _GAINS)


@query(
    "regression_scenarios",
    with_(*CURATED, SCENARIOS, pairs_sql("scur", "spr0", "sg", _SKEYS), S_REPAIR,
          pairs_sql("sstaged", "spr1", "sg2", (*_SKEYS, "stage")), metrics_sql("spr1", "smet", (*_SKEYS, "stage")),
          f"""sres as (select s.domain, s.scenario_id, coalesce(n.n, 0) as proposals, p.paper_id is not null as proposal_found,
        list_contains(coalesce(p.fields, []::VARCHAR[]), 'excluded') as hit, {_GAIN_SQL}, {PASSED.replace('(', '(c.')} = 6 as gates, n.n as any_n
      from scen s join smet b on b.domain = s.domain and b.scenario_id = s.scenario_id and b.stage = 'current' and b.subset = 'reviewed'
        join smet c on c.domain = s.domain and c.scenario_id = s.scenario_id and c.stage = 'candidate' and c.subset = 'reviewed'
        left join srep p on p.domain = s.domain and p.scenario_id = s.scenario_id and p.paper_id = s.target
        left join (select domain, scenario_id, count(*) as n from srep group by 1, 2) n on n.domain = s.domain and n.scenario_id = s.scenario_id),
      sfin as (select *, coalesce(gates and any_n > 0 and gain_inclusion_f1 >= 0 and gain_family_accuracy >= 0
        and gain_paper_type_accuracy >= 0, false) as auto_apply_safe from sres)""",
          f"""select domain, scenario_id, proposals, proposal_found, case when hit then 'excluded' else '' end as matched_fields,
        {', '.join(f'gain_{m}' for m in _GAINS)}, auto_apply_safe, proposal_found and hit and auto_apply_safe as passed from sfin"""),
)
def regression_scenarios(spark, sf):
    out = review.regression_scenarios(
        scenarios(spark, sf), corpus.overrides(spark, sf).drop("ord", "confidence"), corpus.evidence(spark, sf), corpus.gold(spark, sf))
    return out.withColumn("matched_fields", F.array_join("matched_fields", "|"))
