"""Corpus-level findings over the resolved extraction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config.defaults import BASE_CHEMICALS
from ..config.model import Group
from ..operators import decide, match, research
from ..plans import evidence as plan
from ..session import cut
from . import corpus, sql
from .corpus import REGISTRY, per_session
from .matching import pipe
from .registry import query
from .scoring import GATE_SUMMARY, METRICS, SUBSET_METRICS, pairs
from .sql import CURATED, clamp, fx, in_list, joined, metrics_sql, pairs_sql, q, strings, with_

# -- facets -------------------------------------------------------------------

_FACETS = """fac as (select domain, 'chemical' as facet, unnest(chemicals) as label from res
  union all select domain, 'specimen', unnest(specimens) from res union all select domain, 'outcome', unnest(outcomes) from res
  union all select domain, 'phase', unnest(phases) from res union all select domain, 'family', family from res),
facn as (select domain, facet, label, count(*) as n from fac group by all)"""


@query(
    "facet_counts",
    with_(*CURATED, _FACETS, """select *, row_number() over (partition by domain, facet order by n desc, label) as rank from facn
      qualify facet = 'family' or row_number() over (partition by domain, facet order by n desc, label) <= 12"""),
)
def facet_counts(spark, sf):
    return research.facet_counts(corpus.resolved(spark, sf))


@query("family_counts", with_(*CURATED, "select domain, family, count(*) as papers from res group by all"))
def family_counts(spark, sf):
    return research.family_counts(corpus.resolved(spark, sf))


_SPOTS = """spot as (select domain, family, chemical, specimen, count(*) as papers,
    list_sort(list_distinct(flatten(list(outcomes)))) as outs, count(distinct title) as titles
  from (select domain, family, outcomes, title, chemical, unnest(case when len(specimens) > 0 then specimens else ['unspecified'] end) as specimen
    from (select domain, family, outcomes, title, specimens, unnest(chemicals) as chemical from res)) group by all),
spots as (select *, row_number() over (partition by domain order by papers desc, chemical, family, specimen) as rank
  from spot where papers >= 2 and len(outs) >= 2
  qualify row_number() over (partition by domain order by papers desc, chemical, family, specimen) <= 12)"""


@query(
    "hotspots",
    with_(*CURATED, _SPOTS, f"select domain, rank, family, chemical, specimen, papers, {joined('outs')} as outcomes from spots"),
)
def hotspots(spark, sf):
    return research.hotspots(corpus.resolved(spark, sf)).select(
        "domain", "rank", "family", "chemical", "specimen", "papers", pipe("outcomes"))


@query("hotspot_titles", with_(*CURATED, _SPOTS, "select domain, rank, titles from spots"))
def hotspot_titles(spark, sf):
    evidence = corpus.resolved(spark, sf)
    return research.hotspot_titles(evidence, research.hotspots(evidence)).groupBy("domain", "rank").agg(
        F.count("*").alias("titles"))


_SIGNALS = """{n} as (select domain, count(*) as papers, count(*) filter (where family = 'unknown') as unknown_family,
  floor(count(*) filter (where family = 'unknown') / count(*)::DOUBLE * 100 + 0.5e0) / 100e0 as unknown_family_rate,
  sum(len(list_filter(phases, lambda p: p = 'unknown'))) as unknown_phases,
  count(*) filter (where paper_type = 'experimental') as experimental_papers,
  count(*) filter (where paper_type = 'methods') as methods_papers,
  count(*) filter (where paper_type = 'review') as review_papers,
  count(*) filter (where paper_type = 'commentary') as commentary_papers from {s} group by domain)"""


@query("quality_signals", with_(*CURATED, _SIGNALS.format(n="sig", s="res"), "select * from sig"))
def quality_signals(spark, sf):
    return research.quality_signals(corpus.resolved(spark, sf))


@query(
    "override_impact",
    with_(*CURATED, _SIGNALS.format(n="b", s="ex"), _SIGNALS.format(n="r", s="res"), f"""select domain,
      b.unknown_family - r.unknown_family as unknown_families_resolved,
      {fx('b.unknown_family_rate - r.unknown_family_rate', 2)} as unknown_family_rate_delta,
      b.unknown_phases - r.unknown_phases as unknown_phase_delta, r.experimental_papers - b.experimental_papers as experimental_delta,
      r.methods_papers - b.methods_papers as methods_delta, r.review_papers - b.review_papers as review_delta,
      r.commentary_papers - b.commentary_papers as commentary_delta, o.n as overrides_applied, o.x as excluded_papers
      from b join r using (domain) join (select domain, count(*) as n, count(excluded) as x from ovr group by 1) o using (domain)"""),
)
def override_impact(spark, sf):
    return research.override_impact(corpus.evidence(spark, sf), corpus.resolved(spark, sf), corpus.overrides(spark, sf))


# -- contradictions -----------------------------------------------------------

_GENERIC = sql.by_domain(lambda d: strings(d.generic_specimens), "{x}.domain")


def _meaning(a: str) -> str:
    return f"list_filter({a}.phases, lambda p: p not in ('unknown', 'assessment', 'culture'))"


def _overlap(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda v: list_contains({y}, v))) > 0"


def _specific(a: str) -> str:
    return f"list_filter({a}.specimens, lambda v: not list_contains({_GENERIC.format(x=a)}, v))"


#: Brute force over all pairs of papers; fine at the size of a check.
CONTRA = f"""contra as materialized (
  select *, row_number() over (partition by domain order by len(shared) desc, ord_a, ord_b) as rank from (
    select a.domain, a.ord as ord_a, b.ord as ord_b, a.title as title_a, b.title as title_b, a.family as family_a,
      b.family as family_b, a.outcomes as outcomes_a, b.outcomes as outcomes_b,
      list_sort(list_filter(a.chemicals, lambda v: list_contains(b.chemicals, v))) as shared,
      list_sort(list_filter(a.specimens, lambda v: list_contains(b.specimens, v))) as shared_spec,
      case when {_overlap('a.species', 'b.species')}
        and len(list_filter(a.chemicals, lambda v: list_contains(b.chemicals, v))) >= 2 then 0.85e0 else 0.72e0 end as confidence
    from (select * from res where paper_type = 'experimental' and family not in ('unknown', 'comparative')) a
    join (select * from res where paper_type = 'experimental' and family not in ('unknown', 'comparative')) b
      on a.domain = b.domain and a.ord < b.ord and a.family <> b.family and {_overlap('a.chemicals', 'b.chemicals')}
      and {_overlap('a.specimens', 'b.specimens')} and {_overlap('a.outcomes', 'b.outcomes')}
      and (len(a.species) = 0 or len(b.species) = 0 or {_overlap('a.species', 'b.species')})
      and ((len({_specific('a')}) = 0 and len({_specific('b')}) = 0) or {_overlap(_specific('a'), _specific('b'))})
      and (len({_meaning('a')}) = 0 or len({_meaning('b')}) = 0 or {_overlap(_meaning('a'), _meaning('b'))}))
  qualify row_number() over (partition by domain order by len(shared) desc, ord_a, ord_b) <= 20)"""


@query(
    "contradiction_pairs",
    with_(*CURATED, CONTRA, f"""select domain, rank, ord_a, ord_b, family_a, family_b, {joined('shared')} as shared_chemicals,
      {joined('shared_spec')} as shared_specimens, confidence from contra"""),
)
def contradiction_pairs(spark, sf):
    out = research.contradiction_pairs(corpus.resolved(spark, sf), REGISTRY)
    return out.select("domain", "rank", "ord_a", "ord_b", "family_a", "family_b", pipe("shared_chemicals"),
                      pipe("shared_specimens"), "confidence")


@query("top_contradictions", with_(*CURATED, CONTRA, "select domain, rank, title_a, title_b, len(shared) as shared from contra where rank <= 5"))
def top_contradictions(spark, sf):
    out = research.contradiction_pairs(corpus.resolved(spark, sf), REGISTRY, limit=5)
    return out.select("domain", "rank", "title_a", "title_b", F.size("shared_chemicals").alias("shared"))


# -- templates ----------------------------------------------------------------


def group_sql(g: Group) -> str:
    tests = ["true"]
    if g.experimental:
        tests.append("paper_type = 'experimental'")
    if g.specimen:
        tests.append(f"list_contains(specimens, {q(g.specimen)})")
    tests += [f"list_contains(chemicals, {q(c)})" for c in g.chemicals]
    if g.family:
        tests.append(f"family = {q(g.family)}")
    if g.outcomes:
        tests.append("(" + " or ".join(f"list_contains(outcomes, {q(o)})" for o in g.outcomes) + ")")
    if g.title:
        tests.append(sql.rx("title", g.title))
    if g.phase:
        tests.append(f"list_contains(phases, {q(g.phase)})")
    if g.sparse:
        tests.append("len(list_distinct(list_filter(phases, lambda p: p <> 'unknown'))) = 1")
    return " and ".join(tests)


_TEMPLATES = [(d, i, t) for d in REGISTRY.domains for i, t in enumerate(d.templates)]
_MEM = " union all ".join(
    f"select domain, ord, {i} as tpl, {q(name)} as grp, title, family, chemicals, specimens from res where domain = {q(d.id)} and {group_sql(g)}"
    for d, i, t in _TEMPLATES for name, g in t.groups
)


def _rule(d, i, t) -> str:
    text = t.rule
    for name, _ in t.groups:
        text = re.sub(rf"\b{name}\b", f"coalesce(max(n) filter (where grp = '{name}'), 0)", text)
    return f"select {q(d.id)} as domain, {i} as tpl from memn where domain = {q(d.id)} and tpl = {i} having {text}"


def _pick_rows(kind: str) -> str:
    value = {"chemicals": "unnest(chemicals) as v, generate_subscripts(chemicals, 1)",
             "specimens": "unnest(specimens) as v, generate_subscripts(specimens, 1)",
             "families": "family as v, 1", "titles": "title as v, 1"}[kind]
    rows = []
    for d, i, t in _TEMPLATES:
        pick = getattr(t, kind)
        for r, g in enumerate(pick.groups):
            rows.append(f"select domain, tpl, {r} as r, ord, {value} as p, {pick.limit or 'null'}::INT as lim, "
                        f"{strings(pick.drop)} as dropped from mem where domain = {q(d.id)} and tpl = {i} and grp = {q(g)}")
    return " union all ".join(rows)


def _pick_cte(kind: str) -> str:
    return f"""p_{kind} as (select domain, tpl, v, lim, rk from (
    select domain, tpl, v, any_value(lim) as lim, row_number() over (partition by domain, tpl order by min((r, ord, p))) as rk
    from ({_pick_rows(kind)}) where not list_contains(dropped, v) group by domain, tpl, v) where lim is null or rk <= lim)"""


_FIXED = " union all ".join(
    f"select {q(d.id)} as domain, {i} as tpl, {q(t.title)} as title, {q(t.category)} as category, {t.confidence}e0 as confidence, "
    + ", ".join(f"{strings(getattr(t, k).fixed)} as x_{k}" for k in research.PICKS[:3])
    for d, i, t in _TEMPLATES
)


def _listed(kind: str) -> str:
    return f"""case when len(f.x_{kind}) > 0 then f.x_{kind} else coalesce((select list(v order by rk) from p_{kind} p
      where p.domain = f.domain and p.tpl = f.tpl), []) end as {kind}"""


TEMPLATE = f"""mem as materialized ({_MEM}),
memn as (select domain, tpl, grp, count(*) as n from mem group by all),
held as ({' union all '.join(_rule(d, i, t) for d, i, t in _TEMPLATES)}),
{', '.join(_pick_cte(k) for k in research.PICKS)},
claims as materialized (select f.domain, f.tpl as claim_id, f.title, f.category, f.confidence, {', '.join(_listed(k) for k in research.PICKS[:3])}
  from ({_FIXED}) f join held h on h.domain = f.domain and h.tpl = f.tpl),
titles as materialized (select p.domain, p.tpl as claim_id, p.v as title from p_titles p join held h on h.domain = p.domain and h.tpl = p.tpl)"""
CLAIMS = (*CURATED, TEMPLATE)


@per_session
def found(spark, sf) -> plan.Findings:
    """Contradictions, hypotheses and wedge of the resolved corpus, as stored stages."""
    return plan.find(corpus.resolved(spark, sf), REGISTRY)


@query(
    "hypothesis_templates",
    with_(*CLAIMS, f"""select domain, claim_id as template, title, category, confidence, {joined('chemicals')} as chemicals,
      {joined('specimens')} as specimens, {joined('families')} as families from claims"""),
)
def hypothesis_templates(spark, sf):
    out = research.hypothesis_templates(corpus.resolved(spark, sf), REGISTRY)
    return out.select("domain", "template", "title", "category", "confidence", pipe("chemicals"), pipe("specimens"),
                      pipe("families"))


@query("template_titles", with_(*CLAIMS, "select domain, claim_id as template, title from titles"))
def template_titles(spark, sf):
    return research.template_titles(corpus.resolved(spark, sf), REGISTRY).select("domain", "template", "title")


@query(
    "corpus_selectors",
    with_(*CURATED, TEMPLATE, "select domain, tpl as template, grp as \"group\", n as papers from memn"),
)
def corpus_selectors(spark, sf):
    evidence = corpus.resolved(spark, sf)
    tests = F.array_compact(F.array(*[
        F.when((F.col("domain") == d.id) & match.in_group(g),
               F.struct(F.lit(i).alias("template"), F.lit(name).alias("group")))
        for d, i, t in _TEMPLATES for name, g in t.groups]))
    return evidence.select("domain", F.inline(tests)).groupBy("domain", "template", "group").agg(F.count("*").alias("papers"))


SUPPORT = f"""supp0 as (select r.*, c.claim_id, t.title is not null as exact,
    {_overlap('r.specimens', 'c.specimens')} and ({_overlap('r.chemicals', 'c.chemicals')} or list_contains(c.families, r.family)) as lap
  from res r join claims c on c.domain = r.domain
    left join (select distinct domain, claim_id, title from titles) t on t.domain = r.domain and t.claim_id = c.claim_id and t.title = r.title),
supp as materialized (select * from (select *, bool_or(exact) over (partition by domain, claim_id) as any_exact from supp0)
  where exact or (lap and not any_exact))"""
HYP_BASE = (*CLAIMS, SUPPORT)


@query("support_with_fallback", with_(*HYP_BASE, "select domain, claim_id, ord, exact from supp"))
def support_with_fallback(spark, sf):
    f = found(spark, sf)
    out = research.support_with_fallback(corpus.resolved(spark, sf), f.claims, f.titles)
    return out.select("domain", "claim_id", "ord", "exact")


@query(
    "any_exact_fallback",
    with_(*CURATED, """select domain, ord, source from (select r.domain, r.ord, r.source, l.doc_id is not null as labelled,
      bool_or(l.doc_id is not null and l.quality = 0) over (partition by domain, source) as any_bad,
      coalesce(l.quality = 0, false) as bad from rec r left join labels l on l.doc_id = r.ord) where bad or not any_bad"""),
)
def any_exact_fallback(spark, sf):
    labels = corpus.table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), (F.col("quality") == 0).alias("bad"))
    rows = corpus.records(spark, sf).select("domain", "ord", "source").join(labels, "ord", "left").fillna(False, ["bad"])
    return research.any_exact_fallback(rows, ["domain", "source"], "bad").drop("bad")


_STRONG = "len(list_filter(outcome_rules, lambda o: o.strength = 'strong')) > 0"
_SPARSE = "len(list_distinct(list_filter(phases, lambda p: p not in ('unknown', 'assessment', 'culture')))) <= 1"
_BOTH = sql.by_domain(lambda d: str(d.benchmark_needs_both_families).lower())
B = research.BLOCKERS
HYP = f"""hc as (select domain, claim_id, count(*) as papers, count(*) filter (where paper_type = 'experimental') as experimental,
    count(*) filter (where family = 'comparative') as comparative, count(*) filter (where {_STRONG}) as strong_outcome,
    count(*) filter (where list_contains(outcomes, 'transplantation')) as transplantation, count(*) filter (where {_SPARSE}) as sparse,
    count(*) filter (where family = 'unknown') as unknown, count(*) filter (where family = 'vitrification') as vit,
    count(*) filter (where family = 'slow-freezing') as slow, len(list_distinct(flatten(list(species)))) as distinct_species
  from supp group by all),
ht as (select domain, claim_id, count(distinct rank) as contradictions from (
    select c.domain, s.claim_id, c.rank from contra c join (select distinct domain, claim_id, title from supp) s
      on s.domain = c.domain and s.title in (c.title_a, c.title_b)) group by all),
h0 as (select c.*, coalesce(papers, 0) as papers, coalesce(experimental, 0) as experimental, coalesce(comparative, 0) as comparative,
    coalesce(strong_outcome, 0) as strong_outcome, coalesce(transplantation, 0) as transplantation, coalesce(sparse, 0) as sparse,
    coalesce(unknown, 0) as unknown, coalesce(vit, 0) as vit, coalesce(slow, 0) as slow, coalesce(distinct_species, 0) as distinct_species,
    coalesce(contradictions, 0) as contradictions,
    case category {' '.join(f"when {q(k)} then {v}e0" for k, v in research.ACTIONABILITY.items())} end as actionability_score
  from claims c left join hc using (domain, claim_id) left join ht using (domain, claim_id)),
h1 as (select *, {clamp('experimental / 6e0 * 0.4e0 + distinct_species / 3e0 * 0.2e0 + strong_outcome / 3e0 * 0.2e0 + least(comparative, 1) * 0.1e0 + transplantation / 2e0 * 0.1e0')} as e,
    {clamp("contradictions / 3e0 * 0.35e0 + case when papers = 0 then 0e0 else unknown / papers::DOUBLE end * 0.35e0 + case when papers = 0 then 0e0 else sparse / papers::DOUBLE end * 0.3e0")} as u from h0),
hyp as materialized (select *, row_number() over (partition by domain order by priority_score desc, claim_id) as rank from (
  select *, {fx('e', 3)} as evidence_score, {fx('u', 3)} as uncertainty_score,
    {fx(clamp('e * 0.35e0 + u * 0.25e0 + actionability_score * 0.4e0'), 3)} as priority_score,
    domain || ':' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as hypothesis_id,
    list_filter([case when unknown > 0 then unknown || {q(B['unknown'])} end, case when sparse > 0 then sparse || {q(B['sparse'])} end,
      case when contradictions > 0 then contradictions || {q(B['contradictions'])} end,
      case when category = 'endpoint-upgrade' and transplantation = 0 then {q(B['no_endpoint'])} end,
      case when category = 'scale-up' and strong_outcome = 0 then {q(B['light_scale'])} end,
      case when {_BOTH} and category = 'benchmark' and (vit = 0 or slow = 0) then {q(B['unbalanced'])} end], lambda x: x is not null) as blockers
  from h1))"""
HYPS = (*HYP_BASE, CONTRA, HYP)
_H = ("papers", "experimental", "comparative", "strong_outcome", "transplantation", "sparse", "unknown", "contradictions",
      "distinct_species", "evidence_score", "uncertainty_score", "actionability_score", "priority_score")


@query(
    "hypothesis_evidence",
    with_(*HYPS, f"select domain, claim_id, hypothesis_id, {', '.join(_H)}, {joined('blockers')} as blockers from hyp"),
)
def hypothesis_evidence(spark, sf):
    f = found(spark, sf)
    out = research.hypothesis_evidence(f.claims, f.support, f.contradictions, REGISTRY)
    return out.select("domain", "claim_id", "hypothesis_id", *_H, pipe("blockers"))


@per_session
def batch(spark, sf) -> plan.Batch:
    """The whole evidence batch, from papers to findings, gates included."""
    return plan.run_batch(
        corpus.records(spark, sf), corpus.enrichment(spark, sf), corpus.overrides(spark, sf),
        lambda extraction: corpus.gold_rows(spark, sf, extraction), REGISTRY)


@query(
    "evidence_batch",
    with_(*HYPS, f"select domain, claim_id, hypothesis_id, {', '.join(_H)}, {joined('blockers')} as blockers from hyp"),
)
def evidence_batch(spark, sf):
    return batch(spark, sf).findings.hypotheses.select("domain", "claim_id", "hypothesis_id", *_H, pipe("blockers"))


@query("evidence_batch_gates", with_(*METRICS, GATE_SUMMARY))
def evidence_batch_gates(spark, sf):
    """The batch held against the labels."""
    return batch(spark, sf).gates


@query("evidence_batch_metrics", with_(*METRICS, f"select domain, subset, {', '.join(SUBSET_METRICS)} from met"))
def evidence_batch_metrics(spark, sf):
    return batch(spark, sf).metrics.select("domain", "subset", *SUBSET_METRICS)


@query("top_hypotheses", with_(*HYPS, "select domain, hypothesis_id, priority_score from hyp order by priority_score desc, domain, claim_id"))
def top_hypotheses(spark, sf):
    """The agenda over all domains."""
    return found(spark, sf).hypotheses.orderBy(F.desc("priority_score"), "domain", "claim_id").select(
        "domain", "hypothesis_id", "priority_score")


@query("corpora_union", with_(*HYPS, "select domain, count(*) as hypotheses, max(priority_score) as best from hyp group by 1"))
def corpora_union(spark, sf):
    f = found(spark, sf).hypotheses
    parts = [f.where(F.col("domain") == d) for d in REGISTRY.ids()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("domain").agg(F.count("*").alias("hypotheses"), F.max("priority_score").alias("best"))


# -- wedge --------------------------------------------------------------------

_PREFERRED = sql.by_domain(lambda d: sql.rx("title", d.preferred_title) if d.preferred_title else "false")
WEDGE0 = f"""wedge0 as materialized (select * from hyp qualify row_number() over (partition by domain order by
    case when {_PREFERRED} then 0 when category = 'benchmark' then 1 when category <> 'workflow-gap' then 2 else 3 end, rank) = 1)"""


@query("select_wedge", with_(*HYPS, WEDGE0, "select domain, claim_id, title from wedge0"))
def select_wedge(spark, sf):
    return research.select_wedge(found(spark, sf).hypotheses, REGISTRY).select("domain", "claim_id", "title")


_BASE = in_list(BASE_CHEMICALS)
PROFILE = f"""prof as materialized (select r.*, e.title is not null as reviewed,
    case when e.title is null then 'abstract-only' when prim then 'primary-backed' when sec then 'secondary-backed'
      else 'manual-curation-backed' end as authority_profile,
    case when {_STRONG} and e.title is not null then 'strong'
      when len(list_filter(outcome_rules, lambda o: o.strength in ('strong', 'moderate'))) > 0 then 'moderate' else 'limited' end as evidence_strength,
    case when list_contains(species, 'human') then 'clinically adjacent'
      when list_contains(outcomes, 'transplantation') or {sql.rx('lower(r.title)', research.RELEVANT_TITLE)} then 'transplant relevant'
      when len(outcomes) > 0 then 'preclinical' else 'research only' end as translational_signal,
    list_concat(case when {sql.rx('r.title', research.INFERRED_ADJUNCT[1])} then ['p38 MAPK inhibitor'] else []::VARCHAR[] end,
      list_filter(chemicals, lambda c: c not in {_BASE})) as adjuncts,
    list_filter(chemicals, lambda c: c in {_BASE}) as base
  from res r left join (select distinct domain, title from enr where status = 'reviewed') e on e.domain = r.domain and e.title = r.title)"""


@per_session
def profiled(spark, sf):
    """Resolved papers with their authority profile, as a stored stage."""
    reviewed = corpus.enrichment(spark, sf).where("status = 'reviewed'").select("domain", "title")
    return cut(research.authority_profile(research.slim(corpus.resolved(spark, sf)), reviewed), "profiled")


@query(
    "authority_profile",
    with_(*CURATED, PROFILE, "select domain, ord, authority_profile, evidence_strength, translational_signal from prof"),
)
def authority_profile(spark, sf):
    return profiled(spark, sf).select("domain", "ord", "authority_profile", "evidence_strength", "translational_signal")


WSUPP = "wsupp as materialized (select p.*, s.claim_id, s.exact from supp s join wedge0 w using (domain, claim_id) join prof p on p.ord = s.ord)"


@per_session
def wedge_papers(spark, sf):
    f = found(spark, sf)
    chosen = f.wedges.select("domain", "claim_id")
    titles = f.titles.join(chosen, ["domain", "claim_id"])
    claims = f.claims.join(chosen, ["domain", "claim_id"])
    return cut(research.support_with_fallback(profiled(spark, sf), claims, titles), "wedge-papers")


ADJ = f"""adj as materialized (select domain, adjunct, sum(w) as score,
    row_number() over (partition by domain order by sum(w) desc, adjunct) as rank from (
    select domain, unnest(adjuncts) as adjunct, 1e0 + list_contains(species, 'human')::INT + prim::INT + ({_STRONG})::INT
      + case when list_contains(outcomes, 'function') then 0.5e0 else 0e0 end as w from wsupp)
  where adjunct not in ('Glycerol', 'Polyethylene Glycol') group by 1, 2)"""
WBASE = (*HYPS, WEDGE0, PROFILE, WSUPP)


@query("adjunct_scores", with_(*WBASE, ADJ, "select domain, adjunct, score, rank from adj"))
def adjunct_scores(spark, sf):
    return research.adjunct_scores(wedge_papers(spark, sf))


_SIGNAL = "case translational_signal " + " ".join(f"when {q(k)} then {v}" for k, v in research.SIGNAL_WEIGHT.items()) + " end"
R = research.READS
WEDGE = f"""wcount as (select domain, count(*) as support, count(*) filter (where authority_profile = 'primary-backed') as primary_backed,
    count(*) filter (where authority_profile = 'secondary-backed') as secondary_backed,
    count(*) filter (where authority_profile = 'abstract-only') as abstract_only,
    {fx(f'avg(cast({_SIGNAL} as decimal(9,4)))::DOUBLE', 3)} as translational_potential from wsupp group by 1),
wenr as (select e.domain, count(*) filter (where status in ('pending', 'in-progress')) as pending_enrichment,
    count(*) filter (where status = 'reviewed') as reviewed_enrichment
  from enr e join (select distinct t.domain, t.title from titles t join wedge0 using (domain, claim_id)) t using (domain, title) group by 1),
w0 as (select w.* exclude (rank), coalesce(c.support, 0) as support, coalesce(c.primary_backed, 0) as primary_backed,
    coalesce(c.secondary_backed, 0) as secondary_backed, coalesce(c.abstract_only, 0) as abstract_only,
    coalesce(c.translational_potential, 0e0) as translational_potential, coalesce(pending_enrichment, 0) as pending_enrichment,
    coalesce(reviewed_enrichment, 0) as reviewed_enrichment, coalesce(m.outcomes_coverage, 0e0) as outcome_coverage,
    coalesce(m.phases_coverage, 0e0) as phase_coverage
  from wedge0 w left join wcount c using (domain) left join wenr using (domain)
    left join met m on m.domain = w.domain and m.subset = 'reviewed'),
w1 as (select *, {fx(clamp('evidence_score * 0.65e0 + actionability_score * 0.35e0'), 3)} as scientific_relevance,
    {fx(clamp('actionability_score * 0.5e0 + translational_potential * 0.5e0'), 3)} as company_relevance,
    {fx(clamp('outcome_coverage * 0.25e0 + phase_coverage * 0.25e0 + (case when support = 0 then 0e0 else (primary_backed + secondary_backed * 0.7e0) / support end) * 0.25e0 + (1 - uncertainty_score) * 0.25e0'), 3)} as evidence_confidence,
    case when {sql.rx('title', research.ADDITIVE_TITLE)} then list_concat(['Dimethyl Sulfoxide'], coalesce((select list(adjunct order by rank) from adj a
      where a.domain = w0.domain and a.rank <= 5), []))[1:6] else chemicals[1:6] end as dominant_chemicals,
    blockers[1:5] as key_uncertainties from w0),
wedge as materialized (select *, case when {sql.rx('title', research.ADDITIVE_TITLE)} and evidence_confidence >= 0.75e0 then {q(R['additive'])}
    when evidence_confidence >= 0.78e0 and company_relevance >= 0.7e0 then {q(R['strong'])}
    when pending_enrichment > 0 then {q(R['pending'])} else {q(R['open'])} end as current_read from w1)"""
WALL = (*WBASE, pairs_sql("res"), metrics_sql(), ADJ, WEDGE)


@per_session
def wedges(spark, sf):
    from ..operators import quality

    f = found(spark, sf)
    coverage = quality.gate_summary(quality.subset_metrics(pairs(spark, sf))).select("domain", "outcome_coverage", "phase_coverage")
    titles = f.titles.join(f.wedges.select("domain", "claim_id"), ["domain", "claim_id"])
    papers = wedge_papers(spark, sf)
    return cut(research.wedge_scores(
        f.wedges, papers, coverage, titles, corpus.enrichment(spark, sf).select("domain", "title", "status"),
        research.adjunct_scores(papers)), "wedge")


_W = ("support", "primary_backed", "abstract_only", "pending_enrichment", "reviewed_enrichment", "translational_potential",
      "scientific_relevance", "company_relevance", "evidence_confidence", "outcome_coverage", "phase_coverage", "current_read")


@query(
    "wedge_scores",
    with_(*WALL, f"select domain, title, {', '.join(_W)}, {joined('dominant_chemicals')} as dominant_chemicals from wedge"),
)
def wedge_scores(spark, sf):
    return wedges(spark, sf).select("domain", "title", *_W, pipe("dominant_chemicals"))


def _weight(col: str, weights: dict[str, float]) -> str:
    return f"case {col} " + " ".join(f"when {q(k)} then {v}e0" for k, v in weights.items()) + " end"


MATRIX = f"""mx0 as (select s.*, w.category as w_cat, w.families as w_fam, w.dominant_chemicals as w_chem, w.specimens as w_spec,
    {sql.labels([('unknown-family', "s.family = 'unknown'"), ('sparse-protocol', _SPARSE.replace('phases', 's.phases')),
      ('unlabeled-endpoint', 'len(s.outcomes) = 0'),
      ('missing-transplant-endpoint', "w.category = 'endpoint-upgrade' and not list_contains(s.outcomes, 'transplantation')"),
      ('out-of-benchmark-family', "w.category = 'benchmark' and s.family <> 'comparative' and not list_contains(w.families, s.family)")])} as confounds,
    case when len(s.base) > 0 then array_to_string(s.base, ' + ') else 'unspecified' end as backbone
  from wsupp s join wedge w on w.domain = s.domain),
mx as materialized (select *, case when len(adjuncts) > 0 then adjuncts[1] when backbone = 'unspecified' then 'base protocol only'
      else 'base only (' || backbone || ')' end as signal,
    {fx(clamp(f'''case when exact then 0.28e0 else 0.12e0 end + case when list_contains(w_fam, family) then 0.2e0 else 0e0 end
      + case when {_overlap('chemicals', 'w_chem')} then 0.14e0 else 0e0 end + case when {_overlap('specimens', 'w_spec')} then 0.08e0 else 0e0 end
      + {_weight('authority_profile', research.AUTHORITY_WEIGHT)} * 0.16e0 + {_weight('translational_signal', research.SIGNAL_WEIGHT)} * 0.08e0
      + {_weight('evidence_strength', research.STRENGTH_WEIGHT)} * 0.08e0 - len(confounds) * 0.07e0'''), 3)} as relevance
  from mx0)"""
MALL = (*WALL, MATRIX)


@per_session
def matrix(spark, sf):
    return cut(research.matrix_rows(wedge_papers(spark, sf), wedges(spark, sf)), "matrix")


@query(
    "matrix_rows",
    with_(*MALL, f"""select domain, ord, backbone, {joined('adjuncts')} as adjuncts, authority_profile, {joined('confounds')} as confounds,
      signal, relevance from mx"""),
)
def matrix_rows(spark, sf):
    return matrix(spark, sf).select("domain", "ord", "backbone", pipe("adjuncts"), "authority_profile", pipe("confounds"),
                                    "signal", "relevance")


@query("confound_flags", with_(*MALL, "select domain, flag, count(*) as papers from (select domain, unnest(confounds) as flag from mx) group by all"))
def confound_flags(spark, sf):
    w = wedges(spark, sf).select("domain", "category", F.col("families").alias("wf"))
    rows = wedge_papers(spark, sf).join(w, "domain")
    flags = research.confound_flags(F.col("category"), F.col("wf"))
    return rows.select("domain", F.explode(flags).alias("flag")).groupBy("domain", "flag").agg(F.count("*").alias("papers"))


_PLACE = "(-relevance, title, paper_id)"


def _top5(cond: str) -> str:
    return f"""coalesce((select string_agg(x, '|' order by rk) from (select m.signal || ' via ' || m.title as x,
      row_number() over (order by -m.relevance, m.title, m.paper_id) as rk from mx m where m.domain = t.domain and {cond}) where rk <= 5), '')"""


@query(
    "matrix_summary",
    with_(*MALL, f"""select domain, count(*) as rows, count(*) filter (where translational_signal = 'clinically adjacent') as human_relevant,
      count(*) filter (where authority_profile = 'primary-backed') as primary_backed,
      count(*) filter (where authority_profile = 'abstract-only') as abstract_only,
      coalesce((select string_agg(b, '|' order by rk) from (select backbone as b, row_number() over (order by min({_PLACE})) as rk
        from mx m where m.domain = t.domain and backbone <> 'unspecified' group by 1) where rk <= 4), '') as backbones,
      coalesce((select string_agg(v, '|' order by rk) from (select v, row_number() over (order by min((-relevance, title, paper_id, i))) as rk
        from (select m.relevance, m.title, m.paper_id, unnest(adjuncts) as v, generate_subscripts(adjuncts, 1) as i from mx m where m.domain = t.domain)
        where v <> 'Polyethylene Glycol' group by 1) where rk <= 6), '') as adjuncts,
      {_top5("(evidence_strength = 'strong' or authority_profile = 'primary-backed')")} as strongest,
      {_top5("len(confounds) > 0")} as most_confounded
      from mx t group by domain"""),
)
def matrix_summary(spark, sf):
    out = research.matrix_summary(matrix(spark, sf))
    return out.select("domain", "rows", "human_relevant", "primary_backed", "abstract_only",
                      *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("backbones", "adjuncts", "strongest", "most_confounded")])


@query(
    "best_row_per_group",
    with_(*MALL, """select domain, signal, ord, relevance, row_number() over (partition by domain order by relevance desc, title, signal) as rank
      from (select * from mx qualify row_number() over (partition by domain, signal order by relevance desc, title, paper_id) = 1)
      qualify row_number() over (partition by domain order by relevance desc, title, signal) <= 8"""),
)
def best_row_per_group(spark, sf):
    return research.best_row_per_group(matrix(spark, sf)).select("domain", "signal", "ord", "relevance", "rank")


@query(
    "authority_breakdown",
    with_(*MALL, "select domain, " + ", ".join(
        f"count(*) filter (where authority_profile = {q(p)}) as \"{p}\"" for p in research.AUTHORITY_WEIGHT) + " from mx group by 1"),
)
def authority_breakdown(spark, sf):
    return research.authority_breakdown(matrix(spark, sf))


@query("endpoint_frequency", with_(*MALL, "select domain, endpoint, count(*) as rows from (select domain, unnest(outcomes) as endpoint from mx) group by all"))
def endpoint_frequency(spark, sf):
    return research.endpoint_frequency(matrix(spark, sf))


@query(
    "supporting_papers",
    with_(*MALL, """select domain, row_number() over (partition by domain order by relevance desc, a, title, paper_id) as rank, paper_id, title
      from (select *, case authority_profile when 'primary-backed' then 0 when 'manual-curation-backed' then 1 when 'secondary-backed' then 2 else 3 end as a from mx)
      qualify row_number() over (partition by domain order by relevance desc, a, title, paper_id) <= 3"""),
)
def supporting_papers(spark, sf):
    return decide.supporting_papers(matrix(spark, sf))


@query(
    "top_confident",
    with_(*CURATED, """select domain, ord, confidence, row_number() over (partition by domain order by confidence desc, ord) as rank
      from res qualify row_number() over (partition by domain order by confidence desc, ord) <= 10"""),
)
def top_confident(spark, sf):
    return research.top_per(corpus.resolved(spark, sf), ["domain"], 10, F.desc("confidence"), "ord").select(
        "domain", "ord", "confidence", "rank")
