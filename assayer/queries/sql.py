"""Building blocks of the reference SQL (DuckDB dialect).

Written independently of the column builders: only dictionaries and patterns are
shared. Blocks are CTE texts, chained by ``with_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..config import Concept, DomainProfile
from ..config.defaults import default_registry
from ..functions.text import alias_pattern, any_of, phrase_pattern
from .vocabulary import DOI_SOURCES, DOMAIN_OF_LANG, LINK_SOURCES, OPEN_SOURCES, PMCID_SOURCES, PMID_SOURCES, TERMS

REGISTRY = default_registry()
SHARED = REGISTRY.shared


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values: Iterable[str]) -> str:
    items = ", ".join(q(v) for v in values)
    return f"[{items}]::VARCHAR[]"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def fx(expr: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5e0) / {scale})"


def ratio(a: str, b: str, digits: int = 3) -> str:
    return f"(case when ({b}) = 0 then 0e0 else {fx(f'({a})::DOUBLE / ({b})::DOUBLE', digits)} end)"


def clamp(expr: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"least({high}, greatest({low}, {expr}))"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def rx_any(text: str, patterns: Iterable[str]) -> str:
    patterns = list(patterns)
    return rx(text, any_of(patterns)) if patterns else "false"


def labels(pairs: Iterable[tuple[str, str]]) -> str:
    items = ", ".join(f"case when {cond} then {q(label)} end" for label, cond in pairs)
    return f"list_filter([{items}]::VARCHAR[], lambda x: x is not null)"


def concepts(text: str, values: Iterable[Concept]) -> str:
    return labels((c.label, rx_any(text, [phrase_pattern(p) for p in c.phrases])) for c in values)


def by_domain(build, domain: str = "domain") -> str:
    cases = " ".join(f"when {q(d.id)} then {build(d)}" for d in REGISTRY.domains)
    return f"(case {domain} {cases} end)"


def with_(*parts: str) -> str:
    *ctes, body = parts
    return "with " + ",\n".join(ctes) + "\n" + body


def renamed(text: str, suffix: object) -> str:
    """The candidate tables of ``text`` under names of their own, for a second set beside the first."""
    return re.sub(r"\b(keyed|firsts|merged|scored_cand|cand|feat|judged)\b", rf"\g<1>{suffix}", text)


def joined(col: str) -> str:
    return f"array_to_string({col}, '|')"


def number_text(v: str) -> str:
    return f"regexp_replace(cast({v} as varchar), '\\.0$', '')"


def _terms(lang: str) -> str:
    pairs = ", ".join(f"{q(k)}: {q(v)}" for k, v in TERMS[lang].items())
    return f"MAP {{{pairs}}}"


def _subject() -> str:
    cases = " ".join(
        f"when {q(lang)} then list_transform(string_split(text, ' '), lambda w: coalesce({_terms(lang)}[lower(w)], w))"
        for lang in TERMS
    )
    return f"array_to_string(case lang {cases} end, ' ')"


_DOMAIN = "case lang " + " ".join(f"when {q(k)} then {q(v)}" for k, v in DOMAIN_OF_LANG.items()) + " end"

#: Provider records, as ``corpus.records``.
REC = f"""rec as materialized (
  select domain, ord, cast(ord as varchar) as paper_id, source, source || ':' || ord as source_id,
    split_part(t, chr(10), 1) as title,
    nullif(case when instr(t, chr(10)) > 0 then substring(t, instr(t, chr(10)) + 1) else '' end, '') as abstract,
    case when source in {in_list(DOI_SOURCES)} then '10.5/' || digest end as doi,
    case when source in {in_list(PMID_SOURCES)} then left(digest, 10) end as pmid,
    case when source in {in_list(PMCID_SOURCES)} then 'PMC' || substring(digest, 11, 8) end as pmcid,
    'Journal of ' || lang as journal, cast(1990 + n_chars % 40 as integer) as published_year,
    n_chars as citation_count,
    case when source in {in_list(OPEN_SOURCES)} then 'open-access-full-text'
         when source in {in_list(LINK_SOURCES)} then 'full-text-link' else 'abstract-only' end
      as full_text_availability,
    lang, n_chars
  from (select *, {_DOMAIN} as domain, doc_id as ord, md5(text) as digest, {_subject()} as t from documents))"""

_HAY = "lower(title || ' ' || coalesce(abstract, ''))"


def _found(d: DomainProfile) -> str:
    required = REGISTRY.required(d)
    parts = {
        "title_anchors": concepts("tl", d.anchors),
        "title_required": concepts("tl", required),
        "title_context": concepts("tl", d.context),
        "title_methods": concepts("tl", d.title_methods),
        "blocked": concepts("tl", d.blocked),
        "anchors": concepts("hay", d.anchors),
        "required": concepts("hay", required),
        "context": concepts("hay", d.context),
    }
    return "{" + ", ".join(f"{q(k)}: {v}" for k, v in parts.items()) + "}"


def _relevance(d: DomainProfile) -> str:
    parts = [("7e0", "anchors", len(d.anchors)), ("5e0", "required", len(REGISTRY.required(d))),
             ("2e0", "context", len(d.context))]
    return fx(" + ".join(f"len(m.{c})::DOUBLE / {n}e0 * {w}" for w, c, n in parts if n), 3)


def _keep(d: DomainProfile) -> str:
    return (
        f"len(m.blocked) = 0 and len(m.title_anchors) >= 1 and len(m.title_required) >= {d.min_title_required} "
        f"and len(m.title_methods) >= {d.min_title_methods} and len(m.anchors) >= 1 and len(m.required) >= 1"
    )


#: Gate scores per record; ``gated`` keeps the records that pass.
GATE = f"""scored as materialized (
  select *, {by_domain(_relevance)} as relevance_score, {by_domain(_keep)} as keep,
    list_concat(list_concat(m.anchors, list_filter(m.required, lambda x: not list_contains(m.anchors, x))),
      list_filter(m.context, lambda x: not list_contains(m.anchors, x) and not list_contains(m.required, x)))
      as matched_keywords
  from (select *, {by_domain(_found)} as m
        from (select *, lower(title) as tl, {_HAY} as hay from rec))),
gated as materialized (select * from scored where keep)"""


def first_text(col: str) -> str:
    """Longest trimmed value, earliest record among equals."""
    v = f"nullif(trim({col}), '')"
    return f"arg_min({v}, (-length({v}), ord)) filter (where {v} is not null) as {col}"


def candidates_sql(source: str, baseline: Iterable[str]) -> str:
    """Merged candidates from gated records of ``source``."""
    n = len(list(baseline))
    return f"""keyed as (
  select *, coalesce('doi:' || lower(nullif(doi, '')), 'pmid:' || nullif(pmid, ''), 'pmcid:' || nullif(pmcid, ''),
    'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) as dedupe_key from {source}),
firsts as (select * from keyed
  qualify row_number() over (partition by domain, dedupe_key, source order by ord) = 1),
merged as (
  select domain, dedupe_key, {first_text('title')}, {first_text('abstract')}, {first_text('doi')},
    {first_text('pmid')}, {first_text('pmcid')}, {first_text('journal')},
    max(published_year) as published_year, count(*) as record_count, min(ord) as ord,
    list_sort(list_distinct(list(source))) as source_types,
    list_sort(list_distinct(flatten(list(matched_keywords)))) as matched_keywords,
    max(relevance_score) as rel, max(citation_count) as cites,
    bool_or(full_text_availability = 'open-access-full-text') as o,
    bool_or(full_text_availability = 'full-text-link') as l,
    bool_or(full_text_availability = 'abstract-only') as a
  from firsts group by 1, 2),
scored_cand as (
  select *, len(source_types) as source_count,
    case when o then 'open-access-full-text' when l then 'full-text-link' when a then 'abstract-only'
         else 'unknown' end as full_text_availability,
    {fx("rel + len(matched_keywords) * 0.1e0", 3)} as relevance_score,
    {fx("least(1e0, coalesce(cites, 0) / 100e0) + case when o then 0.3e0 when l then 0.15e0 else 0e0 end", 3)}
      as authority_score,
    {fx(f"len(list_filter(source_types, lambda s: s in {in_list(baseline)})) / {n}e0", 3)} as source_diversity_score
  from merged),
cand as materialized (select *, {fx("relevance_score + authority_score + source_diversity_score", 3)} as ranking_score
  from scored_cand)"""


#: Evidence of a candidate ``c`` and of an earlier row ``p`` is the same.
SAME = " and ".join(
    [f"{fx('c.' + s, 3)} = {fx('p.' + s, 3)}" for s in ("ranking_score", "relevance_score", "authority_score", "source_diversity_score")]
    + ["c.recommendation = p.recommendation", "list_sort(c.source_types) = list_sort(p.source_types)",
       "c.record_count = p.record_count", "c.source_count = p.source_count",
       "c.full_text_availability = p.full_text_availability"])


# -- extraction ---------------------------------------------------------------

SENT_SPLIT = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '[\\s ]+', ' ', 'g'), "
    "'([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
)


def split_sentences(text: str) -> str:
    return SENT_SPLIT.replace("{t}", text)


#: Curated records per labelled document, as ``corpus.enrichment``.
ENRICH = """enr as materialized (
  select r.domain, r.paper_id, r.ord, r.title, r.doi, r.full_text_availability as access, r.published_year,
    case when quality = 1 and toxic = 0 then 'reviewed' when quality = 1 then 'in-progress'
         when toxic = 0 then 'pending' else 'rejected' end as status,
    case r.full_text_availability when 'open-access-full-text' then 'extractor-gap'
         when 'full-text-link' then 'ambiguous-evidence'
         else case when r.pmid is not null then 'evidence-thin' else 'step-phase-manual' end end as priority,
    case when r.full_text_availability = 'abstract-only' then 'taken from a secondary review' end as reviewer_notes,
    case r.full_text_availability when 'open-access-full-text' then 'results'
         when 'full-text-link' then 'discussion' else 'manual-note' end as ex_source,
    case r.full_text_availability when 'open-access-full-text' then 'Results section'
         when 'full-text-link' then 'Discussion note' else 'Curator note' end as ex_label,
    r.title as ex_text, quality, toxic
  from labels l join rec r on r.ord = l.doc_id)"""

_PREFIX = by_domain(lambda d: q(d.text_prefix))
SRC = f"""src as materialized (
  select r.*, {_PREFIX.replace('case domain', 'case r.domain')} || '. ' || array_to_string(list_filter([r.title, coalesce(r.abstract, ''),
      case when e.status = 'reviewed' and trim(e.ex_text) <> '' then e.ex_label || ': ' || e.ex_text else '' end],
      lambda p: trim(p) <> ''), ' ') as source_text,
    e.status as e_status, e.ex_label, e.ex_text, e.ex_source, e.reviewer_notes as e_notes
  from rec r left join enr e on e.ord = r.ord and e.status = 'reviewed')"""
SENT = f"""sent as materialized (
  select ord, domain, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as pos
  from (select ord, domain, {split_sentences('source_text')} as s from src))"""


def _aliases(d: DomainProfile) -> str:
    return labels(
        (f"{c.name}#{a}", rx("sentence", alias_pattern(a))) for c in REGISTRY.chemicals(d) for a in c.aliases
    )


def _outcomes(d: DomainProfile) -> str:
    study = [p for p in (SHARED.study_terms, d.outcome_terms, SHARED.preserving_terms) if p]
    found = labels((str(i), rx_any("sentence", o.patterns)) for i, o in enumerate(d.outcomes))
    return f"case when {rx_any('sentence', study)} then {found} else []::VARCHAR[] end"


def find_all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, 0)"


FACT = f"""fact as materialized (
  select *, {rx('sentence', SHARED.process_context)} as process, {rx('sentence', SHARED.stepwise)} as stepwise,
    {by_domain(lambda d: labels((s.label, rx('sentence', s.pattern)) for s in d.specimens))} as specimens,
    {labels((k, rx('sentence', p)) for k, p in SHARED.species)} as species,
    {by_domain(_aliases)} as aliases,
    {by_domain(_outcomes)} as outcomes,
    {by_domain(lambda d: labels((r.phase, rx_any('sentence', r.patterns)) for r in REGISTRY.phases(d)))} as phases,
    {find_all('sentence', SHARED.concentration)} as concentrations,
    {find_all('sentence', SHARED.temperature)} as temperatures,
    {find_all('sentence', SHARED.duration)} as durations,
    {find_all('sentence', SHARED.rate)} as rates
  from sent)"""


def _paper_type(d: DomainProfile) -> str:
    rules = " or ".join("(" + " and ".join(rx("low", p) for p in rule) + ")" for rule in d.experimental_rules)
    return (
        f"case when {rx_any('low', (*SHARED.review_patterns, *d.extra_review))} then 'review' "
        f"when {rx_any('low', (*SHARED.methods_patterns, *d.extra_methods))} then 'methods' "
        f"when {rx_any('low', SHARED.commentary_patterns)} then 'commentary' "
        f"when {rx_any('abstr', (*SHARED.experimental_patterns, *d.extra_experimental))} then 'experimental' "
        f"when {rules or 'false'} then 'experimental' else 'unknown' end"
    )


KIND = f"""kind as materialized (
  select ord, {by_domain(_paper_type)} as paper_type,
    case when v and s then 'comparative' when v then 'vitrification' when s then 'slow-freezing' else 'unknown' end
      as family
  from (select ord, domain, lower(title) || ' ' || lower(coalesce(abstract, '')) as low, coalesce(abstract, '') as abstr,
    {rx("title || '. ' || coalesce(abstract, '')", SHARED.vitrification)} as v,
    {rx("title || '. ' || coalesce(abstract, '')", SHARED.slow_freezing)} as s from rec))"""


def _weights(d: DomainProfile) -> str:
    return "case label " + " ".join(f"when {q(s.label)} then {s.weight}e0" for s in d.specimens) + " end"


def _title_specimens(d: DomainProfile) -> str:
    return labels((s.label, rx("lower(title)", s.pattern)) for s in d.specimens)


SPEC = f"""spec_hits as (
  select ord, label, sum(w) as score from (
    select ord, label, {by_domain(_weights)} + case when process then 1e0 else 0e0 end as w
    from (select ord, domain, process, unnest(specimens) as label from fact)
    union all
    select ord, label, {by_domain(_weights)} + 2e0 from (
      select ord, domain, unnest({by_domain(_title_specimens)}) as label from rec))
  group by 1, 2),
spec as materialized (
  select ord, list(label order by rk) as specimens from (
    select *, row_number() over (partition by ord order by score desc, label) as rk,
      bool_or(score >= 2.5e0) over (partition by ord) as strong from spec_hits)
  where case when strong then score >= 2.5e0 else rk <= 2 end group by ord)"""

_SPECIES_ORDER = strings(k for k, _ in SHARED.species)
_CHEM_ORDER = by_domain(lambda d: strings(c.name for c in REGISTRY.chemicals(d)))
_RULES = by_domain(lambda d: "[" + ", ".join(
    f"{{'rule': {q(str(i))}, 'outcome_class': {q(o.outcome_class)}, 'strength': {q(o.strength)}}}"
    for i, o in enumerate(d.outcomes)) + "]")

AGG = f"""agg as materialized (
  select ord, flatten(list(species order by pos)) as species_all, flatten(list(aliases order by pos)) as aliases_all,
    flatten(list(outcomes order by pos)) as outcomes_all,
    flatten(list(temperatures order by pos)) as temps_all, flatten(list(durations order by pos)) as durs_all
  from fact group by ord)"""
_MEASURED = "(len(concentrations) > 0 or len(temperatures) > 0 or len(rates) > 0)"
STEP = f"""step_raw as (
  select ord, domain, pos, sentence, phase, rule_pos, concentrations, durations, aliases, temperatures, rates,
    case when phase = 'assessment' then 72 when len(phases) >= 2 and {_MEASURED} then 90 else 82 end as conf100
  from (select *, unnest(phases) as phase, generate_subscripts(phases, 1) as rule_pos from fact
        where process and len(phases) > 0 and ({_MEASURED} or len(durations) > 0 or stepwise))),
step as materialized (
  select *, row_number() over (partition by ord order by pos, rule_pos) - 1 as step_no,
    list_distinct_ordered as chemicals
  from (select *, list_filter({_CHEM_ORDER}, lambda n: list_contains(list_transform(aliases,
      lambda a: split_part(a, '#', 1)), n)) as list_distinct_ordered
    from step_raw qualify row_number() over (partition by ord, phase, sentence order by pos, rule_pos) = 1)),
steps as materialized (
  select ord, list(phase order by step_no) as phases, count(*) as n_steps, sum(conf100) as conf_sum,
    count(*) filter (where phase <> 'unknown' and
      (len(chemicals) > 0 or len(concentrations) > 0 or len(temperatures) > 0 or len(rates) > 0)) as explicit_steps
  from step group by ord)"""
_TITLE_SPECIES = labels((k, rx("title", p)) for k, p in SHARED.species)
EX = f"""ex0 as materialized (
  select r.*, k.paper_type, k.family, coalesce(spec.specimens, []) as specimens,
    list_filter({_SPECIES_ORDER}, lambda s: list_contains({_TITLE_SPECIES}, s) or list_contains(a.species_all, s))
      as species,
    list_filter({_CHEM_ORDER.replace('case domain', 'case r.domain')}, lambda n: list_contains(list_transform(a.aliases_all,
      lambda x: split_part(x, '#', 1)), n)) as chemicals,
    list_filter({_RULES.replace('case domain', 'case r.domain')}, lambda o: list_contains(a.outcomes_all, o.rule)) as outcome_rules,
    coalesce(s.phases, []) as phases, coalesce(s.n_steps, 0) as n_steps, coalesce(s.explicit_steps, 0) as explicit_steps,
    coalesce(s.conf_sum, 0) as conf_sum, a.temps_all, a.durs_all,
    (select e.ex_source from enr e where e.ord = r.ord and e.status = 'reviewed' and trim(e.ex_text) <> '') as curated
  from rec r join kind k using (ord) join agg a using (ord) left join spec using (ord) left join steps s using (ord)),
ex as materialized (
  select * exclude (outcome_rules), outcome_rules,
    (family <> 'unknown' or len(specimens) > 0 or len(species) > 0 or len(chemicals) > 0 or len(outcome_rules) > 0
      or len(temps_all) > 0 or len(durs_all) > 0 or coalesce(curated in ('results', 'discussion'), false)) as prim,
    coalesce(curated = 'manual-note', false) as sec,
    list_transform(outcome_rules, lambda o: o.outcome_class) as outcomes,
    least(95, 42 + 7 * ((family <> 'unknown')::INT + (len(specimens) > 0)::INT + (len(species) > 0)::INT
      + (len(chemicals) > 0)::INT + (len(outcome_rules) > 0)::INT + (n_steps > 0)::INT)
      + 8 * (paper_type = 'experimental')::INT + 7 * (named >= 2)::INT + 4 * (named >= 3)::INT
      + 5 * (explicit_steps >= 2)::INT) / 100e0 as confidence
  from (select *, len(list_distinct(list_filter(phases, lambda p: p not in ('unknown', 'assessment', 'culture'))))
      as named from ex0))"""

EXTRACT = (REC, ENRICH, SRC, SENT, FACT, KIND, SPEC, AGG, STEP, EX)

_OPENED, _LINKED = "full_text_availability = 'open-access-full-text'", "full_text_availability = 'full-text-link'"
GOLD = f"""gold as materialized (
  select x.domain, x.paper_id, x.ord, x.title, case when toxic = 0 then 'reviewed' else 'seeded' end as review_status,
    quality = 1 as expected_in, case when {_OPENED} then paper_type when {_LINKED} then 'experimental' end
      as expected_paper_type,
    case when published_year >= 2010 then family when published_year >= 2000 then 'vitrification' end as expected_family,
    case when {_OPENED} then species when {_LINKED} then species[1:1] end as expected_species,
    case when {_OPENED} or {_LINKED} then specimens else specimens[1:1] end as expected_specimens,
    case when {_OPENED} then outcomes when {_LINKED} then null else outcomes[1:1] end as expected_outcomes,
    case when {_OPENED} then list_sort(list_distinct(phases)) when {_LINKED} then []::VARCHAR[] end as expected_phases,
    case when {_LINKED} then 'second-hand label' end as notes
  from ex x join labels l on l.doc_id = x.ord)"""
OVR = f"""ovr as materialized (
  select x.domain, x.paper_id, x.ord, case when quality = 0 and toxic = 1 then true end as excluded,
    case when {_LINKED} then 'experimental' end as paper_type, case when published_year >= 2010 then 'slow-freezing' end
      as family,
    case when published_year < 2000 then []::VARCHAR[] end as species, null::VARCHAR[] as specimens,
    case when {_OPENED} then ['viability'] end as outcomes, null::VARCHAR[] as phases,
    case when full_text_availability = 'abstract-only' then 0.9e0 end as confidence
  from ex x join labels l on l.doc_id = x.ord where quality = 0 or toxic = 1)"""
RES = """res as materialized (
  select x.* replace (coalesce(o.paper_type, x.paper_type) as paper_type, coalesce(o.family, x.family) as family,
    coalesce(o.species, x.species) as species, coalesce(o.outcomes, x.outcomes) as outcomes,
    coalesce(o.confidence, x.confidence) as confidence)
  from ex x left join ovr o on o.ord = x.ord where not coalesce(o.excluded, false))"""
EXACT_FIELDS = ("paper_type", "family")
SET_FIELDS = ("species", "specimens", "outcomes", "phases")


def norm_set(col: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({col}, lambda v: trim(v)), lambda v: v <> '')))"


def pairs_sql(corpus: str, name: str = "pairs", gold: str = "gold", keys: tuple[str, ...] = ("domain",)) -> str:
    on = " and ".join(f"a.{k} = g.{k}" for k in (*keys, "paper_id"))
    actual = ", ".join(f"a.{f} as actual_{f}" for f in (*EXACT_FIELDS, *SET_FIELDS))
    scored = []
    for f in SET_FIELDS:
        w, h = norm_set(f"expected_{f}"), norm_set(f"coalesce(actual_{f}, []::VARCHAR[])")
        scored.append(f"""case when expected_in and expected_{f} is not null then {{'w': {w}, 'h': {h}}} end as s_{f}""")
    ratios, finals = [], []
    for f in SET_FIELDS:
        hit = f"len(list_filter(s_{f}.h, lambda v: list_contains(s_{f}.w, v)))::DOUBLE"
        ratios.append(f"case when len(s_{f}.h) = 0 then 0e0 else {hit} / len(s_{f}.h) end as p_{f}")
        ratios.append(f"case when len(s_{f}.w) = 0 then 1e0 else {hit} / len(s_{f}.w) end as r_{f}")
        finals.append(f"case when p_{f} + r_{f} = 0 then 0e0 else 2 * p_{f} * r_{f} / (p_{f} + r_{f}) end as f_{f}")
    return f"""{name} as materialized (
  select *, {', '.join(finals)} from (select *, {', '.join(ratios)} from (select *, {', '.join(scored)} from (
    select g.*, a.paper_id is not null as present, {actual}, a.confidence as actual_confidence
    from {gold} g left join {corpus} a on {on}))))"""


def metrics_sql(pairs: str = "pairs", name: str = "met", keys: tuple[str, ...] = ("domain",)) -> str:
    k = ", ".join(keys)
    cols = [
        "count(*) as entries", "count(*) filter (where expected_in and present) as tp",
        "count(*) filter (where not expected_in and not present) as tn",
        "count(*) filter (where not expected_in and present) as fp",
        "count(*) filter (where expected_in and not present) as fn", "count(*) filter (where expected_in) as in_scope",
        "avg(cast(actual_confidence as decimal(12,6))) filter (where expected_in and present) as c1",
        "avg(cast(actual_confidence as decimal(12,6))) filter (where not expected_in and present) as c0",
    ]
    outer = [
        f"{fx('c1::DOUBLE', 3)} as confidence_expected", f"{fx('c1::DOUBLE', 3)} as confidence_correct",
        f"{fx('c0::DOUBLE', 3)} as confidence_incorrect",
        f"{ratio('tp + tn', 'tp + tn + fp + fn')} as inclusion_accuracy",
    ]
    p, r = "(case when tp + fp = 0 then 0e0 else tp / (tp + fp)::DOUBLE end)", "(case when tp + fn = 0 then 0e0 else tp / (tp + fn)::DOUBLE end)"
    outer += [f"{fx(p, 3)} as inclusion_precision", f"{fx(r, 3)} as inclusion_recall",
              f"{fx(f'case when {p} + {r} = 0 then 0e0 else 2 * {p} * {r} / ({p} + {r}) end', 3)} as inclusion_f1"]
    for f in EXACT_FIELDS:
        cols += [f"count(*) filter (where expected_in and expected_{f} is not null) as {f}_labeled",
                 f"count(*) filter (where expected_in and expected_{f} = actual_{f}) as {f}_matched"]
        outer += [f"{ratio(f'{f}_matched', f'{f}_labeled')} as {f}_accuracy",
                  f"{ratio(f'{f}_labeled', 'in_scope')} as {f}_coverage"]
    for f in SET_FIELDS:
        cols += [f"count(s_{f}) as {f}_labeled", f"count(*) filter (where s_{f}.w = s_{f}.h) as {f}_exact",
                 *[f"coalesce(sum(floor({m}_{f} * 1000 + 0.5e0)), 0) as {f}_{m}s" for m in "prf"],
                 f"count(*) filter (where expected_in and len(coalesce(expected_{f}, []::VARCHAR[])) > 0) as {f}_covered"]
        outer += [f"{ratio(f'{f}_{m}s', f'{f}_labeled * 1000')} as {f}_{n}" for m, n in
                  (("p", "precision"), ("r", "recall"), ("f", "f1"))]
        outer += [f"{ratio(f'{f}_covered', 'in_scope')} as {f}_coverage"]
    return f"""{name} as materialized (select *, {', '.join(outer)} from (
  select {k}, coalesce(review_status, 'all') as subset, {', '.join(cols)} from {pairs}
  group by grouping sets (({k}), ({k}, review_status))))"""


def unpivot(name: str, fields: Iterable[str], parts: dict[str, str], extra: str = "domain, subset") -> str:
    return " union all ".join(
        f"select {extra}, {q(f)} as field, " + ", ".join(f"{f}_{src} as {out}" for out, src in parts.items()) + f" from {name}"
        for f in fields
    )


GATES_SQL = (("reviewed inclusion F1", "inclusion_f1", "0.9e0"), ("reviewed inclusion precision", "inclusion_precision", "0.9e0"),
             ("reviewed protocol family accuracy", "family_accuracy", "0.85e0"),
             ("reviewed paper type accuracy", "paper_type_accuracy", "0.85e0"),
             ("reviewed specimen macro F1", "specimens_f1", "0.75e0"), ("reviewed species macro F1", "species_f1", "0.75e0"))
PASSED = " + ".join(f"({m} >= {t})::INT" for _, m, t in GATES_SQL)
CURATED = (*EXTRACT, GOLD, OVR, RES)
