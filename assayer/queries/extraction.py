"""Text-to-facts queries over every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from . import corpus, sql
from .corpus import REGISTRY
from .matching import pipe
from .registry import query
from .sql import AGG, ENRICH, EXTRACT, FACT, KIND, REC, SENT, SPEC, SRC, joined, with_

_UP_TO_FACT = (REC, ENRICH, SRC, SENT, FACT)


def _key(*cols):
    return ["domain", "ord", *cols]


@query(
    "attach_reviewed_enrichment",
    with_(REC, ENRICH, "select r.domain, r.ord, e.status as status, e.reviewer_notes as notes, e.ex_label as label "
          "from rec r left join enr e on e.ord = r.ord and e.status = 'reviewed'"),
)
def attach_reviewed_enrichment(spark, sf):
    return corpus.papers(spark, sf).select(
        "domain", "ord", F.col("enrichment_status").alias("status"), F.col("reviewer_notes").alias("notes"),
        F.get("excerpts", 0).label.alias("label"),
    )


@query("augment_source_text", with_(REC, ENRICH, SRC, "select domain, ord, md5(source_text) as text_md5 from src"))
def augment_source_text(spark, sf):
    out = extract.augment_source_text(corpus.papers(spark, sf), REGISTRY)
    return out.select("domain", "ord", F.md5(F.col("source_text").cast("binary")).alias("text_md5"))


@query("explode_sentences", with_(REC, ENRICH, SRC, SENT, "select domain, ord, pos, md5(sentence) as sentence_md5 from sent"))
def explode_sentences(spark, sf):
    texts = extract.augment_source_text(corpus.papers(spark, sf), REGISTRY).select("domain", "ord", "source_text")
    out = extract.explode_sentences(texts, "source_text")
    return out.select("domain", "ord", "pos", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


_FAMILY_EVIDENCE = f"""fam_sent as (
  select ord, unnest(s) as sentence, generate_subscripts(s, 1) as pos from (
    select ord, {sql.split_sentences("title || '. ' || coalesce(abstract, '')")} as s from rec)),
fam_ev as (select ord, arg_min(md5(sentence), pos) filter (where {sql.rx('sentence', sql.SHARED.vitrification)}) as v,
  arg_min(md5(sentence), pos) filter (where {sql.rx('sentence', sql.SHARED.slow_freezing)}) as s
  from fam_sent group by ord)"""


@query(
    "classify_family",
    with_(REC, KIND, _FAMILY_EVIDENCE, "select domain, ord, family, concat_ws('|', v, s) as evidence "
          "from rec join kind using (ord) left join fam_ev using (ord)"),
)
def classify_family(spark, sf):
    found = extract.protocol_family(F.col("title"), F.col("abstract"), REGISTRY)
    out = corpus.records(spark, sf).withColumn("f", found)
    hashed = F.transform("f.evidence", lambda s: F.md5(s.cast("binary")))
    return out.select("domain", "ord", F.col("f.family").alias("family"), F.array_join(hashed, "|").alias("evidence"))


@query("classify_paper_type", with_(REC, KIND, "select domain, ord, paper_type from rec join kind using (ord)"))
def classify_paper_type(spark, sf):
    kind = extract.paper_type(F.col("title"), F.col("abstract"), REGISTRY, F.col("domain"))
    return corpus.records(spark, sf).select("domain", "ord", kind.alias("paper_type"))


@query(
    "rank_specimens",
    with_(*_UP_TO_FACT, SPEC, f"select domain, ord, coalesce({joined('specimens')}, '') as specimens "
          "from rec left join spec using (ord)"),
)
def rank_specimens(spark, sf):
    return corpus.extraction(spark, sf).select(*_key(), pipe("specimens"))


@query("detect_species", with_(*EXTRACT, f"select domain, ord, {joined('species')} as species from ex"))
def detect_species(spark, sf):
    return corpus.extraction(spark, sf).select(*_key(), pipe("species"))


_CHEM = f"""chem_hit as (
  select ord, domain, pos, split_part(a, '#', 1) as name, split_part(a, '#', 2) as alias, a_pos, concentrations
  from (select *, unnest(aliases) as a, generate_subscripts(aliases, 1) as a_pos from fact)),
chem_alias as (select domain, ord, name, string_agg(alias, '|' order by first) as aliases from (
  select domain, ord, name, alias, min(pos * 1000 + a_pos) as first from chem_hit group by all) group by all),
chem_conc as (select domain, ord, name, string_agg(c, '|' order by first) as concentrations from (
  select domain, ord, name, trim(c) as c, min(pos * 1000 + c_pos) as first from (
    select domain, ord, name, pos, unnest(concentrations) as c, generate_subscripts(concentrations, 1) as c_pos
    from (select distinct domain, ord, name, pos, concentrations from chem_hit)) where trim(c) <> '' group by all)
  group by all),
chem_n as (select domain, ord, name, count(distinct pos) as sentences from chem_hit group by all)"""


@query(
    "extract_chemicals",
    with_(*_UP_TO_FACT, _CHEM, """select domain, ord, name, aliases, coalesce(concentrations, '') as concentrations,
      sentences from chem_n join chem_alias using (domain, ord, name) left join chem_conc using (domain, ord, name)"""),
)
def extract_chemicals(spark, sf):
    out = corpus.extraction(spark, sf).select(*_key(), F.inline("chemical_mentions"))
    return out.select(
        *_key("name"), pipe("aliases"), pipe("concentrations"), F.size("sentences").alias("sentences")
    )


_DISTINCT_MENTIONS = """(select string_agg(v, '|' order by i) from (
  select trim(u.v) as v, min(u.i) as i from (select unnest({c}) as v, generate_subscripts({c}, 1) as i) u
  where trim(u.v) <> '' group by 1))"""


@query(
    "extract_mentions",
    with_(*_UP_TO_FACT, AGG, f"""select domain, ord, coalesce({_DISTINCT_MENTIONS.replace('{c}', 'temps_all')}, '') as temperatures,
      coalesce({_DISTINCT_MENTIONS.replace('{c}', 'durs_all')}, '') as durations
      from rec join agg using (ord)"""),
)
def extract_mentions(spark, sf):
    return corpus.extraction(spark, sf).select(*_key(), pipe("temperatures"), pipe("durations"))


_RULE_ROWS = " union all ".join(
    f"select {sql.q(d.id)} as domain, {sql.q(str(i))} as rule, {sql.q(o.outcome_class)} as outcome_class, "
    f"{sql.q(o.strength)} as strength"
    for d in REGISTRY.domains for i, o in enumerate(d.outcomes)
)
OUTCOME = f"""outcome_rule as ({_RULE_ROWS}),
outcome as (select h.domain, h.ord, r.outcome_class, r.strength, cast(h.rule as integer) as rule_pos,
  arg_min(sentence, pos) as summary, count(distinct sentence) as sentences
  from (select domain, ord, pos, sentence, unnest(outcomes) as rule from fact) h
  join outcome_rule r on r.domain = h.domain and r.rule = h.rule group by all)"""


@query(
    "extract_outcomes",
    with_(*_UP_TO_FACT, OUTCOME, "select domain, ord, outcome_class, strength, md5(summary) as summary_md5, sentences from outcome"),
)
def extract_outcomes(spark, sf):
    out = corpus.extraction(spark, sf).select(*_key(), F.inline("outcome_mentions"))
    return out.select(
        *_key("outcome_class", "strength"), F.md5(F.col("summary").cast("binary")).alias("summary_md5"),
        F.size("sentences").alias("sentences"),
    )


_STEP_TEMPS = _DISTINCT_MENTIONS.replace("{c}", "list_concat(temperatures, rates)")


@query(
    "extract_steps",
    with_(*_UP_TO_FACT, sql.STEP, f"""select domain, ord, step_no, phase, md5(sentence) as summary_md5,
      {joined('chemicals')} as chemicals, {joined('concentrations')} as concentrations,
      coalesce({_STEP_TEMPS}, '') as temperatures, {joined('durations')} as durations, conf100 / 100e0 as confidence
      from step"""),
)
def extract_steps(spark, sf):
    out = corpus.extraction(spark, sf).select("domain", "ord", F.inline("steps"))
    return out.select(
        "domain", "ord", F.col("order").alias("step_no"), "phase",
        F.md5(F.col("summary").cast("binary")).alias("summary_md5"), pipe("chemicals"), pipe("concentrations"),
        pipe("temperatures"), pipe("durations"), "confidence",
    )


def _title_hits(items, text: str) -> str:
    return sql.labels((label, sql.rx(text, pattern)) for label, pattern in items)


_LOW_TITLE = sql.by_domain(lambda d: _title_hits([(s.label, s.pattern) for s in d.specimens], "lower(title)"))
_SPECIES_TITLE = _title_hits(sql.SHARED.species, "title")
#: Distinct evidence snippets per paper, as (kind, text, confidence, tier, explicitness, reviewed).
EVIDENCE = f"""ev as materialized (
  select distinct ord, kind, text, conf, tier, explicit, reviewed from (
    select ord, 'protocol-family' as kind, sentence as text, 90 as conf, 'primary-indirect' as tier,
      'direct' as explicit, false as reviewed from fam_sent2
    union all select ord, 'specimen', trim(title), 90, 'primary-indirect', 'direct', false
      from rec where len({_LOW_TITLE}) > 0 or len({_SPECIES_TITLE}) > 0
    union all select ord, 'specimen', sentence, 80, 'primary-indirect', 'direct', false
      from fact where len(specimens) > 0
    union all select ord, 'specimen', arg_min(sentence, pos), 80, 'primary-indirect', 'direct', false
      from (select f.ord, f.pos, f.sentence, unnest(list_filter(f.species, lambda s: not list_contains({_SPECIES_TITLE}, s)))
        as label from fact f join rec using (ord)) group by ord, label
    union all select ord, 'chemical', sentence, 85, 'primary-indirect', 'direct', false from fact where len(aliases) > 0
    union all select ord, 'temperature', sentence, 70, 'primary-indirect', 'direct', false
      from fact where len(temperatures) > 0
    union all select ord, 'duration', sentence, 70, 'primary-indirect', 'direct', false from fact where len(durations) > 0
    union all select ord, 'outcome', sentence, 80, 'primary-indirect', 'direct', false from fact where len(outcomes) > 0
    union all select ord, 'source-enrichment', trim(ex_label || ': ' || ex_text), 92,
      case ex_source when 'results' then 'primary-direct' when 'discussion' then 'primary-indirect'
        else case when e_notes is not null then 'secondary' else 'manual-curation' end end,
      case when {sql.rx('ex_label', extract.DIRECT_LABELS)} then 'direct' else 'indirect' end, true
      from src where e_status = 'reviewed' and trim(ex_text) <> ''))"""
FAM = f"""fam_s as (
  select ord, unnest(s) as sentence, generate_subscripts(s, 1) as pos from (
    select ord, {sql.split_sentences("title || '. ' || coalesce(abstract, '')")} as s from rec)),
fam_sent2 as (
  select ord, arg_min(sentence, pos) as sentence from fam_s where {sql.rx('sentence', sql.SHARED.vitrification)} group by ord
  union all
  select ord, arg_min(sentence, pos) from fam_s where {sql.rx('sentence', sql.SHARED.slow_freezing)} group by ord)"""


@query(
    "collect_evidence",
    with_(*_UP_TO_FACT, FAM, EVIDENCE, "select domain, ord, kind, count(*) as snippets, count(distinct text) as texts, "
          "sum(conf) as confidence_sum from ev join rec using (ord) group by all"),
)
def collect_evidence(spark, sf):
    out = corpus.extraction(spark, sf).select("domain", "ord", F.inline("evidence"))
    return out.groupBy("domain", "ord", "kind").agg(
        F.count("*").alias("snippets"), F.count_distinct("text").alias("texts"),
        F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("confidence_sum"),
    )


@query(
    "enrichment_evidence",
    with_(*_UP_TO_FACT, FAM, EVIDENCE, "select domain, ord, md5(text) as text_md5, conf / 100e0 as confidence, tier, "
          "explicit as explicitness from ev join rec using (ord) where kind = 'source-enrichment'"),
)
def enrichment_evidence(spark, sf):
    papers = extract.augment_source_text(corpus.papers(spark, sf), REGISTRY)
    snippets = extract.enrichment_evidence(F.col("_excerpts"), F.col("reviewer_notes"))
    return papers.select("domain", "ord", F.inline(snippets)).select(
        "domain", "ord", F.md5(F.col("text").cast("binary")).alias("text_md5"), "confidence", "tier", "explicitness"
    )


_TIERS = " ".join(f"when {i} then {sql.q(t)}" for i, t in enumerate(extract.AUTHORITY_TIERS))


@query(
    "authority_summary",
    with_(*_UP_TO_FACT, FAM, EVIDENCE, f"""select r.domain, r.ord,
      case coalesce(min(list_position({sql.strings(extract.AUTHORITY_TIERS)}, tier) - 1), 4) {_TIERS} end as strongest,
      count(*) filter (where tier = 'primary-direct') as primary_direct,
      count(*) filter (where tier = 'primary-indirect') as primary_indirect,
      count(*) filter (where tier = 'secondary') as secondary,
      count(*) filter (where tier = 'manual-curation') as manual_curation,
      count(*) filter (where reviewed) as reviewed, count(*) filter (where explicit = 'direct') as direct,
      count(*) filter (where explicit = 'indirect') as indirect
      from rec r left join ev using (ord) group by 1, 2"""),
)
def authority_summary(spark, sf):
    return corpus.extraction(spark, sf).select(
        "domain", "ord", *[F.col(f"authority.{c}").alias(c) for c in (
            "strongest", "primary_direct", "primary_indirect", "secondary", "manual_curation", "reviewed", "direct",
            "indirect")],
    )


@query("extraction_confidence", with_(*EXTRACT, "select domain, ord, confidence from ex"))
def extraction_confidence(spark, sf):
    return corpus.extraction(spark, sf).select("domain", "ord", "confidence")


@query(
    "assemble_extraction",
    with_(*EXTRACT, f"""select domain, ord, paper_type, family, {joined('species')} as species,
      {joined('specimens')} as specimens, {joined('chemicals')} as chemicals, {joined('outcomes')} as outcomes,
      {joined('phases')} as phases, n_steps, confidence from ex"""),
)
def assemble_extraction(spark, sf):
    return corpus.extraction(spark, sf).select(
        "domain", "ord", "paper_type", "family", pipe("species"), pipe("specimens"), pipe("chemicals"),
        pipe("outcomes"), pipe("phases"), F.size("steps").alias("n_steps"), "confidence",
    )
