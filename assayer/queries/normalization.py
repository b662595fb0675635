"""Measurement and workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config.defaults import BACKBONE_PHASES, CONDITION_PHASES, PHASE_RANK
from ..functions import measures
from ..operators import normalize, research
from . import corpus, sql
from .extraction import _CHEM
from .matching import pipe
from .registry import query
from .sql import EXTRACT, fx, in_list, q, rx, with_

# Units cycled over line numbers; the last of each list is not a known unit.
CONCENTRATION_RAW = ("mM", "M", "percent", "mol/L", "mg/mL", "%", "zz")
DURATION_RAW = ("min", "hours", "days", "weeks", "sec", "h", "zz")
TEMPERATURE_RAW = ("°C", "C", "K", "degrees C", "F", "° C", "zz")


def _pick(values) -> str:
    return f"[{', '.join(q(v) for v in values)}][l_linenumber]"


_RAW = f"""mention as (
  select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'concentration' when 'N' then 'temperature'
      else 'duration' end as kind,
    case l_returnflag when 'A' then cast(l_quantity as varchar) || ' ' || {_pick(CONCENTRATION_RAW)} || ' of ' || p_name
      when 'N' then '-' || cast(l_quantity as varchar) || {_pick(TEMPERATURE_RAW)}
      else cast(l_quantity as varchar) || ' ' || {_pick(DURATION_RAW)} end as raw
  from lineitem join part on p_partkey = l_partkey)"""


def _unit_case(raw: str, units: dict[str, str]) -> str:
    return f"case lower({raw}) " + " ".join(f"when {q(k)} then {q(v)}" for k, v in units.items()) + f" else {raw} end"


def _extract(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}), '')"


_TEMP_VALUE = " , ".join(_extract("raw", p, 1) for p in measures.TEMPERATURES)
_TEMP_UNIT = " , ".join(_extract("raw", p, 2) for p in measures.TEMPERATURES)
_PARSE = f"""parsed as (
  select *, case kind when 'concentration' then {_extract('raw', measures.CONCENTRATION, 1)}
      when 'temperature' then coalesce({_TEMP_VALUE}) else {_extract('raw', measures.DURATION, 1)} end as v,
    case kind when 'concentration' then {_unit_case(_extract('raw', measures.CONCENTRATION, 2), measures.CONCENTRATION_UNITS)}
      when 'temperature' then upper(coalesce({_TEMP_UNIT}))
      else {_unit_case(_extract('raw', measures.DURATION, 2), measures.DURATION_UNITS)} end as u
  from mention)"""


def mentions(spark, sf):
    lines = corpus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )
    parts = corpus.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    amount = F.col("l_quantity").cast("string")

    def unit(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("l_linenumber"))

    flag = F.col("l_returnflag")
    return lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "p_name", "p_brand", amount.alias("amount"), flag.alias("flag"),
        F.when(flag == "A", "concentration").when(flag == "N", "temperature").otherwise("duration").alias("kind"),
        F.when(flag == "A", F.concat(amount, F.lit(" "), unit(CONCENTRATION_RAW), F.lit(" of "), "p_name"))
        .when(flag == "N", F.concat(F.lit("-"), amount, unit(TEMPERATURE_RAW)))
        .otherwise(F.concat(amount, F.lit(" "), unit(DURATION_RAW))).alias("raw"),
    )


@query(
    "parse_measurements",
    with_(_RAW, _PARSE, f"""select l_orderkey, l_linenumber, kind, u as unit, cast(v as double) as value,
        {sql.number_text('cast(v as double)')} || ' ' || u as text from parsed"""),
)
def parse_measurements(spark, sf):
    out = normalize.parse_measurements(mentions(spark, sf))
    m = F.col("measurement")
    return out.select(
        "l_orderkey", "l_linenumber", "kind", m.unit.alias("unit"), m["value"].alias("value"), m.text.alias("text")
    )


_RATE_UNITS = ("min", "hour", "s", "sec", "h", "per min", "zz")


@query(
    "parse_rates",
    with_(f"""rate_raw as (select l_orderkey, l_linenumber, case l_linestatus when 'O' then 'warming' else 'cooling' end as phase,
        case l_returnflag when 'R' then '-' else '' end || cast(l_quantity as varchar) || ' C' ||
        case when l_linenumber = 6 then ' per min' else '/' || {_pick(_RATE_UNITS)} end as raw from lineitem)""",
          f"""rated as (select *, coalesce({', '.join(_extract('raw', p, 1) for p in measures.RATES)}) as v,
        coalesce({', '.join(_extract('raw', p, 3) for p in measures.RATES)}) as per from rate_raw)""",
          f"""select l_orderkey, l_linenumber, phase, case when phase = 'warming' or cast(v as double) > 0 then 'warming-rate' else 'cooling-rate' end
        as kind, 'C/' || {_unit_case('per', measures.DURATION_UNITS)} as unit, cast(v as double) as value from rated where v is not null"""),
)
def parse_rates(spark, sf):
    amount = F.col("l_quantity").cast("string")
    unit = F.element_at(F.array(*[F.lit(v) for v in _RATE_UNITS]), F.col("l_linenumber"))
    tail = F.when(F.col("l_linenumber") == 6, F.lit(" per min")).otherwise(F.concat(F.lit("/"), unit))
    lines = corpus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linestatus") == "O", "warming").otherwise("cooling").alias("phase"),
        F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), amount, F.lit(" C"), tail).alias("raw"),
    )
    out = normalize.parse_rates(lines, F.array("raw")).withColumn("m", F.explode("rates"))
    return out.select("l_orderkey", "l_linenumber", "phase", "m.kind", "m.unit", "m.value")


@query(
    "link_measurement_entity",
    with_("""linked as (select l_returnflag as flag, p_brand, p_name, cast(l_quantity as varchar) || ' mM' as raw,
        case l_returnflag when 'A' then cast(l_quantity as varchar) || ' mM, ' || p_name || ' with ' || p_brand
          when 'N' then p_brand || ' (' || cast(l_quantity as varchar) || ' mM) in ' || p_name
          else p_name || ' at ' || cast(l_quantity as varchar) || ' mm ' || p_brand end as text
        from lineitem join part on p_partkey = l_partkey)""",
          """tested as (select flag, entity, regexp_matches(text, '(?i)' || regexp_escape(raw) || '[\\s,()/%-]{0,18}' ||
          regexp_escape(entity) || '|' || regexp_escape(entity) || '[\\s,()/%-]{0,18}' || regexp_escape(raw)) as hit,
          kind from (select flag, raw, text, p_name as entity, 'name' as kind from linked
          union all select flag, raw, text, p_brand, 'brand' from linked))""",
          "select flag, kind, count(*) as n, count(*) filter (where hit) as linked from tested group by 1, 2"),
)
def link_measurement_entity(spark, sf):
    m = mentions(spark, sf)
    raw = F.concat("amount", F.lit(" mM"))
    text = (
        F.when(F.col("flag") == "A", F.concat(raw, F.lit(", "), "p_name", F.lit(" with "), "p_brand"))
        .when(F.col("flag") == "N", F.concat("p_brand", F.lit(" ("), raw, F.lit(") in "), "p_name"))
        .otherwise(F.concat("p_name", F.lit(" at "), "amount", F.lit(" mm "), "p_brand"))
    )
    kinds = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("p_name").alias("entity")),
        F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("entity")),
    )
    long = m.select("flag", raw.alias("raw"), text.alias("text"), F.inline(kinds))
    hit = normalize.linked(F.col("text"), F.col("raw"), F.col("entity"))
    return long.groupBy("flag", "kind").agg(F.count("*").alias("n"), F.count_if(hit).alias("linked"))


_DETAIL = ("(len(chemicals) > 0 or len(concentrations) > 0 or len(temperatures) > 0 or len(rates) > 0 "
           "or len(durations) > 0)")
_RANK = "case phase " + " ".join(f"when {q(p)} then {r}" for p, r in PHASE_RANK.items()) + " else 99 end"
STRUCT = f"""structural as materialized (
  select *, phase in {in_list(BACKBONE_PHASES)} and ({_DETAIL} or {rx('sentence', normalize.PROCEDURAL)}) as structural,
    {_RANK} as rk from step)"""


@query(
    "mark_structural_steps",
    with_(*EXTRACT, STRUCT, "select domain, ord, step_no, phase, structural from structural"),
)
def mark_structural_steps(spark, sf):
    out = corpus.normalized(spark, sf).select("domain", "ord", F.inline("normalized_steps"))
    return out.select("domain", "ord", F.col("order").alias("step_no"), "phase", "structural")


NEXT = f"""nextp as materialized (
  select a.ord, a.step_no, arg_min(b.phase, b.step_no) as next_phase from structural a join structural b
    on a.ord = b.ord and b.step_no > a.step_no and a.structural and b.structural and a.phase <> b.phase
    and b.rk < 99 and a.rk < 99 and b.rk >= a.rk group by 1, 2)"""


@query(
    "paper_transitions",
    with_(*EXTRACT, STRUCT, NEXT, "select domain, ord, step_no, phase, next_phase from structural left join nextp using (ord, step_no)"),
)
def paper_transitions(spark, sf):
    out = corpus.normalized(spark, sf).select("domain", "ord", F.inline("normalized_steps"))
    return out.select("domain", "ord", F.col("order").alias("step_no"), "phase", "next_phase")


_CONC_VALUE = _extract("raw", measures.CONCENTRATION, 1)
_CONC_TEXT = (f"{sql.number_text(f'cast({_CONC_VALUE} as double)')} || ' ' || "
              + _unit_case(_extract("raw", measures.CONCENTRATION, 2), measures.CONCENTRATION_UNITS))
_LINK = ("regexp_matches(sentence || ' ' || sentence, '(?i)' || regexp_escape(trim(raw)) || '[\\s,()/%-]{0,18}' || "
         "regexp_escape(al) || '|' || regexp_escape(al) || '[\\s,()/%-]{0,18}' || regexp_escape(trim(raw)))")
CONDITION = f"""cond_step as (
  select domain, ord, step_no, phase, sentence, chemicals, unnest(concentrations) as raw,
    generate_subscripts(concentrations, 1) as m_pos from structural
  where structural and phase in {in_list(CONDITION_PHASES)} and len(chemicals) > 0),
cond_parsed as (select *, {_CONC_TEXT} as text from cond_step where {_CONC_VALUE} is not null),
cond_named as (select *, unnest(chemicals) as name, generate_subscripts(chemicals, 1) as c_pos from cond_parsed),
cond_alias as (select domain, ord, name, list_concat([name], string_split(aliases, '|')) as als from chem_alias),
cond_stated as (
  select domain, ord, phase, name, name || ' ' || text as label, 'step' as source,
    case when len(chemicals) = 1 then 90 else 82 end as conf, step_no * 100000 + m_pos * 1000 + c_pos as place
  from cond_named left join cond_alias using (domain, ord, name)
  where len(chemicals) = 1 or len(list_filter(coalesce(als, [name]), lambda al: {_LINK})) > 0),
cond_mention as (
  select domain, ord, 'unknown' as phase, name, name || ' ' || text as label, 'chemical-mention' as source, 60 as conf,
    list_position({sql._CHEM_ORDER}, name) * 100000 + c_pos as place
  from (select domain, ord, name, unnest(string_split(concentrations, '|')) as raw,
      generate_subscripts(string_split(concentrations, '|'), 1) as c_pos from chem_conc) z,
    lateral (select {_CONC_VALUE} as v, {_CONC_TEXT} as text) where v is not null),
cond as materialized (
  select domain, ord, phase, name, label, source, conf from (
    select * from cond_stated
    union all select * from cond_mention where ord not in (select ord from cond_stated))
  qualify row_number() over (partition by ord, phase, label, source order by place) = 1)"""


@query(
    "representative_conditions",
    with_(*EXTRACT, STRUCT, _CHEM, CONDITION, "select domain, ord, phase, name as chemical, label, source, conf / 100e0 as confidence from cond"),
)
def representative_conditions(spark, sf):
    out = corpus.normalized(spark, sf).select("domain", "ord", F.inline("conditions"))
    return out.select("domain", "ord", "phase", "chemical", "label", "source", "confidence")


_STEP_TEXTS = "list_distinct(list_filter(list_transform(list_concat(temperatures, rates), lambda x: trim(x)), lambda x: x <> ''))"


def _matched(col: str, pattern: str) -> str:
    return f"len(list_filter({col}, lambda x: {rx('x', pattern)}))"


_TEMP_ANY = "(" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in measures.TEMPERATURES) + ")"
_RATE_ANY = "(" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in measures.RATES) + ")"
QUALITY = f"""tried as (
  select ord, sum(tried) as tried, sum(parsed) as parsed from (
    select ord, len(c) as tried, {_matched('c', measures.CONCENTRATION)} as parsed
      from (select ord, string_split(concentrations, '|') as c from chem_conc)
    union all
    select ord, len(concentrations) + len({_STEP_TEXTS}) + len(durations) + {_matched(f"list_concat([sentence], {_STEP_TEXTS})", '(?i)' + _RATE_ANY)},
      {_matched('concentrations', measures.CONCENTRATION)} + {_matched(_STEP_TEXTS, '(?i)' + _TEMP_ANY)}
      + {_matched('durations', measures.DURATION)} + {_matched(f"list_concat([sentence], {_STEP_TEXTS})", '(?i)' + _RATE_ANY)}
    from step) group by ord),
quality as materialized (
  select x.domain, x.ord, x.family, coalesce(t.tried, 0) as tried, coalesce(t.parsed, 0) as parsed,
    case when coalesce(t.tried, 0) = 0 then 0.7e0 else {fx('t.parsed / t.tried::DOUBLE', 3)} end as confidence,
    coalesce(t.tried - t.parsed, 0) + (x.n_steps > 0 and not coalesce(s.any_structural, false))::INT as warnings,
    x.n_steps, len(x.chemicals) as n_chemicals
  from ex x left join tried t using (ord)
    left join (select ord, bool_or(structural) as any_structural from structural group by ord) s using (ord))"""
NORM = (*EXTRACT, STRUCT, _CHEM, CONDITION, QUALITY)


@query(
    "normalization_quality",
    with_(*NORM, "select domain, ord, tried, parsed, confidence, warnings from quality"),
)
def normalization_quality(spark, sf):
    return corpus.normalized(spark, sf).select(
        "domain", "ord", F.col("measurements_tried").alias("tried"), F.col("measurements_parsed").alias("parsed"),
        F.col("normalization_confidence").alias("confidence"), F.size("warnings").alias("warnings"),
    )


@query(
    "assemble_normalized",
    with_(*NORM, """select q.domain, q.ord, q.family, q.n_chemicals as chemicals, q.n_steps as steps,
      coalesce(c.n, 0) as conditions, q.parsed as measurements, q.confidence
      from quality q left join (select ord, count(*) as n from cond group by ord) c using (ord)"""),
)
def assemble_normalized(spark, sf):
    """Normalise the stored extraction in one projection."""
    out = normalize.normalize_extraction(corpus.evidence(spark, sf))
    return out.select(
        "domain", "ord", "family", F.size("normalized_chemicals").alias("chemicals"),
        F.size("normalized_steps").alias("steps"), F.size("conditions").alias("conditions"),
        F.col("measurements_parsed").alias("measurements"), F.col("normalization_confidence").alias("confidence"),
    )


@query(
    "normalization_totals",
    with_(*NORM, """select domain, count(*) as protocols, sum(n_chemicals) as chemicals, sum(n_steps) as steps,
      sum(coalesce(c.n, 0)) as conditions, sum(parsed) as measurements, count(*) filter (where warnings > 0) as warned
      from quality q left join (select ord, count(*) as n from cond group by ord) c using (ord) group by domain"""),
)
def normalization_totals(spark, sf):
    return normalize.normalization_totals(corpus.normalized(spark, sf))


TOP3 = "qualify row_number() over (partition by domain, family order by {o}) <= 3"
TRANSITION = """tl as (select distinct x.domain, x.family, s.ord, s.phase || ' -> ' || n.next_phase as label
  from structural s join nextp n using (ord, step_no) join ex x using (ord))"""


@query(
    "transition_frequency",
    with_(*EXTRACT, STRUCT, NEXT, TRANSITION, f"""select *, row_number() over (partition by domain, family
      order by papers desc, label) as rank from (select domain, family, label, count(*) as papers from tl group by all
      having count(*) >= 2) {TOP3.format(o='papers desc, label')}"""),
)
def transition_frequency(spark, sf):
    labels = normalize.transition_labels(corpus.normalized(spark, sf))
    return research.transition_frequency(labels).select("domain", "family", "label", "papers", "rank")


_PHASE_WEIGHT = """case when phase in ('equilibration', 'loading', 'perfusion') then 3
  when phase in ('cooling', 'warming', 'unloading') then 2 else 1 end"""


@query(
    "condition_frequency",
    with_(*EXTRACT, STRUCT, _CHEM, CONDITION, f"""select *, row_number() over (partition by domain, family
      order by papers desc, stated desc, phase_weight desc, label) as rank from (
        select c.domain, x.family, label, count(*) as papers, count(*) filter (where c.source = 'step') as stated,
          max(w) as phase_weight from (
            select domain, ord, label, source, first_w as w from (
              select domain, ord, label, source, {_PHASE_WEIGHT} as first_w, row_number() over (
                partition by ord, label order by rn) as k from (select *, row_number() over () as rn from cond_ordered))
            where k = 1) c join ex x using (ord) group by all having count(*) >= 2)
      {TOP3.format(o='papers desc, stated desc, phase_weight desc, label')}""").replace(
        CONDITION, CONDITION.replace("cond as materialized (\n  select domain, ord, phase, name, label, source, conf from (",
                                     "cond_ordered as materialized (\n  select domain, ord, phase, name, label, source, conf, place from (")
        .replace("qualify row_number() over (partition by ord, phase, label, source order by place) = 1)",
                 "qualify row_number() over (partition by ord, phase, label, source order by place) = 1 order by ord, place)")),
)
def condition_frequency(spark, sf):
    out = research.condition_frequency(corpus.normalized(spark, sf))
    return out.select("domain", "family", "label", "papers", "stated", "phase_weight", "rank")


@query(
    "family_profile",
    with_(*EXTRACT, """fp_chem as (select domain, family, label, count(*) as n from (
        select domain, family, unnest(chemicals) as label from ex) group by all),
      fp_out as (select domain, family, label, count(*) as n from (
        select domain, family, unnest(outcomes) as label from ex) group by all)""",
          f"""select p.domain, p.family, p.papers, coalesce(c.l, '') as chemicals, coalesce(o.l, '') as outcomes
      from (select domain, family, count(*) as papers from ex group by all) p
      left join (select domain, family, string_agg(label, '|' order by n desc, label) as l from (
        select * from fp_chem {TOP3.format(o='n desc, label')}) group by all) c using (domain, family)
      left join (select domain, family, string_agg(label, '|' order by n desc, label) as l from (
        select * from fp_out {TOP3.format(o='n desc, label')}) group by all) o using (domain, family)"""),
)
def family_profile(spark, sf):
    out = research.family_profile(corpus.normalized(spark, sf), corpus.evidence(spark, sf))
    return out.select("domain", "family", "papers", pipe("chemicals"), pipe("outcomes"))
