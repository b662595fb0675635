"""Override, gold and proposal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config.defaults import ENRICHMENT_PRIORITIES, ENRICHMENT_STATUSES, ENRICHMENT_STATUS_RANK
from ..operators import match, research, review
from . import corpus, sql
from .corpus import REGISTRY
from .matching import pipe
from .registry import query
from .sql import CURATED, fx, joined, pairs_sql, q, with_

FIELDS = ("paper_type", "family", "species", "specimens", "outcomes", "phases")


@query(
    "apply_overrides",
    with_(*CURATED, f"""select domain, paper_id, paper_type, family, {joined('species')} as species,
      {joined('outcomes')} as outcomes, {joined('phases')} as phases, confidence from res"""),
)
def apply_overrides(spark, sf):
    out = review.apply_overrides(corpus.evidence(spark, sf), corpus.overrides(spark, sf))
    return out.select(
        "domain", "paper_id", "paper_type", "family", pipe("species"), pipe("outcomes"), pipe("phases"), "confidence"
    )


_INCOMING = """incoming as (select domain, paper_id, ord, case when review_status = 'seeded' then true end as excluded,
  expected_paper_type as paper_type, case when expected_in then expected_family end as family,
  expected_species as species, expected_specimens as specimens, expected_outcomes as outcomes,
  expected_phases as phases, null::DOUBLE as confidence from gold)"""


@query(
    "merge_overrides",
    with_(*CURATED, _INCOMING, f"""select coalesce(i.domain, o.domain) as domain, coalesce(i.paper_id, o.paper_id) as paper_id,
      coalesce(i.excluded, o.excluded) as excluded, coalesce(i.paper_type, o.paper_type) as paper_type,
      coalesce(i.family, o.family) as family, {joined('coalesce(i.species, o.species)')} as species,
      {joined('coalesce(i.outcomes, o.outcomes)')} as outcomes, o.confidence as confidence
      from incoming i full join ovr o on o.domain = i.domain and o.paper_id = i.paper_id"""),
)
def merge_overrides(spark, sf):
    g = corpus.gold(spark, sf)
    incoming = g.select(
        "domain", "paper_id", "ord", F.when(F.col("review_status") == "seeded", True).alias("excluded"),
        F.col("expected_paper_type").alias("paper_type"),
        F.when(F.col("expected_in"), F.col("expected_family")).alias("family"),
        *[F.col(f"expected_{f}").alias(f) for f in FIELDS[2:]], F.lit(None).cast("double").alias("confidence"),
    )
    out = review.merge_overrides(corpus.overrides(spark, sf).drop("ord"), incoming)
    return out.select("domain", "paper_id", "excluded", "paper_type", "family", pipe("species"), pipe("outcomes"), "confidence")


@query(
    "seed_gold",
    with_(*CURATED, f"""select x.domain, x.paper_id, case when o.ord is not null then 'reviewed' else 'seeded' end as review_status,
      not coalesce(o.excluded, false) as expected_in,
      case when o.ord is null then x.family when not coalesce(o.excluded, false) then o.family end as expected_family,
      {joined(f"case when o.ord is null then {sql.norm_set('x.outcomes')} when not coalesce(o.excluded, false) then {sql.norm_set('o.outcomes')} end")}
        as expected_outcomes,
      {joined(f"case when o.ord is null then {sql.norm_set('x.phases')} end")} as expected_phases
      from ex x left join ovr o on o.ord = x.ord"""),
)
def seed_gold(spark, sf):
    out = review.seed_gold(corpus.evidence(spark, sf), corpus.overrides(spark, sf))
    return out.select(
        "domain", "paper_id", "review_status", "expected_in", "expected_family", pipe("expected_outcomes"),
        pipe("expected_phases"),
    )


_REASONS = sql.labels([
    ("unknown-protocol-family", "family = 'unknown'"), ("unknown-paper-type", "paper_type = 'unknown'"),
    ("low-confidence", "confidence < 0.7e0"),
    ("experimental-unknown-family", "paper_type = 'experimental' and family = 'unknown'")])
REASONS = f"reasoned as (select * from (select *, {_REASONS} as reasons from res) where len(reasons) > 0)"


@query("resolution_reasons", with_(*CURATED, REASONS, f"select domain, paper_id, {joined('reasons')} as reasons from reasoned"))
def resolution_reasons(spark, sf):
    return match.resolution_reasons(corpus.resolved(spark, sf)).select("domain", "paper_id", pipe("reasons"))


def _bonus(d) -> str:
    return " + ".join([f"case when list_contains(specimens, {q(s)}) then {b}e0 else 0e0 end" for s, b in d.resolution_bonus] or ["0e0"])


_POINTS = " + ".join(
    f"case when list_contains(reasons, '{r}') then {p}e0 else 0e0 end"
    for r, p in (("experimental-unknown-family", 6), ("unknown-protocol-family", 4), ("unknown-paper-type", 2), ("low-confidence", 2))
)
PRIORITY = f"""prio as (select *, {fx(f"{_POINTS} + {sql.by_domain(_bonus)} + case when len(chemicals) > 0 then 1e0 else 0e0 end + floor((1 - confidence) * 10 + 0.5e0) / 10e0", 1)}
  as priority_score, case when family = 'unknown' then 'resolve-family' when paper_type = 'unknown' then 'classify-paper-type'
  else 'review-low-confidence' end as suggested_action from reasoned)"""


@query("resolution_priority", with_(*CURATED, REASONS, PRIORITY, "select domain, paper_id, priority_score, suggested_action from prio"))
def resolution_priority(spark, sf):
    out = match.resolution_priority(match.resolution_reasons(corpus.resolved(spark, sf)), REGISTRY)
    return out.select("domain", "paper_id", "priority_score", "suggested_action")


@query(
    "resolution_order",
    with_(*CURATED, REASONS, PRIORITY, """select domain, paper_id, row_number() over (partition by domain
      order by priority_score desc, confidence, title, paper_id) as rank from prio
      qualify row_number() over (partition by domain order by priority_score desc, confidence, title, paper_id) <= 25"""),
)
def resolution_order(spark, sf):
    out = match.resolution_priority(match.resolution_reasons(corpus.resolved(spark, sf)), REGISTRY)
    top = research.top_per(out, ["domain"], 25, F.desc("priority_score"), "confidence", "title", "paper_id")
    return top.select("domain", "paper_id", "rank")


MISSING = f"""missing as materialized (
  select domain, paper_id, title, doi, no_outcomes, no_phases, case when no_outcomes then s[1] end as evidence_status,
    case when no_outcomes then s[2] end as evidence_reason from (
    select g.domain, g.paper_id, g.title, r.doi, len(coalesce(expected_outcomes, []::VARCHAR[])) = 0 as no_outcomes,
      len(coalesce(expected_phases, []::VARCHAR[])) = 0 as no_phases,
      case when r.paper_id is null then ['evidence-thin', 'no-extraction']
        when len(r.outcomes) > 0 then ['extractor-gap', 'outcome-extracted-but-unlabeled']
        when {sql.rx_any("r.title || '. ' || coalesce(r.abstract, '')", match.EXPLICIT_OUTCOME_PATTERNS)}
          then ['extractor-gap', 'explicit-outcome-language']
        when {sql.rx_any("r.title || '. ' || coalesce(r.abstract, '')", match.AMBIGUOUS_RESULT_PATTERNS)}
          then ['ambiguous-evidence', 'result-hinted']
        else ['evidence-thin', 'procedural-text'] end as s
    from gold g left join res r on r.domain = g.domain and r.paper_id = g.paper_id
    where review_status = 'reviewed' and expected_in) where no_outcomes or no_phases)"""


def missing(spark, sf):
    return review.missing_depth(corpus.gold(spark, sf), corpus.resolved(spark, sf))


@query(
    "missing_depth_join",
    with_(*CURATED, MISSING, "select domain, paper_id, doi, no_outcomes, no_phases, evidence_status from missing"),
)
def missing_depth_join(spark, sf):
    return missing(spark, sf).select("domain", "paper_id", "doi", "no_outcomes", "no_phases", "evidence_status")


@query("classify_missing_evidence", with_(*CURATED, MISSING, """select domain, evidence_status as status,
  evidence_reason as reason, count(*) as n from missing where no_outcomes group by all"""))
def classify_missing_evidence(spark, sf):
    out = missing(spark, sf).where("no_outcomes")
    return out.groupBy("domain", F.col("evidence_status").alias("status"), F.col("evidence_reason").alias("reason")).agg(
        F.count("*").alias("n"))


@query(
    "missing_audit",
    with_(*CURATED, MISSING, """select domain, count(*) filter (where no_outcomes) as missing_outcomes,
      count(*) filter (where no_phases) as missing_phases,
      count(*) filter (where evidence_status = 'extractor-gap') as extractor_gap,
      count(*) filter (where evidence_status = 'ambiguous-evidence') as ambiguous_evidence,
      count(*) filter (where evidence_status = 'evidence-thin') as evidence_thin from missing group by domain"""),
)
def missing_audit(spark, sf):
    return review.missing_audit(missing(spark, sf))


QUEUE = """queue as materialized (
  select coalesce(m.domain, e.domain) as domain, coalesce(m.paper_id, e.paper_id) as paper_id,
    case when e.status in ('reviewed', 'rejected') then e.title else coalesce(m.title, e.title) end as title,
    case when e.status in ('reviewed', 'rejected') then e.priority
      when m.no_outcomes then coalesce(m.evidence_status, 'evidence-thin')
      when m.no_phases and (e.ord is null or e.priority = 'step-phase-manual') then 'step-phase-manual' end as priority,
    coalesce(e.status, 'pending') as status, e.reviewer_notes
  from missing m full join enr e on e.domain = m.domain and e.paper_id = m.paper_id),
enq as materialized (select * from queue where priority is not null)"""


def enrichment_queue(spark, sf):
    return review.enrichment_queue_merge(missing(spark, sf), corpus.enrichment(spark, sf))


@query(
    "enrichment_queue_merge",
    with_(*CURATED, MISSING, QUEUE, "select domain, paper_id, title, priority, status, reviewer_notes from enq"),
)
def enrichment_queue_merge(spark, sf):
    return enrichment_queue(spark, sf).select("domain", "paper_id", "title", "priority", "status", "reviewer_notes")


_PRIO_RANK = f"list_position({sql.strings(ENRICHMENT_PRIORITIES)}, priority)"
_STATUS_RANK = f"list_position({sql.strings(ENRICHMENT_STATUS_RANK)}, status)"


@query(
    "enrichment_order",
    with_(*CURATED, MISSING, QUEUE, f"select domain, paper_id, priority, status, title from enq order by {_PRIO_RANK}, {_STATUS_RANK}, title, paper_id"),
)
def enrichment_order(spark, sf):
    return review.enrichment_order(enrichment_queue(spark, sf)).select("domain", "paper_id", "priority", "status", "title")


@query(
    "status_counts",
    with_(sql.REC, sql.ENRICH, f"""select d.domain, d.state, count(e.ord) as n from (
      select distinct r.domain, s.state from rec r, (select unnest({sql.strings(ENRICHMENT_STATUSES)}) as state) s) d
      left join enr e on e.domain = d.domain and e.status = d.state group by 1, 2"""),
)
def status_counts(spark, sf):
    from ..operators import decide

    domains = spark.createDataFrame([(d,) for d in REGISTRY.ids()], "domain string")
    return decide.status_counts(corpus.enrichment(spark, sf), "status", ENRICHMENT_STATUSES, domains)


@query(
    "status_subsets",
    with_(*CURATED, """select domain, 'reviewed' as subset, count(*) as n from gold where review_status = 'reviewed' group by 1
      union all select domain, 'seeded', count(*) from gold where review_status = 'seeded' group by 1
      union all select domain, 'in-scope', count(*) from gold where review_status = 'reviewed' and expected_in group by 1
      union all select domain, 'open', count(*) from enr where status in ('pending', 'in-progress') group by 1"""),
)
def status_subsets(spark, sf):
    g = corpus.gold(spark, sf)
    reviewed = F.col("review_status") == "reviewed"
    kinds = F.array_compact(F.array(
        F.when(reviewed, F.lit("reviewed")), F.when(F.col("review_status") == "seeded", F.lit("seeded")),
        F.when(reviewed & F.col("expected_in"), F.lit("in-scope"))))
    open_rows = corpus.enrichment(spark, sf).where("status in ('pending', 'in-progress')").select(
        "domain", F.lit("open").alias("subset"))
    return g.select("domain", F.explode(kinds).alias("subset")).unionByName(open_rows).groupBy("domain", "subset").agg(
        F.count("*").alias("n"))


# -- proposals ----------------------------------------------------------------


def _differs(f: str) -> str:
    if f in FIELDS[:2]:
        return f"(not r.present or r.expected_{f} is distinct from r.actual_{f})"
    a, b = sql.norm_set(f"r.expected_{f}"), sql.norm_set(f"coalesce(r.actual_{f}, []::VARCHAR[])")
    return f"(not r.present or {a} <> {b})"


_FIELDS = sql.labels((f, f"r.expected_{f} is not null and {_differs(f)}") for f in FIELDS)
REPAIR = f"""repair as materialized (
  select *, 'reviewed-benchmark-repair:' || paper_id || ':' || array_to_string(list_sort(fields), '+') as proposal_id from (
    select r.domain, r.paper_id, r.title, r.review_status, r.expected_in,
      case when not r.expected_in and r.present then ['excluded'] when r.expected_in then {_FIELDS} else []::VARCHAR[] end
        as fields, {', '.join(f'r.expected_{f}' for f in FIELDS)}
    from pairs r where r.review_status = 'reviewed') where len(fields) > 0)"""
PAIRED = (*CURATED, pairs_sql("res"))


def repairs(spark, sf):
    return review.repair_proposals(corpus.gold(spark, sf), corpus.evidence(spark, sf), corpus.resolved(spark, sf))


@query(
    "repair_proposals",
    with_(*PAIRED, REPAIR, f"""select domain, paper_id, proposal_id, case when expected_in then 'update-override' else 'exclude-paper' end as action,
      {joined('fields')} as fields, case when expected_in and list_contains(fields, 'family') then expected_family end as family,
      {joined("case when expected_in and list_contains(fields, 'outcomes') then expected_outcomes end")} as outcomes from repair"""),
)
def repair_proposals(spark, sf):
    return repairs(spark, sf).select("domain", "paper_id", "proposal_id", "action", pipe("fields"), "family", pipe("outcomes"))


_NAMED = "list_filter(x.phases, lambda p: p <> 'unknown')"
_DEPTH_FIELDS = sql.labels([
    ("outcomes", """len(coalesce(g.expected_outcomes, []::VARCHAR[])) = 0 and x.paper_type = 'experimental'
      and len(x.outcomes) > 0 and len(list_filter(x.outcome_rules, lambda o: o.strength <> 'weak')) > 0"""),
    ("phases", f"""len(coalesce(g.expected_phases, []::VARCHAR[])) = 0 and len(list_filter({_NAMED},
      lambda p: p in {sql.in_list(review.PROCEDURE_PHASES)})) > 0""")])
DEPTH = f"""out_n as (select ord, sum(sentences) as n_sent from outcome group by ord),
depth0 as (select g.domain, g.paper_id, g.title, x.ord, {_DEPTH_FIELDS} as fields, x.confidence as conf, x.paper_type,
    x.outcome_rules, x.outcomes, x.phases, x.n_steps, x.conf_sum, coalesce(o.n_sent, 0) as n_sent
  from gold g join res x on x.domain = g.domain and x.paper_id = g.paper_id left join out_n o on o.ord = x.ord
  where g.review_status = 'reviewed' and g.expected_in and x.confidence >= 0.78e0),
depth as materialized (
  select *, 'benchmark-depth-autofill:' || paper_id || ':' || array_to_string(list_sort(fields), '+') as proposal_id,
    {fx('''(round(conf * 100) + case when list_contains(fields, 'outcomes') then n_sent * 80 else 0 end
      + case when list_contains(fields, 'phases') then conf_sum else 0 end)::DOUBLE / ((1
      + case when list_contains(fields, 'outcomes') then n_sent else 0 end
      + case when list_contains(fields, 'phases') then n_steps else 0 end) * 100e0)''', 3)} as proposal_confidence,
    case when list_contains(fields, 'outcomes') then {sql.norm_set('outcomes')} end as p_outcomes,
    case when list_contains(fields, 'phases') then {sql.norm_set("list_filter(phases, lambda p: p <> 'unknown')")} end as p_phases
  from depth0 where len(fields) > 0)"""


def _depth_base() -> tuple[str, ...]:
    from .extraction import OUTCOME

    return (*CURATED, OUTCOME, DEPTH)


# overrides replace only the flat outcome labels, so gold rows whose labels were
# overridden keep their extracted mentions
def depth(spark, sf):
    return review.depth_proposals(corpus.gold(spark, sf), corpus.resolved(spark, sf))


@query(
    "depth_proposals",
    with_(*_depth_base(), f"""select domain, paper_id, proposal_id, {joined('fields')} as fields, proposal_confidence,
      {joined('p_outcomes')} as outcomes, {joined('p_phases')} as phases from depth"""),
)
def depth_proposals(spark, sf):
    return depth(spark, sf).select(
        "domain", "paper_id", "proposal_id", pipe("fields"), "proposal_confidence", pipe("outcomes"), pipe("phases"))


_TITLE_TEXT = "regexp_replace(lower(trim(title)), '[.?!:;]+$', '')"
_SENT_TEXT = "regexp_replace(lower(trim(sentence)), '[.?!:;]+$', '')"
RECO = f"""rule_hit as (select h.ord, h.rule, bool_or({_SENT_TEXT} = {_TITLE_TEXT.replace('title', 'd.title')} and
    {sql.rx('sentence', review.TITLE_OUTCOMES)}) as explicit
  from (select ord, sentence, unnest(outcomes) as rule from fact) h join depth d using (ord) group by 1, 2),
explicit as (select ord, bool_and(explicit) as explicit from rule_hit group by 1),
reco0 as (select d.*, len(fields) = 1 as single, list_contains(fields, 'outcomes') as use_o,
    list_contains(fields, 'phases') as use_p, conf >= 0.9e0 as high,
    paper_type = 'experimental' and len(list_filter(outcome_rules, lambda o: o.strength in ('moderate', 'strong'))) > 0 as grounded,
    len(fields) = 1 and coalesce(e.explicit, false) as explicit,
    len(list_distinct(list_filter(phases, lambda p: p <> 'unknown'))) >= 2 and len(list_filter(phases, lambda p: p <> 'unknown')) >= 2 as deep
  from depth d left join explicit e using (ord)),
reco as materialized (select *, round(least(1e0, greatest(0e0, (round(proposal_confidence * 1000) + case when high then 30 else 0 end
    + case when single then 20 else -20 end
    + case when use_o then (case when grounded then 30 else -50 end) + (case when explicit then 60 else 0 end) else 0 end
    + case when use_p then (case when deep then 30 else -50 end) else 0 end) / 1000e0)), 3) as policy_confidence from reco0)"""


def recommended(spark, sf):
    return review.proposal_recommendation(depth(spark, sf), corpus.resolved(spark, sf))


@query(
    "proposal_recommendation",
    with_(*_depth_base(), RECO, f"""select domain, proposal_id, policy_confidence,
      case when policy_confidence >= 0.9e0 then 'accept' else 'defer' end as recommended,
      {joined(sql.labels([('deep-steps', 'use_p and deep'), ('explicit-title-outcome', 'use_o and explicit'),
        ('grounded-outcome', 'use_o and grounded'), ('high-confidence', 'high'), ('low-confidence', 'not high'),
        ('multi-field', 'not single'), ('single-field', 'single'), ('sparse-steps', 'use_p and not deep'),
        ('ungrounded-outcome', 'use_o and not grounded')]))} as reasons from reco"""),
)
def proposal_recommendation(spark, sf):
    return recommended(spark, sf).select(
        "domain", "proposal_id", "policy_confidence", "recommended",
        F.array_join("recommendation_reasons", "|").alias("reasons"))


_PRIOR_DECISION = """prior_dec as (select domain, proposal_id, case when conf >= 0.95e0 then 'pending' when published_year % 2 = 0
    then 'accept' else 'reject' end as decision, case when published_year >= 2015 then ['viability'] end as accepted_outcomes,
    null::VARCHAR[] as accepted_phases, case when published_year < 2000 then 'seen before' end as reviewer_notes
  from (select d.*, r.published_year from depth d join rec r using (ord)) where published_year >= 1995)"""


def prior_decisions(spark, sf):
    """Earlier review decisions on some of the proposals."""
    facts = corpus.resolved(spark, sf).select("domain", "paper_id", "published_year", F.col("confidence").alias("conf"))
    year = F.col("published_year")
    rows = depth(spark, sf).select("domain", "paper_id", "proposal_id").join(facts, ["domain", "paper_id"]).where(year >= 1995)
    return rows.select(
        "domain", "proposal_id",
        F.when(F.col("conf") >= 0.95, "pending").when(year % 2 == 0, "accept").otherwise("reject").alias("decision"),
        F.when(year >= 2015, F.array(F.lit("viability"))).alias("accepted_outcomes"),
        F.lit(None).cast("array<string>").alias("accepted_phases"),
        F.when(year < 2000, "seen before").alias("reviewer_notes"),
    )


DECISION = f"""{_PRIOR_DECISION},
carried as materialized (select d.domain, d.proposal_id, d.paper_id, coalesce(p.decision, 'pending') as decision,
    p.accepted_outcomes, p.reviewer_notes from depth d left join prior_dec p using (domain, proposal_id))"""


def carried(spark, sf):
    return review.carry_forward_by_id(depth(spark, sf), prior_decisions(spark, sf))


@query(
    "carry_forward_by_id",
    with_(*_depth_base(), DECISION, f"""select domain, proposal_id, decision, {joined('accepted_outcomes')} as accepted_outcomes,
      reviewer_notes from carried"""),
)
def carry_forward_by_id(spark, sf):
    return carried(spark, sf).select("domain", "proposal_id", "decision", pipe("accepted_outcomes"), "reviewer_notes")


@query(
    "auto_accept",
    with_(*_depth_base(), RECO, DECISION, """select domain, proposal_id, decision = 'pending' and policy_confidence >= 0.9e0 as auto_accepted,
      case when decision = 'pending' and policy_confidence >= 0.9e0 then 'accept' else decision end as decision
      from carried join reco using (domain, proposal_id)"""),
)
def auto_accept(spark, sf):
    out = review.auto_accept(carried(spark, sf), recommended(spark, sf))
    return out.select("domain", "proposal_id", "auto_accepted", "decision")


@query(
    "apply_accepted_patches",
    with_(*_depth_base(), DECISION, f"""select g.domain, g.paper_id, {joined('''case when c.proposal_id is not null and
        len(coalesce(c.accepted_outcomes, d.p_outcomes, g.expected_outcomes, []::VARCHAR[])) > 0
        then coalesce(c.accepted_outcomes, d.p_outcomes, g.expected_outcomes) else g.expected_outcomes end''')} as outcomes,
      {joined('''case when c.proposal_id is not null and len(coalesce(d.p_phases, g.expected_phases, []::VARCHAR[])) > 0
        then coalesce(d.p_phases, g.expected_phases) else g.expected_phases end''')} as phases,
      case when c.proposal_id is null then g.notes else concat_ws(' ', nullif(g.notes, ''),
        'Accepted benchmark autofill proposal ' || c.proposal_id || '.') end as notes
      from gold g left join (select * from carried where decision = 'accept') c on c.domain = g.domain and c.paper_id = g.paper_id
      left join depth d on d.proposal_id = c.proposal_id and d.domain = c.domain""").replace(
        joined("case when c.proposal_id"), joined("case when c.proposal_id")),
)
def apply_accepted_patches(spark, sf):
    gold = corpus.gold(spark, sf)
    out = review.apply_accepted_patches(gold, depth(spark, sf), carried(spark, sf))
    return out.select(
        "domain", "paper_id", F.array_join("expected_outcomes", "|").alias("outcomes"),
        F.array_join("expected_phases", "|").alias("phases"), "notes")


@query(
    "proposal_order",
    with_(*PAIRED, REPAIR, *_depth_base()[len(CURATED):], """select domain, proposal_id, target, proposal_confidence from (
      select domain, proposal_id, 'override' as target, 1e0 as proposal_confidence, title, paper_id from repair
      union all select domain, proposal_id, 'benchmark', proposal_confidence, title, paper_id from depth)
      order by target, proposal_confidence desc, title, paper_id"""),
)
def proposal_order(spark, sf):
    cols = ["domain", "proposal_id", "target", "proposal_confidence", "title", "paper_id"]
    both = repairs(spark, sf).select(*cols).unionByName(depth(spark, sf).select(*cols))
    return review.proposal_order(both).drop("title", "paper_id")

