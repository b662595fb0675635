"""Gold-set queries."""

from __future__ import annotations

from ..operators import quality, review
from . import corpus, sql
from .matching import pipe
from .registry import query
from .sql import CURATED, EXACT_FIELDS, GATES_SQL, PASSED, SET_FIELDS, metrics_sql, pairs_sql, unpivot, with_

PAIRS = (*CURATED, pairs_sql("res"))
METRICS = (*PAIRS, metrics_sql())


def pairs(spark, sf):
    return quality.gold_join(corpus.gold(spark, sf), corpus.resolved(spark, sf))


@query(
    "gold_join",
    with_(*PAIRS, f"""select domain, paper_id, review_status, expected_in, present, actual_family, actual_paper_type,
      {sql.joined('actual_outcomes')} as actual_outcomes, actual_confidence from pairs"""),
)
def gold_join(spark, sf):
    return pairs(spark, sf).select(
        "domain", "paper_id", "review_status", "expected_in", "present", "actual_family", "actual_paper_type",
        pipe("actual_outcomes"), "actual_confidence",
    )


_INCLUSION = "tp, tn, fp, fn, inclusion_accuracy, inclusion_precision, inclusion_recall, inclusion_f1"


@query("inclusion_metrics", with_(*METRICS, f"select domain, {_INCLUSION} from met where subset = 'all'"))
def inclusion_metrics(spark, sf):
    return quality.inclusion_metrics(pairs(spark, sf))


@query(
    "unexpected_ids",
    with_(*PAIRS, """select domain, paper_id, case when present then 'included' else 'excluded' end as unexpected
      from pairs where expected_in <> present"""),
)
def unexpected_ids(spark, sf):
    return quality.unexpected_ids(pairs(spark, sf))


@query(
    "exact_field_accuracy",
    with_(*METRICS, unpivot("met", EXACT_FIELDS, {"labeled": "labeled", "matched": "matched", "accuracy": "accuracy"})),
)
def exact_field_accuracy(spark, sf):
    return quality.exact_field_accuracy(pairs(spark, sf))


@query(
    "exact_mismatches",
    with_(*PAIRS, """select domain, row_number() over (partition by domain order by ord) as rank, paper_id,
      expected_family as expected, actual_family as actual from pairs
      where expected_in and expected_family is not null and expected_family is distinct from actual_family
      qualify row_number() over (partition by domain order by ord) <= 20"""),
)
def exact_mismatches(spark, sf):
    return quality.exact_mismatches(pairs(spark, sf), "family")


@query(
    "set_field_macro",
    with_(*METRICS, unpivot("met", SET_FIELDS, {k: k for k in ("labeled", "exact", "precision", "recall", "f1")})),
)
def set_field_macro(spark, sf):
    return quality.set_field_macro(pairs(spark, sf))


@query(
    "set_mismatches",
    with_(*PAIRS, """select domain, row_number() over (partition by domain order by f1, title, paper_id) as rank,
      paper_id, f1 from (select *, floor(f_outcomes * 1000 + 0.5e0) / 1000e0 as f1 from pairs
        where s_outcomes is not null and s_outcomes.w <> s_outcomes.h)
      qualify row_number() over (partition by domain order by f1, title, paper_id) <= 20"""),
)
def set_mismatches(spark, sf):
    return quality.set_mismatches(pairs(spark, sf), "outcomes")


_COVERED = " union all ".join(
    f"select domain, subset, '{f}' as field, in_scope as eligible, {f}_{'labeled' if f in EXACT_FIELDS else 'covered'}"
    f" as labeled, {f}_coverage as coverage from met"
    for f in (*EXACT_FIELDS, *SET_FIELDS)
)


@query("label_coverage", with_(*METRICS, _COVERED))
def label_coverage(spark, sf):
    return quality.label_coverage(pairs(spark, sf))


@query(
    "confidence_means",
    with_(*METRICS, "select domain, subset, confidence_expected, confidence_correct, confidence_incorrect from met"),
)
def confidence_means(spark, sf):
    return quality.confidence_means(pairs(spark, sf))


SUBSET_METRICS = ["entries", "tp", "fp", "fn", "inclusion_f1", "family_accuracy", "paper_type_accuracy", "species_f1",
         "specimens_f1", "outcomes_f1", "phases_f1", "outcomes_coverage", "phases_coverage"]


@query("metrics_by_subset", with_(*METRICS, f"select domain, subset, {', '.join(SUBSET_METRICS)} from met"))
def metrics_by_subset(spark, sf):
    return quality.subset_metrics(pairs(spark, sf)).select("domain", "subset", *SUBSET_METRICS)


_GATES = " union all ".join(
    f"select domain, '{n}' as gate, {m} as actual, {t} as threshold, {m} >= {t} as passed from met where subset = 'reviewed'"
    for n, m, t in GATES_SQL
)


@query("quality_gates", with_(*METRICS, _GATES))
def quality_gates(spark, sf):
    return quality.quality_gates(quality.subset_metrics(pairs(spark, sf)))


GATE_SUMMARY = f"""select r.domain, {PASSED.replace('(', '(r.', )} as gates_passed, {PASSED.replace('(', '(r.')} = 6
      as passes_all_gates, {sql.fx('r.inclusion_f1 - a.inclusion_f1', 3)} as inclusion_f1_delta_vs_all,
      r.outcomes_coverage as outcome_coverage, r.phases_coverage as phase_coverage,
      r.outcomes_coverage >= 0.4e0 and r.phases_coverage >= 0.4e0 as depth_ready
      from met r join met a on a.domain = r.domain and a.subset = 'all' where r.subset = 'reviewed'"""


@query("gate_summary", with_(*METRICS, GATE_SUMMARY))
def gate_summary(spark, sf):
    return quality.gate_summary(quality.subset_metrics(pairs(spark, sf)))


DELTAS = quality.DELTA_METRICS
STAGES = (*CURATED, """staged as materialized (select *, 'baseline' as stage from ex union all by name
  select *, 'resolved' as stage from res)""",
          "sgold as (select *, unnest(['baseline', 'resolved']) as stage from gold)",
          pairs_sql("staged", gold="sgold", keys=("domain", "stage")), metrics_sql(keys=("domain", "stage")))


def stages(spark, sf):
    return review.stage_metrics(
        corpus.gold(spark, sf), {"baseline": corpus.evidence(spark, sf), "resolved": corpus.resolved(spark, sf)}
    )


@query(
    "stage_delta",
    with_(*STAGES, "select b.domain, " + ", ".join(f"{sql.fx(f'r.{m} - b.{m}', 3)} as {m}_delta" for m in DELTAS)
          + f""", r.g - b.g as gate_delta from (select *, {PASSED} as g from met where subset = 'reviewed') b
          join (select *, {PASSED} as g from met where subset = 'reviewed') r on r.domain = b.domain
          where b.stage = 'baseline' and r.stage = 'resolved'"""),
)
def stage_delta(spark, sf):
    return quality.stage_delta(stages(spark, sf))
