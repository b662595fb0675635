"""Scoring against a curated gold set.

All figures of a subset come from one aggregation over the gold/extraction
pairs. ``keys`` can carry more than the domain (a stage, a scenario), so several
versions of the corpus are evaluated in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import distinct_sorted, or_empty
from ..functions.numbers import fixed, ratio

EXACT_FIELDS = ("paper_type", "family")
SET_FIELDS = ("species", "specimens", "outcomes", "phases")
# Gate name, metric, threshold; depth thresholds.
GATES = (
    ("reviewed inclusion F1", "inclusion_f1", 0.9),
    ("reviewed inclusion precision", "inclusion_precision", 0.9),
    ("reviewed protocol family accuracy", "family_accuracy", 0.85),
    ("reviewed paper type accuracy", "paper_type_accuracy", 0.85),
    ("reviewed specimen macro F1", "specimens_f1", 0.75),
    ("reviewed species macro F1", "species_f1", 0.75),
)
MIN_DEPTH = 0.4
MISMATCH_LIMIT = 20


def gold_join(gold: DataFrame, extraction: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Every gold row with what the extraction says; extra extractions are ignored."""
    actual = extraction.select(
        *keys,
        "paper_id",
        *[F.col(f).alias(f"actual_{f}") for f in (*EXACT_FIELDS, *SET_FIELDS)],
        F.col("confidence").alias("actual_confidence"),
        F.lit(True).alias("present"),
    )
    return gold.join(actual, [*keys, "paper_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def _row_scores(expected: Column, actual: Column) -> Column:
    """Precision, recall and F1 of one row in thousandths, and the exact flag."""
    want, have = distinct_sorted(expected), distinct_sorted(or_empty(actual))
    overlap = F.size(F.array_intersect(want, have)).cast("double")
    precision = F.coalesce(F.try_divide(overlap, F.size(have).cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(overlap, F.size(want).cast("double")), F.lit(1.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def thousandths(x: Column) -> Column:
        return F.floor(x * 1000 + 0.5).cast("long")

    return F.struct(
        thousandths(precision).alias("p"),
        thousandths(recall).alias("r"),
        thousandths(f1).alias("f1"),
        (want == have).alias("exact"),
    )


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Adds one struct per set field for rows in scope with a label."""
    labelled = {
        f"set_{f}": F.when(
            F.col("expected_in") & F.col(f"expected_{f}").isNotNull(),
            _row_scores(F.col(f"expected_{f}"), F.col(f"actual_{f}")),
        )
        for f in SET_FIELDS
    }
    return pairs.withColumns(labelled)


def _mean(value: Column) -> Column:
    return fixed(F.avg(value.cast("decimal(12,6)")).cast("double"), 3)


def subset_metrics(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """All metrics for the subsets all, reviewed and seeded, one row each."""
    keys = list(keys)
    scope, present = F.col("expected_in"), F.col("present")

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    aggs = [
        F.count("*").alias("entries"),
        count(scope & present).alias("tp"),
        count(~scope & ~present).alias("tn"),
        count(~scope & present).alias("fp"),
        count(scope & ~present).alias("fn"),
        count(scope).alias("in_scope"),
        _mean(F.when(scope & present, F.col("actual_confidence"))).alias("confidence_expected"),
        _mean(F.when(scope & present, F.col("actual_confidence"))).alias("confidence_correct"),
        _mean(F.when(~scope & present, F.col("actual_confidence"))).alias("confidence_incorrect"),
    ]
    for f in EXACT_FIELDS:
        label = F.col(f"expected_{f}")
        aggs += [
            count(scope & label.isNotNull()).alias(f"{f}_labeled"),
            count(scope & label.isNotNull() & label.eqNullSafe(F.col(f"actual_{f}"))).alias(f"{f}_matched"),
        ]
    for f in SET_FIELDS:
        s = f"set_{f}"
        aggs += [
            F.count(s).alias(f"{f}_labeled"),
            count(F.coalesce(F.col(f"{s}.exact"), F.lit(False))).alias(f"{f}_exact"),
            *[F.coalesce(F.sum(f"{s}.{m}"), F.lit(0)).alias(f"_{f}_{m}") for m in ("p", "r", "f1")],
            count(scope & (F.size(or_empty(F.col(f"expected_{f}"))) > 0)).alias(f"{f}_covered"),
        ]
    status = F.col("review_status")
    grouped = scored_pairs(pairs).groupingSets(
        [[F.col(k) for k in keys], [*[F.col(k) for k in keys], status]], *[F.col(k) for k in keys], status
    ).agg(*aggs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    derived = {
        "inclusion_accuracy": ratio(tp + F.col("tn"), tp + F.col("tn") + fp + fn),
        "inclusion_precision": fixed(precision, 3),
        "inclusion_recall": fixed(recall, 3),
        "inclusion_f1": fixed(
            F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 3
        ),
    }
    for f in EXACT_FIELDS:
        derived[f"{f}_accuracy"] = ratio(F.col(f"{f}_matched"), F.col(f"{f}_labeled"))
        derived[f"{f}_coverage"] = ratio(F.col(f"{f}_labeled"), F.col("in_scope"))
    for f in SET_FIELDS:
        for m, name in (("p", "precision"), ("r", "recall"), ("f1", "f1")):
            derived[f"{f}_{name}"] = ratio(F.col(f"_{f}_{m}"), F.col(f"{f}_labeled") * 1000)
        derived[f"{f}_coverage"] = ratio(F.col(f"{f}_covered"), F.col("in_scope"))
    return (
        grouped.withColumns(derived)
        .withColumn("subset", F.coalesce("review_status", F.lit("all")))
        .drop("review_status", *[f"_{f}_{m}" for f in SET_FIELDS for m in ("p", "r", "f1")])
    )


def inclusion_metrics(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    cols = ("tp", "tn", "fp", "fn", "inclusion_accuracy", "inclusion_precision", "inclusion_recall", "inclusion_f1")
    return subset_metrics(pairs, keys).where("subset = 'all'").select(*keys, *cols)


def unexpected_ids(pairs: DataFrame) -> DataFrame:
    """Rows wrongly in or wrongly out, as rows rather than a list."""
    wrong = (
        F.when(~F.col("expected_in") & F.col("present"), "included")
        .when(F.col("expected_in") & ~F.col("present"), "excluded")
    )
    return pairs.select("domain", "paper_id", wrong.alias("unexpected")).where("unexpected is not null")


def _unpivot(metrics: DataFrame, keys: Sequence[str], fields: Sequence[str], parts: dict[str, str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("field"), *[F.col(f"{f}_{src}").alias(out) for out, src in parts.items()])
            for f in fields
        ]
    )
    return metrics.select(*keys, "subset", F.inline(rows))


def exact_field_accuracy(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    parts = {"labeled": "labeled", "matched": "matched", "accuracy": "accuracy"}
    return _unpivot(subset_metrics(pairs, keys), keys, EXACT_FIELDS, parts)


def set_field_macro(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    parts = {k: k for k in ("labeled", "exact", "precision", "recall", "f1")}
    return _unpivot(subset_metrics(pairs, keys), keys, SET_FIELDS, parts)


def label_coverage(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    metrics = subset_metrics(pairs, keys)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col("in_scope").alias("eligible"),
                F.col(f"{f}_{'labeled' if f in EXACT_FIELDS else 'covered'}").alias("labeled"),
                F.col(f"{f}_coverage").alias("coverage"),
            )
            for f in (*EXACT_FIELDS, *SET_FIELDS)
        ]
    )
    return metrics.select(*keys, "subset", F.inline(rows))


def confidence_means(pairs: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    return subset_metrics(pairs, keys).select(
        *keys, "subset", "confidence_expected", "confidence_correct", "confidence_incorrect"
    )


def exact_mismatches(pairs: DataFrame, field: str, limit: int = MISMATCH_LIMIT) -> DataFrame:
    """The first mismatching rows per domain, in gold order (``ord``)."""
    label, actual = F.col(f"expected_{field}"), F.col(f"actual_{field}")
    wrong = pairs.where(F.col("expected_in") & label.isNotNull() & ~label.eqNullSafe(actual))
    order = W.partitionBy("domain").orderBy("ord")
    return (
        wrong.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("domain", "rank", "paper_id", label.alias("expected"), actual.alias("actual"))
    )


def set_mismatches(pairs: DataFrame, field: str, limit: int = MISMATCH_LIMIT) -> DataFrame:
    """The worst rows of a set field per domain, lowest F1 first."""
    s = f"set_{field}"
    wrong = scored_pairs(pairs).where(F.col(s).isNotNull() & ~F.col(f"{s}.exact"))
    order = W.partitionBy("domain").orderBy(F.col(f"{s}.f1"), "title", "paper_id")
    return (
        wrong.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("domain", "rank", "paper_id", (F.col(f"{s}.f1") / 1000).alias("f1"))
    )


def quality_gates(metrics: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """One row per gate over the reviewed subset."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("gate"),
                F.col(metric).alias("actual"),
                F.lit(threshold).alias("threshold"),
                (F.col(metric) >= threshold).alias("passed"),
            )
            for name, metric, threshold in GATES
        ]
    )
    return metrics.where("subset = 'reviewed'").select(*keys, F.inline(rows))


def gate_summary(metrics: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """All gates passed, the F1 gap to the whole set, depth coverage and readiness."""
    keys = list(keys)
    reviewed = metrics.where("subset = 'reviewed'")
    passed = sum((F.when(F.col(m) >= t, 1).otherwise(0) for _, m, t in GATES), F.lit(0))
    whole = metrics.where("subset = 'all'").select(*keys, F.col("inclusion_f1").alias("_all_f1"))
    return reviewed.join(whole, keys).select(
        *keys,
        passed.alias("gates_passed"),
        (passed == len(GATES)).alias("passes_all_gates"),
        fixed(F.col("inclusion_f1") - F.col("_all_f1"), 3).alias("inclusion_f1_delta_vs_all"),
        F.col("outcomes_coverage").alias("outcome_coverage"),
        F.col("phases_coverage").alias("phase_coverage"),
        ((F.col("outcomes_coverage") >= MIN_DEPTH) & (F.col("phases_coverage") >= MIN_DEPTH)).alias("depth_ready"),
    )


DELTA_METRICS = (
    "inclusion_f1", "family_accuracy", "paper_type_accuracy", "species_f1", "specimens_f1", "outcomes_coverage",
    "phases_coverage",
)


def stage_delta(metrics: DataFrame, before: str = "baseline", after: str = "resolved") -> DataFrame:
    """Reviewed metrics of one stage minus another, plus the change in passed gates."""
    summary = gate_summary(metrics, ("domain", "stage")).select("domain", "stage", "gates_passed")
    wide = metrics.where("subset = 'reviewed'").join(summary, ["domain", "stage"])

    def at(stage: str, col: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(col)))

    return wide.groupBy("domain").agg(
        *[fixed(at(after, m) - at(before, m), 3).alias(f"{m}_delta") for m in DELTA_METRICS],
        (at(after, "gates_passed") - at(before, "gates_passed")).alias("gate_delta"),
    )
