"""Reading with declared rules: strict with a reject table, or lenient with defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.defaults import AVAILABILITY, DECISIONS, RECOMMENDATIONS, SOURCES
from ..functions.arrays import or_empty, string_array
from ..functions.text import title_key


@dataclass(frozen=True)
class Rule:
    """What a column must satisfy. A default replaces null before the tests."""

    column: str
    required: bool = False
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    default: object = None

    def problems(self) -> list[Column]:
        col, out = F.col(self.column), []
        if self.required:
            out.append(F.when(col.isNull(), F.lit(f"{self.column}: missing")))
        if self.values:
            out.append(F.when(~col.isin(*self.values), F.lit(f"{self.column}: not an allowed value")))
        if self.low is not None:
            out.append(F.when(col < self.low, F.lit(f"{self.column}: below {self.low:g}")))
        if self.high is not None:
            out.append(F.when(col > self.high, F.lit(f"{self.column}: above {self.high:g}")))
        return out


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``problems``, an array naming every broken rule."""
    for rule in rules:
        if rule.default is not None:
            df = df.withColumn(rule.column, F.coalesce(rule.column, F.lit(rule.default)))
    tests = [p for rule in rules for p in rule.problems()]
    if "_corrupt_record" in df.columns:
        tests.insert(0, F.when(F.col("_corrupt_record").isNotNull(), F.lit("unreadable record")))
    return df.withColumn("problems", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = checked.where(F.size("problems") == 0).drop("problems", "_corrupt_record")
    return valid, checked.where(F.size("problems") > 0)


def validated_read(spark: SparkSession, path: str, schema: str, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their problems) of JSON files.

    One bad record does not stop a large load: it lands in the rejects.
    """
    raw = (
        spark.read.schema(f"{schema}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return split_valid(check_rules(raw, rules))


RECORD_RULES = (
    Rule("source", required=True, values=SOURCES),
    Rule("source_id", required=True),
    Rule("title", required=True),
    Rule("citation_count", low=0),
    Rule("full_text_availability", values=AVAILABILITY, default="unknown"),
    Rule("relevance_score", low=0),
)


def coerce_legacy_rows(raw: DataFrame) -> DataFrame:
    """Old decision rows made valid: bad values become defaults, rows without key or
    title drop out.

    ``raw`` has every field as text (numbers too); lists are arrays of text.
    """

    def one_of(col: str, values: Sequence[str], default: str) -> Column:
        return F.when(F.col(col).isin(*values), F.col(col)).otherwise(F.lit(default))

    def number(col: str) -> Column:
        return F.coalesce(F.col(col).try_cast("double"), F.lit(0.0))

    def positive(col: str) -> Column:
        value = F.col(col).try_cast("double")
        return F.when(value > 0, value.cast("int"))

    sources = F.filter(or_empty(F.col("source_types")), lambda s: s.isin(*SOURCES))
    return raw.where("dedupe_key is not null and title is not null").select(
        *[c for c in ("domain", "ord") if c in raw.columns],
        "dedupe_key", "title", "doi", "pmid", "pmcid",
        F.coalesce("title_key", title_key(F.col("title"))).alias("title_key"),
        one_of("decision", DECISIONS, "pending").alias("decision"),
        one_of("recommendation", RECOMMENDATIONS, "review").alias("recommendation"),
        *[number(c).alias(c) for c in ("ranking_score", "relevance_score", "authority_score", "source_diversity_score")],
        F.coalesce(positive("source_count"), F.lit(1)).alias("source_count"),
        F.coalesce(positive("record_count"), positive("source_count"), F.lit(1)).alias("record_count"),
        F.when(F.size(sources) > 0, sources).otherwise(string_array(["other"])).alias("source_types"),
        one_of("full_text_availability", AVAILABILITY, "unknown").alias("full_text_availability"),
        F.coalesce(F.col("stale_evidence").try_cast("boolean"), F.lit(False)).alias("stale_evidence"),
        "reviewer_notes", F.col("decided_at").try_cast("timestamp").alias("decided_at"),
    )
