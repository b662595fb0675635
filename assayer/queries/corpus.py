"""The driver tables read as literature records.

``documents`` become provider records and papers, ``labels`` the curated layer
(gold rows, overrides, prior decisions, curated excerpts). Each frame's plan is
built once per session and table folder; nothing is cached but the plan.
"""

from __future__ import annotations

from functools import lru_cache, wraps
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import default_registry
from ..operators import corpus as merge
from ..operators import extract, match, normalize, review
from ..session import cut, stored_bytes
from .vocabulary import DIVERSITY_SOURCES, DOI_SOURCES, DOMAIN_OF_LANG, LINK_SOURCES, OPEN_SOURCES, PMCID_SOURCES, PMID_SOURCES, TERMS

REGISTRY = default_registry()
#: Stored bytes of documents that one task is dealt at most, on average.
SHARE = 32 << 20


def per_session(build):
    """Build a frame's plan once per (session, folder)."""

    @lru_cache(maxsize=64)
    def cached(session_id: str, sf: str, spark: SparkSession):
        return build(spark, sf)

    @wraps(build)
    def call(spark: SparkSession, sf: str):
        return cached(spark.sparkContext.applicationId, sf, spark)

    return call


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_lang(values: dict[str, object]):
    out = None
    for lang, value in values.items():
        hit = F.col("lang") == lang
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def subject_text(text: str | Column):
    """Whole words swapped for subject terms: one map lookup per word that has the length of a term's key."""
    words = F.split(F.col(text) if isinstance(text, str) else text, " ", -1)

    def shifted(terms: dict[str, str]):
        # lower case of an ASCII word has as many characters; a map is searched from end to end, so there is one for each length
        maps = {n: F.create_map(*[F.lit(x) for k, v in terms.items() if len(k) == n for x in (k, v)]) for n in sorted({len(k) for k in terms})}

        def swapped(w):
            found = None
            for n, some in maps.items():
                value, sized = F.element_at(some, F.lower(w)), F.length(w) == n
                found = F.when(sized, value) if found is None else found.when(sized, value)
            return F.when(F.length(w) <= max(maps), F.coalesce(found, w)).otherwise(w)

        return F.transform(words, swapped)

    return F.array_join(by_lang({k: shifted(v) for k, v in TERMS.items()}).otherwise(words), " ")


@per_session
def records(spark: SparkSession, sf: str) -> DataFrame:
    """Provider records: one per document, with identities some providers lack."""
    # a file may be one row group, which no task can split; the pattern work behind it must reach every core, in whole
    # rounds, with no more for a task than its share: larger tables make more tasks, not larger ones
    cores = spark.sparkContext.defaultParallelism
    rounds = max(1, ceil(stored_bytes(spark, f"{sf}/documents.parquet") / (cores * SHARE)))
    return provider_records(table(spark, sf, "documents").repartition(cores * rounds, "doc_id"))


def provider_records(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as provider records, with ``more`` of their columns.

    A title is made of the first line alone, so that what reads no abstract swaps no words of the rest.
    """
    digest = F.md5(F.col("text").cast("binary"))
    source = F.col("source")
    shifted = subject_text("text")
    line = F.instr("text", "\n")
    # with its line break, which keeps the last word from being a term: words end at blanks only
    title = F.when(line > 0, F.split_part(subject_text(F.expr("substring(text, 1, instr(text, '\n'))")), F.lit("\n"), F.lit(1))).otherwise(F.col("_t"))
    return (
        documents.withColumn("_t", shifted)
        .select(
            by_lang({k: F.lit(v) for k, v in DOMAIN_OF_LANG.items()}).alias("domain"),
            F.col("doc_id").alias("ord"),
            F.col("doc_id").cast("string").alias("paper_id"),
            source,
            F.concat_ws(":", source, F.col("doc_id").cast("string")).alias("source_id"),
            title.alias("title"),
            F.nullif(F.expr("case when instr(_t, '\n') > 0 then substring(_t, instr(_t, '\n') + 1) else '' end"), F.lit("")).alias("abstract"),
            F.when(source.isin(*DOI_SOURCES), F.concat(F.lit("10.5/"), digest)).alias("doi"),
            F.when(source.isin(*PMID_SOURCES), F.substring(digest, 1, 10)).alias("pmid"),
            F.when(source.isin(*PMCID_SOURCES), F.concat(F.lit("PMC"), F.substring(digest, 11, 8))).alias("pmcid"),
            F.concat(F.lit("Journal of "), F.col("lang")).alias("journal"),
            (F.lit(1990) + F.col("n_chars") % 40).cast("int").alias("published_year"),
            F.col("n_chars").cast("long").alias("citation_count"),
            F.when(source.isin(*OPEN_SOURCES), "open-access-full-text")
            .when(source.isin(*LINK_SOURCES), "full-text-link")
            .otherwise("abstract-only")
            .alias("full_text_availability"),
            *more,
        )
    )


@per_session
def enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Curated records: one per labelled document, as a stored stage."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    # labelled documents only, and never dealt: nothing here reads an abstract, so no text is moved
    labelled = provider_records(table(spark, sf, "documents").join(labels, "doc_id"), "quality", "toxic")
    access = F.col("full_text_availability")
    opened, linked = access == "open-access-full-text", access == "full-text-link"

    def pick(when_open: str, when_linked: str, otherwise: str):
        return F.when(opened, when_open).when(linked, when_linked).otherwise(otherwise)

    excerpt = F.struct(
        pick("Results section", "Discussion note", "Curator note").alias("label"),
        F.col("title").alias("text"),
        pick("results", "discussion", "manual-note").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(True).alias("reviewed"),
    )
    rows = labelled.select(
        "domain", "paper_id", "ord", "title", "doi", "published_year", access.alias("access"),
        F.lit(None).cast("string").alias("paper_url"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "reviewed")
        .when(F.col("quality") == 1, "in-progress").when(F.col("toxic") == 0, "pending").otherwise("rejected")
        .alias("status"),
        F.when(opened, "extractor-gap").when(linked, "ambiguous-evidence")
        .when(F.col("pmid").isNotNull(), "evidence-thin").otherwise("step-phase-manual").alias("priority"),
        F.when(access == "abstract-only", "taken from a secondary review").alias("reviewer_notes"),
        F.array(excerpt).alias("excerpts"),
        "quality", "toxic",
    )
    return cut(rows, "enrichment")


@per_session
def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers with their curated record attached."""
    return extract.attach_reviewed_enrichment(records(spark, sf), enrichment(spark, sf))


@per_session
def extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Plan of the full extraction of every document."""
    return extract.assemble_extraction(papers(spark, sf), REGISTRY)


@per_session
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The extraction as a stored stage, which later jobs read column by column."""
    return cut(extraction(spark, sf).drop("source_text"), "extraction")


@per_session
def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Provider records that pass the gate, as a stored stage."""
    return cut(match.candidate_gate(records(spark, sf), REGISTRY), "gated")


@per_session
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Merged candidates, as a stored stage."""
    merged = merge.dedupe_merge_records(gated(spark, sf), baseline=DIVERSITY_SOURCES, late=True)
    return cut(merged.withColumn("ord", F.col("first_seen.ord")).drop("first_seen"), "candidates")


@per_session
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised protocols, as a stored stage."""
    return cut(normalize.normalize_extraction(evidence(spark, sf)), "normalized")


def _labelled(spark: SparkSession, sf: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"), "quality", "toxic")
    return rows.select("domain", "paper_id", "ord", *columns).join(labels, "ord")


def gold_rows(spark: SparkSession, sf: str, extraction: DataFrame) -> DataFrame:
    """Gold rows of the labelled documents in ``extraction``; expectations are partial on purpose."""
    access, year = F.col("full_text_availability"), F.col("published_year")
    opened, linked = access == "open-access-full-text", access == "full-text-link"
    rows = _labelled(spark, sf, extraction, ["title", "full_text_availability", "published_year", "paper_type", "family", "species",
                                             "specimens", "outcomes", "phases"])
    return rows.select(
        "domain", "paper_id", "ord", "title",
        F.when(F.col("toxic") == 0, "reviewed").otherwise("seeded").alias("review_status"),
        (F.col("quality") == 1).alias("expected_in"),
        F.when(opened, F.col("paper_type")).when(linked, "experimental").alias("expected_paper_type"),
        F.when(year >= 2010, F.col("family")).when(year >= 2000, "vitrification").alias("expected_family"),
        F.when(opened, F.col("species")).when(linked, F.slice("species", 1, 1)).alias("expected_species"),
        F.when(opened | linked, F.col("specimens")).otherwise(F.slice("specimens", 1, 1)).alias("expected_specimens"),
        F.when(opened, F.col("outcomes")).when(linked, F.lit(None)).otherwise(F.slice("outcomes", 1, 1))
        .alias("expected_outcomes"),
        F.when(opened, F.array_sort(F.array_distinct("phases"))).when(linked, F.array().cast("array<string>")).alias("expected_phases"),
        F.when(linked, "second-hand label").alias("notes"),
    )


@per_session
def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold rows of the stored extraction."""
    return gold_rows(spark, sf, evidence(spark, sf))


@per_session
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse patches for the labelled documents in doubt; they need no extraction."""
    access, year = F.col("full_text_availability"), F.col("published_year")
    rows = _labelled(spark, sf, records(spark, sf), ["full_text_availability", "published_year"]).where("quality = 0 or toxic = 1")
    none = F.lit(None).cast("array<string>")
    return rows.select(
        "domain", "paper_id", "ord",
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), True).alias("excluded"),
        F.when(access == "full-text-link", "experimental").alias("paper_type"),
        F.when(year >= 2010, "slow-freezing").alias("family"),
        F.when(year < 2000, F.array().cast("array<string>")).alias("species"),
        none.alias("specimens"),
        F.when(access == "open-access-full-text", F.array(F.lit("viability"))).alias("outcomes"),
        none.alias("phases"),
        F.when(access == "abstract-only", 0.9).alias("confidence"),
    )


@per_session
def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """The extraction with overrides applied, as a stored stage."""
    return cut(review.apply_overrides(evidence(spark, sf), overrides(spark, sf)), "resolved")
