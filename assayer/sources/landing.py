"""Landed listing pages and import files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Registry
from ..config.defaults import CORPUS_SOURCE
from ..functions.text import nonblank
from ..operators.match import candidate_gate

_LABEL = "struct<label:string>"
EXPERIMENT = (
    "struct<experiment_label:string,experiment_method:string,"
    f"curated_bio_context:struct<species:{_LABEL},organ:{_LABEL},tissue:{_LABEL},cell_type:{_LABEL},"
    "developmental_stage:string,physiological_state:string>,"
    "biological_context:struct<species:string,organ:string,tissue:string,cell_line:string,dimensions:string,"
    "health_status:string,developmental_stage:string>>"
)
PAPER = (
    "struct<paper_id:string,paper_title:string,paper_doi:string,paper_url:string,journal:string,"
    f"published_year:int,published_month:int,published_day:int,paper_authors:string,experiments:array<{EXPERIMENT}>>"
)
PAGE_SCHEMA = f"page int, total int, papers array<{PAPER}>"
RECORD = (
    "struct<source:string,source_id:string,source_url:string,raw_query:string,title:string,abstract:string,"
    "doi:string,pmid:string,pmcid:string,journal:string,published_year:int,authors_flat:string,"
    "citation_count:bigint,full_text_availability:string>"
)
IMPORT_SCHEMA = f"generated_at timestamp, domain string, source string, label string, records array<{RECORD}>"


def flatten_experiment_context(experiments: Column) -> Column:
    """Abstract text from nested experiments; null when there is nothing to say."""

    def context(e: Column) -> Column:
        c, b = e.curated_bio_context, e.biological_context
        values = F.array(
            c.species.label, c.organ.label, c.tissue.label, c.cell_type.label, c.developmental_stage,
            c.physiological_state, b.species, b.organ, b.tissue, b.cell_line, b.dimensions, b.health_status,
            b.developmental_stage,
        )
        distinct = F.array_distinct(F.array_compact(F.transform(values, nonblank)))
        return F.array_join(distinct, "; ")

    def section(e: Column) -> Column:
        parts = F.array(e.experiment_label, e.experiment_method, context(e))
        return F.array_join(F.array_compact(F.transform(parts, nonblank)), ". ")

    return nonblank(F.array_join(F.filter(F.transform(experiments, section), lambda s: s != ""), " "))


def flatten_papers(pages: DataFrame) -> DataFrame:
    """One row per paper of the ``papers`` arrays."""
    p = pages.select(*[c for c in pages.columns if c != "papers"], F.explode("papers").alias("p")).select("*", "p.*").drop("p")
    # a content hash, not a random id: re-reading a page yields the same paper
    digest = F.sha2(F.concat_ws("\x1f", "paper_title", "paper_doi", "paper_url", "paper_authors"), 256)
    paper_id = F.coalesce(nonblank(F.col("paper_id")), digest)
    return p.select(
        *[c for c in pages.columns if c != "papers"],
        paper_id.alias("paper_id"),
        F.col("paper_doi").alias("doi"),
        F.coalesce(nonblank(F.col("paper_title")), nonblank(F.col("paper_doi")), paper_id).alias("title"),
        flatten_experiment_context(F.col("experiments")).alias("abstract"),
        "paper_url", "journal", "published_year", "published_month", "published_day",
        F.make_date("published_year", "published_month", "published_day").alias("published_on"),
        F.col("paper_authors").alias("authors_flat"),
    )


def scan_paper_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Papers of landed listing pages.

    One JSON document per line by default, so large files split; ``multi_line``
    reads pretty-printed page files, one task per file.
    """
    return flatten_papers(spark.read.schema(PAGE_SCHEMA).option("multiLine", multi_line).json(path))


def scan_import_files(
    spark: SparkSession, path: str, domain: str | None = None, multi_line: bool = False
) -> DataFrame:
    """Import records with their file and position, in file-name order.

    A file of another domain is an error, raised by the tasks that read it.
    """
    files = spark.read.schema(IMPORT_SCHEMA).option("multiLine", multi_line).json(path)
    files = files.select("domain", "generated_at", "label", "records", F.col("_metadata.file_name").alias("file"))
    if domain is not None:
        wrong = F.concat(F.lit("import file "), "file", F.lit(" targets "), F.coalesce("domain", F.lit("nothing")),
                         F.lit(f", expected {domain}"))
        files = files.withColumn("domain", F.when(F.col("domain") == domain, F.col("domain")).otherwise(F.raise_error(wrong)))
    return files.select(
        "domain", "generated_at", "label", "file", F.posexplode("records").alias("pos", "r")
    ).select("domain", "generated_at", "label", "file", "pos", "r.*")


def _is_empty(df: DataFrame, flag: str) -> DataFrame:
    """One row: whether the frame has no rows (reads a single one)."""
    return df.limit(1).agg((F.count("*") == 0).alias(flag))


def primary_else_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary rows, or the fallback dump if there are none; adds ``used_fallback``."""
    empty = _is_empty(primary, "_empty").scalar()
    return primary.withColumn("used_fallback", F.lit(False)).unionByName(
        fallback.where(empty).withColumn("used_fallback", F.lit(True)), allowMissingColumns=True
    )


KEPT_PRIOR = "no-import-files-present; preserved prior imported-source-records"


def retain_prior_on_empty(new: DataFrame, prior: DataFrame) -> DataFrame:
    """The new import set, or the previous one when nothing was delivered; adds ``reason``."""
    empty = _is_empty(new, "_empty").scalar()
    return new.withColumn("reason", F.lit(None).cast("string")).unionByName(
        prior.where(empty).withColumn("reason", F.lit(KEPT_PRIOR)), allowMissingColumns=True
    )


def corpus_as_source(papers: DataFrame, registry: Registry, source: str = CORPUS_SOURCE) -> DataFrame:
    """The tracked corpus as one more provider, gated like the others."""
    url = nonblank(F.col("paper_url"))
    records = papers.select(
        "domain", *[c for c in ("ord",) if c in papers.columns],
        F.lit(source).alias("source"), F.col("paper_id").alias("source_id"), "paper_url", "title", "abstract", "doi",
        F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), "journal",
        "published_year", F.lit(None).cast("bigint").alias("citation_count"),
        F.when(url.isNotNull(), "full-text-link").otherwise("abstract-only").alias("full_text_availability"),
    )
    return candidate_gate(records.withColumnRenamed("paper_url", "source_url"), registry)
