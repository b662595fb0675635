"""Provider result files to one record layout.

Each function takes the provider's nested rows (read with the schema beside it)
and returns source, source_id, title, abstract, identities, journal, year,
authors, citations and availability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_entities, nonblank, strip_markup

# URL prefixes stripped from identifiers.
DOI_URL, PMID_URL = "https://doi.org/", "https://pubmed.ncbi.nlm.nih.gov/"
PMC_URL = "https://www.ncbi.nlm.nih.gov/pmc/articles/"

OPENALEX = (
    "id string, doi string, title string, abstract_inverted_index map<string,array<int>>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string>>, publication_year int, "
    "cited_by_count bigint, authorships array<struct<author:struct<display_name:string>>>, "
    "ids struct<pmid:string,pmcid:string>, open_access struct<is_oa:boolean>"
)
CROSSREF = (
    "DOI string, title array<string>, abstract string, URL string, `container-title` array<string>, "
    "published struct<`date-parts`:array<array<int>>>, author array<struct<given:string,family:string>>, "
    "`is-referenced-by-count` bigint"
)
EUROPE_PMC = (
    "id string, title string, abstractText string, doi string, pmid string, pmcid string, journalTitle string, "
    "pubYear string, authorString string, citedByCount bigint, "
    "fullTextUrlList struct<fullTextUrl:array<struct<url:string,availability:string>>>"
)
_NAME = "struct<LastName:string,Initials:string>"
_ID = "struct<_IdType:string,_VALUE:string>"
PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string>>>,"
    "ELocationID:array<struct<_EIdType:string,_VALUE:string>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    f"AuthorList:struct<Author:array<{_NAME}>>>>,"
    f"PubmedData struct<ArticleIdList:struct<ArticleId:array<{_ID}>>>"
)


def _joined(names: Column) -> Column:
    """Non-blank names joined by "; ", null when there are none."""
    kept = F.array_compact(F.transform(names, nonblank))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def _row_id(provider_id: Column, *parts: str) -> Column:
    """The provider's id, else a hash of the content (stable across re-reads)."""
    return F.coalesce(nonblank(provider_id), F.sha2(F.concat_ws("\x1f", *parts), 256))


def invert_abstract_index(index: Column) -> Column:
    """Text from a token -> positions map."""
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e.value, lambda p: F.struct(p.alias("pos"), e.key.alias("token"))),
        )
    )
    words = F.transform(F.array_sort(placed), lambda w: w.token)
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def openalex_works(works: DataFrame) -> DataFrame:
    keep = [c for c in works.columns if c in ("domain", "ord")]
    landing = nonblank(F.col("primary_location.landing_page_url"))
    return works.select(
        *keep,
        F.lit("openalex").alias("source"),
        _row_id(F.col("id"), "title", "doi").alias("source_id"),
        F.coalesce(landing, nonblank(F.col("id"))).alias("source_url"),
        F.coalesce(nonblank(F.col("title")), F.lit("untitled")).alias("title"),
        invert_abstract_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.replace(nonblank(F.col("doi")), F.lit(DOI_URL)).alias("doi"),
        F.replace(nonblank(F.col("ids.pmid")), F.lit(PMID_URL)).alias("pmid"),
        F.replace(nonblank(F.col("ids.pmcid")), F.lit(PMC_URL)).alias("pmcid"),
        nonblank(F.col("primary_location.source.display_name")).alias("journal"),
        F.col("publication_year").alias("published_year"),
        _joined(F.transform("authorships", lambda a: a.author.display_name)).alias("authors_flat"),
        F.col("cited_by_count").alias("citation_count"),
        F.when(F.coalesce("open_access.is_oa", F.lit(False)), "open-access-full-text")
        .otherwise("abstract-only").alias("full_text_availability"),
    )


def crossref_works(items: DataFrame) -> DataFrame:
    keep = [c for c in items.columns if c in ("domain", "ord")]
    return items.select(
        *keep,
        F.lit("crossref").alias("source"),
        _row_id(F.col("DOI"), "URL", "abstract").alias("source_id"),
        nonblank(F.col("URL")).alias("source_url"),
        F.coalesce(nonblank(F.get("title", 0)), F.lit("untitled")).alias("title"),
        strip_markup(F.col("abstract")).alias("abstract"),
        nonblank(F.col("DOI")).alias("doi"),
        F.lit(None).cast("string").alias("pmid"),
        F.lit(None).cast("string").alias("pmcid"),
        nonblank(F.get("container-title", 0)).alias("journal"),
        F.get(F.get("published.date-parts", 0), 0).alias("published_year"),
        _joined(F.transform("author", lambda a: F.concat_ws(" ", a.given, a.family))).alias("authors_flat"),
        F.col("is-referenced-by-count").alias("citation_count"),
        F.when(nonblank(F.col("URL")).isNotNull(), "full-text-link").otherwise("abstract-only")
        .alias("full_text_availability"),
    )


def europe_pmc(results: DataFrame) -> DataFrame:
    keep = [c for c in results.columns if c in ("domain", "ord")]
    urls = F.col("fullTextUrlList.fullTextUrl")
    return results.select(
        *keep,
        F.lit("europe-pmc").alias("source"),
        _row_id(F.col("id"), "title", "doi").alias("source_id"),
        nonblank(F.get(urls, 0).url).alias("source_url"),
        F.coalesce(nonblank(F.col("title")), F.lit("untitled")).alias("title"),
        nonblank(F.col("abstractText")).alias("abstract"),
        nonblank(F.col("doi")).alias("doi"),
        nonblank(F.col("pmid")).alias("pmid"),
        nonblank(F.col("pmcid")).alias("pmcid"),
        nonblank(F.col("journalTitle")).alias("journal"),
        F.col("pubYear").try_cast("int").alias("published_year"),
        nonblank(F.col("authorString")).alias("authors_flat"),
        F.col("citedByCount").alias("citation_count"),
        F.when(nonblank(F.col("pmcid")).isNotNull(), "open-access-full-text")
        .when(F.coalesce(F.size(urls), F.lit(0)) > 0, "full-text-link")
        .otherwise("abstract-only").alias("full_text_availability"),
    )


def pubmed_articles(articles: DataFrame) -> DataFrame:
    """Article rows of the XML reader; rows without pmid or title drop out."""
    a = "MedlineCitation.Article."
    keep = [c for c in articles.columns if c in ("domain", "ord")]

    def typed(values: Column, kind: str, name: str) -> Column:
        return F.get(F.filter(values, lambda v: v[kind] == name), 0)["_VALUE"]

    def text(col: Column) -> Column:
        return nonblank(decode_entities(col))

    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    parts = F.transform(F.col(a + "Abstract.AbstractText"), lambda p: decode_entities(p["_VALUE"]))
    date = a + "Journal.JournalIssue.PubDate."
    year = F.coalesce(
        F.nullif(F.regexp_extract(F.col(date + "Year"), r"^(\d{4})", 1), F.lit("")),
        F.nullif(F.regexp_extract(F.col(date + "MedlineDate"), r"^(\d{4})", 1), F.lit("")),
    )
    names = F.transform(
        F.col(a + "AuthorList.Author"), lambda n: F.concat_ws(" ", text(n.LastName), text(n.Initials))
    )
    pmcid = text(typed(ids, "_IdType", "pmc"))
    pmid = nonblank(F.col("MedlineCitation.PMID._VALUE"))
    return articles.select(
        *keep,
        F.lit("pubmed").alias("source"),
        F.concat(F.lit("pubmed:"), pmid).alias("source_id"),
        F.concat(F.lit(PMID_URL), pmid, F.lit("/")).alias("source_url"),
        F.regexp_replace(text(F.col(a + "ArticleTitle")), r"\.$", "").alias("title"),
        F.when(F.size(parts) > 0, F.array_join(parts, " ")).alias("abstract"),
        F.coalesce(
            text(typed(ids, "_IdType", "doi")), text(typed(F.col(a + "ELocationID"), "_EIdType", "doi"))
        ).alias("doi"),
        pmid.alias("pmid"),
        pmcid.alias("pmcid"),
        text(F.col(a + "Journal.Title")).alias("journal"),
        year.try_cast("int").alias("published_year"),
        _joined(names).alias("authors_flat"),
        F.lit(None).cast("bigint").alias("citation_count"),
        F.when(pmcid.isNotNull(), "open-access-full-text").otherwise("abstract-only")
        .alias("full_text_availability"),
    ).where("pmid is not null and title is not null")


def scan_openalex_works(spark: SparkSession, path: str) -> DataFrame:
    return openalex_works(spark.read.schema(OPENALEX).json(path))


def scan_crossref_works(spark: SparkSession, path: str) -> DataFrame:
    return crossref_works(spark.read.schema(CROSSREF).json(path))


def scan_europe_pmc(spark: SparkSession, path: str) -> DataFrame:
    return europe_pmc(spark.read.schema(EUROPE_PMC).json(path))


def scan_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files; large files split at the article tag."""
    return pubmed_articles(spark.read.format("xml").schema(PUBMED).option("rowTag", "PubmedArticle").load(path))
