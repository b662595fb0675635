"""Source, sink and streaming queries: files written from the tables, then read back.

Every file goes under a fresh folder of the shared directory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Registry
from ..config.defaults import DIVERSITY_SOURCES
from ..functions import arrays, keys
from ..functions import text as words
from ..operators import match
from ..session import fresh_path
from ..sources import landing, providers, sinks, validated
from ..streaming import decisions, incremental
from . import corpus, sql
from .corpus import REGISTRY
from .matching import CAND, HINTS, pipe
from .registry import query
from .sql import GATE, REC, SAME, candidates_sql, joined, q, renamed, with_

PAGE = 50


def md5(col: str):
    return F.md5(F.coalesce(col, F.lit("")).cast("binary")).alias(f"{col}_md5")


def _papers(spark, sf):
    """Records as the nested papers of listing pages."""
    r = corpus.records(spark, sf)
    label = lambda c: F.struct(c.alias("label"))
    experiment = F.struct(
        F.col("title").alias("experiment_label"),
        F.col("full_text_availability").alias("experiment_method"),
        F.struct(label(F.col("domain")).alias("species"), label(F.col("journal")).alias("organ"),
                 label(F.col("domain")).alias("tissue"), label(F.lit(" ")).alias("cell_type"),
                 F.col("source").alias("developmental_stage"), F.lit("").alias("physiological_state")).alias("curated_bio_context"),
        F.struct(F.col("journal").alias("species"), F.lit(None).cast("string").alias("organ"), F.col("pmid").alias("tissue"),
                 F.lit(None).cast("string").alias("cell_line"), F.lit(None).cast("string").alias("dimensions"),
                 F.lit(None).cast("string").alias("health_status"), F.lit(None).cast("string").alias("developmental_stage"))
        .alias("biological_context"),
    )
    paper = F.struct(
        F.concat(F.lit(" "), "paper_id").alias("paper_id"),
        F.when(F.col("full_text_availability") != "full-text-link", F.col("title")).alias("paper_title"),
        F.col("doi").alias("paper_doi"), F.lit(None).cast("string").alias("paper_url"), "journal", "published_year",
        F.lit(6).alias("published_month"), F.lit(15).alias("published_day"), F.col("source").alias("paper_authors"),
        F.array(experiment, F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
            ("experiment_label", "string"), ("experiment_method", "string"),
            ("curated_bio_context", "struct<species:struct<label:string>,organ:struct<label:string>,tissue:struct<label:string>,"
             "cell_type:struct<label:string>,developmental_stage:string,physiological_state:string>"),
            ("biological_context", "struct<species:string,organ:string,tissue:string,cell_line:string,dimensions:string,"
             "health_status:string,developmental_stage:string>"))])).alias("experiments"),
    )
    return r.select("ord", "domain", F.floor(F.col("ord") / PAGE).alias("page"), paper.alias("p"))


def _pages(spark, sf) -> str:
    path = fresh_path(spark, "pages")
    pages = _papers(spark, sf).groupBy("page").agg(F.collect_list("p").alias("papers"))  # PAGE papers at most
    pages.withColumn("total", F.size("papers")).write.json(path)
    return path


_TITLE = """coalesce(nullif(trim(case when full_text_availability <> 'full-text-link' then title end), ''), nullif(trim(doi), ''), paper_id)"""
_CONTEXT = """trim(title) || '. ' || full_text_availability || '. ' || concat_ws('; ', domain, journal, source, pmid)"""


@query("scan_paper_pages", with_(REC, f"select paper_id, {_TITLE} as title, doi, published_year, source as authors_flat, "
                                 "cast(make_date(published_year, 6, 15) as varchar) as published_on from rec"))
def scan_paper_pages(spark, sf):
    out = landing.scan_paper_pages(spark, _pages(spark, sf))
    return out.select("paper_id", "title", "doi", "published_year", "authors_flat", F.col("published_on").cast("string"))


@query("flatten_experiment_context", with_(REC, f"select paper_id, md5({_CONTEXT}) as abstract_md5 from rec"))
def flatten_experiment_context(spark, sf):
    papers = _papers(spark, sf).select("p.*")
    return papers.select(F.trim("paper_id").alias("paper_id"), landing.flatten_experiment_context(F.col("experiments")).alias("abstract")).select(
        "paper_id", md5("abstract"))


_RECORD = ("source", "source_id", "title", "abstract", "doi", "pmid", "pmcid", "journal", "published_year", "citation_count",
           "full_text_availability")


def _import_lines(spark, sf, label: str = "imports") -> str:
    path = fresh_path(spark, label)
    record = F.struct(*_RECORD)
    blocks = corpus.records(spark, sf).groupBy("domain", "source", F.floor(F.col("ord") / PAGE).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", record.alias("r")))).alias("rs"))  # PAGE records at most
    blocks.select("domain", "source", F.lit("2024-01-01T00:00:00Z").alias("generated_at"),
                  F.transform("rs", lambda x: x.r).alias("records")).write.json(path)
    return path


@query("scan_import_files", with_(REC, "select domain, source, source_id, doi, citation_count, md5(title) as title_md5, "
                                  "cast((select count(*) from rec b where b.domain = r.domain and b.source = r.source and b.ord < r.ord "
                                  f"and b.ord // {PAGE} = r.ord // {PAGE}) as integer) as pos from rec r"))
def scan_import_files(spark, sf):
    out = landing.scan_import_files(spark, _import_lines(spark, sf))
    return out.select("domain", "source", "source_id", "doi", "citation_count", md5("title"), "pos")


def _json(df, spark, label: str) -> str:
    path = fresh_path(spark, label)
    df.write.json(path)
    return path


def _inverted(df, keys, text):
    """(keys, index): word -> its positions, for every row with a word."""
    words_at = df.select(*keys, F.posexplode(F.split(text, " ")).alias("pos", "word")).where("word <> ''")
    places = words_at.groupBy(*keys, "word").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return places.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("invert_abstract_index", f"select conv_id, turn, md5({_FLAT}) as text_md5 from conversations where {_FLAT} <> ''")
def invert_abstract_index(spark, sf):
    flat = words.collapse(F.col("text"))
    turns = _inverted(corpus.table(spark, sf, "conversations"), ["conv_id", "turn"], flat)
    rebuilt = providers.invert_abstract_index(F.col("index"))
    return turns.select("conv_id", "turn", F.md5(rebuilt.cast("binary")).alias("text_md5"))


_OPEN = "full_text_availability = 'open-access-full-text'"


@query("scan_openalex_works", with_(REC, f"""select 'openalex' as source, 'https://works.example/' || paper_id as source_id, nullif(trim(title), '') as title,
  md5(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g'))) as abstract_md5, doi, pmid, pmcid, journal, published_year, citation_count,
  source || '; ' || lang as authors_flat, case when {_OPEN} then 'open-access-full-text' else 'abstract-only' end as full_text_availability from rec"""))
def scan_openalex_works(spark, sf):
    r = corpus.records(spark, sf).join(corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang"), "ord")
    abstracts = _inverted(r, ["ord"], words.collapse(F.coalesce("abstract", F.lit(""))))
    works = r.join(abstracts, "ord", "left").select(
        F.concat(F.lit("https://works.example/"), "paper_id").alias("id"), F.concat(F.lit(providers.DOI_URL), "doi").alias("doi"), "title",
        F.col("index").alias("abstract_inverted_index"),
        F.struct(F.lit(None).cast("string").alias("landing_page_url"), F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"),
        F.col("published_year").alias("publication_year"), F.col("citation_count").alias("cited_by_count"),
        F.array(*[F.struct(F.struct(n.alias("display_name")).alias("author")) for n in (F.col("source"), F.lit(" "), F.col("lang"))]).alias("authorships"),
        F.struct(F.concat(F.lit(providers.PMID_URL), "pmid").alias("pmid"), F.concat(F.lit(providers.PMC_URL), "pmcid").alias("pmcid")).alias("ids"),
        F.struct((F.col("full_text_availability") == "open-access-full-text").alias("is_oa")).alias("open_access"),
    )
    out = providers.scan_openalex_works(spark, _json(works, spark, "openalex"))
    return out.select("source", "source_id", "title", md5("abstract"), "doi", "pmid", "pmcid", "journal", "published_year",
                      "citation_count", "authors_flat", "full_text_availability")


@query("scan_crossref_works", with_(REC, """select 'crossref' as source, paper_id as source_id, nullif(trim(title), '') as title,
  md5(coalesce(nullif(trim(regexp_replace(coalesce(abstract, '') || ' ' || title, '\\s+', ' ', 'g')), ''), '')) as abstract_md5,
  paper_id as doi, published_year, source || ' ' || journal as authors_flat,
  case when doi is not null then 'full-text-link' else 'abstract-only' end as full_text_availability from rec""")
       .replace("coalesce(abstract, '') || ' ' || title", "regexp_replace('<p>' || coalesce(abstract, '') || '</p><i>' || title || '</i>', '<[^>]+>', ' ', 'g')"))
def scan_crossref_works(spark, sf):
    r = corpus.records(spark, sf)
    works = r.select(
        F.col("paper_id").alias("DOI"), F.array("title").alias("title"),
        F.concat(F.lit("<p>"), F.coalesce("abstract", F.lit("")), F.lit("</p><i>"), "title", F.lit("</i>")).alias("abstract"),
        F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "doi")).alias("URL"), F.array("journal").alias("container-title"),
        F.struct(F.array(F.array("published_year")).alias("date-parts")).alias("published"),
        F.array(F.struct(F.col("source").alias("given"), F.col("journal").alias("family"))).alias("author"),
        F.col("citation_count").alias("is-referenced-by-count"))
    out = providers.scan_crossref_works(spark, _json(works, spark, "crossref"))
    return out.select("source", "source_id", "title", md5("abstract"), "doi", "published_year", "authors_flat", "full_text_availability")


@query("scan_europe_pmc", with_(REC, """select 'europe-pmc' as source, paper_id as source_id, nullif(trim(title), '') as title, md5(trim(coalesce(abstract, ''))) as abstract_md5,
  journal, source as authors_flat, doi, pmid, pmcid, published_year, citation_count,
  case when pmcid is not null then 'open-access-full-text' when doi is not null then 'full-text-link' else 'abstract-only' end as full_text_availability from rec"""))
def scan_europe_pmc(spark, sf):
    r = corpus.records(spark, sf)
    urls = F.when(F.col("doi").isNotNull(), F.array(F.struct(F.concat(F.lit("https://doi.org/"), "doi").alias("url"), F.lit("Open").alias("availability"))))
    works = r.select(F.col("paper_id").alias("id"), "title", F.col("abstract").alias("abstractText"), "doi", "pmid", "pmcid",
                     F.col("journal").alias("journalTitle"), F.col("published_year").cast("string").alias("pubYear"),
                     F.col("source").alias("authorString"), F.col("citation_count").alias("citedByCount"),
                     F.struct(urls.alias("fullTextUrl")).alias("fullTextUrlList"))
    out = providers.scan_europe_pmc(spark, _json(works, spark, "epmc"))
    return out.select("source", "source_id", "title", md5("abstract"), "journal", "authors_flat", "doi", "pmid", "pmcid", "published_year",
                      "citation_count", "full_text_availability")


_CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("scan_pubmed_xml", with_(REC, f"""select 'pubmed:' || ord as source_id, nullif(trim(regexp_replace({_CLEAN.format(c='title')}, '\\.$', '')), '') as title,
  md5(trim({_CLEAN.format(c="regexp_replace(coalesce(abstract, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g')")} || ' part two')) as abstract_md5,
  doi, cast(ord as varchar) as pmid, pmcid, journal, published_year, source || ' X; ' || lang as authors_flat,
  case when pmcid is not null then 'open-access-full-text' else 'abstract-only' end as full_text_availability from rec where {_CLEAN.format(c='title')} <> ''"""))
def scan_pubmed_xml(spark, sf):
    r = corpus.records(spark, sf).join(corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang"), "ord")

    clean = F.regexp_replace("title", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")

    def ident(kind: str, col: str):
        return F.when(F.col(col).isNotNull(), F.struct(F.lit(kind).alias("_IdType"), F.col(col).alias("_VALUE")))

    body = words.collapse(F.regexp_replace(F.coalesce("abstract", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " "))

    def part(label: str, value):
        return F.struct(F.lit(label).alias("_Label"), value.alias("_VALUE"))

    def author(last, initials):
        return F.struct(last.alias("LastName"), initials.alias("Initials"))

    journal = F.struct(
        F.col("journal").alias("Title"),
        F.struct(F.struct(F.col("published_year").cast("string").alias("Year")).alias("PubDate")).alias("JournalIssue"))
    article = F.struct(
        journal.alias("Journal"), clean.alias("ArticleTitle"),
        F.struct(F.array(part("A", F.nullif(body, F.lit(""))), part("B", F.lit("part two"))).alias("AbstractText")).alias("Abstract"),
        F.struct(F.array(author(F.col("source"), F.lit("X")), author(F.col("lang"), F.lit(None).cast("string"))).alias("Author"))
        .alias("AuthorList"))
    path = fresh_path(spark, "pubmed")
    r.select(
        F.struct(F.struct(F.lit("1").alias("_Version"), F.col("paper_id").alias("_VALUE")).alias("PMID"), article.alias("Article"))
        .alias("MedlineCitation"),
        F.struct(F.struct(F.array_compact(F.array(ident("doi", "doi"), ident("pmc", "pmcid"))).alias("ArticleId")).alias("ArticleIdList"))
        .alias("PubmedData"),
    ).write.format("xml").option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").save(path)
    out = providers.scan_pubmed_xml(spark, path)
    return out.select("source_id", "title", md5("abstract"), "doi", "pmid", "pmcid", "journal", "published_year", "authors_flat",
                      "full_text_availability")


# -- fallbacks ----------------------------------------------------------------


@query("primary_else_fallback", with_(REC, """select 'without' as state, ord, true as used_fallback from rec
  union all select 'with', ord, false from rec where lang = 'en'"""))
def primary_else_fallback(spark, sf):
    """Both states: without a primary row every fallback row counts, with one none does."""
    r = corpus.records(spark, sf).select("ord", "domain")
    without = landing.primary_else_fallback(r.where("domain = 'none'"), r).withColumn("state", F.lit("without"))
    primary = landing.primary_else_fallback(r.where("domain = 'islets'"), r).withColumn("state", F.lit("with"))
    return without.unionByName(primary).select("state", "ord", "used_fallback")


@query("retain_prior_on_empty", with_(REC, f"""select domain, count(*) as n, {q(landing.KEPT_PRIOR)} as reason from rec group by 1
  union all select 'new-' || domain, count(*), null from rec where {_OPEN} group by 1"""))
def retain_prior_on_empty(spark, sf):
    r = corpus.records(spark, sf).select("ord", "domain", "full_text_availability")
    kept = landing.retain_prior_on_empty(r.where("domain = 'none'"), r)
    fresh = landing.retain_prior_on_empty(
        r.where("full_text_availability = 'open-access-full-text'").withColumn("domain", F.concat(F.lit("new-"), "domain")), r)
    return kept.unionByName(fresh).groupBy("domain", "reason").agg(F.count("*").alias("n"))


# -- validation ---------------------------------------------------------------

_RULES = (
    validated.Rule("source", required=True, values=tuple(f"src{i}" for i in range(18))),
    validated.Rule("title", required=True), validated.Rule("citation_count", low=100, high=8000),
    validated.Rule("full_text_availability", values=("unknown", "abstract-only", "open-access-full-text"), default="unknown"),
    validated.Rule("pmid", required=True),
)
_PROBLEMS = sql.labels([
    ("source: not an allowed value", "source in ('src18', 'src19')"), ("title: missing", "title is null"),
    ("citation_count: below 100", "citation_count < 100"), ("citation_count: above 8000", "citation_count > 8000"),
    ("full_text_availability: not an allowed value", "full_text_availability = 'full-text-link'"), ("pmid: missing", "pmid is null")])


@query("validated_read", with_(REC, f"""select domain, source_id, {joined(f"list_sort({_PROBLEMS})")} as problems from rec"""))
def validated_read(spark, sf):
    lines = corpus.records(spark, sf).select("domain", "source", "source_id", "title", "citation_count", "full_text_availability", "pmid")
    path = _json(lines, spark, "checked")
    schema = "domain string, source string, source_id string, title string, citation_count bigint, full_text_availability string, pmid string"
    valid, rejects = validated.validated_read(spark, path, schema, _RULES)
    good = valid.withColumn("problems", F.array().cast("array<string>"))
    return good.select("domain", "source_id", "problems").unionByName(rejects.select("domain", "source_id", "problems")).select(
        "domain", "source_id", F.array_join(F.array_sort("problems"), "|").alias("problems"))


@query("coerce_legacy_rows", with_(REC, """select ord, case when lang = 'en' then 'promote' else 'pending' end as decision,
  case when lang = 'fr' then 'defer' else 'review' end as recommendation, case when lang = 'de' then 0e0 else n_chars / 1e0 end as ranking_score,
  case when n_chars % 2 = 0 then published_year else 1 end as source_count,
  case when n_chars % 3 = 0 then 7 when n_chars % 2 = 0 then published_year else 1 end as record_count,
  case when lang = 'en' then 'pubmed' else 'other' end as source_types,
  case when full_text_availability = 'full-text-link' then 'unknown' else full_text_availability end as full_text_availability,
  lang = 'es' as stale_evidence from rec where doi is not null"""))
def coerce_legacy_rows(spark, sf):
    r = corpus.records(spark, sf).join(corpus.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang", "n_chars"), "ord")

    def by(lang: str, yes, no):
        return F.when(F.col("lang") == lang, yes).otherwise(no)

    null = F.lit(None).cast("string")
    raw = r.select(
        "ord", F.concat(F.lit("doi:"), "doi").alias("dedupe_key"), "title", "doi", "pmid", "pmcid", null.alias("title_key"),
        by("en", "promote", "maybe").alias("decision"), by("fr", "defer", "later").alias("recommendation"),
        by("de", F.lit("n/a"), F.col("n_chars").cast("string")).alias("ranking_score"),
        *[null.alias(c) for c in ("relevance_score", "authority_score", "source_diversity_score")],
        F.when(F.col("n_chars") % 2 == 0, F.col("published_year").cast("string")).otherwise("-1").alias("source_count"),
        F.when(F.col("n_chars") % 3 == 0, "7").otherwise("none").alias("record_count"),
        by("en", F.array(F.lit("pubmed"), F.lit("web")), F.array(F.lit("web"))).alias("source_types"),
        F.when(F.col("full_text_availability") == "full-text-link", "paywalled").otherwise(F.col("full_text_availability")).alias("full_text_availability"),
        by("es", "true", "maybe").alias("stale_evidence"), null.alias("reviewer_notes"), null.alias("decided_at"))
    out = validated.coerce_legacy_rows(raw)
    return out.select("ord", "decision", "recommendation", "ranking_score", "source_count", "record_count", pipe("source_types"),
                      "full_text_availability", "stale_evidence")


# -- sinks --------------------------------------------------------------------


@query("write_if_changed", with_(*CAND, """select 'first' as step, true as written, count(*) as rows, 1 as versions from cand
  union all select 'same', false, count(*), 1 from cand union all select 'changed', true, count(*), 2 from cand where record_count = 1"""))
def write_if_changed(spark, sf):
    target = fresh_path(spark, "versioned")
    rows = corpus.candidates(spark, sf).select("domain", "dedupe_key", "ranking_score", "record_count", "matched_keywords")
    table, out = sinks.VersionedTable(spark, target), []
    steps = {
        "first": rows.withColumn("generated_at", F.lit("2024-01-01")),
        "same": rows.repartition(5).withColumn("generated_at", F.lit("2024-02-02")),
        "changed": rows.where("record_count = 1").withColumn("generated_at", F.lit("2024-03-03")),
    }
    for step, frame in steps.items():
        written = sinks.write_if_changed(frame, target)
        out.append(table.read().agg(F.count("*").alias("rows")).select(
            F.lit(step).alias("step"), F.lit(written).alias("written"), "rows", F.lit(len(table.versions())).alias("versions")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("append_run_log", with_(REC, GATE, "select domain, run, count(*) filter (where keep) as kept from scored, (values ('a'), ('b')) as t(run) group by 1, 2"))
def append_run_log(spark, sf):
    path = fresh_path(spark, "run-log")
    for run in ("a", "b"):
        rows = corpus.gated(spark, sf).groupBy("domain").agg(F.count("*").alias("kept")).withColumn("run", F.lit(run))
        sinks.append_run_log(rows, path)
    return spark.read.parquet(path).select("domain", "run", "kept")


@query("snapshot_sink", with_(REC, """select domain, count(*) as n, sum(published_year) as years from rec where lang <> 'fr' group by 1
  union all select domain, count(*), sum(published_year + 1) from rec where lang = 'fr' group by 1"""))
def snapshot_sink(spark, sf):
    root = fresh_path(spark, "snapshots")
    rows = corpus.records(spark, sf).select("domain", "ord", "published_year")
    sinks.snapshot_sink(rows, root, "records")
    later = rows.where("domain = 'ovarian-tissue'").withColumn("published_year", F.col("published_year") + 1)
    return sinks.snapshot_sink(later, root, "records").groupBy("domain").agg(F.count("*").alias("n"), F.sum("published_year").alias("years"))


# -- streaming ----------------------------------------------------------------

_STREAM = (REC, GATE, candidates_sql("gated", DIVERSITY_SOURCES))


@query("incremental_import", with_(*_STREAM, f"select domain, dedupe_key, record_count, {joined('source_types')} as source_types, relevance_score from cand"))
def incremental_import(spark, sf):
    """Files land in two waves; each run picks up only what is new. Pages are generated in their order."""
    landing_dir, state, checkpoint = (fresh_path(spark, n) for n in ("stream-in", "stream-state", "stream-checkpoint"))
    record = F.struct(*_RECORD)
    blocks = corpus.records(spark, sf).groupBy("domain", "source", F.floor(F.col("ord") / PAGE).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", record.alias("r")))).alias("rs"))
    lines = blocks.select("domain", "source", "block", F.timestamp_seconds("block").alias("generated_at"),
                          F.transform("rs", lambda x: x.r).alias("records"))
    middle = lines.agg(F.max("block")).first()[0] // 2
    for wave in (lines.where(F.col("block") <= middle), lines.where(F.col("block") > middle)):
        wave.drop("block").write.mode("append").json(landing_dir)
        incremental.incremental_import(spark, landing_dir, state, checkpoint, REGISTRY).awaitTermination()
    out = incremental.current_candidates(spark, state)
    return out.select("domain", "dedupe_key", "record_count", pipe("source_types"), "relevance_score")


#: Ranking scores of recommendations, about the upper and the lower quarter.
_PROMOTE, _REVIEW = 11.0, 9.0
_TWICE = "doi is not null and pmid is not null"


#: Two waves of deliveries; what has a DOI and a PMID comes first without its DOI, then again with it.
_WAVES = f"""half as (select max(ord // {PAGE}) // 2 as middle from rec),
waves as materialized (select * replace (row_number() over (order by wave, source_id) as ord) from (
  select 1 as wave, * replace (case when {_TWICE} then null else doi end as doi) from gated where ord // {PAGE} <= (select middle from half)
  union all select 2, * from gated where ord // {PAGE} > (select middle from half) or ({_TWICE}))),
wave1 as (select * from waves where wave = 1)"""
_JUDGED = f"case when ranking_score >= {_PROMOTE}e0 then 'promote' when ranking_score >= {_REVIEW}e0 then 'review' else 'defer' end as recommendation"
_STATE_SQL = f"""prior as materialized (select *, case recommendation when 'promote' then 'promote' when 'defer' then 'reject' else 'pending' end as decision,
  case when recommendation <> 'review' then 'wave 1' end as reviewer_notes from (select *, {_JUDGED} from cand1)),
touched as (select distinct domain, dedupe_key from keyed2 where wave = 2),
judged2 as materialized (select *, {_JUDGED} from cand2 semi join touched using (domain, dedupe_key)),
p_hint as (select domain, ord, unnest({HINTS}) as hint from prior),
c_hint as (select domain, dedupe_key, unnest({HINTS}) as hint from judged2),
found as (select c.domain, c.dedupe_key, min(p.ord) as p_ord from c_hint c join p_hint p using (domain, hint) group by 1, 2),
again as (select c.domain, c.dedupe_key, c.recommendation, c.record_count, p.ord is not null and not ({SAME}) as stale_evidence,
    p.decision as before, p.reviewer_notes
  from judged2 c left join found f using (domain, dedupe_key) left join prior p on p.ord = f.p_ord and p.domain = f.domain)"""


@query(
    "incremental_decisions",
    with_(REC, GATE, _WAVES, renamed(candidates_sql("wave1", DIVERSITY_SOURCES), 1), renamed(candidates_sql("waves", DIVERSITY_SOURCES), 2), _STATE_SQL,
          """select domain, dedupe_key, recommendation, record_count, stale_evidence, reviewer_notes,
      case when stale_evidence and before <> 'pending' then 'pending' else coalesce(before, 'pending') end as decision from again
    union all select domain, dedupe_key, recommendation, record_count, false, reviewer_notes, decision from prior anti join touched using (domain, dedupe_key)"""),
)
def incremental_decisions(spark, sf):
    """Candidates of a first wave are reviewed; a second one brings new records, and others again under a stronger key."""
    landing_dir, state, checkpoint = (fresh_path(spark, n) for n in ("decide-in", "decide-state", "decide-checkpoint"))
    rows = corpus.records(spark, sf).withColumn("block", F.floor(F.col("ord") / PAGE))
    middle = rows.agg(F.max("block")).first()[0] // 2
    twice = F.col("doi").isNotNull() & F.col("pmid").isNotNull()
    first = rows.where(F.col("block") <= middle).withColumn("doi", F.when(~twice, F.col("doi")))

    def judge(candidates):
        score = F.col("ranking_score")
        return candidates.withColumn("recommendation", F.when(score >= _PROMOTE, "promote").when(score >= _REVIEW, "review").otherwise("defer"))

    def deliver(records):
        lines = records.groupBy("domain", "source", "block").agg(F.collect_list(F.struct(*_RECORD)).alias("records"))  # PAGE records at most
        lines.drop("block").write.mode("append").json(landing_dir)
        decisions.incremental_decisions(
            spark, landing_dir, state, checkpoint, REGISTRY, judge, within=("source_id",), baseline=DIVERSITY_SOURCES).awaitTermination()

    deliver(first)
    made = decisions.current_decisions(spark, state).where("recommendation <> 'review'")
    decisions.record_reviews(spark, state, made.select(
        "domain", "dedupe_key", F.when(F.col("recommendation") == "promote", "promote").otherwise("reject").alias("decision"),
        F.lit("wave 1").alias("reviewer_notes"), F.lit(None).cast("timestamp").alias("decided_at")))
    deliver(rows.where((F.col("block") > middle) | twice))
    return decisions.current_decisions(spark, state).select(
        "domain", "dedupe_key", "recommendation", "record_count", "stale_evidence", "reviewer_notes", "decision")


# -- registry and expressions -------------------------------------------------


@query("domain_registry", with_(REC, f"""select domain, count(*) as kept from (
  select 'sentinel' as domain, ord from rec where {sql.rx('lower(title)', '(?i)\\bthe\\b')}
    and {sql.rx_any('lower(title)', [words.phrase_pattern(p) for p in ('of', *(p for c in REGISTRY.shared.required_concepts for p in c.phrases))])}
  union all select domain, ord from rec where {sql.rx('lower(title)', '(?i)\\bislets?\\b')} and domain = 'islets'
    and {sql.rx_any('lower(title)', [words.phrase_pattern(p) for c in REGISTRY.required(REGISTRY.get('islets')) for p in c.phrases])}) group by 1"""))
def domain_registry(spark, sf):
    """A new domain is new rows: the registry is stored, extended and read back."""
    rows = REGISTRY.to_frame(spark).where("domain = 'islets' and kind <> 'template'")
    added = spark.createDataFrame(
        [("sentinel", "anchor", 0, "the", "the", None), ("sentinel", "required", 0, "of", "of", None)],
        "domain string, kind string, position int, label string, value string, weight double")
    registry = Registry.from_frame(rows.unionByName(added), REGISTRY.shared)
    r = corpus.records(spark, sf).select("ord", "domain", "title", F.lit(None).cast("string").alias("abstract"))
    both = r.where("domain = 'islets'").unionByName(r.withColumn("domain", F.lit("sentinel")))
    gated = match.candidate_gate(both, registry)
    return gated.groupBy("domain").agg(F.count("*").alias("kept"))


@query("array_set_ops", """with a as (select o_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) as x,
    list_sort(list_distinct(list(case when l_quantity > 25 then l_returnflag || l_linestatus else 'none' end))) as y
  from orders join lineitem on l_orderkey = o_orderkey group by 1)
  select o_orderkey, array_to_string(list_sort(list_filter(x, lambda v: list_contains(y, v))), '|') as both_sides,
    array_to_string(list_sort(list_distinct(list_concat(x, y))), '|') as either, array_to_string(list_sort(list_filter(x, lambda v: not list_contains(y, v))), '|') as left_only from a""")
def array_set_ops(spark, sf):
    code = F.concat("l_returnflag", "l_linestatus")
    # few distinct codes: the sets stay small whatever the number of lines
    rows = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(code).alias("x"), F.collect_set(F.when(F.col("l_quantity") > 25, code).otherwise("none")).alias("y"))
    orders = corpus.table(spark, sf, "orders").select("o_orderkey")

    def text(col):
        return F.array_join(F.array_sort(col), "|")

    return rows.join(orders, "o_orderkey").select(
        "o_orderkey", text(F.array_intersect("x", "y")).alias("both_sides"), text(F.array_union("x", "y")).alias("either"),
        text(F.array_except("x", "y")).alias("left_only"))


@query("distinct_ordered", """with w as (select item_id, trim(u.v) as v, min(u.i) as i from (select item_id, unnest(string_split(text, ' ')) as v,
    generate_subscripts(string_split(text, ' '), 1) as i from benchmark) u where trim(u.v) <> '' group by 1, 2)
  select item_id, string_agg(v, ' ' order by i) as first_seen, string_agg(v, ' ' order by v) as sorted from w group by 1""")
def distinct_ordered(spark, sf):
    tokens = F.split("text", " ")
    return corpus.table(spark, sf, "benchmark").select(
        "item_id", F.array_join(arrays.distinct_ordered(tokens), " ").alias("first_seen"),
        F.array_join(arrays.distinct_sorted(tokens), " ").alias("sorted"))


@query("identity_keys", with_(REC, """select ord, list_count(list_distinct(list_filter(['doi:' || lower(doi), 'pmid:' || pmid, 'pmcid:' || pmcid, 'title:' || t],
    lambda x: x is not null))) as hints, 'title:' || t as title_key, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug,
  coalesce('doi:' || lower(doi), 'pmid:' || pmid, 'pmcid:' || pmcid, 'title:' || t) as dedupe_key
  from (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as t from rec)"""))
def identity_keys(spark, sf):
    ids = [F.col(c) for c in ("doi", "pmid", "pmcid", "title")]
    return corpus.records(spark, sf).select(
        "ord", F.size(keys.identity_hints(*ids)).alias("hints"), words.title_key(F.col("title")).alias("title_key"),
        words.slug(F.col("title")).alias("slug"), keys.dedupe_key(*ids).alias("dedupe_key"))


@query("markup_strip", "select page_id, md5(coalesce(nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ''), '')) as text_md5, "
       "regexp_replace(url, '(?i)^https?://doi\\.org/', '') as url from pages")
def markup_strip(spark, sf):
    return corpus.table(spark, sf, "pages").select(
        "page_id", F.md5(F.coalesce(words.strip_markup(F.col("html")), F.lit("")).cast("binary")).alias("text_md5"),
        words.doi_bare(F.col("url")).alias("url"))


@query("json_counts", """select event_type, cast(json_extract(props, '$.k') as integer) // 25 as bucket, count(*) as n,
  sum(cast(json_extract(props, '$.k') as integer)) as total from events group by 1, 2""")
def json_counts(spark, sf):
    k = F.from_json("props", "k int").k
    return corpus.table(spark, sf, "events").groupBy("event_type", F.floor(k / 25).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(k).alias("total"))

