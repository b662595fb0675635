"""What the extraction spares must not change what it finds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assayer.config import default_registry
from assayer.functions import text
from assayer.operators import extract
from assayer.queries import corpus
from assayer.queries.vocabulary import TERMS

REGISTRY = default_registry()


def _plain(pattern: str) -> str:
    """The pattern with every boundary as a look-around on the spot."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def test_a_place_without_the_first_character_costs_one_test(spark):
    shared = REGISTRY.shared
    patterns = [shared.vitrification, shared.slow_freezing, shared.stepwise, *shared.review_patterns, *shared.experimental_patterns,
                *[p for d in REGISTRY.domains for s in d.specimens for p in (s.pattern,)], r"\beggs?\b|\bx|a", r"\b\d+ h\b", r"\ba?b"]
    assert text.compile_pattern(shared.vitrification).startswith("(?i)v")
    assert text.compile_pattern(shared.slow_freezing).startswith("(?i)(?=[s])")
    said = ["Vitrified", "devitrified vitrif", "_vitrif é", "évitrif", "Slow freezing.", "slow  freezing", "preview review_ review", "This study", "eggs egg",
            "beggs", "12 h", "x12 h", "Islets islet", "we used", "sequentially", "", "a b"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").orderBy("i")
    tests = [p for pattern in patterns for p in (text.compile_pattern(pattern), _plain(pattern))]
    for row in df.select(*[F.col("t").rlike(p).alias(str(k)) for k, p in enumerate(tests)]).collect():
        assert list(row[::2]) == list(row[1::2])


def test_sentences_of_odd_white_space(spark):
    said = ["A b.  C d!\n\nE? f", " lead. tail. ", "a  b.\tc", "a.   b", "no end", ".", "", "x.y z. ", "\n", "a .b . c"]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    for row in rows:
        flat = re.sub("[ \t\n\x0b\x0c\r ]+", " ", row.t)
        assert row.s == [x for x in (p.strip(" ") for p in re.split(r"(?<=[.!?])[ \t]+", flat)) if x], row.t


def test_a_family_is_quoted_from_wherever_it_stands(spark):
    late = "Plain words here. " * 200 + "Then vitrification came. More."
    rows = spark.createDataFrame([(1, "T", late), (2, "T", "Vitrified early. " + late), (3, "T", "no end " * 400 + "slow cooling")], "i int, title string, abstract string")
    found = {r.i: (r.f.family, r.f.evidence) for r in rows.select("i", extract.protocol_family(F.col("title"), F.col("abstract"), REGISTRY).alias("f")).collect()}
    assert found[1] == ("vitrification", ["Then vitrification came."])
    assert found[2] == ("vitrification", ["Vitrified early."])
    assert found[3][0] == "slow-freezing" and found[3][1][0].endswith("no end slow cooling")


def test_subject_text_swaps_whole_words_of_any_case(spark):
    words = ["That", "thatx", "IT", "Khe", "İt", "", "the\nthat", "that"]
    rows = [(lang, " ".join([*words, *terms])) for lang, terms in TERMS.items()] + [(None, "that it"), ("xx", "that it"), ("en", None)]
    for row in spark.createDataFrame(rows, "lang string, t string").select("*", corpus.subject_text("t").alias("s")).collect():
        terms = TERMS.get(row.lang, {})
        assert row.s == (None if row.t is None else " ".join(terms.get(w.lower(), w) for w in row.t.split(" ")))


def test_curated_records_move_no_text(spark, tmp_path):
    """The curated layer reads titles; whole texts must not go through a shuffle for it, nor be swapped word by word."""
    docs = [(i, f"that was {i}\nit for " + "that " * 50, "en", f"src{i % 20}", 10) for i in range(8)] + [(8, "it for", "en", "src1", 5), (9, None, "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (0, 3, 3, 8, 9, 77)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus.enrichment(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.title) for r in rows] == [(0, "islets pancreatic islets 0"), (3, "islets pancreatic islets 3"), (3, "islets pancreatic islets 3"),
                                                (8, "cryopreservation freezing"), (9, None)]
    made = corpus.provider_records(corpus.table(spark, str(tmp_path), "documents")).select("title")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_dictionary_is_looked_at_only_under_its_bits():
    d = REGISTRY.domains[0]
    patterns = text.PatternSet(extract._sentence_patterns(d, REGISTRY))
    assert patterns.touched("s.m", [r"[0-9]"]) == "true"
    facts = extract._sentence_facts(d, REGISTRY, patterns)
    assert patterns.touched("s.m", [text.alias_pattern(a) for c in REGISTRY.chemicals(d) for a in c.aliases]) in facts
