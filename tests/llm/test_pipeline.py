"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from assayer.llm import leaks, secrets, toxicity

from .cases import SF, awkward, table
from .test_jaccard import brute
from .test_secrets import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_stages_are_named_in_order_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "bpe_encoding"
    ]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def kept_of_groups(rows):
    """One row of each component: that with the smallest id."""
    out, seen = [], {}
    for doc, size, component in brute(rows):
        seen[doc] = (size, component)
    for doc, text in rows:
        size, component = seen[doc or -1]
        if not size or doc == component:
            out.append((doc, text))
    return sorted(out)


def test_whole_table_stage_by_stage(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")

    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, labels)
    assert rows_of(clean) == [x for x in rows_of(docs) if toxicity.text_score(x[1], model) < 0.5]
    assert clean.columns == COLUMNS and clean.count() < docs.count()

    single = stages["ngram_jaccard_join"](spark, clean, SF).cache()
    assert rows_of(single) == kept_of_groups(rows_of(clean))
    assert single.columns == COLUMNS and single.count() < clean.count()

    apart = stages["benchmark_decontamination"](spark, single, SF).cache()
    gone = set(rows_of(single)) - set(rows_of(apart))
    held = {x for x in rows_of(single) if any(t in x[1] for t in items.text)}
    assert held <= gone and apart.columns == COLUMNS
    words = [set(zip(w, w[1:], w[2:])) for w in map(leaks.words_of, items.text)]
    for _, text in gone - held:  # most of an item, if not word for word
        own = leaks.words_of(text)
        grams = set(zip(own, own[1:], own[2:]))
        assert max(len(w & grams) / len(w) for w in words if w) >= 0.5

    safe = stages["secret_scans"](spark, apart, SF).cache()
    assert rows_of(safe) == sorted((i, secrets.redacted(t)) for i, t in rows_of(apart))
    assert not any(plain(t) for _, t in rows_of(safe)) and safe.columns == COLUMNS
    assert all(r.n_chars == len(r.text) for r in safe.collect())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows_of(safe):
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    coded = stages["bpe_encoding"](spark, safe, SF)
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == want
    result = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert result == want


def written(spark, tmp_path, rows):
    root = str(tmp_path)
    table(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "no such words"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_awkward_rows_pass_through(spark, tmp_path):
    rows = awkward([(20, "plain words here"), (None, "plain words here"), (None, "alone without an id")])
    root = written(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    single = corpus_pipeline.drop_near_copies(spark, docs, root)
    assert single.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in single.collect()), key=repr)
    # texts without a word all stay; of the copies the one with the smallest id stays
    wordless = [x for x in rows if not (x[1] or "").split()]
    assert [x for x in kept if not (x[1] or "").split()] == sorted(wordless, key=repr)
    assert [i for i, t in kept if t == "plain words here"] == [1]
    assert [i for i, t in kept if t == "alone without an id"] == [None]
    out = corpus_pipeline.run(spark, root)
    assert out.count() == len(kept)


def test_empty_tables(spark, tmp_path):
    root = written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, root).count() == 0


def test_same_id_in_one_group_and_in_two(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base), (5, base), (5, base + " end"), (5, "something else entirely in other words"), (9, base)]
    kept = sorted(r.text for r in corpus_pipeline.drop_near_copies(spark, table(spark, rows), "").collect())
    assert len(kept) == 2 and kept[0] == "something else entirely in other words" and kept[1] in (base, base + " end")


def test_columns_named_like_the_stages_own_keep_their_values(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, 111, "a"), (2, text, 222, "b"), (3, "something else altogether in here", 333, "c"), (4, None, 444, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hash long, _ID string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3]]
