"""Importance resampling against plain sums; toxicity by held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from assayer.llm import quality, queries, toxicity

from .cases import SF, awkward, smallest, table

MEDIUM = "/root/testdata/sf0.01"


def test_log_weights_are_sums_over_ngrams(spark):
    rows = awkward()
    good = ["plain words here and there", "plain words"]
    target = spark.createDataFrame([(t,) for t in good], "text string")
    docs = table(spark, rows)
    ratios = quality.log_ratios(quality.counted(target), quality.counted(docs.select("text")))
    t = Counter(b for x in good for b in quality.buckets(x).tolist())
    r = Counter(b for _, x in rows for b in quality.buckets(x).tolist())
    tn, rn = sum(t.values()) + quality.BUCKETS, sum(r.values()) + quality.BUCKETS
    for b in [*t, *list(r)[:50]]:
        assert ratios[b] == pytest.approx(math.log((t[b] + 1) / tn) - math.log((r[b] + 1) / rn))
    got = sorted((x.doc_id or -1, x.n_features, round(x.log_weight, 2)) for x in quality.weigh(docs, ratios).collect())
    want = sorted((i or -1, len(quality.buckets(x)), round(float(sum(ratios[b] for b in quality.buckets(x))), 2)) for i, x in rows)
    assert got == want


def test_buckets_hold_unigrams_and_bigrams():
    assert len(quality.buckets("a b c")) == 5 and len(quality.buckets("a")) == 1 and len(quality.buckets(None)) == 0
    assert set(quality.buckets("x y").tolist()) & set(quality.buckets("z x y").tolist()) >= set(quality.buckets("x").tolist())


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_highest(spark, k):
    rnd = random.Random(k)
    values = [rnd.gauss(0, 10 ** rnd.randrange(-5, 6)) for _ in range(700)] + [0.0, -0.0, 1.5] * 100
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_highest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_sample_is_gumbel_top_k(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("good fine plain".split() if i % 3 else "junk %%% ***".split()) for _ in range(20))) for i in range(300)]
    docs = table(spark, rows)
    target = docs.where("doc_id % 3 <> 0 and doc_id < 100").select("text")
    got = quality.resample(docs, target, keep=0.6).collect()
    ratios = quality.log_ratios(quality.counted(target), quality.counted(docs))
    every = sorted(((r.key, r.doc_id) for r in quality.weigh(docs, ratios).collect()), reverse=True)
    assert {r.doc_id for r in got} == {i for _, i in every[:180]} and len(got) == 180
    assert sum(r.doc_id % 3 == 0 for r in got) == 0


def test_noise_is_gumbel(spark):
    x = np.array([r.g for r in spark.range(20000).select(quality.gumbel("id", 5).alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - math.pi**2 / 6) < 0.1


def test_resampling_awkward_rows(spark):
    rows = awkward()
    docs = table(spark, rows)
    none = spark.createDataFrame([], "text string")
    assert quality.resample(docs, docs.where("doc_id = 1").select("text"), keep=1.0).count() == len(rows)
    assert quality.resample(docs, none, keep=0.5).count() >= len(rows) // 2
    assert quality.resample(table(spark, []), none).count() == 0
    assert quality.resample(docs, none, keep=0.0).count() == 0


def test_op8_keeps_clean_documents(spark):
    got = {r.doc_id for r in queries.op8(spark, MEDIUM).collect()}
    labels = pd.read_parquet(f"{MEDIUM}/labels.parquet")
    good = labels[labels.quality == 1].doc_id.isin(got).mean()
    bad = labels[labels.quality == 0].doc_id.isin(got).mean()
    assert len(got) == 800 and good > 0.85 and bad < good - 0.4, (good, bad)


def test_label_model_finds_the_classes_and_joins_copies():
    rnd = np.random.default_rng(1)
    n = 20000
    y = rnd.random(n) < 0.15
    masks = np.zeros(n, dtype=np.int64)
    for j in range(6):
        masks |= (rnd.random(n) < np.where(y, 0.5, 0.002)).astype(np.int64) << j
    noise = rnd.random(n) < 0.1  # two voters that copy each other and know nothing
    masks |= (noise.astype(np.int64) << 12) | (noise.astype(np.int64) << 13)
    held, back, counts = np.unique(masks, return_inverse=True, return_counts=True)
    told = np.arange(n) < 1000  # a few labels say which class is which
    on, off = (np.bincount(back[told & (y == v)], minlength=len(held)) for v in (True, False))
    post = toxicity.label_model(held, counts, on, off)[back]
    assert ((post > 0.5) == y).mean() > 0.96
    assert np.corrcoef(post, noise)[0, 1] < 0.1


def test_features():
    terms = ("idiot", "lowe*", "über*")
    assert toxicity.features("Idiot! lowered idiots", terms)[0] == {0, 1}
    assert toxicity.features("idiots flowers ÜBERALL", terms)[0] == {2}
    assert toxicity.features("", terms)[0] == set() and toxicity.features("x", ())[0] == set()
    assert toxicity.features("YOU ARE SUCH BAD FOLK!!", terms)[1][:3] == [True, True, True]


def test_awkward_rows(spark):
    rows = awkward([(100 + i, f"some plain text {i} " + ("you vile toad" if i % 4 == 0 else "good day")) for i in range(200)])
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), "x") for i in range(200)] + [(None, 1, "x"), (1, None, "x")], "doc_id long, toxic int, score string")
    model = toxicity.fit(table(spark, rows), labels)
    assert any(t.rstrip("*") in ("vile", "toad") for t in model.terms)
    got = toxicity.score(table(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if (r.doc_id or 0) >= 100)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.score(table(spark, []), model).count() == 0
    none = toxicity.fit(table(spark, rows), labels.where("false"))
    assert {r.score for r in toxicity.score(table(spark, rows), none).collect()} == {0.0}
    kept = toxicity.reject(table(spark, rows), model)
    assert kept.columns == table(spark, rows).columns and kept.count() == len(rows) - 50


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, f"plain text {i} " + ("vile" if i % 3 == 0 else "fine")) for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(table(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b


def test_op9_held_out_accuracy(spark):
    got = queries.op9(spark, "/root/testdata/sf0.1").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    m = got[got.held_out].merge(labels, on="doc_id")
    assert len(got) == 10000 and (m.predicted == m.toxic).mean() > 0.95
    pos, neg = m[m.toxic == 1].score.to_numpy(), m[m.toxic == 0].score.to_numpy()
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.9, auc


def test_rows_without_an_id_draw_for_themselves(spark):
    rows = [(None, f"text number {i}") for i in range(1000)]
    none = table(spark, []).select("text")
    assert quality.resample(table(spark, rows), none, keep=0.5).count() == 500


def test_all_good_texts_are_the_target(spark):
    docs = table(spark, [(i, f"t{i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.text for r in quality.target_of(docs, labels).collect()) == sorted(f"t{i}" for i in range(1, 50, 2))
