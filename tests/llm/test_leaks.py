"""Benchmark leaks: block-max WAND against scoring every item, and planted passages."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from assayer.llm import leaks, queries

from .cases import SF, awkward, smallest, table


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, score string")


def words(rnd, n, size=600):
    return [f"w{int(size ** rnd.random())}" for _ in range(n)]  # frequent and rare ones


def exhaustive(items, text, threshold):
    """(passage, item text) at or above the threshold, by BM25 over all items."""
    docs = [leaks.words_of(t) for t in items]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1

    def weight(w, d):
        tf = d.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))

    longest = max(map(len, docs))
    own = leaks.words_of(text)
    out = set()
    for p in range(-(-len(own) // leaks.STRIDE)):
        passage = set(own[p * leaks.STRIDE : p * leaks.STRIDE + leaks.STRIDE + longest])
        for item, d in zip(items, docs):
            score = sum(weight(w, d) for w in set(d) & passage) / sum(weight(w, d) for w in set(d))
            if score >= threshold:
                out.add((p, item, round(score, 6)))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_wand_retrieves_what_scoring_everything_does(spark, threshold):
    rnd = random.Random(1)
    items = [" ".join(words(rnd, rnd.randrange(3, 60))) for _ in range(60)]
    items = list(dict.fromkeys(items))
    (index,) = leaks.indexes(bench(spark, list(enumerate(items))))
    for _ in range(25):
        text = words(rnd, rnd.randrange(1, 700))
        if rnd.random() < 0.7:
            at = rnd.randrange(len(text))
            text[at:at] = rnd.choice(items).split()
        ids = np.array([index.terms.get(w, -1) for w in text])
        got = {(p, index.texts[i], round(s, 6)) for p, i, s in index.search(ids, threshold)}
        assert got == exhaustive(items, " ".join(text), threshold)


def test_planted_and_clean(spark, monkeypatch):
    monkeypatch.setattr(leaks, "INDEX_WORDS", 300)  # several blocks of the index
    rnd = random.Random(2)
    items = [(i, " ".join(words(rnd, 25, 3000)).capitalize() + ". " + " ".join(words(rnd, 10, 3000)) + ".") for i in range(40)]
    rows, want = [], set()
    for d in range(60):
        text = words(rnd, rnd.randrange(50, 900), 3000)
        if d % 2:
            at = rnd.randrange(len(text))
            planted = items[d % 40][1].split()
            if d % 4 == 1:
                planted[5] = "changed"
            text[at:at] = [w.upper() for w in planted]
            want.add((d, d % 40))
        rows.append((d, " ".join(text)))
    found = leaks.find_leaks(table(spark, rows), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    kept = leaks.drop_leaks(table(spark, rows), bench(spark, items))
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows if d % 2 == 0}


def test_half_an_item_is_no_leak(spark):
    rnd = random.Random(3)
    question, answer = " ".join(f"q{i}" for i in range(20)), " ".join(f"a{i}" for i in range(12))
    items = [(1, f"{question}. {answer}."), (2, "one two"), (3, " ".join(f"z{i}" for i in range(9)))]
    fill = " ".join(words(rnd, 100))
    rows = [(1, f"{fill} {question} {fill}"), (2, f"{fill} {answer}"), (3, f"{question} {answer}"), (4, "two one"), (5, "ONE, two!"), (6, items[2][1])]
    found = leaks.find_leaks(table(spark, rows), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(3, 1), (5, 2), (6, 3)}


def test_awkward_rows(spark):
    rows = awkward()
    items = [(1, "plain words here"), (2, None), (None, "plain words here"), (3, ""), (4, "?!"), (5, "日本語 test item")]
    found = leaks.find_leaks(table(spark, rows), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (5, 1), (5, 1)]
    assert leaks.find_leaks(table(spark, []), bench(spark, items)).count() == 0
    assert leaks.find_leaks(table(spark, rows), bench(spark, [])).count() == 0
    assert leaks.drop_leaks(table(spark, rows), bench(spark, [])).count() == len(rows)


def test_op2_whole_table(spark):
    import pandas as pd

    docs, items = smallest(), pd.read_parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in queries.op2(spark, SF).collect()}
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, q in zip(items.item_id, items.text) if q in t}
    assert exact and exact <= found
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, leaks.words_of(t)) for i, t in zip(items.item_id, items.text))}
    texts = dict(zip(docs.doc_id, docs.text))
    for d, i in found - exact:  # nothing without most of the item's words in a row
        w = leaks.words_of(texts[d])
        held = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        assert len(grams[i] & held) >= 0.5 * len(grams[i])
