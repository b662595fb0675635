from __future__ import annotations

import math
import random

import numpy as np
import pytest

from assayer.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, a int, b int, place int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def brute(rows):
    whole = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    seen = []
    for k, (anchor, v, label) in enumerate(whole):
        if anchor is None or anchor % 100 or (anchor, v, label) in seen:
            continue
        seen.append((anchor, v, label))
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in whole]
        last = lambda i: (whole[i][0] is None, whole[i][0] or 0)
        order = sorted(range(len(whole)), key=lambda i: (-score[i], last(i)))
        for p in [i for i in order if whole[i][2] == label and i != k][:5]:
            fit = [i for i in order if whole[i][2] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(anchor, whole[p][0], r, whole[i][0], score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    return sorted((tuple(r) for r in negatives.mine(frame(spark, rows)).collect()), key=repr)


def random_rows(n, width=70, seed=1, spread=0.1):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [m * spread + rnd.gauss(0, spread) for m in rnd.choice(middle)], rnd.randrange(10)) for i in range(n)]


def test_products_are_exact():
    rnd = np.random.default_rng(0)
    for width, top in ((1, 3), (64, 255), (300, 90_000), (1000, 2**20)):
        a, b = rnd.integers(-top, top + 1, (5, width)), rnd.integers(-top, top + 1, (7, width))
        a[0], b[0], b[1] = top, top, -top
        assert (negatives.scores(a, b, negatives.primes_for(float(width) * top * top)) == a @ b.T).all()


def test_scores_that_fit_nowhere_are_refused():
    with pytest.raises(ValueError):
        negatives.primes_for(2.0**60)


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    rows = random_rows(420)
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "TILE", 100)
    assert mined(spark, rows) == brute(rows) != []


def test_awkward_rows(spark):
    rows = random_rows(130, 8) + [
        (1000, None, 1), (1001, [0.1] * 8, None), (1100, [float("nan")] * 8, 2), (1200, [float("inf")] * 8, 2), (1300, [None] * 8, 2),
        (1400, [], 3), (1500, [0.5], 3), (None, [0.2] * 8, 4), (None, [0.2] * 8, 5), (-100, [0.3] * 12, 4), (-7, [0.3] * 8, -1),
    ]
    assert mined(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark):
    same = [0.25, -0.5, 0.75]
    rows = [(i, same, i % 2) for i in range(0, 260, 10)] + [(i, same, 3) for i in range(400, 403)] * 2 + [(100, same, 0)] * 2 + [(100, [0.3, -0.5, 0.7], 0)]
    assert mined(spark, rows) == brute(rows) != []


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_query_matches_reference_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op13(spark, sf)
    want = con.execute(queries.HARD_NEGATIVES_SQL)
    names = [c[0] for c in want.description]
    assert names == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall()) != []
