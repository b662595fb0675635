"""Order MinHash against the same method in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayer.llm import fingerprint as fp
from assayer.llm import queries

from .cases import SF, awkward, smallest, table


def next_rows(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    return {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}


def edited(text, following):
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def test_neighbours_and_edits(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)
    rnd = random.Random(1)
    rows = [(rnd.randrange(-50, 500), f"word{i} " * rnd.randrange(9)) for i in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values()) + [(None, "z no id"), (None, None), (7000, "日本語 text é"), (7001, "")]
    follows = next_rows(rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited) for r in fp.edited_with_next(table(spark, rows)).collect())
    want = sorted((i is not None, i or 0, len(t or ""), edited(t or "", rows[follows[k]][1] or "")) for k, (i, t) in enumerate(rows))
    assert got == want


def test_awkward_rows(spark):
    rows = awkward()
    got = fp.edited_with_next(table(spark, rows)).collect()
    assert len(got) == len(rows)
    same = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == fp.SKETCHES
    plain = [tuple(r.fingerprint) for r in got if r.n_chars == len("plain words here")]
    assert len(plain) == 3 and len(set(plain)) == 1
    assert not same and fp.edited_with_next(table(spark, [])).count() == 0
    (one,) = fp.edited_with_next(table(spark, [(1, "a b c d e f g h")])).collect()
    assert one.near_next == 1.0


def test_occurrences_are_numbered(spark):
    """Elements of a text: distinct (k-mer, number) pairs, in text order."""
    text = "a b c a b c a b c a b c x"
    df = spark.createDataFrame([(text,), ("a b c x",)], "text string")
    one, two = (r[0] for r in df.select(fp.fingerprint(F.col("text"), sketches=64)).collect())
    # with a set of k-mers these two would share most; the repeats are elements of their own
    assert sum(a == b for a, b in zip(one, two)) < 32


def test_sketches_follow_the_definition(spark):
    """The selected elements are those with the smallest hashes, in text order."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab cd ef".split()) for _ in range(rnd.randrange(1, 40))) for _ in range(12)] + ["", "one", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: list(r.f) for r in df.select("i", fp.fingerprint(F.col("text"), sketches=4).alias("f")).collect()}
    mask, keep = (1 << 28) - 1, ~((1 << 28) - 1)

    def h(*values):
        kinds = ["string" if isinstance(v, str) else "int" if k == "int" else "bigint" for v, k in values]
        args = ", ".join("cast(null as string)" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as {k})" for (v, _), k in zip(values, kinds))
        return f"xxhash64({args})"

    def evaluate(exprs):
        return list(spark.sql("select array(" + ", ".join(exprs) + ") a").first()["a"]) if exprs else []

    for i, text in enumerate(texts):
        w = text.split()
        grams = [[w[p + j] if p + j < len(w) else None for j in range(3)] for p in range(max(len(w) - 3, 0) + 1)]
        raw = evaluate([h(*[(x, "s") for x in g]) for g in grams])
        packed = sorted((x & keep) | p for p, x in enumerate(raw))
        number, calls = {}, []
        for v in packed:
            key = v >> 28
            n = number.get(key, 0)
            number[key] = n + 1
            calls.append(h((key, "l"), (n, "int")))
        elements = [(x & keep) | (v & mask) for x, v in zip(evaluate(calls), packed)]
        for j, start in enumerate(fp._rotations(4)):
            # smallest after subtracting the constant, around the circle of 64-bit hashes
            turned = sorted(elements, key=lambda e: (e - start - 1) % (1 << 64))
            chosen = sorted((turned * 2)[:2], key=lambda e: e & mask)
            call = f"xxhash64(cast({chosen[0] >> 28} as bigint), cast({chosen[1] >> 28} as bigint))"
            assert got[i][j] == evaluate([call])[0], (i, j)


def test_likeness_falls_with_edits_and_order(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(3000)}" for _ in range(600)]
    few = list(words)
    for _ in range(6):
        few[rnd.randrange(600)] = "edit"
    many = [w if rnd.random() > 0.3 else "other" for w in words]
    turned = words[300:] + words[:300]
    later = ["one", "more", "start"] + words
    df = spark.createDataFrame([(" ".join(x),) for x in (words, few, many, turned, later)], "t string")
    f = [r[0] for r in df.select(fp.fingerprint(F.col("t"), sketches=64)).collect()]
    like = [sum(a == b for a, b in zip(f[0], x)) / 64 for x in f]
    assert like[0] == 1 and like[1] > 0.8 and like[2] < 0.3 and 0.3 < like[3] < 0.75 and like[4] > 0.9


def test_op6_whole_table(spark):
    docs = smallest()
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    follows = next_rows(rows)
    got = {r.doc_id: r for r in queries.op6(spark, SF).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited(t, rows[follows[k]][1]).encode()).hexdigest()
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        nxt = got[rows[follows[k]][0]].fingerprint
        pairs = [(got[i].fingerprint[x : x + 16], nxt[x : x + 16]) for x in range(0, len(nxt), 16)]
        assert got[i].near_next == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    long = [r for r in got.values() if r.n_chars > 800]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_plan_is_native(spark):
    plan = fp.edited_with_next(table(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
