from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from assayer.llm import queries, spelling
from assayer.llm.spelling import LETTERS

from .cases import awkward, smallest, table


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    wild = {}  # words that agree but for one place, or one letter more
    for w in n:
        for i in range(len(w)):
            for key in ((w[:i], "?", w[i + 1 :]), w[:i] + w[i + 1 :]):
                wild.setdefault(key, set()).add(w)
    links = {w: set() for w in n}
    for w in n:
        for key in [(w[:i], "?", w[i + 1 :]) for i in range(len(w))] + [w[:i] + w[i + 1 :] for i in range(len(w))] + [w]:
            links[w] |= {v for v in wild.get(key, ()) if near(w, v)}
        for key in {w[:i] + w[i + 1 :] for i in range(len(w))} & set(n):
            links[w].add(key)
            links[key].add(w)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows, **more):
    return sorted(tuple(r) for r in spelling.group_variants(table(spark, rows), **more).collect())


def variants(seed=2, words=60, docs=400):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(6, 12))) for _ in range(words)]
    rows = []
    for doc in range(docs):
        text = []
        for w in rnd.choices(base, weights=[1 / (i + 1) for i in range(words)], k=40):
            while rnd.random() < 0.15:
                i = rnd.randrange(len(w) + 1)
                w = rnd.choice([w[:i] + rnd.choice("abcÿ×é") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyzà") + w[i + 1 :]])
            text.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((doc, rnd.choice([" ", ", ", "1", "Ā"]).join(text)))
    return rows


def test_matches_brute_force(spark):
    rows = variants()
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)


def test_many_small_filters(spark):
    rows = variants(5, docs=60)
    assert found(spark, rows, limit=256) == brute(rows)


def test_awkward_texts(spark):
    long = "abcdefgh" * 900
    rows = awkward([(20, f"{long} {long}"), (21, f"{long[:-1]} {long[:-1]}"), (22, "ÀÉÎÕÜØÞ " * 3), (23, "àÉÎÕÜØÞ " * 40), (None, "nameless " * 3)])
    got = found(spark, rows)
    assert got == brute(rows)
    assert any(len(r[0]) > 7000 and r[4] for r in got)


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short words only"), (3, "onceonly")]) == []


def test_chains_of_forms(spark):
    rows = [(10**6, " ".join(["zyxwvuts"] * 4000 + ["zyxwvutr"] * 300 + ["zyxwvuar"] * 20 + ["zyxwvbar"] * 2))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert max(len(r[2]) for r in got) and len({r[2] for r in got if r[0].startswith("zyxwv")}) < len(got)


def test_every_edit_is_generated_once_between_two_words():
    """Filters let all pass: each near pair has exactly one side that generates the other."""
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 8))) for _ in range(60)})
    layout = spelling.Layout(dict(Counter(map(len, words))), 1 << 20)
    full = np.full((layout.size, spelling.LANES), np.uint64(2**64 - 1))
    made = Counter()
    for length in {len(w) for w in words}:
        own = [w for w in words if len(w) == length]
        made.update((own[i], e) for i, e in spelling.edits(own, layout, full, 0))
    assert max(made.values()) == 1
    for a in words:
        for b in words:
            if a < b:
                assert made[a, b] + made[b, a] == near(a, b)


def test_hash_of_an_edit_is_the_hash_of_its_text():
    words = ["abcdéfgh", "zzzzzzzz"]
    h = spelling.hashes(spelling.codes(words))
    assert len(set(h)) == 2 and LETTERS[0] == "a" and LETTERS[-1] == "ÿ" and len(LETTERS) == 90


def test_query_over_the_whole_table(spark):
    docs = smallest()
    got = sorted(tuple(r) for r in queries.op12(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(list(zip(docs.doc_id, docs.text)))
