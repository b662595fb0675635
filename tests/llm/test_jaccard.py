"""The similarity join against all pairs, and PartEnum's promise for single pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import jaccard, queries

from .cases import SF, awkward, smallest, table


def sets(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=80):
    """(doc_id, size, component) by comparing every pair that shares a shingle."""
    own = [sets(t) for _, t in rows]
    where, parent = {}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = {}
    for i, s in enumerate(own):
        for x in s:
            for j in where.setdefault(x, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            where[x].append(i)
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(own[i]) + len(own[j]) - n):
            parent[root(j)] = root(i)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((d or -1, len(s), -1 if (c := low.get(root(i)) if s else d) is None else c) for i, ((d, _), s) in enumerate(zip(rows, own)))


def checked(df, rows, percent=80):
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())
    assert got == brute(rows, percent)


def noisy(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rnd.randrange(3), rnd.randrange(len(words))
        if kind == 0:
            words[at] = f"e{rnd.randrange(99999)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{rnd.randrange(99999)}")
    return words


def test_pairs_at_the_threshold_share_a_signature():
    rnd = random.Random(1)
    found = 0
    for _ in range(3000):
        n = rnd.choice([4, 5, 6, 7, 9, 12, 16, 20, 30, 50, 70, 72, 80, 130, 300, 700])
        both = rnd.sample(range(10**9), n)
        extra = n * 20 // 80  # as many other elements as a link allows
        a, b = set(both), set(both)
        for x in rnd.sample(range(2 * 10**9, 3 * 10**9), extra):
            (a if rnd.random() < rnd.choice([0, 0.5, 1]) else b).add(x)
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        found += 1
        import numpy as np

        ea, eb = (np.sort(jaccard._mixed(np.array(sorted(s), dtype=np.uint64), 5)) for s in (a, b))
        sa, sb = dict(jaccard.signatures(ea)), dict(jaccard.signatures(eb))
        met = [x for x in sa if x in sb and len(np.intersect1d(sa[x], sb[x]))]
        assert met, (len(a), len(b), len(a & b))
        x, y = (np.frombuffer(jaccard.sketch(e, met[0]), np.uint64) for e in (ea, eb))
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)
    assert found > 1000


@pytest.mark.parametrize("percent", [80, 60])
def test_near_copies(spark, percent):
    rnd = random.Random(percent)
    rows, i = [], 0
    for size in (5, 6, 8, 10, 12, 20, 40, 80, 200, 500):
        for _ in range(4):
            base = [f"w{rnd.randrange(4000)}" for _ in range(size)]
            for _ in range(6):
                rows.append((i, " ".join(noisy(rnd, base, rnd.randrange(1 + size // 25 + 2)))))
                i += 1
    rnd.shuffle(rows)
    checked(jaccard.similar(table(spark, rows), percent), rows, percent)


def test_awkward_rows(spark):
    rows = awkward([(30, "PLAIN words\there"), (31, "É a b c d e"), (32, "é a b c d e"), (33, "a b c d"), (34, "a  b\nc d"), (None, "a b c d")])
    checked(jaccard.similar(table(spark, rows)), rows)
    assert jaccard.similar(table(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [4096, 7])
def test_buckets_are_opened_again(spark, monkeypatch, tile):
    """With sketches that rule nothing out every forest edge has to be compared, and most fail."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "sketch", lambda elements, space, percent: b"\0" * 8)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        start = rnd.randrange(0, 48)
        words[start : start + 6] = [f"x{i // 2}_{j}" for j in range(6)]
        if i % 2:
            words[-1] = f"end{i}"
        rows.append((i, " ".join(words)))
    checked(jaccard.similar(table(spark, rows)), rows)


def test_chains_become_one_component(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        words = words[2:] + [f"n{i}_{j}" for j in range(2)]
        rows.append((1000 - i, " ".join(words)))
    checked(jaccard.similar(table(spark, rows)), rows)
    assert len({r.component_id for r in jaccard.similar(table(spark, rows)).collect()}) == 1


def test_hot_copies_and_near_copies(spark):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(900)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(150)]
    rows += [(200 + i, " ".join(noisy(rnd, base, rnd.randrange(1, 5)))) for i in range(150)]
    rows += [(400 + i, " ".join(f"w{rnd.randrange(900)}" for _ in range(60))) for i in range(100)]
    checked(jaccard.similar(table(spark, rows)), rows)


def test_op3_whole_table(spark):
    docs = smallest()
    checked(queries.op3(spark, SF), list(zip(docs.doc_id.tolist(), docs.text)))


def links(rows, percent=80):
    """Number of other rows each row links with, by comparing all pairs; in the order of ids."""
    own = sorted((d, sets(t)) for d, t in rows)
    n = dict.fromkeys((d for d, _ in own), 0)
    for k, (i, a) in enumerate(own):
        for j, b in own[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                n[i] += 1
                n[j] += 1
    return sorted(n.items())


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_are_counted(spark, monkeypatch, tile):
    """Chains, copies and a dense family: links that no spanning forest holds count too."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    chain, rows = [f"c{i}" for i in range(100)], []
    for i in range(20):
        chain = chain[2:] + [f"n{i}_{j}" for j in range(2)]
        rows.append((i, " ".join(chain)))
    rows += [(100 + i, " ".join(noisy(rnd, base, rnd.randrange(4)))) for i in range(60)]
    rows += [(200 + i, " ".join(base)) for i in range(5)]
    rows += [(300, "a b"), (301, "a  b"), (302, " "), (303, None), (304, "alone")]
    got = sorted((r.doc_id, r.n_links) for r in jaccard.similar(table(spark, rows)).collect())
    assert got == links(rows)
    assert sum(n for _, n in got) // 2 > len(rows)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    rnd = random.Random(8)
    base = [[f"w{rnd.randrange(400)}" for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(noisy(rnd, base[i % 12], rnd.randrange(2)))) for i in range(60)]
    plain, tried = jaccard.members, []

    def few_names(*args):
        tried.append(args[-1])
        made = plain(*args)
        return made if args[-1] else made.withColumn("node", F.pmod("node", F.lit(5)))

    monkeypatch.setattr(jaccard, "members", few_names)
    checked(jaccard.similar(table(spark, rows)), rows)
    assert len(tried) == 2 and set(tried[1][0]) <= set(range(5))


def test_a_shared_name_is_mixed_with_the_second_hash():
    own = [np.array([i, i + 1], dtype=np.uint64) for i in range(4)]
    names, proofs = jaccard.identities(own)
    again, same = jaccard.identities(own, ((int(names[1]),), (7,)))
    assert (same == proofs).all() and (again == names).tolist() == [True, False, True, True]
    assert jaccard.identities([own[1], own[1]], ((int(names[1]),),))[0].tolist().count(int(again[1])) == 2
