"""Repeat removal against counting every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, repeats

from .cases import SF, awkward, smallest, table


def longest_elsewhere(strings):
    at = [(i, p) for i, s in enumerate(strings) for p in range(len(s))]
    out = []
    for i, p in at:
        best = 0
        for j, q in at:
            if (i, p) != (j, q):
                k = 0
                while p + k < len(strings[i]) and q + k < len(strings[j]) and strings[i][p + k] == strings[j][q + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("letters", [b"ab", b"abcdef", b"\x00a", b"a"])
def test_matching_statistics(letters):
    rnd = random.Random(len(letters))
    for _ in range(40):
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(1, 6))]
        assert repeats.matching_statistics(strings).tolist() == longest_elsewhere(strings)


def windows_counted(texts, length):
    """(kept, spans) of each text, by counting all windows."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            if not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((bytes(c for c, g in zip(t, gone) if not g), spans))
    return out


def checked(df, rows, length):
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((i or -1, len(t), spans, kept) for (i, _), t, (kept, spans) in zip(rows, texts, windows_counted(texts, length)))
    got = sorted((r.doc_id or -1, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect())
    assert got == want


def test_awkward_rows(spark):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdefgh é") for _ in range(150))
    rows = awkward([(20 + i, "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(80))) + passage[i % 3 :] + str(i) * 30) for i in range(12)])
    rows += [(40, "ab" * 300), (41, "b" + "ab" * 90), (42, passage + "tail" + passage), (43, "\x00" * 300)]
    checked(repeats.remove_repeats(table(spark, rows), 100), rows, 100)
    assert repeats.remove_repeats(table(spark, []), 100).count() == 0


def test_near_copies_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    rnd = random.Random(7)
    base = [rnd.choice("abcdefghij") for _ in range(700)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(700)] = rnd.choice("KLM")
        rows.append((i, "".join(own[rnd.randrange(50) : 700 - rnd.randrange(50)])))
    rows += [(100 + i, "".join(rnd.choice("nopq") for _ in range(300)) + "".join(base[100:330])) for i in range(60)]
    checked(repeats.remove_repeats(table(spark, rows), 200), rows, 200)


def test_long_text_is_cut_with_overlap(monkeypatch):
    """Every window of a long text is in exactly one segment, whatever the chunk size."""
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcd") for _ in range(n)).encode() for n in (5000, 150, 900, 200, 1199, 1200, 1201)]
    seen = Counter()
    for data, starts, ends, keys, offsets in repeats._pieces(list(range(len(texts))), texts, 200):
        doc, first, last, _ = repeats.segments(data, starts, ends, 200)
        for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist()):
            for i in range(a, b + 1):
                at = i - starts[d] + offsets[d]
                assert data[i : i + 200] == texts[keys[d]][at : at + 200]
                seen[keys[d], at] += 1
    assert seen == Counter((k, i) for k, t in enumerate(texts) for i in range(len(t) - 199))


def test_op10_whole_table(spark):
    docs = smallest()
    texts = [t.encode() for t in docs.text]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10(spark, SF).collect()}
    want = {
        i: (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        for i, t, (kept, spans) in zip(docs.doc_id, texts, windows_counted(texts, 200))
    }
    assert got == want


def test_rows_that_share_a_key_get_another(spark, monkeypatch):
    rnd = random.Random(6)
    shared = " ".join(rnd.choice(["ab", "cde", "f"]) for _ in range(60))
    rows = [(i % 20, "".join(rnd.choice("abc ") for _ in range(60)) + (shared if i % 3 else "")) for i in range(40)] * 2
    plain, turns = repeats._row_hash, []

    def few_keys(turn):
        turns.append(turn)
        return plain(turn) if turn else F.pmod(plain(0), F.lit(7))

    monkeypatch.setattr(repeats, "_row_hash", few_keys)
    checked(repeats.remove_repeats(table(spark, rows), 64), rows, 64)
    assert turns == [0, 1]
