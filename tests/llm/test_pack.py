"""Vector packing: balance, slots and whole groups."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from assayer.llm import pack, queries

from .cases import SF, awkward, smallest, table


def checked(got, rows, shards):
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        assert 0 <= r.shard < shards and r.grown_shard is None and r.law == "bytes"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark):
    rows = awkward()
    checked(pack.pack(table(spark, rows), 3).collect(), rows, 3)
    assert pack.pack(table(spark, []), 3).count() == 0


def test_balance_with_a_hot_group(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, "hot copy of a text " * 3) for i in range(4000)]
    rows += [(4000 + i, f"{i} " + "word " * int(rnd.integers(1, 40))) for i in range(8000)]
    got = pack.pack(table(spark, rows), 10).collect()
    checked(got, rows, 10)
    size, count = np.zeros(10), np.zeros(10)
    for r in got:
        size[r.shard] += r["size"]
        count[r.shard] += 1
    assert size.max() / size.mean() < 1.005 and size.min() / size.mean() > 0.995 and count.max() / count.mean() < 1.05


@pytest.mark.parametrize("name", [7, None])
def test_balance_with_equal_rows_of_one_id(spark, name):
    rows = [(name, "the same row again " * 40)] * 2000 + [(i, f"short {i}") for i in range(2000)]
    got = pack.pack(table(spark, rows), 10).collect()
    checked(got, rows, 10)
    size = np.zeros(10)
    for r in got:
        size[r.shard] += r["size"]
    assert size.max() / size.mean() < 1.02 and size.min() / size.mean() > 0.98


def test_groups_stay_whole(spark):
    rows = [(i, f"text number {i % 700} " * (1 + i % 7)) for i in range(2100)]
    shard = {}
    for r in pack.pack(table(spark, rows), 4).collect():
        shard.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in shard.values())


def test_place_takes_the_highest_dot_product():
    demands = np.array([[0.3, 0.1, 0.1], [0.1, 0.3, 0.1], [0.1, 0.1, 0.3], [0.1, 0.1, 0.1]])
    out = pack.place(demands, 2)
    left = np.tile(np.array([1, 1 + pack.SLACK, 1 + pack.SLACK]) / 2, (2, 1))
    for i in (0, 1, 2, 3):
        fits = [s for s in range(2) if (left[s] >= demands[i] - 1e-9).all()]
        best = max(fits or range(2), key=lambda s: (left[s] @ demands[i], -s))
        assert not fits or out[i] == best
        left[out[i]] -= demands[i]


def test_op7_whole_table(spark):
    docs = smallest()
    got = queries.op7(spark, SF).collect()
    checked(got, list(zip(docs.doc_id, docs.text)), 40)
