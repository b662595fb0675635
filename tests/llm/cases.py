"""Small tables with every awkward case, and the driver's smallest one."""

from __future__ import annotations

import random

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those the operators make.
CLASHING = {"lang": "en", "n_tokens": 7, "ids": "x", "size": -1, "shard": 3, "score": 0.5, "node": 1, "start": 2, "count": 9, "words": "w"}


def table(spark, rows):
    """(doc_id, text) rows beside columns with clashing names."""
    schema = "doc_id long, text string, " + ", ".join(
        f"`{k}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in CLASHING.items()
    )
    return spark.createDataFrame([(i, t, *CLASHING.values()) for i, t in rows], schema)


def awkward(extra=()):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épée", "ß", "日本語", "x1", "don't", "O'Neil's", "😀"]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    return [
        (1, "plain words here"), (2, ""), (3, None), (None, "no id"), (None, None), (4, long), (5, "plain words here"),
        (5, "plain words here"), (6, " \t\n "), (7, "x" * 5000), (8, "日本語" * 800), *extra,
    ]


def smallest() -> pd.DataFrame:
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return pd.read_parquet(f"{SF}/documents.parquet")
