"""Token counts: batches balanced by bytes, only lengths come back.

Where the tokenizer drops white space and nothing in it looks across (composition,
lower case, splitting and merges all stop there), the length of a text is the sum of
the lengths of its runs without white space. Each worker remembers the lengths of the
runs it has met, so most of a text costs a lookup; only new runs are encoded. For
other files whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Characters of a piece of a long text, and bytes of one encoding batch.
PIECE = 1 << 15
BATCH = 1 << 18
#: Runs a worker remembers, and the bytes of the longest of them. When the memory is full it is kept: early runs are frequent ones.
HELD_RUNS, HELD_BYTES = 1 << 18, 64

_SPACE = re.compile(r"[\t-\r ]")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> lengths, for a .json or a .model file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses every core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return False, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"] or {}
    # white space is a safe cut only where the splitting pattern drops it
    drops = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] for p in pre.get("pretokenizers", [pre]) if p)
    return drops, lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[bytes, int]:
    return {}


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at the first white space after each ``size`` characters; without any it stays whole."""
    start = 0
    while len(text) - start > size and (hit := _SPACE.search(text, start + size)):
        yield text[start : hit.start()]
        start = hit.start()
    yield text[start:]


def batches(texts: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """``texts`` in groups of at most ``size`` bytes; a longer text is a group of its own."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def lengths(texts: list[str], path: str, batch: int = BATCH) -> np.ndarray:
    """Number of tokens of each text."""
    splits, count = _encoder(path)

    def encoded(parts: list[bytes]) -> list[int]:
        return [n for group in batches(parts, batch) for n in count([x.decode() for x in group])]

    if not splits:
        return np.array(encoded([t.encode() for t in texts]), dtype=np.int64)
    held = _memory(path)
    totals = np.zeros(len(texts), dtype=np.int64)
    owners = iter([i for i, text in enumerate(texts) for _ in pieces(text)])
    for group in batches((piece.encode() for text in texts for piece in pieces(text)), batch):
        runs = [piece.split() for piece in group]  # bytes split at [\t-\r ]
        if len(held) < HELD_RUNS:
            new = [x for x in set().union(*runs).difference(held) if len(x) <= HELD_BYTES][: HELD_RUNS - len(held)]
            held.update(zip(new, encoded(new)))
        # what is not remembered is encoded together, one text for each piece
        rest = [b" ".join([x for x in own if x not in held]) for own in runs]
        for own, n in zip(runs, encoded(rest)):
            totals[next(owners)] += n + sum([held[x] for x in own if x in held])
    return totals


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    One pass without a shuffle; tokens never leave the worker. A null text
    counts as empty: no bytes, no tokens. Null or repeated ids pass through row
    by row; further columns are not read; an empty table gives an empty table.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = lengths(batch.column(2).to_pylist(), path)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(text_col, F.lit("")))
    out = map_batches(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
