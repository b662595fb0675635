"""Quality by importance resampling.

Two generative models of hashed word uni- and bigrams are counted: one of the
target (documents labelled good), one of the raw text (all documents). A
document's log importance weight is the sum, over its n-grams, of the log ratio
of their probabilities under the two. Adding Gumbel noise to the log weights and
taking the k highest draws a sample of k documents without replacement, in
proportion to the weights.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bisect, bloom_joins, map_batches, map_partitions, small_batches, stored

#: Buckets that n-grams are hashed into, and the pseudo-count of each.
BUCKETS = 10_000
SMOOTHING = 1.0
#: Share of the rows that the sample takes.
KEEP = 0.8
SEED = 20_250
#: Words remembered by a worker.
CACHE = 400_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}


def buckets(text: str | None, size: int = BUCKETS) -> np.ndarray:
    """Bucket of every unigram and bigram of a whole text."""
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    try:
        values = list(map(_known.__getitem__, tokens))
    except KeyError:
        if len(_known) > CACHE:
            _known.clear()
        for t in set(tokens):
            if t not in _known:
                _known[t] = xxhash.xxh64_intdigest(t)
        values = [_known[t] for t in tokens]
    one = np.array(values, dtype=np.uint64)
    two = (one[:-1] * _MIX) ^ (one[1:] + (one[:-1] >> np.uint64(7)))
    return (np.concatenate([one, two * _MIX >> np.uint64(11)]) % np.uint64(size)).astype(np.int64)


def counted(df: DataFrame, size: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in ``text``. A task sends a row for each bucket, not for each word."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(buckets(text, size), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return map_partitions(df.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame, size: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of the ratio of the smoothed probabilities, by bucket; all 0 if the target holds no n-gram.

    Each model is computed once, and ``size`` rows of it reach the driver. A target that is found by a join sends only
    texts that pass a Bloom filter of the wanted ids through the shuffle.
    """
    with bloom_joins(target.sparkSession):
        wanted = target.collect()
    if not wanted:
        return np.zeros(size)
    logs = []
    for counts in (wanted, raw.collect()):
        n = np.full(size, smoothing)
        for r in counts:
            n[r["bucket"]] += r["n"]
        logs.append(np.log(n / n.sum()))
    return logs[0] - logs[1]


def gumbel(id_col: str, seed: int) -> Column:
    """Noise that depends on the id alone, so that it is the same wherever and whenever a row is read."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _ordered(value: float) -> int:
    """Integers in the order of the floats."""
    (bits,) = struct.unpack("<q", struct.pack("<d", value))
    return bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def _float(order: int) -> float:
    bits = order if order >= 0 else order ^ 0x7FFFFFFFFFFFFFFF
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def kth_highest(df: DataFrame, column: str, k: int) -> float:
    """The k-th highest value: counts in a bounded number of bins, then again inside the bin that holds it.

    Nothing is sorted and at most 4,097 counts reach the driver in a round.
    """
    low, high = (_ordered(x + 0.0) for x in df.agg(F.min(column), F.max(column)).first())
    bins = 4096
    while low < high:
        width = max(1, -(-(high - low + 1) // bins))
        edges = [_float(low + i * width) for i in range(1, -(-(high - low + 1) // width))]
        inside = df.where((F.col(column) >= F.lit(_float(low))) & (F.col(column) <= F.lit(_float(high))))
        counts = dict(inside.groupBy(bisect(F.col(column), edges).alias("bin")).count().collect())
        bin_ = max(counts)
        while k > counts.get(bin_, 0):
            k -= counts.get(bin_, 0)
            bin_ -= 1
        low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
    return _float(low)


def weigh(df: DataFrame, ratios: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, log_weight, key) of every whole text; ``key`` is the log weight with its noise."""
    size = len(ratios)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [buckets(t, size) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([float(ratios[f].sum()) for f in found], pa.float64()), batch.column(2)],
            names=["id", "n_features", "log_weight", "own"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    # what the noise is drawn for: the id, or the text where there is none
    own = F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit("nameless"))).alias("own")
    out = map_batches(df.select(id_col, text_col, own), run, f"id {kind}, n_features long, log_weight double, own long")
    noise = F.when(F.col("id").isNull(), gumbel("own", seed)).otherwise(gumbel("id", seed))
    return out.select(F.col("id").alias(id_col), "n_features", "log_weight", (F.col("log_weight") + noise).alias("key"))


def target_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All texts labelled good."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(good, "doc_id", "left_semi").select("text")


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, log_weight, key) of the sampled documents, ``round(keep * rows)`` of them.

    A row with a null or empty text has no n-grams, weight 0 in logs, and takes
    part like any other; a row without an id draws its noise for its text. Rows that tie on the
    key at the threshold (repeated rows) are all in, so that no copy is dropped by
    chance. Without a target text no ratio can be told and noise alone decides.
    An empty table gives an empty table; columns beside id and text are not read.
    """
    rows = stored(weigh(docs, log_ratios(counted(target), counted(docs)), seed), "weights")
    k = math.floor(keep * rows.count() + 0.5)
    if k <= 0:
        return rows.limit(0)
    return rows.where(F.col("key") >= F.lit(kth_highest(rows, "key", k)))
