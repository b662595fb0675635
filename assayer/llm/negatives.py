"""Hard negatives by exact integer scores: residue-number-system products.

Scores are inner products of integer vectors. Both sides are reduced modulo a few
small primes; residues lie around zero, so a float32 product over ``INNER`` components
stays under 2^24 and is exact. The Chinese remainder theorem turns the residues of
a score back into the signed integer. As many primes are taken as the largest norm needs.

Anchors meet all rows in blocks: every pair of a block of ``BLOCK`` anchors and a block of ``BLOCK`` rows is a group of
its own, so no task holds more than two blocks, however large the table is. Rows are dealt to blocks
by their place in the scan: equal rows, labels or ids cannot fill a block. A group returns the best few rows of
each anchor in it; windows over those few select the result.

Rows with a null label, a null vector or a null or non-finite component take no part.
A shorter vector counts as filled up with zeros. Rows that repeat an anchor wholly are one anchor, but as partners each
of them counts. A row without an id is no anchor; as partner it stands behind equal scores. An empty table gives no rows.
Scores must fit 56 bits; a table that could exceed them raises ``ValueError`` before any product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, stored, tasks_for

#: The largest primes under 1024, and the components over which float32 sums of their products are exact.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983, 977)
INNER = 64
#: Anchors, and rows, of a block; scores computed at once.
BLOCK = 4096
TILE = 1 << 20
MAX_SCORE = 1 << 56


def primes_for(bound: float) -> tuple[int, ...]:
    """The fewest primes whose product tells all integers from -bound to bound apart."""
    if bound >= MAX_SCORE:
        raise ValueError("scores of these vectors do not fit 56 bits")
    product, taken = 1, []
    for p in PRIMES:
        taken.append(p)
        product *= p
        if product > 2 * bound + 1:
            break
    return tuple(taken)


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """``values`` modulo ``p``, from -(p-1)/2 to (p-1)/2, as float32."""
    half = p // 2
    return ((values + half) % p - half).astype(np.float32)


def product_mod(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """``left @ right.T`` modulo ``p`` of centred float32 residues, as int64 in [0, p)."""
    total = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, left.shape[1], INNER):
        total += (left[:, k : k + INNER] @ right[:, k : k + INNER].T).astype(np.int64)
    return total % p


def reconstruct(parts: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed integers with these residues (mixed radix, int64 throughout)."""
    value, radix = parts[0].copy(), primes[0]
    for part, p in zip(parts[1:], primes[1:]):
        digit = ((part - value % p) % p * pow(radix, -1, p)) % p
        value += radix * digit
        radix *= p
    value[value > radix // 2] -= radix
    return value


def scores(left: np.ndarray, right: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact ``left @ right.T`` of int64 matrices."""
    return reconstruct([product_mod(residues(left, p), residues(right, p), p) for p in primes], primes)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """List column to an int64 matrix of floor(256 x), short rows filled with zeros."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    label, vector = F.col(label_col), F.col(vec_col)
    shifted = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), shifted.cast("long").alias("label"))
        .where(F.col("label").isNotNull() & F.col("vector").isNotNull())
        .where(finite)
    )


def _meet(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], fn, schema: str) -> DataFrame:
    """``fn(anchors, rows)`` as Arrow tables for each pair of blocks."""
    n_anchors, n_rows = sizes
    own, other = max(1, math.ceil(n_anchors / BLOCK)), max(1, math.ceil(n_rows / BLOCK))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")

    left = anchors.withColumn("a", dealt(own)).withColumn("b", blocks(other))
    right = rows.withColumn("b", dealt(other)).withColumn("a", blocks(own))
    ship_package(rows.sparkSession)
    # few bytes, much work: neither side is merged into fewer tasks
    tasks = tasks_for(rows)
    left, right = left.repartition(tasks, "a", "b"), right.repartition(tasks, "a", "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(fn, schema)


def _tiles(left: pa.Table, right: pa.Table, width: int, primes: tuple[int, ...]):
    """(place of the anchor, its scores with all rows), rows ordered by id."""
    ours, theirs = _matrix(left["vector"], width), _matrix(right["vector"], width)
    step = max(1, TILE // max(1, len(theirs)))
    for start in range(0, len(ours), step):
        yield from enumerate(scores(ours[start : start + step], theirs, primes), start)


def _by_id(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by([("vec_id", "ascending")])  # nulls come last
    return table, table["label"].to_numpy()


def _best(values: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """``places`` of the k highest values; earlier places first among equals."""
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        sure, tied = places[values > least], places[values == least][:k]
        values, places = np.concatenate([values[values > least], np.full(len(tied), least)]), np.concatenate([sure, tied])
        order = np.lexsort((places, -values))
    else:
        order = np.argsort(-values, kind="stable")
    return places[order[:k]]


def mine(
    df: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id ``every`` divides. For each anchor and each of its first ``positives`` rows of
    the same label: the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    """
    rows = _rows(df, id_col, vec_col, label_col)
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x.cast("double") * 256.0).cast("double"), F.lit(2.0)))
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector", "label"])
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(norm).alias("norm")).first()
    # no score exceeds the largest squared norm; the last place is for rounding of the sum
    primes, width = primes_for((seen["norm"] or 0.0) * 1.001 + 1), seen["width"] or 0
    # the key of an anchor is its place in the stored table
    anchors = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    sizes = (anchors.count(), seen["n"])

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        right, labels = _by_id(right)
        ids, own_labels, own_ids = right["vec_id"], left["label"].to_numpy(), left["vec_id"].to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        theirs = _matrix(right["vector"], width)
        ours = _matrix(left["vector"], width)
        known = ids.fill_null(-1).to_numpy()
        valid = ids.is_valid().to_numpy(zero_copy_only=False) if ids.null_count else None
        for i, row in _tiles(left, right, width, primes):
            mine_ = np.flatnonzero(labels == own_labels[i])
            best = _best(row[mine_], mine_, positives + 1)
            itself = (known[best] == own_ids[i]) & (theirs[best] == ours[i]).all(axis=1)
            if valid is not None:
                itself &= valid[best]
            out.append((np.full(len(best), i), best, row[best], itself))
        at, best, value, itself = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({
            "anchor": left["anchor"].take(pa.array(at.astype(np.int64))), "positive_id": ids.take(pa.array(best.astype(np.int64))),
            "positive_score": pa.array(value.astype(np.int64)), "itself": pa.array(itself.astype(bool)),
        })

    found = _meet(
        rows, anchors.select("anchor", "vec_id", "vector", "label"), sizes, same_label,
        "anchor long, positive_id long, positive_score long, itself boolean",
    )
    order = (F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    # the anchor itself is among the first few or behind them; one row of its kind goes
    itself = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("itself"), *order))
    nearest = (
        found.withColumn("place", first).where(F.col("place") <= positives + 1)
        .withColumn("_own", itself).where(~(F.col("itself") & (F.col("_own") == 1)))
        .withColumn("place", first).where(F.col("place") <= positives)
    )
    chosen = nearest.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen"))
    paired = stored(anchors.join(chosen, "anchor").select("anchor", "vec_id", "vector", "label", "chosen"), "positives")

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        right, labels = _by_id(right)
        ids, own_labels, wanted = right["vec_id"], left["label"].to_numpy(), left["chosen"].to_pylist()
        at, place, picked, value = [], [], [], []
        for i, row in _tiles(left, right, width, primes):
            there = np.flatnonzero(labels != own_labels[i])
            there = there[(100 * row[there] <= high * max(p["positive_score"] for p in wanted[i]))]
            there = there[np.argsort(-row[there], kind="stable")]
            falling = -row[there]
            for p in wanted[i]:
                score = p["positive_score"]
                start = np.searchsorted(falling, -(high * score // 100))
                for j in there[start : start + negatives]:
                    if low * score <= 100 * int(row[j]) <= high * score:
                        at.append(i), place.append(p["place"]), picked.append(j), value.append(int(row[j]))
        return pa.table({
            "anchor": left["anchor"].take(pa.array(at, pa.int64())), "place": pa.array(place, pa.int32()),
            "negative_id": ids.take(pa.array(picked, pa.int64())), "negative_score": pa.array(value, pa.int64()),
        })

    met = _meet(rows, paired, sizes, other_label, "anchor long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(
        Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    )
    best = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    pairs = paired.select("anchor", F.col("vec_id").alias("anchor_id"), F.inline("chosen"))
    return best.join(pairs, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
