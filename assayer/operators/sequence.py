"""Ordered work inside long sequences.

A window over one key runs in one task. Here every sequence is cut into chunks
(a monotone function of the order, such as the day or a block of positions), the
window runs per (key, chunk), and a per-chunk summary table carries what crosses
chunk borders. One very long sequence is then many small tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config.defaults import PHASE_RANK


def step_ordinals(df: DataFrame, keys: Sequence[str], chunk: Column, *order: str, out: str = "order") -> DataFrame:
    """0-based running number per key."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, F.col("_start") + F.col("_i"))
        .drop("_chunk", "_i", "_start")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: str, value: str, out: str
) -> DataFrame:
    """The value of the row before, per key; null on the first row."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    lasts = chunked.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    across = W.partitionBy(*keys).orderBy("_chunk")
    carried = lasts.select(*keys, "_chunk", F.lag("_last").over(across).alias("_carry"))
    return (
        chunked.withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_prev", F.lag(value).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_prev")))
        .drop("_chunk", "_first", "_prev", "_carry")
    )


def phase_transitions(
    steps: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: str,
    phase: str = "phase",
    structural: str = "structural",
    ranks: dict[str, int] | None = None,
) -> DataFrame:
    """Adds ``next_phase``: the first later structural step of another phase whose
    rank is not lower.

    The set of phases is fixed, so "where does each phase occur next" is one
    running minimum per phase inside a chunk plus one per chunk across chunks.
    """
    ranks = ranks or {p: r for p, r in PHASE_RANK.items() if r < 99}
    keys = list(keys)
    chunked = steps.withColumn("_chunk", chunk)

    def place(name: str) -> Column:
        return F.when(F.col(structural) & (F.col(phase) == name), F.col(order))

    names = list(ranks)
    after = W.partitionBy(*keys, "_chunk").orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    firsts = chunked.groupBy(*keys, "_chunk").agg(*[F.min(place(p)).alias(f"f{i}") for i, p in enumerate(names)])
    later = W.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = firsts.select(*keys, "_chunk", *[F.min(f"f{i}").over(later).alias(f"c{i}") for i in range(len(names))])
    local = chunked.select("*", *[F.min(place(p)).over(after).alias(f"n{i}") for i, p in enumerate(names)])
    joined = local.join(carried, [*keys, "_chunk"])
    own = reduce(lambda acc, p: acc.when(F.col(phase) == p, ranks[p]), names, F.when(F.lit(False), 0))
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(phase) != p) & (own <= ranks[p]) & F.coalesce(f"n{i}", f"c{i}").isNotNull(),
                    F.struct(F.coalesce(f"n{i}", f"c{i}").alias("at"), F.lit(p).alias("p")),
                )
                for i, p in enumerate(names)
            ]
        )
    )
    drop = ["_chunk", *[f"{x}{i}" for x in "nc" for i in range(len(names))]]
    return joined.withColumn("next_phase", F.when(F.col(structural), F.array_min(options)["p"])).drop(*drop)


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows strictly before, per key, in two levels."""
    keys = list(keys)
    chunked = df.withColumn("_bucket", bucket)
    totals = chunked.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        chunked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_in"))
        .drop("_bucket", "_in", "_start")
    )
