"""Whole rows by key: reduced before the shuffle, or found on keys alone and fetched afterwards (``placed``).

Joins on hot keys are left to adaptive execution, which splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``.

    An aggregate instead of a window: rows are reduced before the shuffle, so a
    key with a third of the table costs one row per input partition.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
    )


def placed(df: DataFrame, keys: Sequence[str], place: str, last: bool = False) -> DataFrame:
    """The rows that stand first (or last) in their key, by a number that no two rows of a key share.

    For rows that lie in a table, since they are read twice: the first time keys and numbers alone. Whole rows travel once, by key and number, so that a hot key
    spreads; they stream past the winners, which are the built side of the join.
    """
    pick = F.max if last else F.min
    won = df.groupBy(*keys).agg(pick(place).alias("_place")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_place")
    same = F.col(place) == F.col("_place")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    return df.join(won.hint("shuffle_hash"), same, "left_semi")


def first_by_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_by(df, keys, F.struct(*order))


def last_by_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_by(df, keys, F.struct(*order), last=True)
