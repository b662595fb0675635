"""Array column helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels_where(pairs: Sequence[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in the given order."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in pairs]))


def distinct_ordered(values: Column) -> Column:
    """Trimmed, non-blank, distinct, first occurrence first."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(distinct_ordered(values))


def has_all(have: Column, need: Column) -> Column:
    return F.size(F.array_except(need, have)) == 0


def same_set(left: Column, right: Column) -> Column:
    return distinct_sorted(left) == distinct_sorted(right)


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def or_empty(values: Column, element: str = "string") -> Column:
    return F.coalesce(values, F.array().cast(f"array<{element}>"))


def first_per(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in order: one sort, where comparing with all earlier elements would be quadratic."""

    def heads(placed: Column) -> Column:
        return F.filter(placed, lambda x, j: (j == 0) | ~F.get(placed, j - 1)["k"].eqNullSafe(x["k"]))

    def chosen(vs: Column) -> Column:
        placed = F.array_sort(F.transform(vs, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"))))
        first = F.get(F.transform(F.array(placed), heads), 0)
        return F.transform(F.array_sort(F.transform(first, lambda x: x["i"])), lambda i: F.get(vs, i))

    return F.get(F.transform(F.array(values), chosen), 0)
