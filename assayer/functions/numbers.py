"""Numeric column helpers with one fixed rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Half-up rounding by floor; behaves the same in every SQL engine."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(numerator: Column, denominator: Column, digits: int = 3) -> Column:
    """numerator / denominator rounded, 0 on an empty denominator."""
    share = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(fixed(share, digits), F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def number_text(value: Column) -> Column:
    """Shortest decimal text: 2.0 -> '2', 0.25 -> '0.25'."""
    whole = value == F.floor(value)
    plain = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    return F.when(whole, F.floor(value).cast("string")).otherwise(plain)


def year_scale(year: Column) -> Column:
    scaled = fixed(clamp((year.cast("double") - 1990.0) / 40.0), 4)
    return F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(0.0)).otherwise(scaled)


def unit_share(count: Column, full: float) -> Column:
    """count / full clamped to [0, 1], 4 decimals."""
    return fixed(clamp(count.cast("double") / F.lit(float(full))), 4)
