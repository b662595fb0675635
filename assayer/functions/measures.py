"""Measurement strings to (value, unit) columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text
from .text import compile_pattern, has_digit

# Accepted measurement forms. A bare "%" needs a following word
# character to match, as in "10%v".
CONCENTRATION = (
    r"(?i)(-?\d+(?:\.\d+)?)\s*"
    r"(mM|mmol/L|M|mol/L|%|percent|mg/mL|mg/ml|ug/mL|ug/ml|µg/mL|µg/ml|g/L|g/l|v/v|w/v)\b"
)
#: the same with a plain "%" accepted
CONCENTRATION_LOOSE = (
    r"(?i)(-?\d+(?:\.\d+)?)\s*"
    r"(mM\b|mmol/L\b|M\b|mol/L\b|%|percent\b|mg/mL\b|ug/mL\b|µg/mL\b|g/L\b|v/v\b|w/v\b)"
)
TEMPERATURES = (
    r"(?i)(-?\d+(?:\.\d+)?)\s*(?:°\s*)?(C|F|K)\b",
    r"(?i)(-?\d+(?:\.\d+)?)\s*degrees?\s*(C|F|K)\b",
)
DURATION = (
    r"(?i)(\d+(?:\.\d+)?)\s*"
    r"(s|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|week|weeks)\b"
)
RATES = (
    r"(?i)(-?\d+(?:\.\d+)?)\s*(?:°\s*)?(C|F|K)\s*(?:/|per)\s*"
    r"(sec|second|seconds|min|minute|minutes|h|hr|hour|hours)\b",
    r"(?i)(-?\d+(?:\.\d+)?)\s*(?:°\s*)?(C|F|K)\s*/\s*(s|m|h)\b",
)
# Raw unit (lower case) to canonical unit.
CONCENTRATION_UNITS = {
    "%": "%", "percent": "%", "m": "M", "mol/l": "M", "mm": "mM", "mmol/l": "mM", "mg/ml": "mg/mL",
    "ug/ml": "ug/mL", "µg/ml": "ug/mL", "g/l": "g/L", "v/v": "v/v", "w/v": "w/v",
}
DURATION_UNITS = {
    "s": "sec", "sec": "sec", "secs": "sec", "second": "sec", "seconds": "sec",
    "m": "min", "min": "min", "mins": "min", "minute": "min", "minutes": "min",
    "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day", "week": "week", "weeks": "week",
}
PARSED_CONFIDENCE = 0.9


def unit_of(raw: Column, units: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(raw))), F.trim(raw))


def _group(text: Column, patterns: tuple[str, ...], index: int) -> Column:
    """Capture group of the first pattern that matches, null when none does."""
    found = [F.nullif(F.regexp_extract(text, compile_pattern(p), index), F.lit("")) for p in patterns]
    return reduce(lambda a, b: F.coalesce(a, b), found)


def _measurement(raw: Column, kind, value: Column, unit: Column) -> Column:
    """The measurement struct, null when nothing was parsed.

    ``kind`` maps the value to its kind. Number and unit are bound once, so each
    pattern runs once per text.
    """
    parsed = F.array(F.struct(value.try_cast("double").alias("value"), unit.alias("unit")))
    built = F.transform(
        parsed,
        lambda p: F.when(
            p["value"].isNotNull(),
            F.struct(
                raw.alias("raw"),
                kind(p["value"]).alias("kind"),
                p["value"].alias("value"),
                p.unit.alias("unit"),
                F.concat(number_text(p["value"]), F.lit(" "), p.unit).alias("text"),
                F.lit(PARSED_CONFIDENCE).alias("confidence"),
            ),
        ),
    )
    # texts without a digit cannot hold a measurement
    return F.when(has_digit(raw), F.get(built, 0))


def _always(kind: str):
    return lambda _: F.lit(kind)


def parse_concentration(raw: Column, strict: bool = True) -> Column:
    patterns = (CONCENTRATION if strict else CONCENTRATION_LOOSE,)
    unit = unit_of(_group(raw, patterns, 2), CONCENTRATION_UNITS)
    return _measurement(raw, _always("concentration"), _group(raw, patterns, 1), unit)


def parse_temperature(raw: Column) -> Column:
    unit = F.upper(_group(raw, TEMPERATURES, 2))
    return _measurement(raw, _always("temperature"), _group(raw, TEMPERATURES, 1), unit)


def parse_duration(raw: Column) -> Column:
    unit = unit_of(_group(raw, (DURATION,), 2), DURATION_UNITS)
    return _measurement(raw, _always("duration"), _group(raw, (DURATION,), 1), unit)


def parse_rate(raw: Column, phase: Column) -> Column:
    """Temperature per time. A positive rate counts as warming in every phase."""
    unit = F.concat_ws("/", F.upper(_group(raw, RATES, 2)), unit_of(_group(raw, RATES, 3), DURATION_UNITS))

    def kind(value: Column) -> Column:
        return F.when((phase == "warming") | (value > 0), "warming-rate").otherwise("cooling-rate")

    return _measurement(raw, kind, _group(raw, RATES, 1), unit)


PARSERS = {
    "concentration": parse_concentration,
    "temperature": parse_temperature,
    "duration": parse_duration,
}
