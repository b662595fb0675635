"""Measurements, workflow structure and representative conditions of a record.

Steps and measurements of one record are nested in its row, so normalisation is
again a projection. ``phase_transitions`` is the long-table form for sequences
that do not fit one row; it lives in ``sequence``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.defaults import BACKBONE_PHASES, CONDITION_PHASES, PHASE_RANK
from ..functions.arrays import first_per
from ..functions.measures import PARSERS, parse_concentration, parse_duration, parse_rate, parse_temperature
from ..functions.numbers import fixed
from ..functions.text import matches

# Wording of accepted autofill steps and of procedural work.
AUTOFILL = r"(?i)^reviewed benchmark autofill accepted for protocol phase:"
PROCEDURAL = (
    r"(?i)\b(expos(?:e|ed)|equilibrat(?:e|ed|ion)|load(?:ed|ing)?|perfus(?:e|ed|ion)|cool(?:ed|ing)?"
    r"|freez(?:e|ing)|super-?cool(?:ed|ing)?|nucleat(?:e|ed|ion)|plung(?:e|ed|ing)|store(?:d|age)?"
    r"|cryopreserv(?:e|ed|ation)|vitrif(?:y|ied|ication)|warm(?:ed|ing)?|thaw(?:ed|ing)?|rewarm(?:ed|ing)?"
    r"|wash(?:ed|ing)?|dilut(?:e|ed|ion)|unload(?:ed|ing)?|incubat(?:e|ed|ion)|cultured?|transferred?"
    r"|suspended?|added?)\b"
)
LINK_GAP = r"[\s,()/%-]{0,18}"
SINGLE_CONFIDENCE, LINKED_CONFIDENCE, MENTION_CONFIDENCE = 0.9, 0.82, 0.6
NOTHING_ATTEMPTED = 0.7
CONDITION = (
    "struct<phase:string,chemical:string,measurement:struct<raw:string,kind:string,value:double,unit:string,"
    "text:string,confidence:double>,label:string,source:string,confidence:double>"
)


def parse_measurements(mentions: DataFrame, raw: str = "raw", kind: str = "kind", strict: bool = True) -> DataFrame:
    """Long mentions to measurements; ``measurement`` is null where nothing parses."""
    out = None
    for name, parser in PARSERS.items():
        parsed = parser(F.col(raw), strict) if name == "concentration" else parser(F.col(raw))
        hit = F.col(kind) == name
        out = F.when(hit, parsed) if out is None else out.when(hit, parsed)
    return mentions.withColumn("measurement", out)


def parse_rates(steps: DataFrame, texts: Column, phase: str = "phase") -> DataFrame:
    """Rates found in an array of texts (a step's summary and temperatures)."""
    found = F.array_compact(F.transform(texts, lambda t: parse_rate(t, F.col(phase))))
    return steps.withColumn("rates", found)


def is_structural(phase: Column, summary: Column, has_detail: Column, text: Column) -> Column:
    """A backbone phase that is an autofill, carries detail, or names a procedure."""
    return phase.isin(*BACKBONE_PHASES) & (matches(summary, AUTOFILL) | has_detail | matches(text, PROCEDURAL))


def _step_text(s: Column) -> Column:
    """Summary plus its evidence, which for extracted steps is the sentence itself."""
    return F.concat_ws(" ", s.summary, s.summary)


def normalized_steps(steps: Column, strict: bool = True) -> Column:
    def one(s: Column) -> Column:
        detail = (
            (F.size(s.chemicals) > 0)
            | (F.size(s.concentrations) > 0)
            | (F.size(s.temperatures) > 0)
            | (F.size(s.durations) > 0)
        )

        def parsed(values: Column, parser) -> Column:
            return F.array_compact(F.transform(values, parser))

        rate_texts = F.concat(F.array(s.summary), s.temperatures)
        return F.struct(
            s.order.alias("order"),
            s.phase.alias("phase"),
            s.summary.alias("summary"),
            s.chemicals.alias("chemicals"),
            parsed(s.concentrations, lambda r: parse_concentration(r, strict)).alias("concentrations"),
            parsed(s.temperatures, parse_temperature).alias("temperatures"),
            parsed(s.durations, parse_duration).alias("durations"),
            parsed(rate_texts, lambda r: parse_rate(r, s.phase)).alias("rates"),
            is_structural(s.phase, s.summary, detail, _step_text(s)).alias("structural"),
            F.size(s.concentrations).alias("n_concentrations"),
            F.size(s.temperatures).alias("n_temperatures"),
            F.size(s.durations).alias("n_durations"),
        )

    return F.transform(steps, one)


def next_phases(steps: Column) -> Column:
    """Per step, the phase it leads to: the first later structural step of another
    phase whose rank is not lower; null for non-structural steps.

    The structural phases of a row are written as one string of letters. Cut behind
    each letter that may follow a phase, the string tells for every place what
    comes next, so a row costs one pass for each ranked phase, however many steps it has.
    """
    ranked = {p: r for p, r in PHASE_RANK.items() if r < 99}
    letter = dict(zip(ranked, string.ascii_lowercase, strict=False))

    def code(s: Column) -> Column:
        named = F.element_at(F.create_map(*[F.lit(x) for pair in letter.items() for x in pair]), s.phase)
        return F.coalesce(F.when(s.structural, named), F.lit("."))

    letters = F.array_join(F.transform(steps, code), "")
    phase_of = F.create_map(*[F.lit(x) for p, c in letter.items() for x in (c, p)])

    def following(phase: str) -> Column:
        """At each place, the next phase that ``phase`` may lead to; right wherever a step of ``phase`` stands."""
        goals = "".join(letter[p] for p, r in ranked.items() if p != phase and r >= ranked[phase])
        if not goals:
            return F.transform(steps, lambda s: F.lit(None).cast("string"))
        runs = F.split(letters, f"(?<=[{goals}])")

        def spread(run: Column) -> Column:
            last = F.right(run, F.lit(1))
            return F.array_repeat(F.when(last.rlike(f"[{goals}]"), F.element_at(phase_of, last)), F.length(run))

        return F.flatten(F.transform(runs, spread))

    columns = {phase: f"after_{i}" for i, phase in enumerate(ranked)}

    def one(z: Column) -> Column:
        chosen = F.coalesce(*[F.when(z["s"].phase == phase, z[name]) for phase, name in columns.items()])
        return F.when(z["s"].structural, chosen)

    return F.transform(F.arrays_zip(steps.alias("s"), *[following(p).alias(n) for p, n in columns.items()]), one)


def _quoted(value: Column) -> Column:
    """The value as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def linked(text: Column, raw: Column, name: Column) -> Column:
    """The two strings stand next to each other, in either order."""
    a, b = _quoted(F.trim(raw)), _quoted(name)
    gap = F.lit(LINK_GAP)
    near = F.concat(F.lit("(?i)"), a, gap, b, F.lit("|"), b, gap, a)
    # the cheap substring tests keep most rows away from the per-row pattern
    possible = F.contains(F.lower(text), F.lower(name)) & F.contains(F.lower(text), F.lower(F.trim(raw)))
    return (F.trim(raw) != "") & possible & F.regexp_like(text, near)


def _condition(phase: Column, chemical: Column, m: Column, source: str, confidence: float) -> Column:
    return F.struct(
        phase.alias("phase"),
        chemical.alias("chemical"),
        m.alias("measurement"),
        F.concat(chemical, F.lit(" "), m.text).alias("label"),
        F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence"),
    )


def distinct_conditions(conditions: Column) -> Column:
    """First condition per (phase, label, source)."""
    return first_per(conditions, lambda c: F.struct(c.phase, c.label, c.source))


def step_conditions(steps: Column, mentions: Column) -> Column:
    """Conditions stated in structural steps.

    A step with one chemical takes all its concentrations; with several, a
    concentration belongs to the chemicals written next to it.
    """

    def of_step(s: Column) -> Column:
        names = F.array_distinct(s.chemicals)
        single = F.transform(
            s.concentrations, lambda m: _condition(s.phase, F.get(names, 0), m, "step", SINGLE_CONFIDENCE)
        )

        def of_measure(m: Column) -> Column:
            def near(name: Column) -> Column:
                own = F.flatten(F.transform(F.filter(mentions, lambda c: c["name"] == name), lambda c: c.aliases))
                return F.exists(F.array_union(F.array(name), own), lambda a: linked(_step_text(s), m.raw, a))

            return F.transform(
                F.filter(names, near), lambda name: _condition(s.phase, name, m, "step", LINKED_CONFIDENCE)
            )

        several = F.flatten(F.transform(s.concentrations, of_measure))
        usable = s.structural & s.phase.isin(*CONDITION_PHASES) & (F.size(names) > 0)
        return (
            F.when(~usable, F.array().cast(f"array<{CONDITION}>"))
            .when(F.size(names) == 1, single.cast(f"array<{CONDITION}>"))
            .otherwise(several.cast(f"array<{CONDITION}>"))
        )

    return F.flatten(F.transform(steps, of_step))


def normalize_extraction(extraction: DataFrame, strict: bool = True) -> DataFrame:
    """One normalised row per extraction row.

    Adds normalized_chemicals, normalized_steps (with ``next_phase``),
    conditions, warnings and normalization_confidence.
    """
    title = F.col("title")
    chemicals = F.transform(
        "chemical_mentions",
        lambda c: F.struct(
            c["name"].alias("name"),
            c.aliases.alias("aliases"),
            F.array_compact(F.transform(c.concentrations, lambda r: parse_concentration(r, strict))).alias(
                "concentrations"
            ),
        ),
    )
    out = extraction.withColumn("normalized_chemicals", chemicals).withColumn(
        "_steps", normalized_steps(F.col("steps"), strict)
    )
    out = out.withColumn("_next", next_phases(F.col("_steps")))
    stated = distinct_conditions(F.col("_stated"))
    mentioned = distinct_conditions(
        F.flatten(
            F.transform(
                "normalized_chemicals",
                lambda c: F.transform(
                    c.concentrations,
                    lambda m: _condition(F.lit("unknown"), c["name"], m, "chemical-mention", MENTION_CONFIDENCE),
                ),
            )
        )
    )
    out = out.withColumn("_stated", step_conditions(F.col("_steps"), F.col("chemical_mentions")))
    out = out.withColumn("conditions", F.when(F.size("_stated") > 0, stated).otherwise(mentioned))

    def total(values: Column, size) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, x: acc + size(x))

    tried_mentions = total(F.col("chemical_mentions"), lambda c: F.size(c.concentrations))
    parsed_mentions = total(F.col("normalized_chemicals"), lambda c: F.size(c.concentrations))
    tried_steps = total(F.col("_steps"), lambda s: s.n_concentrations + s.n_temperatures + s.n_durations)
    parsed_steps = total(
        F.col("_steps"), lambda s: F.size(s.concentrations) + F.size(s.temperatures) + F.size(s.durations)
    )
    rates = total(F.col("_steps"), lambda s: F.size(s.rates))
    out = out.withColumn("measurements_tried", tried_mentions + tried_steps + rates).withColumn(
        "measurements_parsed", parsed_mentions + parsed_steps + rates
    )

    def unparsed(values: Column, parser, label: str) -> Column:
        missed = F.filter(values, lambda r: parser(r).isNull())
        return F.transform(
            missed, lambda r: F.concat(title, F.lit(f': could not normalize {label} "'), r, F.lit('"'))
        )

    def strict_concentration(r: Column) -> Column:
        return parse_concentration(r, strict)

    no_structure = (F.size("steps") > 0) & ~F.exists("_steps", lambda s: s.structural)
    warnings = F.concat(
        F.flatten(
            F.transform(
                "chemical_mentions",
                lambda c: unparsed(c.concentrations, strict_concentration, "chemical concentration"),
            )
        ),
        F.flatten(
            F.transform(
                "steps",
                lambda s: F.concat(
                    unparsed(s.concentrations, strict_concentration, "step concentration"),
                    unparsed(s.temperatures, parse_temperature, "temperature"),
                    unparsed(s.durations, parse_duration, "duration"),
                ),
            )
        ),
        F.when(
            no_structure,
            F.array(F.concat(title, F.lit(": no structural workflow steps survived normalization filters"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    confidence = F.when(F.col("measurements_tried") == 0, NOTHING_ATTEMPTED).otherwise(
        fixed(F.col("measurements_parsed") / F.col("measurements_tried").cast("double"), 3)
    )
    final_steps = F.transform(
        F.arrays_zip(F.col("_steps").alias("s"), F.col("_next").alias("n")),
        lambda z: F.struct(
            *[z["s"][f].alias(f) for f in (
                "order", "phase", "summary", "chemicals", "concentrations", "temperatures", "durations", "rates",
                "structural")],
            z["n"].alias("next_phase"),
        ),
    )
    return (
        out.withColumn("warnings", warnings)
        .withColumn("normalization_confidence", confidence)
        .withColumn("normalized_steps", final_steps)
        .drop("_steps", "_next", "_stated")
    )


def normalization_totals(normalized: DataFrame) -> DataFrame:
    """Per domain: protocols, chemicals, steps, conditions, measurements, warned."""
    size = F.size
    return normalized.groupBy("domain").agg(
        F.count("*").alias("protocols"),
        F.sum(size("normalized_chemicals")).alias("chemicals"),
        F.sum(size("normalized_steps")).alias("steps"),
        F.sum(size("conditions")).alias("conditions"),
        F.sum("measurements_parsed").alias("measurements"),
        F.count_if(size("warnings") > 0).alias("warned"),
    )


def transition_labels(normalized: DataFrame) -> DataFrame:
    """(domain, family, paper_id, label): each "phase -> next" once per paper."""
    labels = F.array_distinct(
        F.transform(
            F.filter("normalized_steps", lambda s: s.next_phase.isNotNull()),
            lambda s: F.concat(s.phase, F.lit(" -> "), s.next_phase),
        )
    )
    return normalized.select("domain", "family", "paper_id", F.explode(labels).alias("label"))

