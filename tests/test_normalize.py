from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from assayer.config.defaults import PHASE_RANK
from assayer.functions.measures import parse_concentration, parse_duration, parse_rate, parse_temperature
from assayer.operators.normalize import next_phases, normalize_extraction

MENTION = "struct<name:string,aliases:array<string>,concentrations:array<string>,sentences:array<string>>"
STEP = (
    "struct<order:int,phase:string,summary:string,chemicals:array<string>,concentrations:array<string>,"
    "temperatures:array<string>,durations:array<string>,confidence:double>"
)
SCHEMA = f"domain string, family string, title string, chemical_mentions array<{MENTION}>, steps array<{STEP}>"


def step(order, phase, summary, chemicals=(), concentrations=(), temperatures=(), durations=()):
    return (order, phase, summary, list(chemicals), list(concentrations), list(temperatures), list(durations), 0.9)


def normal(spark, steps=(), mentions=()):
    df = spark.createDataFrame([("islets", "vitrification", "Paper", list(mentions), list(steps))], SCHEMA)
    return normalize_extraction(df).first()


DMSO = "Dimethyl Sulfoxide"


def test_measurements_are_parsed(spark):
    row = normal(spark, [step(0, "cooling", "Cooling at 0.25 C/min after loading.", [DMSO], ["2 M"], ["-40 C"], ["5 min"])])
    s = row.normalized_steps[0]
    assert [m.text for m in s.concentrations] == ["2 M"]
    assert [m.text for m in s.temperatures] == ["-40 C"]
    assert [m.text for m in s.durations] == ["5 min"]
    assert [(m.text, m.kind) for m in s.rates] == [("0.25 C/min", "warming-rate")]
    assert row.normalization_confidence == 1.0


def test_transitions_skip_noise(spark):
    row = normal(
        spark,
        [
            step(0, "loading", "Loaded with solution.", [DMSO]),
            step(1, "assessment", "Viability was assessed."),
            step(2, "cooling", "Cooled slowly."),
            step(3, "storage", "Stored in liquid nitrogen."),
        ],
    )
    assert [s.next_phase for s in row.normalized_steps] == ["cooling", None, "storage", None]


def test_no_backward_transition_and_warnings(spark):
    row = normal(
        spark,
        [
            step(0, "storage", "Stored.", concentrations=["roughly high"]),
            step(1, "cooling", "Cooled.", durations=["overnight"], temperatures=["cold"]),
        ],
    )
    assert [s.next_phase for s in row.normalized_steps] == [None, None]
    assert len(row.warnings) == 3
    assert row.normalization_confidence == 0.0


def test_nothing_attempted_is_not_zero(spark):
    assert normal(spark).normalization_confidence == 0.7


def test_step_condition_wins_over_mention(spark):
    mention = (DMSO, ["dmso"], ["1.5 M"], ["x"])
    row = normal(spark, [step(0, "loading", "Loaded with 2 M DMSO.", [DMSO], ["2 M"])], [mention])
    assert [(c.phase, c.label, c.source) for c in row.conditions] == [("loading", f"{DMSO} 2 M", "step")]


def test_mention_condition_is_the_fallback(spark):
    mention = (DMSO, ["dmso"], ["1.5 M"], ["x"])
    row = normal(spark, [step(0, "loading", "Loaded with DMSO.", [DMSO])], [mention])
    assert [(c.phase, c.label, c.source) for c in row.conditions] == [("unknown", f"{DMSO} 1.5 M", "chemical-mention")]


def test_shared_concentration_goes_to_both(spark):
    mentions = [(DMSO, ["me2so"], [], ["x"]), ("Ethylene Glycol", ["eg"], [], ["x"])]
    row = normal(
        spark, [step(0, "loading", "Loading in Me2SO 1.5 M and EG 1.5 M.", [DMSO, "Ethylene Glycol"], ["1.5 M"])], mentions
    )
    assert sorted(c.label for c in row.conditions) == [f"{DMSO} 1.5 M", "Ethylene Glycol 1.5 M"]


@pytest.mark.parametrize(
    ("parser", "raw", "want"),
    [
        (parse_concentration, "1.50 mol/L", "1.5 M"),
        (parse_concentration, "20 ug/ml", "20 ug/mL"),
        (parse_concentration, "10% EG", None),
        (parse_concentration, "10%v", "10 %"),
        (parse_temperature, "-196 °C", "-196 C"),
        (parse_temperature, "37 degrees C", "37 C"),
        (parse_duration, "2 hrs", "2 hour"),
        (parse_duration, "overnight", None),
    ],
)
def test_units(spark, parser, raw, want):
    got = spark.createDataFrame([(raw,)], "r string").select(parser(F.col("r")).text).first()[0]
    assert got == want


def test_loose_percent(spark):
    df = spark.createDataFrame([("10% EG",)], "r string")
    assert df.select(parse_concentration(F.col("r"), strict=False).text).first()[0] == "10 %"


def test_rates(spark):
    df = spark.createDataFrame([("-0.3 °C/min", "cooling"), ("5 C per hour", "warming"), ("none", "cooling")], "r string, p string")
    got = [r[0] for r in df.select(parse_rate(F.col("r"), F.col("p"))).collect()]
    assert [(m.kind, m.text) if m else None for m in got] == [
        ("cooling-rate", "-0.3 C/min"), ("warming-rate", "5 C/hour"), None,
    ]


def test_transitions_of_long_workflows_match_brute_force(spark):
    rng = random.Random(8)
    names = [*PHASE_RANK, "something else", None]
    rows = [[(rng.choice(names), rng.random() < 0.7) for _ in range(n)] for n in (0, 1, 2, 7, 60, 60, 400)] + [None, [("storage", None), ("culture", True)]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, steps array<struct<phase:string,structural:boolean>>")
    got = {r.id: r.next for r in df.select("id", next_phases(F.col("steps")).alias("next")).collect()}

    def leads_to(steps, i):
        phase, structural = steps[i]
        rank = PHASE_RANK.get(phase, 99)
        later = (p for p, s in steps[i + 1 :] if s and p != phase and rank <= PHASE_RANK.get(p, 99) < 99)
        return next(later, None) if structural and rank < 99 else None

    assert got == {i: None if steps is None else [leads_to(steps, j) for j in range(len(steps))] for i, steps in enumerate(rows)}


def test_transitions_cost_as_much_as_there_are_steps(spark):
    def seconds(n):
        step = F.struct(F.lit("storage").alias("phase"), F.lit(True).alias("structural"))
        df = spark.range(1).select(F.array_repeat(step, n).alias("steps"))
        start = time.perf_counter()
        assert df.select(F.array_size(F.array_compact(next_phases(F.col("steps")))).alias("n")).first().n == 0
        return time.perf_counter() - start

    seconds(10)
    assert seconds(200_000) < 60
