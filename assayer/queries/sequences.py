"""Ordered queries over long sequences: user event streams and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, sequence, skew
from . import corpus
from .registry import query

EVENT_RANK = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
_RANKED = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in EVENT_RANK.items()) + " end"


def events(spark, sf):
    return corpus.table(spark, sf, "events")


def block(col: str, size: int = 256):
    """Chunk of a position: a monotone function of the order."""
    return F.floor(F.col(col) / size)


_NEXT = ", ".join(
    f"min(case when event_type = '{p}' then event_id end) over (partition by user_id order by event_id "
    f"rows between 1 following and unbounded following) as n_{p}"
    for p in EVENT_RANK
)
_OPTIONS = ", ".join(
    f"case when event_type <> '{p}' and {r} >= rk then n_{p} end" for p, r in EVENT_RANK.items()
)


@query(
    "phase_transitions",
    f"""with e as (select *, {_RANKED} as rk, {_NEXT} from events),
    o as (select *, least({_OPTIONS}) as nx from e)
    select o.event_id, o.user_id, case when o.rk is not null then n.event_type end as next_phase
    from o left join events n on n.event_id = o.nx""",
)
def phase_transitions(spark, sf):
    rows = events(spark, sf).select(
        "event_id", "user_id", F.col("event_type").alias("phase"), (F.col("event_type") != "error").alias("structural")
    )
    out = sequence.phase_transitions(rows, ["user_id"], block("event_id"), "event_id", ranks=EVENT_RANK)
    return out.select("event_id", "user_id", "next_phase")


@query(
    "step_ordinals",
    "select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as step_no from events",
)
def step_ordinals(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id")
    return sequence.step_ordinals(rows, ["user_id"], block("event_id"), "event_id", out="step_no")


@query(
    "first_by_key",
    """select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders
    qualify row_number() over (partition by o_custkey order by o_orderkey) = 1""",
)
def first_by_key(spark, sf):
    rows = corpus.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return skew.first_by_key(rows, ["o_custkey"], "o_orderkey")


@query(
    "last_by_key",
    """select user_id, event_type, event_id, value from events
    qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1""",
)
def last_by_key(spark, sf):
    rows = events(spark, sf).select("user_id", "event_type", "event_id", "value")
    return skew.last_by_key(rows, ["user_id", "event_type"], "event_id")


_CYCLES = """cycles as (
  select event_type as domain, cycle, sha256(n || ':' || total) as state_hash from (
    select event_type, cast(datediff('day', date '2024-01-01', cast(ts as date)) as integer) as cycle,
      cast(count(*) // 40 as varchar) as n, cast(count(distinct user_id) // 40 as varchar) as total
    from events group by 1, 2))"""


def cycles(spark, sf):
    """Each event type as a domain, each day as a cycle with a coarse state hash."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    counts = events(spark, sf).groupBy(F.col("event_type").alias("domain"), day.alias("cycle")).agg(
        F.floor(F.count("*") / 40).alias("n"), F.floor(F.count_distinct("user_id") / 40).alias("u")
    )
    state = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("u").cast("string")), 256)
    return counts.select("domain", "cycle", state.alias("state_hash"))


@query(
    "cycle_state_change",
    f"""with {_CYCLES}, p as (select *, lag(state_hash) over (partition by domain order by cycle) as state_before
    from cycles) select domain, cycle, state_hash, state_before, state_before is distinct from state_hash as changed from p""",
)
def cycle_state_change(spark, sf):
    return decide.cycle_state_change(cycles(spark, sf), block("cycle", 8))


@query(
    "capped_history",
    """select user_id as domain, event_id, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id) <= 50""",
)
def capped_history(spark, sf):
    rows = events(spark, sf).select(F.col("user_id").alias("domain"), F.col("ts").alias("run_ts"), "event_id", "value")
    return decide.capped_history(rows, "event_id").select("domain", "event_id", "value")
