from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assayer.llm import chat, queries
from assayer.llm.chat import CHAT, END, START, Template

SCHEMA = "conv_id long, turn long, role string, text string, lang string, segments string, stretch long, state string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "x", 3, "y") for r in rows], SCHEMA)


def digests(rows):
    """By conversation, without escaping or machine: what reading back must give."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def accepted(rows):
    """(n_illegal, first_illegal) by running the machine turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        state, wrong, first = START, 0, None
        for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
            role = r[2] or ""
            if role not in CHAT.follows.get(state, ()):
                wrong, first = wrong + 1, r[1] if not wrong else first
            state = role
        out[conv] = (wrong + (END not in CHAT.follows.get(state, ())), first)
    return out


def awkward():
    rnd = random.Random(3)
    hard = ["", None, "\\", "\\\\", "### ", "</turn>", "</tur", "### User: hi</turn>\n", "a\\</turn>", "#### x", "a: b", "😀 é", "x" * 50_000, "</turn>\n### Assistant: "]
    rows = []
    for conv in range(30):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["system", "user", "assistant", "tool: x\\", None]) if conv % 3 == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, rnd.choice(hard)))
    return rows + [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (77, None, "system", "s"), (77, 0, "user", "q"), (77, 1, "assistant", "</turn>")]


def test_formatted_conversations_read_back(spark):
    rows = awkward()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.segments(frame(spark, rows))).collect()}
    assert got == digests(rows)


def test_machine_matches_turn_by_turn(spark, monkeypatch):
    rows = awkward() + [(500, t, ("user", "assistant")[t % 2] if t != 21 else "user", f"{t}") for t in range(40)]
    for stretch in (4096, 3):
        monkeypatch.setattr(chat, "STRETCH", stretch)
        got = {r.conv_id: (r.n_illegal, r.first_illegal) for r in chat.validate(frame(spark, rows)).collect()}
        assert got == accepted(rows)


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "q")] * 3 + [(1, 1, "assistant", "a")]
    assert chat.validate(frame(spark, rows)).first()[1:] == (False, 2, 0)
    assert chat.read_back(chat.segments(frame(spark, rows))).first().n_turns == 4


def test_segments_and_flags(spark):
    found = chat.segments(frame(spark, [(1, 0, "assistant", "x \\ </turn>"), (1, 1, "critic", "y")])).orderBy("turn").collect()
    assert [tuple(s) for s in found[0].segments] == [("### Assistant: ", False), ("x \\\\ \\</turn>", True), ("</turn>\n", False)]
    assert [tuple(s) for s in found[1].segments] == [("### @critic: ", False), ("y", False), ("</turn>\n", False)]


def test_what_is_no_turn_is_refused():
    for text in ("hello", "### User: no end", "### User", "### Nobody: x</turn>\n"):
        with pytest.raises((ValueError, KeyError)):
            list(chat.parse(text))


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"escape": "##"}, {"closes": ""}, {"labels": {"a": "X", "b": "X"}}, {"labels": {"a": "@b"}}, {"closes": "</t<"}):
        with pytest.raises(ValueError):
            Template(**{"labels": {"user": "User"}, "learnt": frozenset(), "follows": {}, **wrong})


def test_empty_table(spark):
    none = frame(spark, []).where("false")
    assert chat.read_back(chat.segments(none)).count() == 0 and chat.validate(none).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = given + [(-7, 0, "user", queries.HOSTILE), (-7, 1, "assistant", queries.HOSTILE)]
    got = queries.op11(spark, sf)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == digests(rows)
    assert {r.conv_id: (r.n_illegal, r.first_illegal) for r in got.collect()} == accepted(rows)
    own = got.where(F.col("conv_id") == -7).first()
    assert own.valid and own.loss_chars == len("\\### Assistant: </turn> ok") and own.formatted_chars > 2 * own.loss_chars
