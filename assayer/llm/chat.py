r"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

A template says for each role how a turn opens and closes, whether its text counts
for the loss, and which roles may follow. Text that looks like a control string is
escaped, so what was formatted can be read back exactly.

* ``segments`` writes each turn as segments ``(text, loss)``; a turn needs nothing but its own row, so this never shuffles.
* ``validate`` runs the machine over the roles alone. Copies of a row are counted before the
  shuffle, and a conversation travels in stretches of ``STRETCH`` turns, each of which reports the
  role it begins and ends with; only those reports meet per conversation.
* ``read_back`` parses formatted turns in order and digests them. A digest has to see a conversation
  from its first character to its last, so one conversation is one stream through one task, never held whole.

Order inside a conversation: turn (null first), then role, then the hash of the text. Rows equal in
all of these are interchangeable, and all of them are turns. A null role is the role ``""``, a null
text is empty. Rows without an id are one conversation of their own. An empty table gives no rows.
Columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_partitions

#: Turns of one conversation that are validated together.
STRETCH = 4096

START, END = "<start>", "<end>"


@dataclass(frozen=True)
class Template:
    """How turns look, and which role may follow which.

    ``labels`` names the roles in headers; another role is written as ``other`` and its own name, escaped.
    ``follows`` maps a state (``START`` or the role of the turn before) to the roles allowed next; ``END`` among
    them lets a conversation stop there. A turn out of order is still written, and the machine goes on from its role.
    """

    labels: Mapping[str, str]
    learnt: frozenset[str]
    follows: Mapping[str, tuple[str, ...]]
    opens: str = "### "
    named: str = ": "
    closes: str = "</turn>"
    after: str = "\n"
    other: str = "@"
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "controls", (self.escape, self.opens, self.closes))
        if len(self.escape) != 1 or any(not c for c in self.controls) or not self.named:
            raise ValueError("the escape is one character and no control string is empty")
        if any(self.escape in c for c in (self.opens, self.named, self.closes, self.after)):
            raise ValueError("control strings may not hold the escape")
        shown = list(self.labels.values())
        if len(set(shown)) < len(shown) or any(s.startswith(self.other) or self.named in s or self.escape in s for s in shown):
            raise ValueError("labels must differ from each other and from other roles")
        if self.closes[:1] in self.closes[1:]:
            raise ValueError("the closing string may not hold its own first character again")


CHAT = Template(
    labels={"system": "System", "user": "User", "assistant": "Assistant"},
    learnt=frozenset({"assistant"}),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", END)},
)


def _role(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _escaped(text: Column, controls: tuple[str, ...], escape: str) -> Column:
    found = "|".join(re.escape(c) for c in controls)
    return F.regexp_replace(text, F.lit(f"({found})"), F.lit(re.sub(r"([\\$])", r"\\\1", escape) + "$1"))


def segments(df: DataFrame, template: Template = CHAT, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``df`` with ``segments``: array of (text, loss) whose texts joined are the formatted turn.

    The column replaces one of that name. Only the text of a learnt role has ``loss``; markers never do.
    """
    role = _role(role_col)
    label = F.concat(F.lit(template.other), _escaped(role, (*template.controls, template.named), template.escape))
    for name, shown in template.labels.items():
        label = F.when(role == name, shown).otherwise(label)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    body = _escaped(F.coalesce(F.col(text_col), F.lit("")), template.controls, template.escape)
    return df.withColumn(
        "segments",
        F.array(
            segment(F.concat(F.lit(template.opens), label, F.lit(template.named)), F.lit(False)),
            segment(body, role.isin(*template.learnt) if template.learnt else F.lit(False)),
            segment(F.lit(template.closes + template.after), F.lit(False)),
        ),
    )


def validate(
    df: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, valid, n_illegal, first_illegal): does the machine accept each conversation, and where does it first not.

    ``n_illegal`` counts turns that may not follow what stands before them, plus one if the conversation may not end where
    it does. ``first_illegal`` is the turn of the first such turn, null if there is none or only the end is wrong.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), _role(role_col).alias("role"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
    )
    copies = rows.groupBy("id", "turn", "role", "tie").agg(F.count("*").alias("copies"))
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        allowed = F.when(F.col("state") == state, F.col("role").isin(*roles)).otherwise(allowed)

    order = ("turn", "role", "tie")
    stretch = copies.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    judged = (
        stretch.withColumn("state", F.lag("role").over(Window.partitionBy("id", "stretch").orderBy(*order)))
        .withColumn("bad", F.when(F.col("state").isNotNull() & ~allowed, 1).otherwise(0))
        # a copy of a turn follows a turn of its own role
        .withColumn("again", F.when(F.col("copies") > 1, _self_bad(template)).otherwise(0) * (F.col("copies") - 1))
    )
    place = F.struct(*order)
    reports = judged.groupBy("id", "stretch").agg(
        F.min_by("role", place).alias("role"), F.max_by("role", place).alias("last"),
        F.sum(F.col("bad") + F.col("again")).alias("inner"), F.min_by("turn", place).alias("turn"),
        F.min_by("turn", F.when(F.col("bad") + F.col("again") > 0, place)).alias("inner_first"),
        F.max(F.when(F.col("bad") + F.col("again") > 0, 1).otherwise(0)).alias("has_inner"),
    )
    linked = (
        reports.withColumn("state", F.coalesce(F.lag("last").over(Window.partitionBy("id").orderBy("stretch")), F.lit(START)))
        .withColumn("entry", F.when(allowed, 0).otherwise(1))
        .withColumn("at", F.when(F.col("entry") > 0, F.col("turn")).otherwise(F.col("inner_first")))
        .withColumn("wrong", F.col("entry") + F.col("has_inner") > 0)
    )
    ends = [s for s, roles in template.follows.items() if END in roles]
    nth = F.struct(F.col("stretch"))
    return (
        linked.groupBy("id")
        .agg(
            F.sum(F.col("entry") + F.col("inner")).alias("inside"),
            F.min_by("at", F.when(F.col("wrong"), nth)).alias("first_illegal"),
            F.max_by("last", nth).alias("last"),
        )
        .withColumn("n_illegal", (F.col("inside") + F.when(F.col("last").isin(*ends), 0).otherwise(1)).cast("long"))
        .select(F.col("id").alias(id_col), (F.col("n_illegal") == 0).alias("valid"), "n_illegal", "first_illegal")
    )


def _self_bad(template: Template) -> Column:
    fine = [s for s, roles in template.follows.items() if s in roles]
    return F.when(F.col("role").isin(*fine), 0).otherwise(1) if fine else F.lit(1)


def parse(text: str, template: Template = CHAT) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; anything that is not a turn raises ``ValueError``."""
    one = re.escape(template.escape)
    plain = re.compile(f"{one}(.)", re.DOTALL)
    ends = {s: re.compile(f"{one}.|({re.escape(s)})", re.DOTALL) for s in (template.named, template.closes)}
    roles = {shown: name for name, shown in template.labels.items()}

    def upto(mark: str, start: int) -> int:
        for hit in ends[mark].finditer(text, start):
            if hit[1] is not None:
                return hit.start()
        raise ValueError(f"no {mark!r} after character {start}")

    at = 0
    while at < len(text):
        if not text.startswith(template.opens, at):
            raise ValueError(f"no turn opens at character {at}")
        at += len(template.opens)
        named = upto(template.named, at)
        label = text[at:named]
        role = plain.sub(r"\1", label[len(template.other) :]) if label.startswith(template.other) else roles[label]
        at = named + len(template.named)
        closed = upto(template.closes, at)
        yield role, plain.sub(r"\1", text[at:closed])
        at = closed + len(template.closes) + len(template.after)


class _Digest:
    """The running figures of one conversation."""

    def __init__(self, key) -> None:
        self.key, self.turns, self.chars, self.loss = key, 0, 0, 0
        self.all, self.learnt = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def read_back(
    formatted: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from ``segments``.

    Turns come from parsing the formatted text, the loss text from the flagged segments alone; the
    columns ``turn``, ``role`` and ``text`` only give the order.
    """
    kind = formatted.schema[id_col].dataType.simpleString()
    plain = re.compile(f"{re.escape(template.escape)}(.)", re.DOTALL)
    ordered = (
        formatted.select(
            F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), _role(role_col).alias("role"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), "segments",
        )
        .repartition("id")
        .sortWithinPartitions("id", "turn", "role", "tie")
        .select("id", "segments")
    )
    schema = f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        names: list[str] = []
        for batch in batches:
            done, id_type = [], batch.schema.field(0).type
            names = names or [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                text = "".join(p["text"] for p in parts)
                now.chars += len(text)
                for role, said in parse(text, template):
                    now.turns += 1
                    now.all.update(f"{role}\n{said}\n".encode())
                learnt = plain.sub(r"\1", "".join(p["text"] for p in parts if p["loss"]))
                now.loss += len(learnt)
                now.learnt.update(learnt.encode())
            if done:
                yield _batch(done, names, id_type)
        if now is not None:
            yield _batch([now.row()], names, id_type)

    return map_partitions(ordered, run, schema)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
