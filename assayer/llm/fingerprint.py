"""Order MinHash fingerprints, with built-in functions only.

A text is a sequence of words; scripts written without spaces count by
character. Its k-mers (k words in a row) are numbered by occurrence, so the
second time a k-mer appears it is another element. Under each of ``sketches`` hash
functions the two elements with the smallest hashes are selected, put back in
the order in which they stand in the text, and hashed as a pair. Two texts agree on
a sketch if they share both elements and their order, so the share of equal
sketches falls with edits and with moved passages alike.

The hash functions are rotations of one 64-bit hash: function j subtracts its own
constant, around the circle of hashes. The smallest elements under a rotation are those that
follow the constant in hash order, so one sorted array serves all sketches, and a
sketch costs a bisection instead of a pass over the text.

Everything about one text happens inside its row: nothing is exploded and no
row leaves its partition for a fingerprint. An element is one long, the upper
bits its hash and the lower ones its position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bisect

#: Words of a k-mer, and sketches of a fingerprint.
KMER = 3
SKETCHES = 32
#: Lower bits of an element: its position, up to 268 million words in one text.
POSITION_BITS = 28
_MASK = (1 << POSITION_BITS) - 1
#: Rows of a range of neighbouring ids, ranges at most (their edges are a literal), and ids looked at for an edge.
RANGE_ROWS = 512
RANGES = 1 << 16
EDGE_IDS = 64

#: A character of a script without spaces, or a word.
_UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upper(c: Column) -> Column:
    return F.shiftright(c, POSITION_BITS)


def _packed(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_MASK)).bitwiseOR(position)


def _occurrence(elements: Column, at: Column, key: Column) -> Column:
    """How many elements before ``at`` have the same key; ``elements`` are sorted, so the run is found by bisection."""

    def step(back: Column, power: Column) -> Column:
        wider = back + power
        same = (at >= wider) & (_upper(F.get(elements, at - wider)) == key)
        return F.when(same, wider).otherwise(back)

    first = (at == 0) | (_upper(F.get(elements, at - 1)) != key)
    run = F.aggregate(F.lit([1 << b for b in range(POSITION_BITS, -1, -1)]), F.lit(0), step)
    return F.when(first, F.lit(0)).otherwise(run)


def _rotations(n: int) -> list[int]:
    """The constants of the rotations, evenly spread over the circle."""
    spread = [(j + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for j in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in spread]


def _sketch(elements: Column, n: Column, start: Column) -> Column:
    """Hash of the two elements that follow ``start``, in the order of the text."""

    def step(count: Column, power: Column) -> Column:
        more = count + power
        return F.when(F.coalesce(F.get(elements, more - 1) <= start, F.lit(False)), more).otherwise(count)

    def pair(at: Column) -> Column:
        return _let(F.get(elements, at % n), lambda a: _let(F.get(elements, (at + 1) % n), lambda b: ordered(a, b)))

    def ordered(a: Column, b: Column) -> Column:
        before = a.bitwiseAND(F.lit(_MASK)) <= b.bitwiseAND(F.lit(_MASK))
        return F.when(before, F.xxhash64(_upper(a), _upper(b))).otherwise(F.xxhash64(_upper(b), _upper(a)))

    return _let(F.aggregate(F.lit([1 << b for b in range(POSITION_BITS - 1, -1, -1)]), F.lit(0), step), pair)


def fingerprint(text: Column, sketches: int = SKETCHES, k: int = KMER) -> Column:
    """Array of ``sketches`` hashes. A null text counts as empty; all texts without a word are equal."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))

    def kmers(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        return F.sort_array(F.transform(at, lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i.cast("long"))))

    def numbered(s: Column) -> Column:
        # hashed again with the number, because the key alone repeats
        return F.sort_array(
            F.transform(s, lambda v, i: _packed(F.xxhash64(_upper(v), _occurrence(s, i, _upper(v))), v.bitwiseAND(F.lit(_MASK))))
        )

    def sketched(e: Column) -> Column:
        return _let(F.size(e), lambda n: F.transform(F.lit(_rotations(sketches)), lambda start: _sketch(e, n, start)))

    return _let(words, lambda w: _let(kmers(w), lambda s: _let(numbered(s), sketched)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches, from 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same.cast("double") / F.size(a)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(df: DataFrame, derived: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the columns ``derived`` and ``next``: those of the following row with its text, by id and then text.

    The last row is followed by the first. Ids are cut into ranges by rough
    quantiles. Rows are dealt by range, once, and each range ends with a copy of
    the first row of the range after it, so a window inside a range sees every
    neighbour. Rows without an id come first; rows that share one id stay in one range.
    """
    ids = df.select(id_col)
    known = ids.agg(F.count(id_col)).first()[0]
    ranges = min(RANGES, max(1, known // RANGE_ROWS))
    edges: list[int] = []
    if ranges > 1:
        some = ids.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, known // (EDGE_IDS * ranges)))) == 0)
        at = F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 4 * ranges)
        edges = sorted(set(some.agg(at).first()[0] or []))

    def dealt(rows: DataFrame) -> DataFrame:
        # range 0 holds the rows without an id
        return rows.withColumn("_range", F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(bisect(F.col(id_col), edges) + 1))

    lows = dealt(ids).groupBy("_range").agg(F.min(id_col).alias("_low")).orderBy("_range").collect()
    kind = df.schema[id_col].dataType.simpleString()
    rings = df.sparkSession.createDataFrame(
        [(r["_range"], r["_low"], lows[i - 1]["_range"]) for i, r in enumerate(lows)], f"_range int, _low {kind}, _before int"
    )
    # at most RANGES + 1 short rows, so the broadcast is bounded
    firsts = (
        dealt(df)
        .join(F.broadcast(rings), "_range")
        .where(F.col(id_col).eqNullSafe(F.col("_low")))
        .groupBy("_range", "_before")
        .agg(F.min_by(F.struct(*df.columns), F.struct(id_col, text_col)).alias("_first"))
        .select("_first.*", F.col("_before").alias("_range"), F.lit(1).alias("_copy"))
    )
    both = dealt(df).withColumn("_copy", F.lit(0)).unionByName(firsts).withColumns(derived)
    ahead = F.lead(F.struct(text_col, *derived)).over(Window.partitionBy("_range").orderBy("_copy", id_col, text_col))
    return both.withColumn("next", ahead).where("_copy = 0").drop("_copy", "_range")


def edited_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    ``edited``: the last quarter of the code points gives way to as many from the
    start of the next text (or all it has). Null texts count as empty, and empty
    ones have the fingerprint of a text without words; repeated rows follow each other, so a
    row may be its own copy's neighbour; a single row is followed by itself. An
    empty table gives an empty table; columns beside id and text are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter))
    pairs = with_next(rows, {"fingerprint": fingerprint(F.col("text"))}).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        edited.alias("edited"),
        "fingerprint",
        F.col("next.fingerprint").alias("_next"),
    )
    done = pairs.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return done.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
