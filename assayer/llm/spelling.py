"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

1. ``vocabulary`` counts words, per task first.
2. ``filters`` lays one blocked Bloom filter per word length side by side in an array of bits. Longer words have more
   edits, so their filters get more bits per word. Segments of the array are made in tasks; the array is broadcast and never
   exceeds ``FILTER_BYTES``: a larger vocabulary is split by hash into as many arrays as it takes, each probed in a pass of its own.
3. ``neighbours`` generates every edit of every word as a hash (a word's hash is the XOR of a mix of each place and letter, so an
   edit costs one or two XORs) and probes the filter of the edit's length. Of two words one edit apart exactly
   one generates the other: the longer deletes, the one with the smaller letter replaces, and in a run of equal
   letters only the last is deleted. What passes is spelled out and joined with the vocabulary, which removes false positives.
4. ``forms`` counts near words, picks each word's form and follows forms to the last.

A word has at most 90 letters to choose from at each place, so the number of its near words is bounded by its length, not by the
table. Null texts have no words. A null id counts as an empty one. Repeated rows count each. An empty table, or one
whose words occur once, gives no rows. Words of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_partitions, stored, tasks_for

#: Letters of a word, lower-cased only from A to Z, in code-point order.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
EVERY = 31

#: Distinct words a task counts before it hands them on.
HELD_WORDS = 1 << 17
#: Bytes of one array of filters: what a broadcast may weigh.
FILTER_BYTES = 32 << 20
#: 64-bit words of a filter block (one cache line), and blocks of a segment.
LANES, SEGMENT = 8, 512
#: Edits hashed at once.
CHUNK = 1 << 20

_WORDS = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")


def occurring(doc_id, text: str) -> Counter:
    """Words of a text and how often each occurs, after the deletions that id and run decide."""
    runs = Counter(_WORDS.findall(text.encode().lower().decode()))  # bytes lower only A-Z
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % EVERY == 0:
            cut = h % len(run)
            run = run[:cut] + run[cut + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.update(occurring(doc_id, text))
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    counted = map_partitions(df.select(F.col(id_col).cast("string"), text_col), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -- hashes and filters -------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: neighbouring inputs get unrelated outputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((place.astype(np.uint64) * np.uint64(128) + letter.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def codes(words: list[str]) -> np.ndarray:
    """Places of the letters of equally long words in ``LETTERS``."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.where(flat < 0xC0, flat.astype(np.int16) - ord("a"), flat.astype(np.int16) - 0xC0 + 26)


def hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(_at(np.arange(letters.shape[1]), letters), axis=1) if letters.size else np.zeros(len(letters), np.uint64)


def bits_per_word(length: int) -> int:
    """Enough that the false positives of all edits of a word stay few, whatever its length."""
    return 16 + 4 * max(0, (length // 8).bit_length())


class Layout:
    """Where the filter of each length lies in the array; ``parts`` arrays share the vocabulary by hash."""

    def __init__(self, counts: dict[int, int], limit: int) -> None:
        total = sum(n * bits_per_word(length) for length, n in counts.items()) // 8
        self.parts = max(1, -(-total // limit))
        self.blocks: dict[int, tuple[int, int]] = {}
        self.size = 0
        for length, n in sorted(counts.items()):
            own = max(1, n * bits_per_word(length) // self.parts // (64 * LANES))
            self.blocks[length] = (self.size, own)
            self.size += own

    def part(self, h: np.ndarray) -> np.ndarray:
        return (_mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.parts)).astype(np.int64)

    def block(self, h: np.ndarray, length: int) -> np.ndarray:
        start, own = self.blocks[length]
        return start + ((h >> np.uint64(32)) * np.uint64(own) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bits(h: np.ndarray) -> Iterator[np.ndarray]:
        """One bit for each lane of a block, six bits of a second hash at a time."""
        h = _mix(h + np.uint64(0x2545F4914F6CDD1D))
        for lane in range(LANES):
            yield np.uint64(1) << ((h >> np.uint64(6 * lane)) & np.uint64(63))


def filters(words: DataFrame, limit: int = FILTER_BYTES) -> tuple[Layout, list]:
    """The layout, and for each part a broadcast array of its filters."""
    spark = words.sparkSession
    counts = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    layout = Layout(counts, limit)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, h = _grouped(batch.column(0).to_pylist())
        block = np.concatenate([layout.block(h[places], length) for length, places in own.items()])
        h = np.concatenate([h[places] for places in own.values()])
        return pa.RecordBatch.from_arrays(
            [pa.array(layout.part(h)), pa.array(block // SEGMENT), pa.array(block % SEGMENT), pa.array(h.view(np.int64))],
            names=["part", "segment", "block", "h"],
        )

    def segment(table: pa.Table) -> pa.Table:
        made = np.zeros((SEGMENT, LANES), np.uint64)
        blocks, h = table["block"].to_numpy(), table["h"].to_numpy().view(np.uint64)
        for lane, bits in enumerate(layout.bits(h)):
            np.bitwise_or.at(made[:, lane], blocks, bits)
        return pa.table({"part": table["part"][:1], "segment": table["segment"][:1], "bits": pa.array([made.tobytes()], pa.binary())})

    keyed = map_batches(words.select("word"), hashed, "part long, segment long, block long, h long")
    made = stored(keyed.groupBy("part", "segment").applyInArrow(segment, "part long, segment long, bits binary"), "filters")
    arrays = []
    for part in range(layout.parts):
        array = np.zeros((-(-layout.size // SEGMENT) * SEGMENT, LANES), np.uint64)
        for row in made.where(F.col("part") == part).toLocalIterator():  # at most ``limit`` bytes and a segment
            start = row["segment"] * SEGMENT
            array[start : start + SEGMENT] = np.frombuffer(row["bits"], np.uint64).reshape(SEGMENT, LANES)
        arrays.append(spark.sparkContext.broadcast(array))
    return layout, arrays


def _grouped(words: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Places of the words by length, and the hash of each word."""
    lengths = np.array([len(w) for w in words])
    own = {int(length): np.flatnonzero(lengths == length) for length in np.unique(lengths)}
    h = np.zeros(len(words), np.uint64)
    for places in own.values():
        h[places] = hashes(codes([words[i] for i in places]))
    return own, h


def _passing(h: np.ndarray, length: int, layout: Layout, array: np.ndarray, part: int) -> np.ndarray:
    """Places of the hashes that the filter of this length does not rule out."""
    left = np.arange(len(h)) if layout.parts == 1 else np.flatnonzero(layout.part(h) == part)
    block = layout.block(h[left], length)
    for lane, bits in enumerate(layout.bits(h[left])):
        hit = (array[block, lane] & bits) != 0 if lane == 0 else (array[block[keep], lane] & bits[keep]) != 0
        keep = np.flatnonzero(hit) if lane == 0 else keep[hit]
    return left[keep]


def edits(words: list[str], layout: Layout, array: np.ndarray, part: int) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for every generated edit that passes its filter; all words are equally long."""
    letters = codes(words)
    length = letters.shape[1]
    whole = hashes(letters)
    stretch = max(1, CHUNK // (len(LETTERS) * len(words)))
    if length in layout.blocks:
        for start in range(0, length, stretch):
            place = np.arange(start, min(length, start + stretch))
            old = letters[:, place]
            without = whole[:, None] ^ _at(place, old)
            new = np.arange(len(LETTERS))
            w, p, c = np.nonzero(new > old[:, :, None])
            h = without[w, p] ^ _at(place[:, None], new)[p, c]
            for hit in _passing(h, length, layout, array, part):
                i, at = int(w[hit]), int(place[p[hit]])
                yield i, words[i][:at] + LETTERS[c[hit]] + words[i][at + 1 :]
    if length - 1 in layout.blocks:
        places = np.arange(length)
        # letters before the deleted one keep their place, those behind it move up
        before = np.bitwise_xor.accumulate(_at(places, letters), axis=1)
        moved = np.bitwise_xor.accumulate(_at(np.maximum(places - 1, 0), letters)[:, ::-1], axis=1)[:, ::-1]
        h = np.zeros_like(before)
        h[:, 1:] ^= before[:, :-1]
        h[:, :-1] ^= moved[:, 1:]
        last = np.ones(letters.shape, bool)
        last[:, :-1] = letters[:, :-1] != letters[:, 1:]
        w, p = np.nonzero(last)
        for hit in _passing(h[w, p], length - 1, layout, array, part):
            i, at = int(w[hit]), int(p[hit])
            yield i, words[i][:at] + words[i][at + 1 :]


def neighbours(words: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): each two words one edit apart, once."""
    layout, arrays = filters(words, limit)

    def probe(part: int, held) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            own, _ = _grouped(texts)
            at, found = [], []
            for places in own.values():
                for i, edit in edits([texts[i] for i in places], layout, held.value, part):
                    at.append(int(places[i]))
                    found.append(edit)
            if not at:
                return None
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(n[at], pa.int64()), pa.array(found, pa.string())], names=["word", "n", "near"])

        # few bytes, many edits: the words are dealt to all tasks
        dealt = words.select("word", "n").repartition(tasks_for(words), "word")
        return map_batches(dealt, run, "word string, n long, near string")

    positives = None
    for part, held in enumerate(arrays):
        one = probe(part, held)
        positives = one if positives is None else positives.unionByName(one)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return positives.join(known, "near").select("word", "n", "near", "near_n")


# -- forms --------------------------------------------------------------------


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for words that have a form: forms are followed by doubling.

    A form is at least ``FORM_RATIO`` times as frequent, so chains are short and never close.
    """
    hops = stored(links.select("word", F.col("form").alias("root")), "hops")
    while True:
        next_ = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = stored(hops.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "hops")
        if hops.where("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word. Strings order by their UTF-8 bytes, which is code-point order."""
    sides = F.explode(F.array(
        F.struct(F.col("word").alias("word"), F.col("near").alias("near"), F.col("near_n").alias("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )).alias("side")
    near = pairs.select(sides).select("side.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    counted = words.join(near, "word", "left")
    enough = -F.col("best.less") >= FORM_RATIO * F.col("n")
    chosen = stored(counted.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots = _roots(chosen.where("form is not null"))
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = FILTER_BYTES) -> DataFrame:
    """Every word of the vocabulary with its near words counted, its form and the root of its chain of forms."""
    words = stored(vocabulary(df, id_col, text_col), "vocabulary")
    return forms(words, neighbours(words, limit))
