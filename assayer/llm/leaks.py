"""Benchmark decontamination: an inverted index of test items, queried by every passage.

The index holds BM25 impacts of the test items, each as a share of the item's
own total, so a passage's score against an item lies between 0 and 1 and says
how much of the item, weighed by BM25, stands in the passage. Every document is
read as overlapping passages; each queries the index by block-max WAND:

* a term's largest impact bounds it in its whole list; passages whose terms'
  bounds do not add up to the threshold have no pivot and are done;
* for the others the largest impacts by block of items are added, and only
  blocks that can reach the threshold are opened;
* there the exact scores are computed, and all items above it are retrieved.

Retrieved items are then compared word by word: enough of the word triples of
the question and of the answer must stand in the passage.

Test items are indexed in blocks of bounded size, one broadcast each, so the benchmark
may be of any size; statistics (document frequencies, lengths) are taken over
all items.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, small_batches

#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Least share of an item's BM25 mass, and of the word n-grams of its question and answer.
SCORE = 0.6
OVERLAP = 0.5
GRAM = 3
#: Items under this many words must stand in the passage word for word.
SHORT = 8
#: Words from the start of a passage to the next; a passage is longer by the longest item.
STRIDE = 128
#: Items of a block of the index, and words of the items that one index (one broadcast) takes.
BLOCK = 8
INDEX_WORDS = 60_000
#: Bounds added at a time.
CELLS = 4_000_000

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence answers, or else the last third of the words."""
    sentences = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    """Distinct n-grams; fewer words make one gram."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def share(part: set[tuple[str, ...]], passage: list[str], n: int = GRAM) -> float:
    """Share of the grams of a question or answer that a passage holds; 1 for an empty part."""
    if not part:
        return 1.0
    length = len(next(iter(part)))
    held = {tuple(passage[i : i + length]) for i in range(len(passage) - length + 1)}
    return len(part & held) / len(part)


def _contains(passage: list[str], words: list[str]) -> bool:
    n = len(words)
    return any(passage[i : i + n] == words for i in range(len(passage) - n + 1))


@dataclass
class Index:
    """Postings of one block of items: for term t, items[starts[t]:starts[t+1]] with their impacts."""

    ids: list
    texts: list[str]
    terms: dict[str, int]
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        n, blocks = len(self.terms), -(-len(self.ids) // BLOCK)
        self.top = np.zeros(n, dtype=np.float64)  # bound of each list
        self.block_top = np.zeros((n, blocks), dtype=np.float32)  # and of each block in it
        owner = np.repeat(np.arange(n), np.diff(self.starts))
        np.maximum.at(self.top, owner, self.impacts)
        np.maximum.at(self.block_top, (owner, self.items // BLOCK), self.impacts.astype(np.float32) * np.float32(1 + 1e-6))
        # where the postings of a term in a block begin
        held = np.bincount(owner * blocks + self.items // BLOCK, minlength=n * blocks)
        self.block_starts = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        self.parts = [tuple(grams(p) for p in question_answer(t)) for t in self.texts]
        self.words = [words_of(t) for t in self.texts]

    def __reduce__(self):
        return Index, (self.ids, self.texts, self.terms, self.starts, self.items, self.impacts, self.longest)

    def scores(self, terms: np.ndarray, block: int) -> np.ndarray:
        """Exact scores of the items of a block for the distinct terms of a passage."""
        cell = terms * self.block_top.shape[1] + block
        first, many = self.block_starts[cell], self.block_starts[cell + 1]
        many = many - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.items[at] - block * BLOCK, self.impacts[at], BLOCK)

    def search(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold.

        ``ids`` has the term of each word of a text, -1 for a word no item has.
        """
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        n = len(self.terms)
        length = STRIDE + self.longest
        passages = []
        for back in range(-(-length // STRIDE)):  # the passages that cover a word
            p = at // STRIDE - back
            ok = (p >= 0) & (at < p * STRIDE + length)
            passages.append(p[ok] * n + ids[at[ok]])
        pairs = np.unique(np.concatenate(passages))
        passage, term = pairs // n, pairs % n
        bound = np.bincount(passage, self.top[term])
        alive = bound[passage] >= threshold - 1e-9
        passage, term = passage[alive], term[alive]
        if not len(passage):
            return []
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        found = []
        step = max(1, CELLS // (self.block_top.shape[1] * min(n, length)))
        for lo in range(0, len(first), step):
            heads = first[lo : lo + step]
            end = int(first[lo + step]) if lo + step < len(first) else len(passage)
            bounds = np.add.reduceat(self.block_top[term[heads[0] : end]], heads - heads[0], axis=0)
            stops = [*heads[1:].tolist(), end]
            for k, block in zip(*np.nonzero(bounds >= threshold - 1e-4)):
                own = self.scores(term[heads[k] : stops[k]], int(block))
                found += [
                    (int(passage[heads[k]]), int(block) * BLOCK + int(i), float(own[i])) for i in np.flatnonzero(own >= threshold - 1e-9)
                ]
        return found

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(item, passage, score, question's overlap, answer's overlap): the best verified passage for each item."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        best: dict[int, tuple] = {}
        for p, item, score in self.search(ids, threshold):
            passage = words[p * STRIDE : p * STRIDE + STRIDE + self.longest]
            if len(self.words[item]) < SHORT:
                if not _contains(passage, self.words[item]):
                    continue
                q = a = 1.0
            else:
                q, a = (share(part, passage) for part in self.parts[item])
            if q >= overlap and a >= overlap:
                row = (item, p, score, q, a)
                if item not in best or (score, q + a, -p) > (best[item][2], best[item][3] + best[item][4], -best[item][1]):
                    best[item] = row
        return [best[i] for i in sorted(best)]


def _terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, text, length, term, tf), one row per distinct word of an item."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            rows += [(item, len(words), w, n) for w, n in counts.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], [], [], []), (pa.int64(), pa.int64(), pa.string(), pa.int64()))],
            names=["item", "length", "term", "tf"],
        )

    return map_batches(items.select("item", text_col), run, "item long, length long, term string, tf long")


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """The index, as blocks of items with at most about INDEX_WORDS words each.

    Equal texts are indexed once and keep all their ids. Items without a word
    are left out. One block at a time is built on the driver; frequencies and
    lengths come from all items.
    """
    spark = benchmark.sparkSession
    small_batches(spark)
    texts = (
        benchmark.where(F.col(text_col).isNotNull())
        .groupBy(F.col(text_col).alias("text"))
        .agg(F.sort_array(F.collect_set(id_col)).alias("ids"), F.min(id_col).alias("first"))
        .withColumn("item", F.xxhash64("text"))
    )
    terms = _terms(texts, id_col, "text")
    total = terms.select("item", "length").distinct().agg(F.count("*"), F.avg("length"), F.sum("length")).first()
    n, mean, size = total[0], total[1], total[2] or 0
    if not n:
        return []
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    own = Window.partitionBy("item")
    weighed = terms.join(df, "term").withColumn("raw", impact).withColumn("impact", F.col("raw") / F.sum("raw").over(own))
    blocks = max(1, math.ceil(size / INDEX_WORDS))
    out = []
    for k in range(blocks):
        mine = F.pmod(F.col("item"), F.lit(blocks)) == k
        # items of like length stand together: their impacts are alike, so block bounds are tight
        rows = texts.where(mine).collect()
        rows = sorted((r for r in rows if words_of(r["text"])), key=lambda r: (len(words_of(r["text"])), r["text"]))
        place = {r["item"]: i for i, r in enumerate(rows)}
        found = [(r["term"], place[r["item"]], r["impact"]) for r in weighed.where(mine).select("term", "item", "impact").collect()]
        found.sort()
        names = sorted({t for t, _, _ in found})
        number = {t: i for i, t in enumerate(names)}
        starts = np.concatenate([[0], np.cumsum(np.bincount([number[t] for t, _, _ in found], minlength=len(names)))]).astype(np.int64)
        if rows:
            out.append(
                Index(
                    [list(r["ids"]) or [None] for r in rows],
                    [r["text"] for r in rows],
                    number,
                    starts,
                    np.array([i for _, i, _ in found], dtype=np.int64),
                    np.array([w for _, _, w in found], dtype=np.float64),
                    max(len(words_of(r["text"])) for r in rows),
                )
            )
    return out


def find_leaks(
    df: DataFrame, benchmark: DataFrame, threshold: float = SCORE, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, item_id, passage, score, question_overlap, answer_overlap) of every leak.

    A row for each document row and test item that stands in it; ``passage`` is
    the number of its best passage. Documents without a leak have no row. Null
    and empty texts, and items without a word, leak nothing; null and repeated
    ids on either side are reported as they are (items with one text share its
    hits; if all their ids are null, the id is null). Further columns are not read; an
    empty table on either side gives an empty table. No shuffle of documents.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, passage int, score double, question_overlap double, answer_overlap double"
    parts = []
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)  # bounded by INDEX_WORDS

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            own = shared.value
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, p, s, q, a in own.matches(text, threshold, overlap):
                    rows += [(doc, i, p, s, q, a) for i in own.ids[item]]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                names=[id_col, "item_id", "passage", "score", "question_overlap", "answer_overlap"],
            )

        parts.append(map_batches(df.select(id_col, text_col), run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_leaks(df: DataFrame, benchmark: DataFrame, threshold: float = SCORE, overlap: float = OVERLAP, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that hold a test item; all columns stay."""
    at = df.columns.index(text_col)
    for index in indexes(benchmark):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            own = shared.value
            return batch.filter(pa.array([not own.matches(t, threshold, overlap) for t in batch.column(at).to_pylist()], pa.bool_()))

        df = map_batches(df, run, df.schema)
    return df
