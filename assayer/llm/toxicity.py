"""Toxicity by weak supervision.

1. Terms (whole words and word beginnings) that labelled training rows tie to
   toxicity are dealt into lexicons; each lexicon is a voter, and so is each
   pattern (shouting, direct address, ...).
2. A generative label model with a hidden class estimates, from how the voters
   agree over all training documents, how often each votes in either class.
   Voters that still go together inside a class are correlated; they are joined
   into one variable with a joint table, so their evidence is not counted twice.
3. A linear classifier learns the model's posterior labels from single terms and
   patterns. It scores every whole text in one pass.

Labels choose the terms and start the label model; language, source and id are never
read. Rows held out (crc32 of the id, modulo 5, is 0) take no part in learning.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_partitions, small_batches

#: Labelled rows that terms are chosen from and the classifier is fitted on, at most.
SAMPLE = 20_000
#: Terms the classifier sees, lexicon voters, and lengths of word beginnings.
TERMS = 256
LEXICONS = 12
STEMS = (4, 5, 6)
#: Candidate terms, and for each the least share of toxic rows over clean ones and the least toxic rows.
CANDIDATES = 2048
LEAST_LIFT = 4.0
LEAST_ROWS = 4
#: Least toxic share of the rows that hold a chosen term.
LEAST_PURITY = 0.6
#: Toxic rows that a clean row with the term costs it.
CLEAN_COST = 3.0
#: What a chosen term must add: this share of the toxic rows, rows counting half for each term that already covers them.
LEAST_GAIN = 0.004
#: Voters that are more correlated than this inside a class are joined, up to GROUP of them.
CORRELATED = 0.25
GROUP = 3

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (
    ("shouting", re.compile(r"(?:\b[A-Z]{3,}\b[^A-Za-z]*){4}")),
    ("exclaiming", re.compile(r"!{2,}")),
    ("address", re.compile(r"\byou(?:'re| are|r)\b", re.IGNORECASE)),
    ("masking", re.compile(r"\b[A-Za-z][*#@$]{2,}[A-Za-z]?\b")),
)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


@dataclass
class Model:
    """Terms ending in ``*`` are word beginnings; ``weights`` has terms, patterns and the bias."""

    terms: list[str] = field(default_factory=list)
    lexicon: list[int] = field(default_factory=list)  # voter of each term, -1: none
    weights: list[float] = field(default_factory=list)

    def key(self) -> tuple:
        return tuple(self.terms), tuple(self.lexicon)


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        word = term.rstrip("*")
        found.add_word(word, (*found.get(word, ()), (i, len(word), term.endswith("*"))))
    found.make_automaton()
    return found


def features(text: str, terms: tuple[str, ...]) -> tuple[set[int], list[bool]]:
    """Terms and patterns that a whole text holds."""
    low = text.lower()
    hits: set[int] = set()
    if terms and low:
        for end, group in _automaton(terms).iter(low):
            for i, n, stem in group:
                start = end - n + 1
                if i not in hits and (start == 0 or not low[start - 1].isalpha()):
                    if stem or end + 1 == len(low) or not low[end + 1].isalpha():
                        hits.add(i)
    return hits, [bool(p.search(text)) for _, p in _PATTERNS]


def votes(hits: set[int], patterns: list[bool], lexicon: tuple[int, ...]) -> int:
    """Bit mask of the voters that vote: lexicons first, then patterns."""
    mask = 0
    for i in hits:
        if lexicon[i] >= 0:
            mask |= 1 << lexicon[i]
    for j, on in enumerate(patterns):
        mask |= on << (LEXICONS + j)
    return mask


def candidate_terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """The labelled training rows learnt from: ``rows`` at most, picked by a hash of the id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    return usable.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(rows)


def copy_key(text: str) -> int:
    """The smallest hash of a text's longer words: copies and near copies mostly share it, others rarely."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 6}
    return min((zlib.crc32(w.encode()) for w in words), default=zlib.crc32(text.encode()))


def _choose(names: list[str], hits: list[list[int]], toxic: np.ndarray, weight: np.ndarray) -> list[int]:
    """Forward selection of terms.

    Each time the term is taken that covers most toxic weight, where a row counts half for
    every chosen term it already has and clean rows count against it; a term that begins a chosen one, or is begun by it, adds
    nothing new and is skipped.
    """
    rows = [[] for _ in names]
    for r, own in enumerate(hits):
        for t in own:
            rows[t].append(r)
    rows = [np.array(r, dtype=np.int64) for r in rows]
    on, off = max(weight[toxic].sum(), 1e-9), max(weight[~toxic].sum(), 1e-9)
    left = np.where(toxic, weight, 0.0)
    least = max(2.0, LEAST_GAIN * on)
    possible = []
    clean = np.zeros(len(names))
    for t, r in enumerate(rows):
        a, b = weight[r][toxic[r]].sum(), weight[r][~toxic[r]].sum()
        if a >= LEAST_ROWS / 2 and a >= LEAST_PURITY * (a + b) and a / on >= LEAST_LIFT * (b + 0.5) / off:
            possible.append(t)
            clean[t] = b
    chosen: list[int] = []
    while possible and len(chosen) < TERMS:
        gain, t = max(((round(float(left[rows[t]].sum() - CLEAN_COST * clean[t]), 9), -len(names[t]), names[t]), t) for t in possible)
        if gain[0] < least:
            break
        chosen.append(t)
        left[rows[t]] /= 2
        word = names[t].rstrip("*")
        possible = [x for x in possible if not (word.startswith(y := names[x].rstrip("*")) or y.startswith(word))]
    return chosen


def label_model(masks: np.ndarray, counts: np.ndarray, on: np.ndarray, off: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of the hidden toxic class for each vote pattern.

    A voter that does not vote abstains, which says nothing. One that votes has an accuracy: the
    share of toxic documents among those it votes on. A pattern's posterior follows from the accuracies
    of its votes, and an accuracy from the posteriors of all documents voted on, in turns.
    ``counts`` documents have a pattern; of them ``on`` are labelled toxic and ``off`` clean, which starts
    the turns off and says which class is which. A first run takes voters as independent inside a class; those
    whose correlation, given the class, stays high are then joined and fitted once more
    as one voter with an accuracy for each way it can vote.
    """
    voters = LEXICONS + len(_PATTERNS)
    bits = ((masks[:, None] >> np.arange(voters)) & 1).astype(float)
    weight = counts.astype(float)
    # documents without a label weigh as much as the labelled ones, all together
    free = np.maximum(weight - on - off, 0)
    free *= min(1.0, (on.sum() + off.sum()) / max(free.sum(), 1))
    base = (on.sum() + 1) / (on.sum() + off.sum() + 2)

    def logit(p: np.ndarray) -> np.ndarray:
        return np.log(p) - np.log(1 - p)

    def fit(groups: list[list[int]]) -> np.ndarray:
        codes = [(bits[:, g] @ (1 << np.arange(len(g)))).astype(int) for g in groups]
        post = None
        for _ in range(rounds):
            yes, no = (on, off) if post is None else (on + free * post, off + free * (1 - post))
            total = np.full(len(masks), logit(base))
            for g, code in zip(groups, codes):
                a, b = np.bincount(code, yes, 1 << len(g)), np.bincount(code, no, 1 << len(g))
                said = logit((a + base) / (a + b + 1)) - logit(base)
                said[0] = 0  # abstains
                total += said[code]
            new = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            if post is not None and np.abs(new - post).max() < 1e-6:
                return new
            post = new
        return post

    post = fit([[j] for j in range(voters)])
    groups: list[list[int]] = [[j] for j in range(voters)]
    pairs = []
    for share in (post, 1 - post):
        mass = weight * share
        if mass.sum() < 20:
            continue
        mean = mass @ bits / mass.sum()
        centred = bits - mean
        cov = (centred * mass[:, None]).T @ centred / mass.sum()
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = cov / sd[:, None] / sd[None, :]
        pairs += [(-corr[i, j], i, j) for i in range(voters) for j in range(i) if corr[i, j] > CORRELATED and min(mean[i], mean[j]) * mass.sum() >= 5]
    for _, i, j in sorted(pairs):
        a, b = (next(g for g in groups if x in g) for x in (i, j))
        if a is not b and len(a) + len(b) <= GROUP:
            groups.remove(b)
            a += b
    return fit(groups) if len(groups) < voters else post


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method for a logistic regression on soft labels; the bias (last) is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - shrink * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _row(hits: set[int], patterns: list[bool], terms: int) -> np.ndarray:
    x = np.zeros(terms + len(patterns) + 1)
    x[list(hits)] = 1
    x[terms : terms + len(patterns)] = patterns
    x[-1] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from documents and labels.

    ``sample`` bounds the labelled rows used; votes are counted over all training
    documents, labelled or not. Sent to the driver: the CANDIDATES best terms, one
    row for each vote pattern (2 to the number of voters at most), and the
    candidates of each sampled row. Without labels, or without a toxic row, nothing
    can be learnt and the model scores everything 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text")
    picked = [(r["doc_id"], r["toxic"]) for r in _sample(labels, sample).collect()]
    toxic, clean = sum(y == 1 for _, y in picked), sum(y != 1 for _, y in picked)
    if not toxic or not clean:
        return Model()
    # bounded: at most ``sample`` ids
    picked_rows = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))
    labelled = texts.join(picked_rows, "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            on, off = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (on if y == 1 else off).update(candidate_terms(text))
            terms = list({**on, **off})
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([on[t] for t in terms], pa.int64()), pa.array([off[t] for t in terms], pa.int64())],
                names=["term", "a", "b"],
            )

    lift = (F.col("a") / toxic) / ((F.col("b") + 0.5) / clean)
    best = (
        map_partitions(labelled, count, "term string, a long, b long")
        .groupBy("term")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where((F.col("a") >= LEAST_ROWS) & (lift >= LEAST_LIFT))
        .orderBy((F.col("a") * F.log(lift)).desc(), "term")
        .limit(CANDIDATES)
    )
    candidates = tuple(sorted(r["term"] for r in best.collect()))

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        found = [features(t, candidates) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(1),
                pa.array([sorted(h) for h, _ in found], pa.list_(pa.int32())),
                pa.array([p for _, p in found], pa.list_(pa.bool_())),
                pa.array([copy_key(t) for t in texts], pa.int64()),
            ],
            names=["toxic", "hits", "patterns", "copies"],
        )

    rows = map_batches(labelled, row, "toxic int, hits array<int>, patterns array<boolean>, copies long")
    rows = rows.orderBy("copies", "toxic", "hits", "patterns").collect()  # at most ``sample`` rows, unless ids repeat
    size = Counter(r["copies"] for r in rows)
    weight = np.array([1 / size[r["copies"]] for r in rows])
    chosen_terms = _choose(list(candidates), [r["hits"] for r in rows], np.array([r["toxic"] == 1 for r in rows]), weight)
    terms = [candidates[t] for t in chosen_terms]
    model = Model(terms, [i % LEXICONS for i in range(len(terms))])
    names, lexicon = model.key()

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = Counter(votes(*features(t, names), lexicon) for t in batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["mask", "n"])

    patterns = map_batches(texts.select("text"), vote, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).orderBy("mask").collect()
    place = {t: i for i, t in enumerate(chosen_terms)}
    held = [({place[t] for t in r["hits"] if t in place}, r["patterns"]) for r in rows]
    own = [votes(h, p, lexicon) for h, p in held]
    told = [Counter(m for m, r in zip(own, rows) if (r["toxic"] == 1) == y) for y in (True, False)]
    masks = np.array([r["mask"] for r in patterns], dtype=np.int64)
    on, off = (np.array([float(c[m]) for m in masks.tolist()]) for c in told)
    posterior = dict(zip(masks.tolist(), label_model(masks, np.array([r["n"] for r in patterns]), on, off).tolist()))

    x = np.stack([_row(h, p, len(names)) for h, p in held])
    y = np.array([posterior.get(m, 0.0) for m in own])
    model.weights = _logistic(x, y).tolist()
    return model


def text_score(text: str | None, model: Model) -> float:
    """Between 0 and 1; a null text counts as empty."""
    if not model.weights:
        return 0.0
    hits, patterns = features(text or "", tuple(model.terms))
    z = model.weights[-1] + sum(model.weights[i] for i in hits)
    z += sum(w for w, on in zip(model.weights[len(model.terms) :], patterns) if on)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text.

    One pass without a shuffle; the model is a few kilobytes. Null and empty
    texts get the score of a text without any term. Rows with null or repeated
    ids are scored one by one; a null id counts as held out. Only id and text
    are read; an empty table gives an empty table.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [text_score(t, model) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64())], names=[id_col, "held_out", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, held_out(id_col).alias("held_out"), text_col)
    out = map_batches(rows, run, f"`{id_col}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``df`` without the rows whose text scores ``limit`` or more; all columns stay."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([text_score(t, model) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, run, df.schema)
