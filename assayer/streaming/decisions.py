"""Decisions kept beside the import stream, by identity.

Every micro-batch merges anew the candidates that its records belong to and carries decisions
onto them. Records lie in buckets by their key, decisions in buckets by each identity their candidate
is known by. Both are logs: an entry belongs to one batch or one review, a batch reads what
came before it and overwrites only its own entry, so running it again gives the same rows. A batch
opens the buckets of its own identities and keeps their rows alone; a candidate that got no record
keeps the decision it has, unread.

An identity that a candidate no longer has is closed by a row of its own (``gone``), which its
latest decision finds under the candidate's key. The state folder is not one of
``incremental_import``, and its number of buckets is fixed by the first batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_POLICY, Registry
from ..config.defaults import DIVERSITY_SOURCES
from ..functions.text import title_key
from ..operators import policy as scoring
from ..operators.corpus import DECISION_STATE, carry_forward_decisions, dedupe_merge_records, record_hints, record_key
from ..operators.match import candidate_gate
from ..operators.skew import first_by_key
from ..session import cut
from .incremental import _run_folder, import_stream

#: Buckets of a state: at 100 TB some thousands, so that one holds what a task can read.
BUCKETS = 64
#: What identifies a candidate and orders it among those that arrived before it.
_OWN = ("domain", "dedupe_key", "title", "doi", "pmid", "pmcid", "title_key", "first_seen")
_EXTRA = ("stale_evidence",)


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


class DecisionState:
    """The stored records and decisions of one stream."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        place = f"{self.path}/buckets"
        if self._fs.exists(self._fs_path(f"{place}/_SUCCESS")):
            known = int(spark.read.text(place).first()[0])
            if buckets not in (None, known):
                raise ValueError(f"the state was begun with {known} buckets")
            self.buckets = known
        else:
            self.buckets = buckets or BUCKETS
            spark.createDataFrame([(str(self.buckets),)], "value string").coalesce(1).write.mode("overwrite").text(place)

    def entries(self) -> list[str]:
        root = self._fs_path(f"{self.path}/decided")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        done = [n for n in names if self._fs.exists(self._fs_path(f"{self.path}/decided/{n}/_SUCCESS"))]
        return sorted(n.removeprefix("entry=") for n in done)

    def held(self, df: DataFrame, column: str = "bucket") -> list[int]:
        """Bucket numbers that occur: no more than there are buckets."""
        return sorted(r[0] for r in df.select(column).distinct().collect())

    def write(self, df: DataFrame, place: str) -> None:
        """One entry, a folder for each bucket; each bucket is written by one task."""
        dealt = df.repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{place}")

    def log(self, before: str | None, buckets: Sequence[int]) -> DataFrame | None:
        """Decision rows of these buckets from completed entries before ``before`` (None: all)."""
        names = [n for n in self.entries() if before is None or n < before]
        if not names:
            return None
        rows = self.spark.read.parquet(f"{self.path}/decided")
        rows = rows.withColumn("entry", F.col("entry").cast("string"))
        upto = F.col("entry") <= names[-1]
        return rows.where(upto & F.col("bucket").isin(list(buckets)))

    def latest(self, log: DataFrame) -> DataFrame:
        """The newest row of each candidate under each identity, if it is still one of the candidate's."""
        rest = [c for c in log.columns if c not in ("domain", "dedupe_key", "hint", "bucket")]
        newest = log.groupBy("domain", "dedupe_key", "hint").agg(F.max_by(F.struct(*rest), "entry").alias("_r"))
        return newest.select("domain", "dedupe_key", "hint", *[F.col(f"_r.{c}").alias(c) for c in rest]).where(~F.col("gone"))

    def put(self, decided: DataFrame, entry: str, was: DataFrame | None = None) -> None:
        """Store decided candidates under every identity they have, and close those they no longer have.

        ``was`` has the identities (``hints``) that candidates had before.
        """
        own = F.coalesce("title_key", title_key(F.col("title")))
        rows = decided.withColumn("hints", record_hints(F.col("dedupe_key"), own))
        none = F.array().cast("array<string>")
        if was is None:
            rows = rows.withColumn("_was", none)
        else:
            old = was.select(F.col("domain").alias("_d"), F.col("dedupe_key").alias("_k"), F.col("hints").alias("_was"))
            match = F.col("domain").eqNullSafe(F.col("_d")) & F.col("dedupe_key").eqNullSafe(F.col("_k"))
            rows = rows.join(old, match, "left").withColumn("_was", F.coalesce("_was", none)).drop("_d", "_k")
        kept = F.transform("hints", lambda h: F.struct(h.alias("hint"), F.lit(False).alias("gone")))
        closed = F.transform(F.array_except("_was", "hints"), lambda h: F.struct(h.alias("hint"), F.lit(True).alias("gone")))
        # a candidate without any identity is kept under none, and found by nothing
        places = rows.withColumn("_p", F.explode_outer(F.concat(kept, closed))).select(
            *_OWN, *DECISION_STATE, *_EXTRA, "hints", F.col("_p.hint").alias("hint"),
            F.coalesce("_p.gone", F.lit(False)).alias("gone"),
        )
        self.write(places.withColumn("bucket", _bucket(self.buckets, "domain", "hint")), f"decided/entry={entry}")


def scored_by_policy(candidates: DataFrame) -> DataFrame:
    return scoring.score_candidates(candidates, DEFAULT_POLICY).drop("features", "contributions")


def decide_batch(
    store: DecisionState,
    batch: DataFrame,
    run: str,
    batch_id: int,
    registry: Registry,
    judge: Callable[[DataFrame], DataFrame] = scored_by_policy,
    within: Sequence[str] = ("file", "pos", "source_id"),
    baseline: Sequence[str] = DIVERSITY_SOURCES,
) -> None:
    """Store a batch's records and the decisions of the candidates they belong to."""
    spark = store.spark
    entry = f"{run.removeprefix('run=')}-{batch_id:012d}"
    keyed = candidate_gate(batch, registry).withColumn("dedupe_key", record_key())
    kept = first_by_key(keyed, ["domain", "dedupe_key", "source"], *within)
    kept = kept.withColumn("bucket", _bucket(store.buckets, "domain", "dedupe_key"))
    store.write(kept, f"records/{run}/batch={batch_id}")

    # the schema is given, since a batch without a record leaves no file to read it from
    schema = kept.withColumns({"run": F.lit(""), "batch": F.lit(0).cast("long")}).schema
    records = spark.read.schema(schema).parquet(f"{store.path}/records")
    here = (F.col("run") == run.removeprefix("run=")) & (F.col("batch") == batch_id)
    own = records.where(here)
    held = store.held(own)
    if not held:
        return
    earlier = (F.col("run") < run.removeprefix("run=")) | ((F.col("run") == run.removeprefix("run=")) & (F.col("batch") <= batch_id))
    keys = own.select("domain", "dedupe_key").distinct()
    history = records.where(earlier & F.col("bucket").isin(held))
    mine = history.join(keys, _same(history, keys, "domain", "dedupe_key"), "left_semi").drop("bucket", "dedupe_key")
    merged = dedupe_merge_records(mine, order=("run", "batch", *within), baseline=baseline)
    candidates = cut(judge(merged), "batch-candidates")

    hints = candidates.select("domain", F.explode(record_hints(F.col("dedupe_key"))).alias("hint")).distinct()
    hints = hints.withColumn("bucket", _bucket(store.buckets, "domain", "hint"))
    log = store.log(entry, store.held(hints))
    was = None
    if log is None:
        prior = candidates.limit(0).withColumns(
            {"ord": F.col("first_seen"), "title_key": F.lit(None).cast("string"), "decision": F.lit("pending"),
             "reviewer_notes": F.lit(None).cast("string"), "decided_at": F.lit(None).cast("timestamp")})
    else:
        known = cut(store.latest(log.join(hints.select("domain", "hint"), ["domain", "hint"], "left_semi")), "batch-prior")
        was = known.where(F.col("hint") == F.col("dedupe_key"))
        # a candidate met under several identities is one earlier decision
        prior = known.drop("hint", "hints", "gone", "entry").dropDuplicates(["domain", "dedupe_key"]).withColumnRenamed("first_seen", "ord")
    store.put(carry_forward_decisions(candidates, prior), entry, was)


def incremental_decisions(
    spark: SparkSession,
    landing: str,
    state: str,
    checkpoint: str,
    registry: Registry,
    judge: Callable[[DataFrame], DataFrame] = scored_by_policy,
    max_files: int | None = None,
    buckets: int | None = None,
    within: Sequence[str] = ("file", "pos", "source_id"),
    baseline: Sequence[str] = DIVERSITY_SOURCES,
) -> StreamingQuery:
    """Decide on the candidates of every file that has landed since the last run, then stop.

    ``judge`` adds ``recommendation`` to merged candidates; ``within`` orders the records of a batch.
    """
    store = DecisionState(spark, state, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        run = _run_folder(batch.sparkSession, store.path, checkpoint)
        decide_batch(store, batch.drop("generated_at"), run, batch_id, registry, judge, within, baseline)

    return (
        import_stream(spark, landing, max_files)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_decisions(spark: SparkSession, state: str) -> DataFrame:
    """The newest decision of every candidate; None before the first."""
    store = DecisionState(spark, state)
    log = store.log(None, range(store.buckets))
    return None if log is None else _by_key(store, log)


def _by_key(store: DecisionState, log: DataFrame) -> DataFrame:
    return store.latest(log.where(F.col("hint").eqNullSafe(F.col("dedupe_key")))).drop("hint", "gone", "entry")


def record_reviews(spark: SparkSession, state: str, reviews: DataFrame) -> None:
    """Store reviewers' decisions: (domain, dedupe_key, decision, reviewer_notes, decided_at), one row per candidate.

    Only buckets of reviewed keys are opened. Reviews of keys that are not stored change nothing. A review
    stands until a batch changes the evidence behind it.
    """
    store = DecisionState(spark, state)
    found = store.entries()
    if not found:
        return
    entry = _next_review(found[-1])
    given = cut(
        reviews.select("domain", "dedupe_key", *[F.col(c).alias(f"_{c}") for c in ("decision", "reviewer_notes", "decided_at")])
        .withColumn("bucket", _bucket(store.buckets, "domain", "dedupe_key")), "reviews")
    log = store.log(None, store.held(given))
    decided = _by_key(store, log).join(given.drop("bucket"), ["domain", "dedupe_key"])
    new = {c: F.col(f"_{c}") for c in ("decision", "reviewer_notes", "decided_at")}
    store.put(decided.withColumns({**new, "stale_evidence": F.lit(False)}).drop("hints"), entry)


def _next_review(last: str) -> str:
    """A name that sorts after everything stored and before the next batch."""
    base, _, number = last.partition("-review-")
    return f"{base}-review-{int(number) + 1 if number else 0:06d}"
