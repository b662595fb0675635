"""Import files picked up as they land.

Each micro-batch is gated and reduced to one row per (identity, provider) and
written under its run and batch. Those rows are partial aggregates: merging all of
them with the batch job's own merge gives the candidate table, so state grows
by what is new, a re-run batch overwrites only itself, and nothing lives in
executor memory. A run is a checkpoint: a new one, whose batch ids start at 0
again, gets a folder of its own. ``compact`` folds everything stored so far into a base
with one row per identity and provider, so that later merges read the base and what
came after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Registry
from ..operators.corpus import carry_forward_decisions, dedupe_merge_records, record_key
from ..operators.match import candidate_gate
from ..operators.skew import first_by_key
from ..sources.landing import IMPORT_SCHEMA
from ..sources.sinks import VersionedTable

#: The order of a batch. A file may hold many import documents, so a place in a file and a list names no single record;
#: documents come in the order in which they were generated.
WITHIN = ("generated_at", "file", "pos", "source_id")
#: The order in which records arrived: earlier ones win ties.
ARRIVAL = ("run", "batch", *WITHIN)


def import_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(IMPORT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.json(landing).select("domain", "generated_at", "records", F.col("_metadata.file_path").alias("file"))
    return files.select("domain", "generated_at", "file", F.posexplode("records").alias("pos", "r")).select(
        "domain", "generated_at", "file", "pos", "r.*"
    )


def reduce_batch(batch: DataFrame, registry: Registry) -> DataFrame:
    """First gated record per (domain, identity, provider) of a batch."""
    gated = candidate_gate(batch, registry).withColumn("dedupe_key", record_key())
    return first_by_key(gated, ["domain", "dedupe_key", "source"], *WITHIN).drop("dedupe_key")


def _run_folder(spark: SparkSession, state: str, checkpoint: str) -> str:
    """``run=<number>-<id of the checkpoint>``; numbers follow the order in which runs first stored something."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/records")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
    runs = [n for n in names if n.startswith("run=")]
    return next((n for n in runs if n.endswith(own)), f"run={len(runs):06d}-{own}")


def incremental_import(
    spark: SparkSession, landing: str, state: str, checkpoint: str, registry: Registry, max_files: int | None = None
) -> StreamingQuery:
    """Process every file that has landed since the last run, then stop."""

    def store(batch: DataFrame, batch_id: int) -> None:
        folder = _run_folder(batch.sparkSession, state, checkpoint)
        reduce_batch(batch, registry).write.mode("overwrite").parquet(f"{state}/records/{folder}/batch={batch_id}")

    return (
        import_stream(spark, landing, max_files)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, state: str) -> DataFrame:
    # batches of earlier versions lack the time
    rows = spark.read.option("mergeSchema", "true").parquet(f"{state}/records").withColumn("run", F.col("run").cast("string"))
    return rows if "generated_at" in rows.columns else rows.withColumn("generated_at", F.lit(None).cast("timestamp"))


def stored_records(spark: SparkSession, state: str) -> DataFrame:
    """The compacted base, if there is one, and the batches that it does not cover."""
    rows = _batches(spark, state)
    base, covered = (VersionedTable(spark, f"{state}/{part}") for part in ("base", "covered"))
    versions = base.versions()
    if not versions:
        return rows
    late = rows.join(covered.staged(versions[-1]), ["run", "batch"], "left_anti")
    return base.staged(versions[-1]).unionByName(late, allowMissingColumns=True)


def compact(spark: SparkSession, state: str) -> None:
    """Fold everything stored so far into a new base.

    The list of covered batches is written first under the same version number; a reader looks for
    the base first, so a failure between the two changes nothing.
    """
    covered, base = (VersionedTable(spark, f"{state}/{part}") for part in ("covered", "base"))
    versions = base.versions()
    version = versions[-1] + 1 if versions else 0
    seen = _batches(spark, state).select("run", "batch").distinct()
    seen.write.mode("overwrite").parquet(f"{covered.path}/v{version}")
    # what lands meanwhile is not covered and stays a batch
    rows = _batches(spark, state).join(covered.staged(version), ["run", "batch"], "left_semi")
    keyed = rows.withColumn("dedupe_key", record_key())
    first = first_by_key(keyed, ["domain", "dedupe_key", "source"], *ARRIVAL).drop("dedupe_key")
    base.write(first.select(*rows.columns))


def current_candidates(spark: SparkSession, state: str) -> DataFrame:
    """Candidates over everything imported so far; earlier batches win ties."""
    return dedupe_merge_records(stored_records(spark, state), order=ARRIVAL)


def refresh_decisions(candidates: DataFrame, state: str) -> DataFrame:
    """Carry the stored decisions onto the current candidates, store the result and return it.

    ``candidates`` come from ``current_candidates`` and carry their recommendation. Decisions keep the order
    in which their candidates first arrived, so an identity that two prior rows share goes to the
    same one in every run.
    """
    table = VersionedTable(candidates.sparkSession, f"{state}/decisions")
    prior = table.read()
    if prior is None:
        prior = _undecided(candidates).limit(0)
    table.write(carry_forward_decisions(candidates, prior).withColumn("ord", F.col("first_seen")))
    return table.read()


def _undecided(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns(
        {
            "ord": F.col("first_seen"),
            "title_key": F.lit(None).cast("string"),
            "decision": F.lit("pending"),
            "reviewer_notes": F.lit(None).cast("string"),
            "decided_at": F.lit(None).cast("timestamp"),
        }
    )
