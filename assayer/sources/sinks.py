"""Idempotent outputs: versioned tables, run logs and stage snapshots."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def fingerprint_metrics(columns: Sequence[str], ignore: Sequence[str] = ()) -> list[Column]:
    """Order-free fingerprint of a table as aggregates: row count, hash sum and hash xor."""
    kept = sorted(c for c in columns if c not in ignore)
    # JSON keeps nulls apart from empty values and covers nested columns and maps
    row = F.xxhash64(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}))
    return [
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash_xor"),
    ]


def content_fingerprint(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """``fingerprint_metrics`` as a one-row table, for a table that is stored already."""
    return df.agg(*fingerprint_metrics(df.columns, ignore))


class VersionedTable:
    """A table kept as numbered Parquet versions in one folder.

    A reader takes the newest complete version (a marker file is written last, whatever the
    committer writes), so a writer that dies half-way changes nothing and a job may read the
    table it is about to replace.
    """

    MARKER = "_COMPLETE"
    #: What a version's content amounts to, beside the version; readers of the table skip names that start like this.
    CONTENT = "_CONTENT"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._new_path = hadoop
        self._fs = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._new_path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        numbers = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
        return [n for n in numbers if self._fs.exists(self._new_path(f"{self.path}/v{n}/{self.MARKER}"))]

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The newest version; with a schema, an empty table when there is none."""
        found = self.versions()
        if found:
            return self.spark.read.parquet(f"{self.path}/v{found[-1]}")
        return self.spark.createDataFrame([], schema) if schema else None

    def stage(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Write the next version without publishing it."""
        found = self.versions()
        version = found[-1] + 1 if found else 0
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/v{version}")
        return version

    def staged(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def publish(self, version: int) -> None:
        self._fs.create(self._new_path(f"{self.path}/v{version}/{self.MARKER}")).close()

    def note(self, version: int, text: str) -> None:
        """Keep a short text beside a version."""
        out = self._fs.create(self._new_path(f"{self.path}/v{version}/{self.CONTENT}"))
        out.write(bytearray(text, "utf-8"))
        out.close()

    def noted(self, version: int) -> str | None:
        place = self._new_path(f"{self.path}/v{version}/{self.CONTENT}")
        if not self._fs.exists(place):
            return None
        stream = self._fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def drop(self, version: int) -> None:
        self._fs.delete(self._new_path(f"{self.path}/v{version}"), True)

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        version = self.stage(df, partition_by)
        self.publish(version)
        return version


def write_if_changed(df: DataFrame, target: str, ignore: Sequence[str] = ("generated_at",)) -> bool:
    """Write a new version only if the content differs, apart from run timestamps.

    ``df`` is computed once, and neither version is read back: Spark observes count, sum and
    xor of the row hashes while the new version is written, and they are kept beside it for the next
    comparison. Equal content drops the new version again. A column whose type changed is a
    difference, and so is another list of ignored columns.
    """
    table = VersionedTable(df.sparkSession, target)
    known = table.versions()
    seen = Observation()
    version = table.stage(df.observe(seen, *fingerprint_metrics(df.columns, ignore)))
    # a plan that is known to hold no row may be planned away together with its observation
    metrics = seen.get or content_fingerprint(table.staged(version), ignore).first().asDict()
    content = json.dumps({"columns": sorted(df.dtypes), "ignored": sorted(ignore), **metrics}, sort_keys=True)
    if known and table.noted(known[-1]) == content:
        table.drop(version)
        return False
    table.note(version, content)
    table.publish(version)
    return True


def append_run_log(row: DataFrame, target: str) -> None:
    row.write.mode("append").parquet(target)


def snapshot_sink(df: DataFrame, root: str, stage: str) -> DataFrame:
    """Persist a stage by domain and return it as read back.

    Only the domains present are replaced; rows of a very large domain are
    spread over many files by the writing tasks, not gathered per domain.
    """
    path = f"{root.rstrip('/')}/{stage}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").parquet(path)
    return df.sparkSession.read.parquet(path)
