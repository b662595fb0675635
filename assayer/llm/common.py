"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

#: Rows and bytes of one Arrow batch. A worker holds one batch and what it makes
#: of it, so this bounds its memory for any table; one text is never split.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers of this application the package, wherever it is installed on the driver."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parent.parent
        held = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
        with zipfile.ZipFile(held, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(held))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches bounded by rows and by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_partitions(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(fn)`` over small batches; what a task has freed goes back to the machine when it ends.

    Workers live on from task to task, so memory they keep after a large batch would add up.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df`` with ``fn`` applied to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return map_partitions(df, run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: a lost executor costs a re-read."""
    path = fresh_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(spark: SparkSession, *tables: DataFrame, wait: float = 0.3) -> None:
    """Delete stored stages that nothing reads any more, and have Spark drop the shuffle files of finished jobs.

    Spark drops those when the driver collects its garbage, which may be long after they have filled a disk.
    It takes two collections with some time between them to let go of the last job, and files are deleted in
    the background; ``wait`` is the seconds after each.
    """
    jvm = spark.sparkContext._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(wait)


@contextmanager
def bloom_joins(spark: SparkSession) -> Iterator[None]:
    """Inner joins planned inside may drop rows before their shuffle by a Bloom filter of the other side's keys.

    Spark does so by itself for large scans. The filter has a fixed largest size; beyond it only more rows travel.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    settings = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g"}
    before = {k: spark.conf.get(prefix + k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(prefix + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(prefix + k) if v is None else spark.conf.set(prefix + k, v)


def tasks_for(df: DataFrame) -> int:
    """The session's shuffle partitions: what the cluster's owner sized for the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bisect(value: Column, edges: list) -> Column:
    """How many of the sorted ``edges`` are at or below ``value``, found by halving."""
    if not edges:
        return F.lit(0)
    held = F.lit(edges)

    def step(n: Column, power: Column) -> Column:
        more = n + power
        return F.when(F.coalesce(F.get(held, more - 1) <= value, F.lit(False)), more).otherwise(n)

    return F.aggregate(F.lit([1 << b for b in range(len(edges).bit_length(), -1, -1)]), F.lit(0), step)
