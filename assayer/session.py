"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job wants; none of them fixes a cluster size.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "assayer", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders of the applications this process has run.
_opened: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can see.

    The cluster names it in ``spark.checkpoint.dir``. Only a master that runs everything in
    this one process (``local``, as in tests) may do without; it gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="assayer-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses.

    It lives as long as the application: the file system deletes the application's folder
    when the driver ends.
    """
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if root not in _opened:
        _opened.add(root)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a stored table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Later jobs start from files, so a lost executor costs a re-read and not the
    whole lineage; unlike a cache, the result does not live on executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
