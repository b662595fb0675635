"""The corpus pipeline: five stages over ``documents``, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, jaccard, leaks, secrets, toxicity
from assayer.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels come from the given table."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many marks behind it as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the smallest id.

    If the id repeats inside the group, the text with the smallest hash stays; rows
    that repeat both are one document. A row without an id stays only if its group
    has no id at all. Documents without a word are in no group and all stay.
    """
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = jaccard.similar(docs).where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("first")
    own, hashed = unused(docs, "_id"), unused(docs, "_hash")
    kept = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.text_hash").alias(hashed))
    one = (
        docs.where(~wordless)
        .withColumn(hashed, F.xxhash64("text"))
        .join(kept, hashed)
        .where(F.col("doc_id").eqNullSafe(F.col(own)))
        .dropDuplicates([hashed, "doc_id"])
    )
    return one.select(*docs.columns).unionByName(docs.where(wordless))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, hidden ones too, is replaced by a mark; all documents stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids (little-endian unsigned 32-bit integers), with a check that they decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.round_trip(docs, path)
    return coded.select("doc_id", "n_tokens", "ids", bpe.digest("ids").alias("ids_sha256"), bpe.digest("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode_tokens),
]

#: SQL can express neither the learnt classifier nor the recursive decoding nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
