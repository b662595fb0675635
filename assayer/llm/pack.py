"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

Equal texts form a group. A group's demand is a vector (bytes, tokens, rows),
each as a share of the table. Groups are placed one after the other, largest
first, into the shard that has room for them and whose residual capacity has
the highest dot product with the demand.

Placing billions of groups one by one cannot be done in order, and need not:
only groups that are large against a shard are placed on their own. There are at
most ``3 * shards * GRAIN`` of those, as each holds that share of some total. All
others are dealt by hash into ``shards * GRAIN`` cells, and a cell is placed like a
group. So the list that is packed on the driver has a fixed bound, whatever the
table holds, and its small members fill the last gaps.

A group over half a shard could not be balanced in one piece; it is split into
pieces of a quarter of a shard. What splits it is the place of a row in the stored
table of sizes, not its id, so rows that are equal in everything spread too.

Slots are counted in windows no larger than a cell: a large group is numbered in
as many parts as it fills cells, and each part starts where the one before it ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A group or cell of the average size fills this part of a shard: 1 / GRAIN.
GRAIN = 64
#: Groups above this part of a shard are split, into pieces of SPLIT of a shard.
WHOLE = 0.5
SPLIT = 0.25
#: What a shard may hold of the other totals beyond its even share, so that they don't keep bytes from coming out even.
SLACK = 0.01
#: Bytes a row costs besides its text.
ROW_BYTES = 16


def place(demands: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``demands`` holds an item's share of each total, one row per item, bytes first.

    Items go in order of their largest share. Each goes to the shard where the
    dot product of demand and residual capacity is highest among those where it
    fits; if it fits nowhere, to the shard with most bytes left, as bytes are the law.
    """
    out = np.zeros(len(demands), dtype=np.int64)
    capacity = np.array([1.0, *[1 + SLACK] * (demands.shape[1] - 1)]) / shards
    left = np.tile(capacity, (shards, 1))
    for i in np.lexsort((np.arange(len(demands)), -demands.sum(1), -demands.max(1))):
        room = (left >= demands[i] - 1e-12).all(axis=1)
        if room.any():
            out[i] = np.argmax(np.where(room, left @ demands[i], -np.inf))
        else:
            out[i] = np.argmax(left[:, 0])
        left[out[i]] -= demands[i]
    return out


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, text_hash) of each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("text_hash"),
    )


def pack(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard), one row per row of ``df``.

    The law is ``bytes``: the sizes of the shards come out nearly equal (tokens
    and rows are balanced with them); ``grown_shard`` is null. ``slot`` counts from
    0 without gaps in each shard. Copies share a shard unless their group is over
    half a shard; which copies of such a group go together depends on how the table
    lies in files. Two texts with the same 64-bit hash would share one too, which
    does no harm. Rows with a null or repeated id are rows like any other, also where
    equal rows are most of the table; an empty table gives an empty table; further
    columns are not read.

    Texts are read once; the narrow table of sizes is stored and everything else
    reads that. The shuffles carry counts by group and narrow rows by cell; no
    window is larger than a cell, that is 1 / (shards * GRAIN) of a large table.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    # the number becomes data when the table is written; later stages and their retries read it back
    rows = stored(sized(df, id_col, text_col).withColumn("at", F.monotonically_increasing_id()), "sizes")
    cells = shards * GRAIN
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    whole = [max(1, x or 0) for x in total]
    share = F.greatest(*[F.col(c) / w for c, w in zip("btn", whole)])
    pieces = F.when(share > WHOLE / shards, F.ceil(share * shards / SPLIT)).otherwise(1).cast("int")
    large = (
        groups.where(share >= 1 / cells)
        .withColumn("pieces", pieces)
        .select("text_hash", "pieces", (F.col("pieces") * F.ceil(share * cells / F.col("pieces"))).cast("int").alias("parts"))
    )
    # at most 3 * cells groups hold 1 / cells of a total, so the broadcast is bounded
    part = F.pmod(F.xxhash64("at"), F.col("parts")).cast("int")
    dealt = (
        rows.join(F.broadcast(large), "text_hash", "left")
        .withColumn("part", F.coalesce(part, F.lit(-1)))
        .withColumn("piece", F.coalesce(F.pmod("part", "pieces"), F.lit(-1)))
        .withColumn("key", F.when(F.col("pieces").isNotNull(), F.col("text_hash")).otherwise(F.pmod(F.xxhash64("text_hash"), F.lit(cells))))
        .drop("text_hash", "pieces", "parts")
    )
    # bounded too: the parts of a large group are as many as the cells it fills, and less than one for each piece more
    parts = (
        dealt.groupBy("key", "piece", "part")
        .agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
        .orderBy("key", "piece", "part")
        .collect()
    )
    items: dict[tuple[int, int], np.ndarray] = {}
    for x in parts:
        name = (x["key"], x["piece"])
        items[name] = items.get(name, 0) + np.array([x["b"], x["t"], x["n"]], dtype=float)
    spark = df.sparkSession
    demands = np.array(list(items.values()), dtype=float).reshape(len(items), 3) / whole
    chosen = dict(zip(items, place(demands, shards).tolist()))
    first = [0] * shards
    plan = []
    for x in parts:
        shard = chosen[x["key"], x["piece"]]
        plan.append((x["key"], x["piece"], x["part"], shard, first[shard]))
        first[shard] += x["n"]
    placed = spark.createDataFrame(plan, "key long, piece int, part int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("key", "piece", "part").orderBy("doc_id", "text_crc32", "size", "at"))
    # bounded: a row for each cell and each part of a large group
    return dealt.withColumn("rank", rank).join(F.broadcast(placed), ["key", "piece", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "tokens",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
