"""Operator 2: shards of near equal bytes by longest-processing-time scheduling.

Rows with equal texts are a group and stay together. Groups go, largest first, to the shard with the
least bytes so far, kept in a heap. A group counts alone if it holds at least 1/1000 of a shard's even
share, so that at most 1000 groups a shard do; smaller ones are first gathered by hash into lots, of
which there are 500 a shard, and a lot is scheduled like a group. What the heap and the broadcast hold is
thus bounded by the number of shards, whatever the number of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

SHARDS = 24
#: A group with 1/ALONE of a shard's even share of the bytes is scheduled alone.
ALONE = 1000
#: Lots of smaller groups, for each shard.
LOTS = 500
#: Bytes that each row counts besides its text.
OVERHEAD = 8
#: Rows of a shard are numbered in ranges of about so many, each by a task of its own.
RANGE_ROWS = 50_000


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict:
    """Shard of each (size, key): by size downwards, ties by key, always to the least loaded, ties to the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, s = heap[0]
        placed[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", shard_name: str = "shard", slot: str = "slot", order: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``size``, ``text_crc32``, a shard (0 to shards - 1) and a gapless slot in it.

    A null text counts as an empty one (and shares its group). Slots follow ranges of a hash of ``order``, so that
    they are numbered in many tasks, and say nothing of its own order; repeated rows have slots of their own. An empty table gives an empty one. Other columns stay;
    those with a new column's name are replaced.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = (
        docs.withColumn("size", F.octet_length(body).cast("long") + OVERHEAD)
        .withColumn("text_crc32", F.crc32(body))
        .withColumn("__group", F.xxhash64(body))
        .drop(text)
    )
    groups = checkpoint(rows.groupBy("__group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    least = total / (shards * ALONE)
    lot = F.pmod(F.col("__group"), F.lit(shards * LOTS)).cast("int")
    alone = groups.filter(F.col("bytes") >= least).select("bytes", "__group").collect()
    lots = groups.filter(F.col("bytes") < least).groupBy(lot.alias("lot")).agg(F.sum("bytes")).collect()
    # Keys of lots are small and those of groups are hashes; a pair keeps them apart.
    placed = longest_first([(b, (0, g)) for b, g in alone] + [(b, (1, k)) for k, b in lots], shards)
    spark = docs.sparkSession
    to_shard = lambda kind, name, dtype: F.broadcast(
        spark.createDataFrame(
            [(k, s) for (what, k), s in placed.items() if what == kind],
            T.StructType([T.StructField(name, dtype), T.StructField(f"{name}_shard", T.IntegerType())]),
        )
    )
    placed_rows = (
        rows.join(to_shard(0, "__group", T.LongType()), "__group", "left")
        .withColumn("__lot", lot)
        .join(to_shard(1, "__lot", T.IntegerType()), "__lot", "left")
        .withColumn(shard_name, F.coalesce("__group_shard", "__lot_shard"))
        .drop("__lot", "__group_shard", "__lot_shard")
    )
    ranges = max(64, -(-n // (shards * RANGE_ROWS)))
    placed_rows = checkpoint(placed_rows.withColumn("__range", F.pmod(F.xxhash64(F.col(order), "__group"), F.lit(ranges))))
    by_range = Window.partitionBy(shard_name).orderBy("__range")
    starts = (
        placed_rows.groupBy(shard_name, "__range")
        .agg(F.count("*").alias("__rows"))
        .withColumn("__start", F.sum("__rows").over(by_range) - F.col("__rows"))
        .drop("__rows")
    )
    inside = Window.partitionBy(shard_name, "__range").orderBy(F.col(order).asc_nulls_first(), "__group")
    return (
        placed_rows.withColumn("__row", F.row_number().over(inside))
        .join(starts, [shard_name, "__range"])
        .withColumn(slot, (F.col("__start") + F.col("__row") - 1).cast("long"))
        .drop("__range", "__start", "__row", "__group")
    )


def query(spark, sf_dir):
    """All documents in shards of near equal bytes, copies together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
