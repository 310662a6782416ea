"""What the training-data operators share: reading, bounded Arrow batches, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are turned into Python objects at once.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, rows: int = SLICE_ROWS):
    """Arrow batches, or arrays, in slices of so many rows at most: Spark bounds a batch by bytes, this what is made of it."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def by_bytes(array: pa.Array, most: int):
    """Ranges (start, end) of a string array of about ``most`` bytes each; a longer string stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < len(array):
        end = max(start + 1, int(np.searchsorted(ends, total + most, "right")))
        yield start, end
        start, total = end, int(ends[end - 1])


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """As ``df.groupBy(keys).applyInArrow(run, schema)``, for many small groups: those of a batch come in one call. Keys are numbers, none null."""

    def each(table: pa.Table, edges: np.ndarray):
        table = table.combine_chunks()
        yield from pa.concat_tables([run(table.slice(a, b - a)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]).combine_chunks().to_batches()

    def stream(batches):
        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(key).to_numpy(zero_copy_only=False) for key in keys]
            new = np.zeros(len(batch), bool)
            for x in columns:
                new[1:] |= x[1:] != x[:-1]
            new[0] = last != tuple(x[0] for x in columns)
            last = tuple(x[-1] for x in columns)
            starts, table, before = np.flatnonzero(new), pa.Table.from_batches([batch]), sum(map(len, held))
            if not len(starts):
                held.append(table)
                continue
            edges = np.concatenate([np.zeros(min(before, 1), np.int64), starts + before])
            if len(edges) > 1:
                yield from each(pa.concat_tables([*held, table.slice(0, starts[-1])]), edges)
            held = [table.slice(starts[-1])]
        if held:
            yield from each(pa.concat_tables(held), np.array([0, sum(map(len, held))]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a session on one machine may name none: there one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Versions:
    """A table that each round writes anew in the shared folder: two places in turn, so that a round reads the one and writes the other."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Bits of the map that ``may_have`` sends to the scan.
MAP_BITS = 1 << 24


def bit_map(spots: DataFrame) -> Broadcast:
    """A broadcast map of MAP_BITS bits, 32 to a number, with those of ``spots`` (spot, below MAP_BITS) set."""
    words = spots.groupBy(F.shiftright("spot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(spot & 31)))").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return spots.sparkSession.sparkContext.broadcast(bits)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def may_have(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` may be among ``keys`` (key), from a bit map of fixed size: no false "no", few false "yes".

    It spares a join the shuffle of the rows that have no partner. With far more keys than bits it lets all
    rows through.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    shared = bit_map(keys.select(spot(F.col("key")).alias("spot")))

    @F.arrow_udf("boolean")
    def may_be(spots: pa.Array) -> pa.Array:
        return pa.array(is_set(shared.value, spots.to_numpy(zero_copy_only=False)))

    return may_be(spot(key.cast("long")))
