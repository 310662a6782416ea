"""Where intermediate tables lie, and how small inputs are spread."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; only a session on one machine may name none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def built(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, for what is read several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer parts than there are, as a table in one small file has; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(rows: dict[str, DataFrame], keys: dict[str, str], most: int) -> dict[str, DataFrame]:
    """Tables that are to meet by a key each, in as many parts as leave about ``most`` rows of the largest one in each, however Spark would merge parts."""
    largest = max(df.count() for df in rows.values())
    parts = max(-(-largest // most), next(iter(rows.values())).sparkSession.sparkContext.defaultParallelism)
    return {name: df.repartition(parts, keys[name]) for name, df in rows.items()}
