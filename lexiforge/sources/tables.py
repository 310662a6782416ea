"""Readers with checks, and writers that can run twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 25 * 1024 * 1024


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", magic: str = "%PDF-") -> DataFrame:
    """(path, length, digest, reason): files by what their bytes say; ``reason`` is why one isn't taken, or null. Spark leaves out empty files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    starts = F.substring("content", 1, len(magic)) == F.encode(F.lit(magic), "UTF-8")
    reason = F.when(F.col("length") > MOST_BYTES, "too_large").when(~starts, "no_such_type")
    return raw.select("path", "length", F.sha2("content", 256).alias("digest"), reason.alias("reason"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases of a JSON file {version, cases: [{id, query, language, expected_topics}]}, each with its faults."""
    schema = "version int, cases array<struct<id:string,query:string,language:string,expected_topics:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("version", F.inline("cases"))
    again = F.count("*").over(Window.partitionBy("id")) > 1
    faults = F.array_compact(
        F.array(
            F.when(~F.col("version").eqNullSafe(1), "version"),
            F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id"),
            F.when(again, "repeated_id"),
            F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query"),
            F.when(F.coalesce(F.size("expected_topics"), F.lit(0)) <= 0, "expected_topics"),
        )
    )
    return rows.withColumn("faults", faults)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes ``rows``; partitions that they have are replaced, others stay. Running it twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def cached(spark: SparkSession, wanted: DataFrame, path: str, key: str, make) -> DataFrame:
    """Rows for ``wanted`` from the store at ``path``, and for keys that it lacks from ``make``."""
    store = existing(spark, path)
    if store is None:
        return make(wanted)
    lacking = wanted.join(store.select(key), key, "left_anti")
    return store.join(wanted.select(key), key, "left_semi").unionByName(make(lacking))


def report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a Markdown table, bars escaped, nulls as dashes."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), r"\|", r"\\|") for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_debug(rows: DataFrame, path: str, document: str) -> None:
    """Chunks, images and page states of each document as JSON lines in a folder of its own; a second run replaces it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).json(path)


def read_debug(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_debug`` wrote, with faults: an object that isn't JSON or lacks its content."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumn("fault", F.when(F.col("_broken").isNotNull(), "no_json").when(F.coalesce(F.trim("content"), F.lit("")) == "", "no_content")).drop("_broken")
