"""A training corpus out of raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, others that ``docs`` has included, whatever their names. Rows with a null id pass every stage;
null and empty texts are no near copies, hold nothing and have no tokens. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import bpe, decontamination, ngram_jaccard, substring_dedup, toxicity
from lexiforge.llm.common import checkpoint

#: No SQL has the language models, chunk digests and merges of these stages; tests hold them against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't predict as toxic. Repeated rows share their fate; without labels of both classes all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), name="__score")
    return scored.filter("__score < 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, a Jaccard similarity of 0.8 or more.

    Of repeated rows of an id one stays.
    """
    return ngram_jaccard.first_of_each(docs, words=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a passage that several have stays in the one of the smallest id only. ``n_chars`` follows the text."""
    kept = substring_dedup.dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; of an id with several texts none stays if one holds an item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return docs.join(decontamination.contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids (little-endian unsigned 32-bit integers), their number, and the digest of their decoded text."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = checkpoint(docs)
    return docs
