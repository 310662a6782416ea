"""Lexical and dense retrieval, fusion, ranking, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

RRF_K = 60
DEPTH = 20


def postings(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, term, tf): sub-linear term frequencies, 1 + ln(count)."""
    return (
        docs.select(doc_id, F.explode(text.terms(F.col(body))).alias("term"))
        .groupBy(doc_id, "term")
        .agg(F.count("*").alias("n"))
        .select(doc_id, "term", (1 + F.log("n")).alias("tf"))
    )


def inverse_frequencies(found: DataFrame, documents: int | Column) -> DataFrame:
    """(term, n, idf): ln(1 + (N - n + 0.5) / (n + 0.5))."""
    return found.groupBy("term").agg(F.count("*").alias("n")).withColumn("idf", F.log(1 + (documents - F.col("n") + 0.5) / (F.col("n") + 0.5)))


def top(scored: DataFrame, query_id: str, doc_id: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ranked from 1, ties to the smaller id."""
    order = Window.partitionBy(query_id).orderBy(F.desc(score), doc_id)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sparse_search(found: DataFrame, queries: DataFrame, weights: DataFrame, query_id: str, doc_id: str = "doc_id", k: int = DEPTH) -> DataFrame:
    """(query, doc, score, rank): sums of query tf x document tf x idf over the terms in common.

    ``queries`` and ``found`` are postings; only the terms of queries meet the index.
    """
    asked = queries.join(weights.select("term", "idf"), "term").select(F.col(query_id), "term", (F.col("tf") * F.col("idf")).alias("q"))
    scores = found.join(asked, "term").groupBy(query_id, doc_id).agg(F.sum(F.col("tf") * F.col("q")).alias("raw"))
    return top(scores.select(query_id, doc_id, F.round("raw", 6).alias("score")), query_id, doc_id, k)


def fuse(first: DataFrame, second: DataFrame, keys: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: sums of 1 / (k + rank), ties to the better rank, then the id."""
    both = first.select(*keys, F.col("rank").alias("first_rank")).join(second.select(*keys, F.col("rank").alias("second_rank")), keys, "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("first_rank") + part("second_rank"), 9))
    order = Window.partitionBy(keys[0]).orderBy(F.desc("rrf"), F.least("first_rank", "second_rank"), keys[1])
    return scored.withColumn("fused_rank", F.row_number().over(order))


def hydrate(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with what the documents say; ``stale`` where there is no such document. Ranks keep their gaps."""
    return hits.join(docs.withColumn("__there", F.lit(True)), key, "left").withColumn("stale", F.col("__there").isNull()).drop("__there")


def feature_rank(candidates: DataFrame, adjustments: list[Column], query_id: str, doc_id: str, rank: str = "rank") -> DataFrame:
    """Final scores: 1 - 0.025 (rank - 1), and adjustments that weigh less the lower the rank."""
    base = 1 - 0.025 * (F.col(rank) - 1)
    gate = F.greatest(F.lit(0.35), 1 - 0.04 * (F.col(rank) - 1))
    scored = candidates.withColumn("final_score", F.round(base + gate * sum(adjustments, F.lit(0.0)), 6))
    order = Window.partitionBy(query_id).orderBy(F.desc("final_score"), rank, doc_id)
    return scored.withColumn("final_rank", F.row_number().over(order))


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int, most: int) -> DataFrame:
    """Rows of each group up to the first that breaks the budget, without those over half of it, ``most`` at most."""
    fits = rows.filter(F.col(size) <= budget // 2)
    w = Window.partitionBy(group).orderBy(*order)
    used = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = fits.withColumn("used", F.sum(size).over(used)).withColumn("place", F.row_number().over(w))
    return counted.filter((F.col("used") <= budget) & (F.col("place") <= most))


def diverse(candidates: DataFrame, query_id: str, source: str, rank: str, per_source: int, most: int) -> DataFrame:
    """The best of each query with at most ``per_source`` from a source: no more than ``most``."""
    own = Window.partitionBy(query_id, source).orderBy(rank)
    kept = candidates.withColumn("of_source", F.row_number().over(own)).filter(F.col("of_source") <= per_source)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(rank))).filter(F.col("place") <= most)
