"""Chunks of documents from the first source that has them, what an ingestion run reports, what metadata is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The metadata of a chunk that is kept.
KEPT_KEYS = (
    "document_id", "original_filename", "source", "page_start", "page_end", "page_number", "headings", "content_type", "language", "document_type", "level", "skill", "theme",
    "extraction_mode", "extraction_modes_used", "quality_score", "languages", "image_ids", "has_image", "requires_vision", "structural_quality",
)
#: Sources in the order in which they are looked at, and what is left where there is none.
SOURCES, NOWHERE = ("already_persisted", "legacy_debug", "extraction_cache"), "unavailable_without_reprocessing"


def safe_metadata(metadata: Column) -> Column:
    """A map without keys that nobody asked to keep."""
    return F.map_filter(metadata, lambda k, v: k.isin(*KEPT_KEYS))


def structurally_blank(text: Column, items: Column) -> Column:
    """Whether a page holds nothing: no text and no item; a page without text that has an item is one that wasn't read."""
    return (F.coalesce(F.trim(text), F.lit("")) == "") & (F.coalesce(items, F.lit(0)) == 0)


def audit(documents: DataFrame, sources: dict[str, DataFrame], document: str = "document_id") -> DataFrame:
    """(document, a count for each source, method): how many chunks each source has of a document, and the first that has any.

    ``sources`` are tables of chunks with a column of the document, by name and in order of preference.
    """
    rows = documents.select(document).distinct()
    for name, chunks in sources.items():
        rows = rows.join(chunks.groupBy(document).agg(F.count("*").alias(name)), document, "left")
    method = F.coalesce(*[F.when(F.col(n) > 0, n) for n in sources], F.lit(NOWHERE))
    return rows.select(document, *[F.coalesce(n, F.lit(0)).alias(n) for n in sources], method.alias("method"))


def materialized(documents: DataFrame, sources: dict[str, DataFrame], document: str = "document_id") -> DataFrame:
    """The chunks of each document from the first source that has any, with ``method``; sources have the same columns.

    Each source is joined with the documents that it speaks for only. A document that none has is missing.
    """
    chosen = audit(documents, sources, document).select(document, "method")
    parts = [chunks.join(chosen.filter(F.col("method") == name), document) for name, chunks in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def summaries(pages: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """What an ingestion run reports of each document: ``pages`` (document, page, quarantined, ocr, ocr_failed, pictures), ``chunks`` (document, valid, kind).

    A document without pages isn't reported; the disposition is that of failed pages: none, at most a fifth and not all, or more.
    """
    of_pages = pages.groupBy(document).agg(
        F.count("*").alias("pages_total"), F.count_if("quarantined").alias("pages_quarantined_count"), F.array_sort(F.collect_set(F.when(F.col("quarantined"), F.col("page")))).alias("quarantined_page_numbers"),
        F.sum("pictures").alias("pictures_count"), F.count_if("ocr").alias("ocr_pages_count"), F.count_if("ocr_failed").alias("ocr_failures_count"),
    )
    of_chunks = chunks.groupBy(document).agg(F.count_if("valid").alias("chunks_valid"), F.count_if(~F.col("valid")).alias("chunks_quarantined_count"), F.count_if(F.col("kind") == "table").alias("tables_count"))
    met = of_pages.join(of_chunks, document, "left")
    for c in ("chunks_valid", "chunks_quarantined_count", "tables_count"):
        met = met.withColumn(c, F.coalesce(c, F.lit(0)))
    failed, total = F.col("pages_quarantined_count"), F.col("pages_total")
    status = F.when(failed == 0, "complete").when((failed <= 0.2 * total) & (failed < total), "partial").otherwise("failed")
    return met.withColumn("quality_status", status)
