"""Queries of sources of chunks and of ingestion reports: five documents make a file; vectors, labels and pages say where its chunks are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import materializing as M


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def filed(rows, key):
    """Rows of a table as chunks of a file."""
    return rows.filter(F.col(key).isNotNull()).select(F.floor(F.col(key) / 5).alias("document_id"), F.col(key).alias("chunk_id"))


def sources(spark, d):
    """Files under 40 have vectors, under 60 labels, all of them pages, as far as the tables go."""
    tables = (("embeddings", "vec_id", 40), ("labels", "doc_id", 60), ("pages", "page_id", 10**9))
    return {name: filed(read(spark, d, table), key).filter(F.col("document_id") % 90 < most) for name, (table, key, most) in zip(M.SOURCES, tables, strict=True)}


def files(spark, d):
    return filed(read(spark, d, "documents"), "doc_id").select("document_id")


def legacy_audit(spark, d):
    """How many chunks each source has of a file, and the safest way to get them."""
    return M.audit(files(spark, d), sources(spark, d))


def materialized_chunks(spark, d):
    """The chunks of each file from the first source that has any."""
    return M.materialized(files(spark, d), sources(spark, d)).select("document_id", "chunk_id", "method")


def safe_metadata(spark, d):
    """The metadata of documents that is kept, of what was collected."""
    docs = read(spark, d, "documents")
    made = F.create_map(F.lit("source"), "source", F.lit("language"), "lang", F.lit("path"), F.concat(F.lit("/tmp/"), F.col("doc_id").cast("string")), F.lit("page_number"), (F.col("doc_id") % 5).cast("string"), F.lit("debug"), F.lit("x"))
    kept = F.array_sort(F.map_entries(M.safe_metadata(made)))
    return docs.select("doc_id", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"))


def blank_pages(spark, d):
    """Pages with nothing on them, and pages without text that have items."""
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>", ""), r"<[^>]*>", " ")
    items = F.regexp_count("html", F.lit(r"(?i)<(?:img|table|li|h[1-6])[ >]"))
    text = F.regexp_replace(bare, r"[\p{Z}\x09-\x0D]+", " ")
    return read(spark, d, "pages").select("page_id", F.coalesce(items, F.lit(0)).cast("long").alias("items"), F.char_length(F.trim(text)).cast("long").alias("n_chars"), M.structurally_blank(text, items).alias("blank"))


def ingestion_summaries(spark, d):
    """What an ingestion run reports of each file: pages by quality labels, chunks by toxicity labels."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    rows = docs.withColumn("document_id", F.floor(F.col("doc_id") / 5)).withColumn("bad", F.coalesce(F.col("quality") == 0, F.lit(False)))
    pages = rows.select("document_id", (F.col("doc_id") % 5 + 1).alias("page"), F.col("bad").alias("quarantined"), (F.col("n_chars") < 200).alias("ocr"), (F.col("bad") & (F.col("n_chars") < 200)).alias("ocr_failed"), (F.col("doc_id") % 3).alias("pictures"))
    chunks = rows.select("document_id", F.coalesce(F.col("toxic") != 1, F.lit(True)).alias("valid"), F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text").alias("kind"))
    made = M.summaries(pages, chunks)
    return made.withColumn("quarantined_page_numbers", F.array_join("quarantined_page_numbers", ","))


_SOURCES = """f AS (SELECT DISTINCT doc_id // 5 AS document_id FROM documents),
 s AS (SELECT 1 AS k, vec_id // 5 AS document_id, vec_id AS chunk_id FROM embeddings WHERE vec_id // 5 % 90 < 40 UNION ALL SELECT 2, doc_id // 5, doc_id FROM labels WHERE doc_id // 5 % 90 < 60 UNION ALL SELECT 3, page_id // 5, page_id FROM pages),
 a AS (SELECT f.document_id, count(*) FILTER (k = 1) AS already_persisted, count(*) FILTER (k = 2) AS legacy_debug, count(*) FILTER (k = 3) AS extraction_cache, min(k) AS first,
  CASE min(k) WHEN 1 THEN 'already_persisted' WHEN 2 THEN 'legacy_debug' WHEN 3 THEN 'extraction_cache' ELSE 'unavailable_without_reprocessing' END AS method FROM f LEFT JOIN s USING (document_id) GROUP BY f.document_id)"""
QUERIES = {
    "legacy_audit": (legacy_audit, f"WITH {_SOURCES} SELECT * EXCLUDE (first) FROM a"),
    "materialized_chunks": (materialized_chunks, f"WITH {_SOURCES} SELECT document_id, chunk_id, method FROM a JOIN s USING (document_id) WHERE k = first"),
    "safe_metadata": (safe_metadata, "SELECT doc_id, 'language=' || lang || ',page_number=' || doc_id % 5 || ',source=' || source AS metadata FROM documents"),
    "blank_pages": (
        blank_pages,
        r"""SELECT page_id, coalesce(items, 0) AS items, length(t) AS n_chars, t = '' AND coalesce(items, 0) = 0 AS blank FROM (SELECT page_id, len(regexp_extract_all(html, '(?i)<(?:img|table|li|h[1-6])[ >]')) AS items,
        trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>', '', 'g'), '<[^>]*>', ' ', 'g'), '[\p{Z}\x09-\x0D]+', ' ', 'g')) AS t FROM pages)""",
    ),
    "ingestion_summaries": (
        ingestion_summaries,
        """SELECT *, CASE WHEN pages_quarantined_count = 0 THEN 'complete' WHEN 5 * pages_quarantined_count <= pages_total AND pages_quarantined_count < pages_total THEN 'partial' ELSE 'failed' END AS quality_status FROM
        (SELECT doc_id // 5 AS document_id, count(*) AS pages_total, count(*) FILTER (quality = 0) AS pages_quarantined_count, coalesce(string_agg(doc_id % 5 + 1, ',' ORDER BY doc_id) FILTER (quality = 0), '') AS quarantined_page_numbers, sum(doc_id % 3)::BIGINT AS pictures_count,
        count(*) FILTER (n_chars < 200) AS ocr_pages_count, count(*) FILTER (quality = 0 AND n_chars < 200) AS ocr_failures_count, count(*) FILTER (coalesce(toxic <> 1, true)) AS chunks_valid, count(*) FILTER (toxic = 1) AS chunks_quarantined_count, count(*) FILTER (doc_id % 7 = 0) AS tables_count
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1)""",
    ),
}
