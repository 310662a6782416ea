"""Sources of chunks in order of preference, ingestion reports, blank pages, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import materializing as M


def test_the_first_source_that_has_chunks_speaks(spark):
    table = lambda rows: spark.createDataFrame(rows, "document_id long, chunk string")
    documents = spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "document_id long")
    sources = dict(zip(M.SOURCES, (table([(1, "a"), (1, "b"), (9, "z")]), table([(1, "c"), (2, "d")]), table([(2, "e"), (3, "f"), (3, "g")])), strict=True))
    audit = {r.document_id: (r.already_persisted, r.legacy_debug, r.extraction_cache, r.method) for r in M.audit(documents, sources).collect()}
    assert audit == {1: (2, 1, 0, M.SOURCES[0]), 2: (0, 1, 1, M.SOURCES[1]), 3: (0, 0, 2, M.SOURCES[2]), 4: (0, 0, 0, M.NOWHERE)}
    got = sorted((r.document_id, r.chunk, r.method) for r in M.materialized(documents, sources).collect())
    assert got == [(1, "a", M.SOURCES[0]), (1, "b", M.SOURCES[0]), (2, "d", M.SOURCES[1]), (3, "f", M.SOURCES[2]), (3, "g", M.SOURCES[2])]


def test_reports(spark):
    pages = spark.createDataFrame([(1, p, p == 2, p == 2, False, 1) for p in range(1, 6)] + [(2, 1, True, False, True, 0)] + [(3, 1, False, False, False, 2)], "document_id long, page long, quarantined boolean, ocr boolean, ocr_failed boolean, pictures long")
    chunks = spark.createDataFrame([(1, True, "table"), (1, False, "text"), (3, True, "text")], "document_id long, valid boolean, kind string")
    got = {r.document_id: r for r in M.summaries(pages, chunks).collect()}
    assert [got[k].quality_status for k in (1, 2, 3)] == ["partial", "failed", "complete"]
    one = got[1]
    assert (one.pages_total, one.quarantined_page_numbers, one.pictures_count, one.ocr_pages_count, one.chunks_valid, one.chunks_quarantined_count, one.tables_count) == (5, [2], 5, 1, 1, 1, 1)
    assert (got[2].ocr_failures_count, got[2].chunks_valid) == (1, 0)


def test_blank_pages_and_metadata(spark):
    rows = spark.createDataFrame([(" ", 0), (None, None), ("", 1), ("x", 0)], "t string, n int")
    assert [r[0] for r in rows.select(M.structurally_blank(F.col("t"), F.col("n"))).collect()] == [True, True, False, False]
    made = spark.range(1).select(M.safe_metadata(F.create_map(F.lit("level"), F.lit("A1"), F.lit("secret_path"), F.lit("/x"))).alias("m"))
    assert made.first().m == {"level": "A1"}
