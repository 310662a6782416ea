"""Readers, writers, streams."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from lexiforge.sources import tables
from lexiforge.streaming import jobs


def test_files_are_checked_by_their_bytes(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("c.pdf", b"hello"), ("d.txt", b"%PDF-")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in tables.files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "c.pdf": "no_such_type"}


def test_cases_tell_their_faults(spark, tmp_path):
    case = {"id": "1", "query": "q", "language": "fr", "expected_topics": ["t"]}
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"version": 1, "cases": [case, {**case, "id": "2", "query": " "}, {**case, "id": "3", "expected_topics": []}, case]}))
    got = sorted((r.id, tuple(r.faults)) for r in tables.cases(spark, str(path)).collect())
    assert got == [("1", ("repeated_id",)), ("1", ("repeated_id",)), ("2", ("query",)), ("3", ("expected_topics",))]


def test_partitions_are_replaced_and_a_store_is_used(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "doc long, v string, part int")
    tables.replace_partitions(make([(1, "a", 1), (2, "b", 2)]), path, "part")
    for _ in range(2):
        tables.replace_partitions(make([(3, "c", 2)]), path, "part")
    assert sorted((r.doc, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "c")]
    wanted = spark.createDataFrame([(1,), (9,)], "doc long")
    made = lambda rows: rows.select("doc", F.lit("new").alias("v"), F.lit(7).alias("part"))
    assert sorted((r.doc, r.v) for r in tables.cached(spark, wanted, path, "doc", made).collect()) == [(1, "a"), (9, "new")]
    assert tables.cached(spark, wanted, path + "-none", "doc", made).count() == 2


def test_report_escapes_bars(spark):
    rows = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert tables.report(rows, ["x", "y"]).first().line == r"| a\|b | - |"


EVENTS = "document_id long, job_type string, event string, at long"


def test_job_states_follow_events(spark, tmp_path):
    source = str(tmp_path / "events")
    put = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    put([(1, "ingest", "queued", 1), (1, "ingest", "started", 2), (2, "ingest", "done", 1), (3, "ingest", "queued", 1), (3, "ingest", "queued", 2)])

    def run():
        q = jobs.job_states(spark.readStream.schema(EVENTS).parquet(source)).writeStream.outputMode("update").foreachBatch(
            lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))
        ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == [(1, "ingest", "processing", 1), (2, "ingest", "", 0), (3, "ingest", "pending", 0)]
    put([(1, "ingest", "error", 3), (1, "ingest", "queued", 4), (1, "ingest", "started", 5), (1, "ingest", "error", 6), (1, "ingest", "queued", 7)])
    assert (1, "ingest", "failed", 2) in run()


def test_stale_jobs_recover(spark):
    t = datetime.datetime(2026, 1, 1, 12)
    old = t - datetime.timedelta(minutes=30)
    rows = spark.createDataFrame([(1, "processing", old, 1), (2, "processing", old, 2), (3, "processing", t, 1), (4, "pending", old, 0)], "id int, state string, started_at timestamp, attempts int")
    got = {r.id: r.state for r in jobs.recovered(rows, F.lit(t)).collect()}
    assert got == {1: "pending", 2: "failed", 3: "processing", 4: "pending"}


def test_ingestion_takes_each_key_once(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "doc_id long, text string"
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "x"), (3, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.ingest(spark.readStream.schema(schema).parquet(source), out, cp).awaitTermination(120)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_windows_and_sessions_of_a_stream(spark):
    stream = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    for made, name in ((jobs.windowed(stream), "w"), (jobs.sessions(stream), "s")):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).agg(F.sum("n")).first()[0] > 0


def test_debug_artifacts(spark, tmp_path):
    from lexiforge.sources import tables as S

    path = str(tmp_path / "debug")
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (2, 0, "c")], "document_id long, chunk_index long, content string")
    S.write_debug(rows, path, "document_id")
    S.write_debug(rows.filter("document_id = 2"), path, "document_id")
    got = sorted((r.document_id, r.chunk_index, r.fault) for r in S.read_debug(spark, path, "document_id long, chunk_index long, content string").collect())
    assert got == [(1, 0, None), (1, 1, "no_content"), (2, 0, None)]


def test_term_numbers(spark):
    import hashlib

    from lexiforge.functions import text as T
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([("الأسرة",), ("x",), (None,)], "t string").select(T.term_id(F.col("t"))).collect()]
    want = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest(), "big") & 0x7FFFFFFF for t in ("الأسرة", "x")]
    assert got == [*want, None]
