"""Streams with state and timers."""

from __future__ import annotations

import datetime

import pytest

from lexiforge.streaming import recovery

UTC = datetime.timezone.utc


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    recovery.use_rocksdb(spark)
    yield spark
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(minutes):
    return datetime.datetime(2024, 5, 1, 12, 0, tzinfo=UTC) + datetime.timedelta(minutes=minutes)


def test_hung_jobs_are_recovered_by_timers(rocksdb, tmp_path):
    spark, folder = rocksdb, str(tmp_path / "in")
    schema = "document_id long, job_type string, event string, at timestamp"
    out: list = []

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema(schema).json(folder)
        query = recovery.job_states(stream).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        got = sorted(out)
        out.clear()
        return got

    first = run([(1, "index", "queued", at(0)), (1, "index", "started", at(1)), (2, "index", "queued", at(0)), (2, "index", "started", at(1)), (2, "index", "done", at(5))])
    assert first == [(1, "index", "processing", 1, False), (2, "index", "completed", 1, False)]
    later = run([(3, "index", "queued", at(60))])  # the watermark passes the timer of job 1
    again = run([(3, "index", "started", at(61))])
    recovered = [r for r in later + again if r[4]]
    assert recovered == [(1, "index", "pending", 1, True)]
    run([(1, "index", "started", at(62))])
    last = run([(4, "index", "queued", at(200))]) + run([(4, "index", "queued", at(201))])
    assert [r for r in last if r[0] == 1 and r[4]] == [(1, "index", "failed", 2, True)]


def test_a_restart_gives_the_same_index(rocksdb, tmp_path):
    spark = rocksdb
    schema = "doc_id long, version long, text string"
    batches = [[(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], [(1, 2, "a"), (2, 2, "B")], [(3, 2, None), (1, 3, "x"), (1, 4, "y")], [(2, 3, "B"), (4, 1, "d")]]
    folder, path, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def follow():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
        recovery.follow(stream, path, cp).awaitTermination(300)

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        follow()
        # as if the driver had been lost after the batch was written and before that was noted
        commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
        last = commits[-1]
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        follow()
    got = sorted(tuple(r) for r in recovery.current(spark, path).collect())
    assert got == [(1, 2, "y"), (2, 2, "B"), (4, 1, "d")]
    everything = sorted((r.doc_id, r.revision, r.action) for r in spark.read.parquet(path).collect())
    assert everything == [(1, 1, "upsert"), (1, 2, "upsert"), (2, 1, "upsert"), (2, 2, "upsert"), (3, 1, "upsert"), (3, 2, "delete"), (4, 1, "upsert")]
