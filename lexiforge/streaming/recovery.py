"""Processing jobs and incremental ingestion as streams with state: timers for jobs that hang, digests of what has been ingested.

These need the RocksDB state store (``use_rocksdb(spark)``), which keeps state on disk and its changes in the checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import MOST_ATTEMPTS, STEPS

STALE_MINUTES = 30


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Jobs(StatefulProcessor):
    """A job's state and attempts; a timer of a job that is being processed recovers it when it hangs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long")
        self.attempts = handle.getValueState("attempts", "n int")

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _out(self, key, state: str, attempts: int, recovered: bool) -> pd.DataFrame:
        return pd.DataFrame({"document_id": [key[0]], "job_type": [key[1]], "state": [state], "attempts": [attempts], "recovered": [recovered]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, since = self.now.get() if self.now.exists() else ("", 0)
        attempts = self.attempts.get()[0] if self.attempts.exists() else 0
        for e in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            after = STEPS.get((state, e.event))
            if after is None or (state == "failed" and attempts >= MOST_ATTEMPTS):
                continue
            state, since = after, int(e.at.timestamp() * 1000)
            self._stop_timers()
            if state == "processing":
                attempts += 1
                self.handle.registerTimer(since + STALE_MINUTES * 60_000)
        self.now.update((state, since))
        self.attempts.update((attempts,))
        yield self._out(key, state, attempts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, _ = self.now.get()
        attempts = self.attempts.get()[0]
        if state == "processing":
            state = "failed" if attempts >= MOST_ATTEMPTS else "pending"
            self.now.update((state, expiredTimerInfo.getExpiryTimeInMs()))
            yield self._out(key, state, attempts, True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(document_id, job_type, state, attempts, recovered) of events (document_id, job_type, event, at timestamp), after each batch and when a job has hung for STALE_MINUTES.

    Time is that of the events, as their watermark tells it. A job goes back to pending, or fails if it has been tried MOST_ATTEMPTS times.
    """
    schema = "document_id long, job_type string, state string, attempts int, recovered boolean"
    return events.withWatermark("at", late).groupBy("document_id", "job_type").transformWithStateInPandas(Jobs(), schema, "Update", "EventTime")


class Changes(StatefulProcessor):
    """Of each document the digest of what was ingested last and its revision: what doesn't change is skipped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digest = handle.getValueState("digest", "digest string")
        self.revision = handle.getValueState("revision", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        digest = self.digest.get()[0] if self.digest.exists() else None
        revision = self.revision.get()[0] if self.revision.exists() else 0
        out = []
        # several versions in one batch: the last in order of ``version`` holds
        last = pd.concat(list(rows)).sort_values(["version", "text"], kind="stable", na_position="first").iloc[-1]
        gone = last["text"] is None or pd.isna(last["text"])
        new = "" if gone else hashlib.sha256(last["text"].encode()).hexdigest()
        if new != (digest or "") or (digest is None and not gone):
            revision += 1
            self.digest.update((new,))
            self.revision.update((revision,))
            out.append({"doc_id": key[0], "revision": revision, "action": "delete" if gone else "upsert", "text": None if gone else last["text"]})
        yield pd.DataFrame(out, columns=["doc_id", "revision", "action", "text"])

    def close(self) -> None:
        pass


def changes(versions: DataFrame) -> DataFrame:
    """(doc_id, revision, action, text): what documents (doc_id, version, text) change in an index; a null text deletes."""
    return versions.groupBy("doc_id").transformWithStateInPandas(Changes(), "doc_id long, revision long, action string, text string", "Update", "None")


def follow(versions: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch of changes to a folder of its own number and stops at the end of what is there.

    A batch that is done again after a failure replaces its folder, so that a change is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return changes(versions).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, revision, text): the index that all batches of ``follow`` make."""
    from pyspark.sql import functions as F

    last = spark.read.parquet(path).groupBy("doc_id").agg(F.max_by(F.struct("revision", "action", "text"), "revision").alias("c"))
    return last.filter("c.action = 'upsert'").select("doc_id", "c.revision", "c.text")
