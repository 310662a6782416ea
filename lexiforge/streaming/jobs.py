"""Processing jobs as streams: states by key, incremental ingestion, windows over late events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import existing

#: What a job may become, by its state and what is reported.
STEPS = {("", "queued"): "pending", ("pending", "started"): "processing", ("processing", "done"): "completed", ("processing", "error"): "failed", ("failed", "queued"): "pending"}
MOST_ATTEMPTS = 2


def job_states(events: DataFrame) -> DataFrame:
    """(document_id, job_type, state, attempts) after each batch of events (document_id, job_type, event, at).

    Events of a job are taken in order of their time; one that doesn't fit the job's state changes nothing,
    so that queueing an active job again is harmless. A job that has failed MOST_ATTEMPTS times stays failed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts = state.get if state.exists else ("", 0)
        for event in pd.concat(list(batches)).sort_values("at", kind="stable")["event"]:
            after = STEPS.get((now, event))
            if after is None or (now == "failed" and attempts >= MOST_ATTEMPTS):
                continue
            attempts += after == "processing"
            now = after
        state.update((now, attempts))
        yield pd.DataFrame({"document_id": [key[0]], "job_type": [key[1]], "state": [now], "attempts": [attempts]})

    return events.groupBy("document_id", "job_type").applyInPandasWithState(
        step, "document_id long, job_type string, state string, attempts int", "state string, attempts int", "update", GroupStateTimeout.NoTimeout
    )


def recovered(jobs: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Jobs of a table, where those that have been processing for so long go back to pending, or fail."""
    stale = (F.col("state") == "processing") & (F.col("started_at") <= now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("state", F.when(stale & (F.col("attempts") >= MOST_ATTEMPTS), "failed").when(stale, "pending").otherwise(F.col("state")))


def windowed(events: DataFrame, length: str = "10 minutes", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events (ts, event_type, value) counted by window; a window ends when events are ``late`` past it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id"):
    """Starts a query that appends a stream's rows to the table at ``path``, each key once, and stops at the end of what is there."""

    def put(batch: DataFrame, number: int) -> None:
        rows, known = batch.dropDuplicates([key]), existing(batch.sparkSession, path)
        if known is not None:
            rows = rows.join(known.select(key), key, "left_anti")
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
