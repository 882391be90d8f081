"""Jobs as events (job_id, event_id, ts, event, progress_page): state in batch and as a stream.

Events: submitted, progress, complete, error, deleted. The same rules hold in both: the last
terminal event decides the status, the last progress event the page, and a job that began
longer than TTL ago is gone whatever its status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS, SWEEP_SECONDS, POLL_MS = 3600, 300, 500
TERMINAL = ("complete", "error")


def states(events: DataFrame) -> DataFrame:
    """(job_id, status, progress_page, n_events, created_at, elapsed_seconds) of each job; the last of equal times is the one with the larger event_id."""
    order = F.struct("ts", "event_id")
    end = F.max_by(F.struct("event", "ts"), F.when(F.col("event").isin(*TERMINAL), order))
    out = events.groupBy("job_id").agg(
        end.alias("_end"),
        F.max_by("progress_page", F.when(F.col("event") == "progress", order)).alias("progress_page"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("_last"),
    )
    elapsed = F.unix_micros(F.coalesce("_end.ts", "_last")) - F.unix_micros("created_at")
    return out.select("job_id", F.coalesce("_end.event", F.lit("processing")).alias("status"), F.coalesce("progress_page", F.lit(0)).alias("progress_page"), "n_events", "created_at", (elapsed / F.lit(1e6)).alias("elapsed_seconds"))


def alive(jobs: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Jobs that began within the last ttl seconds."""
    return jobs.where(F.unix_micros("created_at") >= F.unix_micros(now) - F.lit(ttl * 1_000_000))


def without_deleted(jobs: DataFrame, deletions: DataFrame) -> DataFrame:
    return jobs.join(deletions.select("job_id").distinct(), "job_id", "left_anti")


def result_code(status: Column) -> Column:
    """What asking for a result yields: 404 unknown, 500 failed, 409 not done, else 200."""
    return F.when(status.isNull(), 404).when(status == "error", 500).when(status != "complete", 409).otherwise(200)


def progress_percent(page: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), page / total * 100)).otherwise(0.0)


def latest_progress(events: DataFrame) -> DataFrame:
    """Each job's progress events with the page seen so far."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.where("event = 'progress'").withColumn("furthest_page", F.max("progress_page").over(w))


STATE = "status string, progress_page int, created_us long, last_us long, event_id long, end_us long, end_id long"
OUTPUT = "job_id long, status string, progress_page int, created_us long, expired boolean"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One job's state over a micro-batch; a timeout in event time ends it."""
    if state.hasTimedOut:
        status, page, created, *_ = state.get
        state.remove()
        yield pd.DataFrame([{"job_id": key[0], "status": status, "progress_page": page, "created_us": created, "expired": True}])
        return
    status, page, created, last, last_id, end, end_id = state.get if state.exists else ("processing", 0, 2**62, -(2**62), -1, -(2**62), -1)
    deleted = False
    for frame in frames:
        for ts, event_id, event, p in zip(frame["ts"], frame["event_id"], frame["event"], frame["progress_page"], strict=True):
            us = int(pd.Timestamp(ts).value // 1000)
            created = min(created, us)
            if event in TERMINAL and (us, event_id) > (end, end_id):
                status, end, end_id = event, us, int(event_id)
            elif event == "progress" and (us, event_id) > (last, last_id):
                page, last, last_id = int(p), us, int(event_id)
            deleted |= event == "deleted"
    if deleted:
        if state.exists:
            state.remove()
        return
    state.update((status, page, created, last, last_id, end, end_id))
    state.setTimeoutTimestamp(max(created // 1000 + TTL_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([{"job_id": key[0], "status": status, "progress_page": page, "created_us": created, "expired": False}])


def state_stream(events: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """A stream of job states from a stream of events, in update mode; expired jobs come once more, marked, and their state goes."""
    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("job_id").applyInPandasWithState(_advance, OUTPUT, STATE, "update", "EventTimeTimeout")


def progress_windows(events: DataFrame, lateness: str = "5 minutes", width: str = "10 minutes") -> DataFrame:
    """A stream of counts by window and event, late events dropped at the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event").agg(F.count(F.lit(1)).alias("n"), F.max("progress_page").alias("furthest_page"))
