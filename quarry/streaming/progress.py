"""Streaming twins of the progress fold and the stale-run timeout (the batch forms are in the catalogue)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(events: DataFrame, run: str = "run", stage: str = "stage", status: str = "status", ts: str = "ts") -> DataFrame:
    """(run, stage, status, ts): the last status of each stage, in batch or as a stream in update mode; ties go to the larger status."""
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(status).alias("status"))).alias("x")
    return events.groupBy(run, stage).agg(last).select(run, stage, "x.status", "x.ts")


def final_stage(stages: DataFrame, last: str, run: str = "run", stage: str = "stage") -> DataFrame:
    """(run, stage): failed if any stage failed, done if the last one completed, else the stage that moved last."""
    any_failed = F.bool_or(F.col("status") == "failed")
    done = F.bool_or((F.col(stage) == last) & (F.col("status") == "completed"))
    now = F.max_by(stage, F.struct("ts", stage))
    return stages.groupBy(run).agg(F.when(any_failed, "failed").when(done, "done").otherwise(now).alias("stage"))


def window_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts per tumbling window and kind; events later than the watermark are dropped by the engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def stale_runs(events: DataFrame, gap: str = "15 minutes", late: str = "1 minute", run: str = "run", status: str = "status", ts: str = "ts") -> DataFrame:
    """(run, quiet_since, state): one row when a run has had no event for the gap, ``finished`` if it ended before, else ``stale``. As a
    stream in append mode a row appears when the watermark passes the end of the run's session."""
    ended = F.bool_or(F.col(status).isin("completed", "failed"))
    sessions = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), run).agg(ended.alias("ended"))
    return sessions.select(run, F.col("w.end").alias("quiet_since"), F.when(F.col("ended"), "finished").otherwise("stale").alias("state"))


def write_once(stream: DataFrame, folder: str, checkpoint: str):
    """Exactly-once Parquet sink of everything there is now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
