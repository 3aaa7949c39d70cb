"""The event log of jobs and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_job(events: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key, by one aggregation."""
    rest = [c for c in events.columns if c != by]
    out = events.groupBy(by).agg(F.max(F.struct(ts, tie, *(c for c in rest if c not in (ts, tie)))).alias("r"))
    return out.select(by, *(F.col(f"r.{c}").alias(c) for c in rest))


def queue_health(jobs: DataFrame, status: str, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """running, queued, failed_recently: one row."""
    recent = F.col(ts) >= now - F.expr(f"interval {hours} hours")
    return jobs.agg(
        F.count_if(F.col(status) == "running").alias("running"),
        F.count_if(F.col(status) == "queued").alias("queued"),
        F.count_if((F.col(status) == "failed") & recent).alias("failed_recently"),
    )


def stage_durations(log: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """Adds duration_ms: to the start of the next stage of the job."""
    ahead = F.lead(ts).over(Window.partitionBy(by).orderBy(ts, tie))
    ms = (F.unix_micros(ahead.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    return log.withColumn("duration_ms", F.floor(ms).cast("long"))


def stale(log: DataFrame, by: str, ts: str, status: str, now: Column, minutes: int) -> DataFrame:
    """Jobs that still run and haven't been heard of for so long."""
    last = log.groupBy(by).agg(F.max(ts).alias("last"), F.max_by(status, ts).alias("status"))
    return last.filter((F.col("status") == "running") & (F.col("last") < now - F.expr(f"interval {minutes} minutes")))


def progress(log: DataFrame, by: str, stage: str, percent: str, ts: str) -> DataFrame:
    """The first row of each stage and whole percent of a job."""
    return log.groupBy(by, stage, F.floor(percent).alias("percent")).agg(F.min(ts).alias(ts))
