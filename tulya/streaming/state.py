"""Jobs as a stream: drafts and finals, progress that isn't repeated, runs that have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RESULT = "key string, status string, seq long, body string"
_PROGRESS = "key string, stage string, percent int, seq long"


def progressive(results: DataFrame, key: str, status: str, seq: str, body: str) -> DataFrame:
    """key, status, seq, body: what a reader of results may be shown, as it comes.

    A key's draft is passed on while there is no final one, if it is newer than the one
    before; its first final result is passed on and ends it: drafts that come late and
    further finals are dropped. The state is a key's last number and whether it is final.
    """
    rows = results.select(F.col(key).cast("string").alias("key"), F.col(status).alias("status"), F.col(seq).cast("long").alias("seq"), F.col(body).cast("string").alias("body"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (-(1 << 62), False)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if ended or (row.status != "final" and row.seq <= last):
                continue
            ended, last = row.status == "final", int(row.seq)
            out.append((k[0], row.status, last, row.body))
        state.update((last, ended))
        yield pd.DataFrame(out, columns=["key", "status", "seq", "body"])

    return rows.groupBy("key").applyInPandasWithState(step, _RESULT, "last long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def throttled(log: DataFrame, key: str, stage: str, percent: Column, seq: str) -> DataFrame:
    """key, stage, percent, seq: a job's progress, passed on when its stage or whole percent changes.

    The state is the pair last passed on, so a row that repeats it is dropped, in
    whatever micro-batch it comes; one that returns to an earlier pair is news.
    """
    rows = log.select(F.col(key).cast("string").alias("key"), F.col(stage).alias("stage"), F.floor(percent + 0.5).cast("int").alias("percent"), F.col(seq).cast("long").alias("seq"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if (row.stage, int(row.percent)) != last:
                last = (row.stage, int(row.percent))
                out.append((k[0], *last, int(row.seq)))
        if last:
            state.update(last)
        yield pd.DataFrame(out, columns=["key", "stage", "percent", "seq"])

    return rows.groupBy("key").applyInPandasWithState(step, _PROGRESS, "stage string, percent int", "append", GroupStateTimeout.NoTimeout)


def sessions(log: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """key, started, ended, n: runs of a key's rows with no gap of that length between them.

    On a stream a run is given once the watermark, ``late`` behind the newest row, has
    passed its end: that is when a job that isn't heard of any more counts as stopped.
    Times without a zone, which a watermark can't be of, are taken in the session's and
    given back without one.
    """
    kind = log.schema[ts].dataType
    rows = log.select(F.col(key), F.col(ts).cast("timestamp").alias("_ts"))
    rows = rows if late is None else rows.withWatermark("_ts", late)
    out = rows.groupBy(F.col(key), F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast(kind).alias("started"), F.col("w.end").cast(kind).alias("ended"), "n")


def over_time(stages: DataFrame, key: str, started: str, now: Column, limit: Column) -> DataFrame:
    """Open stages (key, started) whose limit has passed, with deadline: what is to be cancelled."""
    out = stages.withColumn("deadline", F.col(started) + limit)
    return out.filter(F.col("deadline") < now)
