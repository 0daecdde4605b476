"""Structured Streaming: directly-follows counts, calendar buckets and batching sessions of event streams.

Rows older than the watermark are dropped, where a batch run would sort them in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def directly_follows(events: DataFrame, late: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """(case_id, source, target, ts): each event with the one before it in its case.

    Events wait, sorted, until the watermark has passed them, so that late ones find their place and the rows are those
    of a batch run over all events that were not dropped. A case without events for ``idle`` after the watermark is
    forgotten: its next event begins anew.
    """
    ship(events.sparkSession)
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, ids, names = state.get if state.exists else (None, [], [], [])
        rows = list(zip(times, ids, names))
        if not state.hasTimedOut:
            for p in parts:
                rows += zip(p["us"].tolist(), p["event_id"].tolist(), p["activity"].tolist())
        rows.sort(key=lambda r: (r[0], r[1].rjust(40, "0") if r[1].isdigit() else r[1]))
        until = state.getCurrentWatermarkMs()
        ready = [r for r in rows if r[0] // 1000 < until]
        rows = rows[len(ready) :]
        out = pd.DataFrame({"case_id": key[0], "source": [last, *[r[2] for r in ready]][: len(ready)], "target": [r[2] for r in ready], "us": [r[0] for r in ready]})
        last = ready[-1][2] if ready else last
        if state.hasTimedOut and not ready and not rows:
            state.remove()
            return
        state.update((last, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        state.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, until + 1) if rows else until + keep)
        if len(out):
            yield out[out["source"].notna()]

    ts = F.col("ts").cast("timestamp")
    timed = events.select("case_id", "activity", ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("event_id").cast("string").alias("event_id")).withWatermark("ts", late)
    out = timed.groupBy("case_id").applyInPandasWithState(step, "case_id string, source string, target string, us long", "last string, times array<long>, ids array<string>, names array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("case_id", "source", "target", F.timestamp_micros("us").alias("ts"))


def calendar(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(bucket, activity, n) of tumbling windows, each given out once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "activity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "activity", "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(resource, activity, begun, ended, size): runs of an activity by a resource without a longer gap.

    Unlike the batch operator, a run isn't broken by another activity in between.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = timed.groupBy("resource", "activity", F.session_window("ts", gap)).agg(F.count("*").alias("size"))
    return s.select("resource", "activity", F.col("session_window.start").alias("begun"), F.col("session_window.end").alias("ended"), "size")
