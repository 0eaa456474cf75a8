"""Operators over events that work on tables and on streams alike, and stateful ones for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """``(start, event_type, n)`` for windows of ``width``; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """``(user_id, start, n)``: a user's events with less than ``gap`` from one to the next."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def newer(events: DataFrame, marks: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows beyond the mark of their key (key, mark), and those of keys that have none."""
    return events.join(marks, key, "left").where(F.col("mark").isNull() | (F.col(ts) > F.col("mark"))).drop("mark")


def stale(states: DataFrame, key: str, checked: str, now: str, days: int, jitter: int = 7) -> DataFrame:
    """Keys to look at again: not seen for ``days`` and up to ``jitter`` more, which a checksum of the key spreads."""
    age = F.datediff(F.to_date(F.lit(now)), F.expr(f"try_to_date({checked})"))
    return states.where(age.isNull() | (age > F.lit(days) + F.crc32(F.col(key).cast("string")) % jitter))


def limited(events: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """``(user_id, ts, allowed)`` on a stream: an event is allowed if fewer than ``limit`` allowed ones lie within the
    ``seconds`` before it. A user's state are the times of at most ``limit`` events, and it ends when they are old."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed = []
        for t in (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist():
            times = [x for x in times if x > t - seconds]
            allowed.append(len(times) < limit)
            if allowed[-1]:
                times.append(t)
        state.update((times,))
        state.setTimeoutTimestamp(int(max(max(times, default=0.0) * 1000, state.getCurrentWatermarkMs())) + seconds * 1000)
        yield pd.DataFrame({"user_id": key[0], "ts": rows["ts"], "allowed": allowed})

    return events.select("user_id", "ts").withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
