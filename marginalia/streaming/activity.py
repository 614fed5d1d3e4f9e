"""Conversation activity over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

EXPIRED = "conv_id long, last_accessed_ms long"


def activity_sessions(events: DataFrame, key: str = "user_id", gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Closed activity periods; works on streams (append mode) and tables alike."""
    return events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(
        key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


class _IdleProcessor(StatefulProcessor):
    def __init__(self, max_age_ms: int):
        self.max_age_ms = max_age_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["ms"].max()) for frame in rows)
        if self.last.exists():
            newest = max(newest, self.last.get()[0])
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(newest + self.max_age_ms)
        yield pd.DataFrame({"conv_id": [], "last_accessed_ms": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"conv_id": [int(key[0])], "last_accessed_ms": [last]})

    def close(self) -> None:
        pass


def expire_idle(events: DataFrame, max_age_seconds: int = 3600, delay: str = "1 minute") -> DataFrame:
    """Emits a conversation when the watermark passes its last access by more than the age, and forgets it."""
    timed = events.withWatermark("ts", delay).selectExpr("conv_id", "unix_millis(ts) as ms", "ts")
    return timed.groupBy("conv_id").transformWithStateInPandas(
        _IdleProcessor(max_age_seconds * 1000), EXPIRED, "Append", "EventTime")
