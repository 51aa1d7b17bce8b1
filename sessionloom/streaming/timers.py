"""Streams with timers by event time: a trigger fires when the stream's own time has passed it.

State is a few numbers a session; a timer drops it when a session has been still for long. What is later
than the watermark is left out, as in windowed counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sessionloom.operators import segments

#: The state store that timers and several states a key need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Triggers(StatefulProcessor):
    """Rows of a session in, the moments that ask for a snapshot out, once ``settle_ms`` of event time have passed."""

    def __init__(self, settle_ms: float, dwell_ms: float, idle_ms: float):
        self.settle, self.dwell, self.idle = settle_ms, dwell_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "event_id long, t double, reason string")
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        armed = self.armed.get() if self.armed.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        out, latest = [], None
        for e in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples(index=False):
            why, latest = (e.kind if e.kind in ("focus_change", "bookmark") else None), float(e.t)
            if e.kind in segments.MEANINGFUL:
                why = "dwell_resume" if last is not None and e.t - last >= self.dwell else None
                last = float(e.t)
            if why is None:
                continue
            if armed is not None and e.t - armed[1] >= self.settle:
                out.append((key[0], *armed))
                armed = None
            if armed is None:  # what comes while one is armed folds into it
                armed = (int(e.event_id), float(e.t), why)
        if last is not None:
            self.last.update((last,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if armed is not None:
            self.armed.update(armed)
            self.handle.registerTimer(int(-(-(armed[1] + self.settle) // 1)))
        else:
            self.armed.clear()
            self.handle.registerTimer(int(latest + self.idle))
        yield pd.DataFrame(out, columns=["session_id", "event_id", "t", "reason"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        if self.armed.exists():
            armed = self.armed.get()
            out.append((key[0], *armed))
            self.armed.clear()
            self.handle.registerTimer(int(armed[1] + max(self.idle, self.settle + 1)))
        else:
            self.last.clear()
        yield pd.DataFrame(out, columns=["session_id", "event_id", "t", "reason"])

    def close(self) -> None:
        pass


def boundary_triggers(events: DataFrame, *, settle_ms: float = 250.0, dwell_ms: float = 3000.0, idle_ms: float = 3_600_000.0, late: str = "10 seconds") -> DataFrame:
    """session_id, event_id, t, reason as a stream: what ``segments.boundary_triggers`` gives of the same rows.

    ``events``: session_id, event_id, ts (timestamp), t (ms of ts), kind. One fires when the watermark is
    ``settle_ms`` past it, or a later one shows it. After ``idle_ms`` without rows the session's time of
    last input is forgotten, so that what resumes later is no dwell.
    """
    use_rocksdb(events.sparkSession)
    kind = events.schema["session_id"].dataType.simpleString()
    rows = events.select("session_id", "event_id", "ts", "t", "kind").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(Triggers(settle_ms, dwell_ms, idle_ms), f"session_id {kind}, event_id long, t double, reason string", "Append", "EventTime")
