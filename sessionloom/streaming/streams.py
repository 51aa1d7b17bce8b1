"""Streaming variants: windowed counts, gap sessions, throttles, debounced triggers, tallies, incremental segments.

Input streams hold event_id, session_id, ts (timestamp), kind and whatever else a function names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionloom.operators import segments


def bucket(buckets: int) -> Column:
    """Which of so many folders a session's rows lie in."""
    return F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")


def event_sink(events: DataFrame, path: str, checkpoint: str, every: str = "250 milliseconds", partition: str | None = None, buckets: int = 64, once: bool = False):
    """Appends a stream to Parquet in small batches, partitioned; returns the running query.

    Without a ``partition`` column sessions are dealt to ``buckets`` folders, so that their number does
    not grow with the people. ``once`` ends it when all that is there now has been written.
    """
    if partition is None:
        events, partition = events.withColumn("bucket", bucket(buckets)), "bucket"
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(partition).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """session_id, window, kind, n in tumbling or sliding windows, rows later than ``late`` left out."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy("session_id", window.alias("window"), "kind").agg(F.count("*").alias("n"))


def gap_sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """session_id, window, n: stretches without a pause longer than ``gap`` (rows exactly that far apart stay together)."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))


def throttle(events: DataFrame, gap_ms: float, idle_ms: int | None = 3_600_000) -> DataFrame:
    """event_id, session_id, t of rows that are ``gap_ms`` or more after the session's last kept one; a clock that goes back keeps.

    ``events``: session_id, event_id, t (ms). State is one number a session, dropped after ``idle_ms`` without rows; without
    ``idle_ms`` it stays, and a stream over what is there now comes to its end.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for e in pd.concat(list(frames)).sort_values(["t", "event_id"]).itertuples(index=False):
            if last is None or e.t - last >= gap_ms or e.t < last:
                last = float(e.t)
                kept.append((e.event_id, key[0], last))
        state.update((last,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(kept, columns=["event_id", "session_id", "t"])

    kind = events.schema["session_id"].dataType.simpleString()
    return events.select("session_id", "event_id", "t").groupBy("session_id").applyInPandasWithState(step, f"event_id long, session_id {kind}, t double", "last double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def boundary_trigger(events: DataFrame, debounce_ms: int = 250, dwell_ms: float = 3000.0, idle_ms: int = 3_600_000) -> DataFrame:
    """session_id, event_id, reason: what ``segments.boundary_triggers`` gives, once each is ``debounce_ms`` old.

    Armed by a focus change, a bookmark, or input after ``dwell_ms`` without any; more rows while armed
    fold into it and do not put it off; the timer fires it. State is one row a session, dropped after
    ``idle_ms`` without rows.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event_id, reason, due, last = state.get if state.exists else (None, None, None, None)
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            if event_id is None:
                state.remove()
                return
            state.update((None, None, None, last))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame([(key[0], event_id, reason)], columns=["session_id", "event_id", "reason"])
            return
        for e in pd.concat(list(frames)).sort_values(["t", "event_id"]).itertuples(index=False):
            why = e.kind if e.kind in ("focus_change", "bookmark") else None
            if e.kind in segments.MEANINGFUL:
                why = "dwell_resume" if last is not None and e.t - last >= dwell_ms else None
                last = float(e.t)
            if why and event_id is None:
                event_id, reason, due = int(e.event_id), why, now + debounce_ms
        state.update((event_id, reason, due, last))
        state.setTimeoutDuration(idle_ms if due is None else max(1, due - now))

    kind = events.schema["session_id"].dataType.simpleString()
    return events.select("session_id", "event_id", "t", "kind").groupBy("session_id").applyInPandasWithState(step, f"session_id {kind}, event_id long, reason string", "event_id long, reason string, due long, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_tallies(events: DataFrame) -> DataFrame:
    """Counts so far of each session's keys, clicks and focus changes, and its latest app; for update mode."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return events.groupBy("session_id").agg(n("key_down").alias("keys"), n("mouse_down").alias("clicks"), n("focus_change").alias("focus_changes"), F.max_by("app", F.when(F.col("app").isNotNull(), F.struct("t", "event_id"))).alias("latest_app"))


def incremental_segments(events: DataFrame, log: str, out: str, checkpoint: str, buckets: int = 64, **gaps):
    """Appends each batch to ``log`` and derives anew the segments of the buckets it touched, by partition overwrite.

    Both are partitioned by a hash of the session, so the number of folders does not grow with the
    people; a batch reads and writes its own buckets only, and doing a batch twice leaves the same
    segments: rows are taken once by event_id. Returns the stream writer.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        rows = df.withColumns({"batch": F.lit(epoch), "bucket": bucket(buckets)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(log)
        touched = rows.select("bucket").distinct()
        held = spark.read.parquet(log).join(F.broadcast(touched), "bucket", "left_semi").dropDuplicates(["session_id", "event_id"])  # at most as many rows as buckets
        bounds = segments.boundaries(held, segments.session_ends(held), **gaps)
        made = segments.segments(bounds).withColumn("bucket", bucket(buckets))
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
