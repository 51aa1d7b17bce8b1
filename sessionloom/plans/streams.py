"""Streaming operators run over the whole event table: what is there is read once, then the stream ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.plans.events import _greedy as greedy
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources import tables
from sessionloom.streaming import streams, timers

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.readStream.schema(_SCHEMA).parquet(f"{d}/event[s].parquet")  # a pattern, since a stream takes no single file
    return _shaped(raw)


def _shaped(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for p in {"view": "focus_change", "click": "mouse_down", "error": "key_down", "purchase": "scroll", "signup": "bookmark"}.items() for x in p])[F.col("event_type")]
    ts = F.col("ts").cast("timestamp")
    return raw.select("event_id", F.col("user_id").alias("session_id"), ts.alias("ts"), (F.unix_micros(ts) / 1000.0).alias("t"), kind.alias("kind"), F.when(kind == "focus_change", F.concat(F.lit("app"), (k % 8).cast("string"))).alias("app"))


def _folder(spark: SparkSession) -> str:
    tables.ensure_checkpoint_dir(spark)
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _last(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream's result table holds when all its input has been read."""
    path = _folder(spark)
    write = "overwrite" if mode == "complete" else "append"
    writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(write).parquet(f"{path}/out"))
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


_KIND = "CASE event_type WHEN 'view' THEN 'focus_change' WHEN 'click' THEN 'mouse_down' WHEN 'error' THEN 'key_down' WHEN 'purchase' THEN 'scroll' ELSE 'bookmark' END"


@query("x1_windowed_counts", f"SELECT user_id AS session_id, epoch(date_trunc('day', ts))::BIGINT AS start, {_KIND} AS kind, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, d):
    out = _last(spark, streams.windowed_counts(_events(spark, d), "1 day", late="100 days"))
    return out.select("session_id", F.col("window.start").cast("long").alias("start"), "kind", "n")


@query("x2_gap_sessions", "WITH l AS (SELECT user_id AS s, epoch_us(ts) AS us, event_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT *, sum((b IS NULL OR us - b > 28800000000)::INTEGER) OVER (PARTITION BY s ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT s AS session_id, min(us) AS start_us, count(*) AS n FROM g GROUP BY s, g")
def gaps(spark, d):
    out = _last(spark, streams.gap_sessions(_events(spark, d), "8 hours", late="100 days"))
    return out.select("session_id", F.unix_micros("window.start").alias("start_us"), "n")


@query("x3_throttled", greedy("SELECT event_id, user_id AS session_id, epoch_us(ts) / 1000.0::DOUBLE AS t FROM events", "86400000.0"))
def throttled(spark, d):
    return _last(spark, streams.throttle(_events(spark, d), 86_400_000.0, idle_ms=None), "append").select("event_id", "session_id")


_LIVE = f"ev AS (SELECT event_id, user_id AS session_id, epoch_us(ts) AS us, {_KIND} AS kind FROM events)"


@query("x6_segments", f"WITH {_LIVE}, {fx.SEG} SELECT session_id, seg_no::INTEGER AS seg_no, start_us, end_us, reason FROM seg")
def segments_so_far(spark, d):
    path = _folder(spark)
    q = streams.incremental_segments(_events(spark, d), f"{path}/log", f"{path}/out", f"{path}/checkpoint", buckets=8, dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS)
    q.trigger(availableNow=True).start().awaitTermination()
    us = lambda c: F.round(F.col(c) * 1000).cast("long")
    return spark.read.parquet(f"{path}/out").select("session_id", "seg_no", us("t_start").alias("start_us"), us("t_end").alias("end_us"), "reason")


@query("x5_live_tallies", f"WITH e AS (SELECT *, {_KIND} AS kind, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events) SELECT user_id AS session_id, count(*) FILTER (WHERE kind = 'key_down') AS keys, count(*) FILTER (WHERE kind = 'mouse_down') AS clicks, count(*) FILTER (WHERE kind = 'focus_change') AS focus_changes, max_by('app' || (k % 8), (ts, event_id)) FILTER (WHERE kind = 'focus_change') AS latest_app FROM e GROUP BY user_id")
def tallies(spark, d):
    return _last(spark, streams.live_tallies(_events(spark, d)))


@query("s2_event_sink", f"SELECT user_id AS session_id, {_KIND} AS kind, count(*) AS n FROM events GROUP BY ALL")
def sink(spark, d):
    path = _folder(spark)
    q = streams.event_sink(_events(spark, d), f"{path}/out", f"{path}/checkpoint", buckets=8, once=True)
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("session_id", "kind").agg(F.count("*").alias("n"))


def _in_order(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of three batches by time, and a row behind all others, which lets the stream's time pass them."""
    path = f"{_folder(spark)}/in"
    rows = spark.read.schema(_SCHEMA).parquet(f"{d}/events.parquet")
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    cut = [lo + (hi - lo) * i / 3 for i in range(1, 3)]
    at = F.col("ts")
    for part in (rows.filter(at < cut[0]), rows.filter((at >= cut[0]) & (at < cut[1])), rows.filter(at >= cut[1])):
        part.coalesce(1).write.mode("append").parquet(path)
    behind = rows.orderBy(F.desc("ts")).limit(1).select("event_id", (F.col("ts") + F.expr("interval 300 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), "event_type", "value", "props")
    behind.coalesce(1).write.mode("append").parquet(path)
    return _shaped(spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))


_TRIGGERS = f"WITH {_LIVE} SELECT *, us / 1000.0::DOUBLE AS t, CASE WHEN kind IN ('focus_change', 'bookmark') THEN kind WHEN kind IN ('mouse_down', 'key_down', 'scroll') AND us - last_value(CASE WHEN kind IN ('mouse_down', 'key_down', 'scroll') THEN us END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {fx.DWELL_MS * 1000} THEN 'dwell_resume' END AS reason FROM ev QUALIFY reason IS NOT NULL"


@query("x4_triggers", greedy(_TRIGGERS, f"{fx.BURST_MS}"))
def triggers(spark, d):
    """Boundary triggers by event time, the same as over the whole table."""
    out = timers.boundary_triggers(_in_order(spark, d), settle_ms=fx.BURST_MS, dwell_ms=fx.DWELL_MS, idle_ms=400 * 86_400_000.0, late="1 second")
    return _last(spark, out, "append").filter("session_id >= 0").select("event_id", "session_id")
