"""Streams against the same work done in batch."""

import datetime
import random
import tempfile
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import features, segments, temporal
from sessionloom.streaming import streams, timers

SCHEMA = "event_id long, session_id string, ts timestamp, t double, kind string, app string, x double, y double"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng, out, at = random.Random(1), [], {s: 0.0 for s in "abc"}
    for i in range(240):
        s = rng.choice("abc")
        at[s] += rng.choice([5, 40, 700, 3500])
        kind = rng.choice(["focus_change", "key_down", "mouse_down", "scroll", "bookmark", "mouse_move"])
        out.append((i, s, START + datetime.timedelta(milliseconds=at[s]), at[s], kind, f"app{i % 3}" if kind == "focus_change" else None, 1.0, 2.0))
    return out


def stream_of(spark, rows, files=4):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(files):
        spark.createDataFrame(rows[i * len(rows) // files : (i + 1) * len(rows) // files], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05)
    return folder, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    return spark.table(name)


def test_windowed_counts(spark, rows):
    _, s = stream_of(spark, rows)
    out = drain(spark, streams.windowed_counts(s, "2 seconds"), "x1", "complete").collect()
    want = Counter((r[1], int(r[3] // 2000), r[4]) for r in rows)
    assert Counter({(r.session_id, round((r.window.start - START).total_seconds() / 2), r.kind): r.n for r in out}) == want


def test_gap_sessions(spark, rows):
    _, s = stream_of(spark, rows)
    out = drain(spark, streams.gap_sessions(s, "3 seconds"), "x2", "complete").collect()
    want, last = Counter(), {}
    for _, sess, _, t, *_ in rows:
        if sess not in last or t - last[sess] > 3000:
            want[sess] += 1
        last[sess] = t
    assert Counter(r.session_id for r in out) == want and sum(r.n for r in out) == len(rows)


def until(spark, df, name, n):
    """Rows of a stream that has timers, and so never counts as drained: waits for n of them."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table(name).count() < n:
            time.sleep(0.5)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_throttle_equals_batch(spark, rows):
    _, s = stream_of(spark, rows)
    batch = temporal.min_gap(spark.createDataFrame(rows, SCHEMA), F.lit(100.0)).collect()
    out = until(spark, streams.throttle(s, 100.0), "x3", len(batch))
    assert sorted(r.event_id for r in out) == sorted(r.event_id for r in batch)


def test_boundary_trigger_fires_the_first(spark, rows):
    _, s = stream_of(spark, rows, 1)
    out = until(spark, streams.boundary_trigger(s, 200), "x4", 3)
    first = {}
    for r in segments.boundary_triggers(spark.createDataFrame(rows, SCHEMA)).orderBy("t", "event_id").collect():
        first.setdefault(r.session_id, (r.event_id, r.reason))
    assert {r.session_id: (r.event_id, r.reason) for r in out} == first


def test_live_tallies_equal_batch(spark, rows):
    _, s = stream_of(spark, rows)
    out = drain(spark, streams.live_tallies(s), "x5", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, features.tallies(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_incremental_segments_equal_batch(spark, rows):
    folder, s = stream_of(spark, rows)
    for _ in range(2):  # a second run from the same checkpoint changes nothing
        q = streams.incremental_segments(s, f"{folder}/log", f"{folder}/segs", f"{folder}/cp").start()
        q.processAllAvailable()
        q.stop()
    ev = spark.createDataFrame(rows, SCHEMA)
    want = segments.segments(segments.boundaries(ev, segments.session_ends(ev)))
    cols = ["session_id", "seg_no", "t_start", "t_end", "reason"]
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/segs").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_event_sink_appends_all(spark, rows):
    folder, s = stream_of(spark, rows)
    q = streams.event_sink(s, f"{folder}/out", f"{folder}/cp2")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{folder}/out").count() == len(rows)


def _fed(spark, tmp_path, batches, shape):
    """The rows of a stream that gets one file after the other."""
    path = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, "session_id string, event_id long, ts timestamp, t double, kind string").coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    stream = spark.readStream.schema("session_id string, event_id long, ts timestamp, t double, kind string").option("maxFilesPerTrigger", 1).parquet(str(path))
    out = shape(stream)
    writer = out.writeStream.outputMode("append").foreachBatch(lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out")))
    writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def _at(s, i, sec, kind="key_down"):
    return (s, i, START + datetime.timedelta(seconds=sec), 1_704_067_200_000.0 + sec * 1000, kind)


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    batches = [[_at("a", 1, 0), _at("a", 2, 100)], [_at("tick", 7, 100)], [_at("a", 3, 95), _at("a", 4, 40)], [_at("a", 5, 1000)], [_at("tick", 6, 5000)]]
    # rows are held against the watermark that the batch before them began with, 90 s: 40 s is later, 95 s is not
    counts = {(r.window.start.minute * 60 + r.window.start.second): r.n for r in _fed(spark, tmp_path / "x1", batches, lambda s: streams.windowed_counts(s, "10 seconds", late="10 seconds")) if r.session_id == "a"}
    assert counts == {0: 1, 90: 1, 100: 1, 1000: 1}
    gaps = sorted(r.n for r in _fed(spark, tmp_path / "x2", batches, lambda s: streams.gap_sessions(s, "8 seconds", late="10 seconds")) if r.session_id == "a")
    assert gaps == [1, 1, 2]


def test_event_time_triggers_match_the_table(spark, tmp_path):
    rng, rows, sec = random.Random(5), [], 0.0
    for i in range(300):
        sec += rng.choice([0.05, 0.2, 1.0, 5.0])
        rows.append(_at(rng.choice("abc"), i, round(sec, 3), rng.choice(["focus_change", "key_down", "scroll", "mouse_move", "bookmark"])))
    batches = [rows[at : at + 75] for at in range(0, 300, 75)]
    for b in batches:
        rng.shuffle(b)
    got = _fed(spark, tmp_path, [*batches, [_at("tick", 999, sec + 10_000)]], lambda s: timers.boundary_triggers(s, settle_ms=250, dwell_ms=3000, late="1 second"))
    want = segments.boundary_triggers(spark.createDataFrame(rows, "session_id string, event_id long, ts timestamp, t double, kind string"), settle_ms=250, dwell_ms=3000).collect()
    assert sorted((r.session_id, r.event_id, r.reason) for r in got if r.session_id != "tick") == sorted((r.session_id, r.event_id, r.reason) for r in want)


def test_a_still_session_is_forgotten(spark, tmp_path):
    batches = [[_at("a", 1, 0)], [_at("tick", 2, 100)], [_at("tick", 3, 200)], [_at("a", 4, 300)], [_at("a", 5, 310)], [_at("tick", 6, 9000)]]
    got = _fed(spark, tmp_path, batches, lambda s: timers.boundary_triggers(s, settle_ms=250, dwell_ms=3000, idle_ms=50_000, late="1 second"))
    # input at 300 s follows nothing known, input at 310 s a pause of ten seconds
    assert [r.event_id for r in got if r.session_id == "a"] == [5]
