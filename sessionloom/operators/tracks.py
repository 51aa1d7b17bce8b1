"""All lanes of a session, in their fixed order, as one table.

A row is a bucket of a density lane (value, value2, peak), a mark (start_sec) or a span (start_sec, end_sec);
``at`` is the bucket, or what tells marks and spans of one time apart. Lanes without a row are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import features, library, segments

# Lanes in order, each in its band.
ORDER = (
    ("frames", "screen"), ("apps", "screen"), ("web", "screen"), ("ax", "screen"), ("levels", "segments"), ("caption", "segments"), ("transcript", "audio"), ("audio", "audio"),
    ("typing", "input"), ("clicks", "input"), ("scroll", "input"), ("mouse-speed", "input"), ("mouse-xy", "input"), ("idle", "input"), ("markers", "marks"),
)
# What marks are called.
MARKERS = {"keymap_change": "keyboard layout", "display_change": "displays changed", "bookmark": "bookmark"}


def pointer_bounds(ev: DataFrame, displays: DataFrame | None) -> DataFrame:
    """session_id, bw, bh: right and bottom of the latest displays (session_id, t, right, bottom), else the farthest point seen, 1 at least."""
    seen = ev.groupBy("session_id").agg(F.greatest(F.lit(1.0), F.max("x")).alias("mx"), F.greatest(F.lit(1.0), F.max("y")).alias("my"))
    if displays is None:
        return seen.select("session_id", F.col("mx").alias("bw"), F.col("my").alias("bh"))
    per = displays.groupBy("session_id", "t").agg(F.max("right").alias("r"), F.max("bottom").alias("b")).filter("r > 0 and b > 0")
    last = per.groupBy("session_id").agg(F.max_by(F.struct("r", "b"), "t").alias("d"))
    return seen.join(last, "session_id", "left").select("session_id", F.coalesce("d.r", "mx").alias("bw"), F.coalesce("d.b", "my").alias("bh"))


def pointer_lane(ev: DataFrame, axis: DataFrame, buckets: int, displays: DataFrame | None = None) -> DataFrame:
    """session_id, bucket, x, y: where the pointer was last, as shares of the screen; null before it first moved."""
    moves = ev.filter("kind = 'mouse_move' and x is not null and y is not null").join(pointer_bounds(ev, displays), "session_id").join(axis, "session_id")
    sec = F.greatest((F.col("t") - F.col("origin_ms")) / 1000, F.lit(0.0)).alias("sec")
    point = moves.select("session_id", "event_id", sec, F.struct((F.col("x") / F.col("bw")).alias("x"), (F.col("y") / F.col("bh")).alias("y")).alias("value"))
    return features.bucket_hold(point, axis.select("session_id", "total_sec"), buckets).select("session_id", "bucket", F.col("value.x").alias("x"), F.col("value.y").alias("y"))


def rates(samples: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """session_id, bucket, value, peak: counts to a rate a second over about one second around each bucket, over the peak.

    How many buckets a second covers follows from each session's length, so a session's buckets are one array.
    """
    counts = features.bucket_counts(samples, totals, buckets)
    arrays = counts.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "n"))), lambda s: s["n"]).alias("ns")).join(totals, "session_id")
    per = F.col("total_sec") / buckets
    span = F.greatest(F.lit(1), F.floor(1 / F.when(per > 0, per) + 0.5)).cast("int")
    half = F.floor(F.col("span") / 2).cast("int")

    def rate(n: Column, b: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), b - half), F.least(F.lit(buckets - 1), b + F.col("span") - half - 1)
        held = F.slice("ns", lo + 1, hi - lo + 1)
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s + x) / ((hi - lo + 1) * F.col("per"))

    rows = arrays.withColumns({"per": per, "span": span})
    values = F.when(F.col("per") > 0, F.transform("ns", rate)).otherwise(F.transform("ns", lambda n: F.lit(0.0)))
    return features.normalised(rows.select("session_id", F.posexplode(values).alias("bucket", "value")))


def session_tracks(
    ev: DataFrame, axis: DataFrame, buckets: int, *, frames: DataFrame, walks: DataFrame, segs: DataFrame, levels: DataFrame, clips: DataFrame, audio: DataFrame, displays: DataFrame | None = None,
    dwell_ms: float = segments.DWELL_MS, burst_ms: float = segments.BURST_MS,
) -> DataFrame:
    """session_id, lane_no, band, lane, at, start_sec, end_sec, value, value2, peak, label.

    ``axis``: session_id, origin_ms, total_sec (A23); ``frames``: frame_id, session_id, t; ``walks``: session_id,
    walk_id, t, reason, n_elements, walk_ms; ``segs``: as ``library.presence_lanes``; ``levels``: session_id,
    level, node_id, t_start, t_end, text; ``clips``: session_id, clip_no, t_start, t_end, text, which stand for
    the transcript where a session has any; ``audio``: session_id, media, start_sec, duration_sec, peaks.
    """
    at = lambda c: F.greatest((F.col(c) - F.col("origin_ms")) / 1000, F.lit(0.0))
    none = {"start_sec": "double", "end_sec": "double", "value": "double", "value2": "double", "peak": "double", "label": "string"}
    totals = axis.select("session_id", "total_sec")
    out: list[DataFrame] = []

    def lane(name: str, rows: DataFrame, key: Column, called: Column | None = None, **given: Column) -> None:
        no = [n for n, _ in ORDER].index(name)
        columns = [(given[c] if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in none.items()]
        out.append(rows.select("session_id", F.lit(no).alias("lane_no"), F.lit(ORDER[no][1]).alias("band"), (F.lit(name) if called is None else called).alias("lane"), key.cast("long").alias("at"), *columns))

    def on_axis(rows: DataFrame) -> DataFrame:
        return rows.join(axis, "session_id")

    def density(name: str, rows: DataFrame, called: Column | None = None) -> None:
        lane(name, rows, F.col("bucket"), called, value=F.col("value"), peak=F.col("peak"))

    samples = on_axis(ev).select("session_id", "event_id", "kind", at("t").alias("sec"))
    lane("frames", on_axis(frames), F.col("frame_id"), start_sec=at("t"), label=F.col("frame_id").cast("string"))
    # to the microsecond, since a length in seconds times 1000 may lie past the last event
    ends = axis.select("session_id", F.round(F.col("origin_ms") + F.col("total_sec") * 1000, 3).alias("t_end"))
    apps = on_axis(segments.app_spans(ev, ends))
    lane("apps", apps, F.round("t_start"), start_sec=at("t_start"), end_sec=at("t_end"), label=F.col("app"))
    web = on_axis(ev.filter("kind = 'url_change' and url is not null"))
    lane("web", web, F.col("event_id"), start_sec=at("t"), label=F.coalesce(text.url_prefix(F.col("url")), F.col("url")))
    said = F.concat(F.col("reason"), F.lit(" · "), F.col("n_elements").cast("string"), F.lit(" elements · "), F.round("walk_ms").cast("long").cast("string"), F.lit("ms"))
    lane("ax", on_axis(walks), F.col("walk_id"), start_sec=at("t"), label=said)
    lane("levels", on_axis(levels), F.col("node_id"), F.concat(F.lit("level-"), F.col("level").cast("string")), start_sec=at("t_start"), end_sec=at("t_end"), label=F.coalesce("text", F.lit("summary missing")))
    present = library.presence_lanes(segs)
    # spans of text are told apart by their start on the axis, in whole milliseconds
    starts = F.round(at("t_start") * 1000)
    lane("caption", on_axis(present.filter("lane = 'caption'")), starts, start_sec=at("t_start"), end_sec=at("t_end"), label=F.col("text"))
    timed = clips.select("session_id", "t_start", "t_end", "text", F.col("clip_no").cast("long").alias("key"))
    spoken = present.filter("lane = 'transcript'").join(clips.select("session_id").distinct(), "session_id", "left_anti")
    heard = timed.unionByName(spoken.select("session_id", "t_start", "t_end", "text", F.lit(None).cast("long").alias("key")))
    lane("transcript", on_axis(heard), F.coalesce("key", starts.cast("long")), start_sec=at("t_start"), end_sec=at("t_end"), label=F.col("text"))
    # a medium of a session has an axis of its own
    both = F.struct("session_id", "media")
    peaks = features.merge_peaks(audio.select(both.alias("session_id"), "start_sec", "duration_sec", "peaks"), audio.select("session_id", "media").distinct().join(totals, "session_id").select(both.alias("session_id"), "total_sec"), buckets)
    loud = features.normalised(peaks)
    density("audio", loud.select(F.col("session_id.session_id").alias("session_id"), F.col("session_id.media").alias("media"), "bucket", "value", "peak"), F.concat(F.lit("audio-"), F.col("media")))
    density("typing", rates(samples.filter("kind = 'key_down'"), totals, buckets))
    moved = F.when(F.col("up_x").isNotNull() & F.col("x").isNotNull(), F.hypot(F.col("up_x") - F.col("x"), F.col("up_y") - F.col("y"))).otherwise(0.0)
    pressed = on_axis(segments.clicks(ev).join(ev.select("event_id", "x", "y"), "event_id")).withColumn("moved", moved)
    drag = F.concat(F.lit("drag "), F.round(F.coalesce(F.col("up_t") - F.col("t"), F.lit(0.0))).cast("long").cast("string"), F.lit("ms · "), F.round("moved").cast("long").cast("string"), F.lit("px"))
    lane("clicks", pressed, F.col("event_id"), start_sec=at("t"), label=F.when(F.col("moved") > 4, drag).otherwise("click"))
    density("scroll", rates(samples.filter("kind = 'scroll'"), totals, buckets))
    speeds = features.pointer_speeds(ev).join(axis, "session_id").select("session_id", F.greatest(F.col("sec") - F.col("origin_ms") / 1000, F.lit(0.0)).alias("sec"), "value")
    density("mouse-speed", features.normalised(features.bucket_max(speeds, totals, buckets)))
    lane("mouse-xy", pointer_lane(ev, axis, buckets, displays), F.col("bucket"), value=F.col("x"), value2=F.col("y"), peak=F.lit(1.0))
    idle = on_axis(segments.pauses(ev, dwell_ms=dwell_ms, burst_ms=burst_ms))
    lasted = F.round((F.col("t_end") - F.col("t_start")) / 1000, 6)  # to the microsecond: a difference of doubles may lie below the half
    lasting = F.concat(F.when(F.col("pause") == "dwell_gap", "idle ").otherwise("pause "), (F.round(lasted * 10) / 10).cast("decimal(24,1)").cast("string"), F.lit("s"))
    lane("idle", idle, F.round("t_end"), start_sec=at("t_start"), end_sec=at("t_end"), label=lasting)
    names = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    lane("markers", on_axis(ev.filter(F.col("kind").isin(*MARKERS))), F.col("event_id"), start_sec=at("t"), label=names[F.col("kind")])
    return reduce(DataFrame.unionByName, out)
