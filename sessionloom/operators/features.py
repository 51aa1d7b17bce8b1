"""Features of segments and lanes of sessions: behaviour vectors, digests, buckets, rates, peaks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text
from sessionloom.operators.temporal import interval_join
from sessionloom.sources.tables import ensure_checkpoint_dir

BINS = 8


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def events_in_segments(ev: DataFrame, segs: DataFrame) -> DataFrame:
    """Every (event, segment) pair, a session's last segment holding its right end."""
    last = segs.withColumn("_session_end", F.max("t_end").over(Window.partitionBy("session_id")))
    return interval_join(ev, last, closed_at="_session_end").drop("_session_end")


def behaviour(ev: DataFrame, segs: DataFrame, *, bucket_ms: float = 250.0) -> DataFrame:
    """session_id, seg_no, v: twelve shares and rates of each segment, all in 0..1, zeros where nothing happened.

    Rates of clicks, keys, scrolls and moves a second over 5, 10, 10 and 60; mean pointer speed over
    5 px/ms; evenness of eight directions; clicks among clicks and keys; share of active buckets; and
    the share of each quarter of the time.
    """
    ensure_checkpoint_dir(ev.sparkSession)
    segs = segs.select("session_id", "seg_no", "t_start", "t_end").checkpoint()  # read three times
    rows = events_in_segments(ev, segs)
    w = Window.partitionBy("session_id", "seg_no").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    move = F.col("kind") == "mouse_move"
    before = F.last(F.when(move, F.struct("t", "x", "y")), ignorenulls=True).over(w)
    rows = rows.withColumn("_b", F.when(move, before))
    dx, dy, dt = F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y"), F.col("t") - F.col("_b.t")
    far = F.sqrt(dx * dx + dy * dy)
    rel, dur = F.col("t") - F.col("t_start"), F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    rows = rows.withColumns({
        "_speed": F.when(dt > 0, far / dt),
        "_bin": F.when(far > 0, F.least(F.lit(BINS - 1), F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * BINS).cast("int"))),
        "_quarter": F.least(F.lit(3), F.greatest(F.lit(0), F.floor(rel / F.when(dur > 0, dur / 4).otherwise(1.0)).cast("int"))),
        "_bucket": F.floor(rel / bucket_ms),
    })
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("double")
    found = rows.groupBy("session_id", "seg_no").agg(
        n("mouse_down").alias("c"), n("key_down").alias("k"), n("scroll").alias("s"), n("mouse_move").alias("m"),
        F.avg("_speed").alias("speed"), F.countDistinct("_bucket").alias("active"),
        F.array(*[F.count(F.when(F.col("_bin") == i, 1)).cast("double") for i in range(BINS)]).alias("bins"),
        F.array(*[F.count(F.when(F.col("_quarter") == i, 1)).cast("double") for i in range(4)]).alias("quarters"),
    )
    every = segs.join(found, ["session_id", "seg_no"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    c, k, s, m, sec = zero("c"), zero("k"), zero("s"), zero("m"), F.greatest(dur / 1000, F.lit(1e-3))
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b)
    entropy = F.when(total > 0, F.aggregate("bins", F.lit(0.0), lambda a, b: a - F.when(b > 0, b / total * F.log2(b / total)).otherwise(0.0)) / math.log2(BINS))
    share = lambda i: F.coalesce(F.when(c + k + s + m > 0, F.col("quarters")[i] / (c + k + s + m)), F.lit(0.0))
    values = [
        c / sec / 5, k / sec / 10, s / sec / 10, m / sec / 60, F.coalesce("speed", F.lit(0.0)) / 5, F.coalesce(entropy, F.lit(0.0)),
        F.when(c + k > 0, c / (c + k)).otherwise(0.0), F.coalesce("active", F.lit(0)) / F.greatest(F.lit(1.0), F.ceil(dur / bucket_ms).cast("double")),
        *(share(i) for i in range(4)),
    ]
    return every.select("session_id", "seg_no", F.array(*[_clamp(v.cast("double")) for v in values]).alias("v"))


def _distinct_in_order(pairs: str, field: str) -> Column:
    """Distinct non-null values of an ordered array of structs, by first appearance."""
    return F.array_distinct(F.filter(F.transform(F.array_sort(pairs), lambda p: p[field]), lambda v: v.isNotNull()))


def digest(ev: DataFrame, segs: DataFrame, *, focus: DataFrame | None = None, typed: DataFrame | None = None, clicked: DataFrame | None = None, max_typed: int = 280) -> DataFrame:
    """session_id, seg_no, digest: what happened in each segment, in words.

    ``ev`` may have a title of focus changes. ``focus``: session_id, seg_no, app, url and perhaps title
    in force at a segment's start. ``typed``: session_id, seg_no, typed. ``clicked``: session_id,
    event_id, label of clicks that hit something with a name. Order: apps and titles, URLs, typed text,
    labels clicked, counts, a phrase for each app; ``idle segment`` if there is nothing to say.
    """
    keys = ["session_id", "seg_no"]
    none = F.lit(None).cast("string")
    ev = ev.withColumn("title", F.nullif("title", F.lit("")) if "title" in ev.columns else none)
    ev = ev.withColumn("label", none) if clicked is None else ev.drop("label").join(clicked.select("session_id", "event_id", "label").dropDuplicates(["session_id", "event_id"]), ["session_id", "event_id"], "left")
    rows = events_in_segments(ev, segs.select(*keys, "t_start", "t_end")).select(*keys, "t", "event_id", "kind", F.when(F.col("kind") == "focus_change", F.col("app")).alias("app"), F.when(F.col("kind").isin("focus_change", "url_change"), F.col("url")).alias("url"), F.when(F.col("kind") == "focus_change", F.col("title")).alias("title"), F.when(F.col("kind") == "mouse_down", F.col("label")).alias("label"))
    if focus is not None:
        rows = rows.unionByName(focus.select(*keys, F.lit(-1.0).alias("t"), F.lit(-1).cast("long").alias("event_id"), F.lit("inherited").alias("kind"), "app", "url", F.col("title") if "title" in focus.columns else none.alias("title"), none.alias("label")))
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    rows = rows.withColumns({"_app": F.last("app", ignorenulls=True).over(w), "_changed": F.col("app").isNotNull() & ~F.col("app").eqNullSafe(F.last("app", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))})
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    acts = rows.filter("_app is not null and kind in ('mouse_down', 'key_down', 'scroll')").groupBy(*keys, "_app").agg(F.min(F.struct("t", "event_id")).alias("first"), n("key_down").alias("k"), n("mouse_down").alias("c"), n("scroll").alias("s"))
    phrase = F.concat(F.when(F.col("k") > 0, "typed in ").when(F.col("c") > 0, "clicked in ").otherwise("scrolled in "), F.col("_app"))
    phrases = acts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", phrase.alias("p")))), lambda x: x["p"]), ", ").alias("phrases"))
    tally = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_changed"), F.struct("t", "event_id", "app")))).alias("apps"),
        F.sort_array(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("t", "event_id", "url")))).alias("urls"),
        F.collect_list(F.when(F.col("title").isNotNull(), F.struct("t", "event_id", "title"))).alias("titles"),
        F.collect_list(F.when(F.length("label") > 0, F.struct("t", "event_id", "label"))).alias("labels"),
        n("mouse_down").alias("c"), n("key_down").alias("k"), n("scroll").alias("s"), n("mouse_move").alias("m"),
    )
    every = segs.select(*keys).join(tally, keys, "left").join(phrases, keys, "left")
    every = every.join(typed.select(*keys, "typed"), keys, "left") if typed is not None else every.withColumn("typed", F.lit(None).cast("string"))
    plural = lambda c, unit: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {unit}"), F.when(F.col(c) == 1, "").otherwise("s")))
    apps = F.array_join(F.transform("apps", lambda a: a["app"]), " → ")
    titles = F.array_join(_distinct_in_order("titles", "title"), ", ")
    named = F.concat_ws(" — ", F.nullif(apps, F.lit("")), F.nullif(titles, F.lit("")))
    where = F.nullif(F.when(F.size("apps") > 1, F.concat(F.lit("app focus: "), named)).otherwise(named), F.lit(""))
    hit = F.array_join(F.transform(_distinct_in_order("labels", "label"), lambda x: F.concat(F.lit('clicked "'), x, F.lit('"'))), ", ")
    urls = F.array_distinct(F.flatten(F.transform("urls", lambda u: text.url_terms(u["url"]))))
    said = F.when(F.length("typed") > max_typed, F.concat(F.rtrim(F.substring("typed", 1, max_typed)), F.lit("…"))).otherwise(F.col("typed"))
    busy = F.concat_ws(", ", plural("c", "click"), F.when(F.col("s") > 5, "heavy scrolling").when(F.col("s") > 0, "light scrolling"), plural("k", "keystroke"))
    activity = F.when(busy != "", busy).when(F.col("m") > 0, "mouse movement")
    parts = F.concat_ws(". ", where, F.when(F.size("urls") > 0, F.array_join(urls, " ")), F.when(F.length("typed") > 0, F.concat(F.lit('typed "'), said, F.lit('"'))), F.nullif(hit, F.lit("")), activity, F.col("phrases"))
    return every.select(*keys, F.when(parts == "", "idle segment").otherwise(F.concat(parts, F.lit("."))).alias("digest"))


def bucket_index(sec: Column, total: Column, buckets: int) -> Column:
    """The bucket that an offset falls in, clamped at both ends; the first where there is no length."""
    return F.when(total > 0, F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(sec / total * buckets).cast("int")))).otherwise(F.lit(0))


def _axis(totals: DataFrame, buckets: int) -> DataFrame:
    return totals.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))


def bucket_counts(samples: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """session_id, bucket, n for every bucket of every session. ``samples``: session_id, sec; ``totals``: session_id, total_sec."""
    n = samples.join(totals, "session_id").groupBy("session_id", bucket_index(F.col("sec"), F.col("total_sec"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    return _axis(totals, buckets).join(n, ["session_id", "bucket"], "left").select("session_id", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_max(samples: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """The largest value of each bucket, nothing below 0; a flick of one sample is not averaged away."""
    m = samples.join(totals, "session_id").groupBy("session_id", bucket_index(F.col("sec"), F.col("total_sec"), buckets).alias("bucket")).agg(F.max("value").alias("v"))
    return _axis(totals, buckets).join(m, ["session_id", "bucket"], "left").select("session_id", "bucket", F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)).alias("value"))


def bucket_hold(samples: DataFrame, totals: DataFrame, buckets: int, *, seq: str = "event_id") -> DataFrame:
    """The last value of each bucket, carried forward; null before the first sample."""
    last = samples.join(totals, "session_id").groupBy("session_id", bucket_index(F.col("sec"), F.col("total_sec"), buckets).alias("bucket")).agg(F.max_by("value", F.struct("sec", seq)).alias("v"))
    w = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return _axis(totals, buckets).join(last, ["session_id", "bucket"], "left").select("session_id", "bucket", F.last("v", ignorenulls=True).over(w).alias("value"))


def smoothed_rate(counts: DataFrame, per_bucket_sec: float) -> DataFrame:
    """Counts to a rate a second over about one second around each bucket, divided by what the window covers."""
    span = max(1, int(math.floor(1 / per_bucket_sec + 0.5)))
    half = span // 2
    w = Window.partitionBy("session_id").orderBy("bucket").rowsBetween(-half, span - half - 1)
    return counts.select("session_id", "bucket", (F.sum("n").over(w) / (F.count("*").over(w) * per_bucket_sec)).alias("value"))


def normalised(lane: DataFrame) -> DataFrame:
    """value over the session's peak, nulls kept; zeros where the peak is not above 0."""
    peak = F.greatest(F.max("value").over(Window.partitionBy("session_id")), F.lit(0.0))
    return lane.select("session_id", "bucket", F.when(F.col("value").isNotNull(), F.when(peak > 0, F.col("value") / peak).otherwise(0.0)).alias("value"), peak.alias("peak"))


def merge_peaks(blobs: DataFrame, totals: DataFrame, buckets: int) -> DataFrame:
    """Peaks of audio blobs on the session's axis: each by its midpoint, the largest wins; null where nothing covers.

    ``blobs``: session_id, start_sec, duration_sec, peaks (array).
    """
    n = F.size("peaks")
    each = blobs.filter(n > 0).select("session_id", (F.col("start_sec")).alias("s"), (F.col("duration_sec") / n).alias("w"), F.posexplode("peaks").alias("i", "value"))
    samples = each.select("session_id", (F.col("s") + (F.col("i") + 0.5) * F.col("w")).alias("sec"), "value")
    m = samples.join(totals, "session_id").filter((F.col("sec") >= 0) & (F.col("sec") <= F.col("total_sec"))).groupBy("session_id", bucket_index(F.col("sec"), F.col("total_sec"), buckets).alias("bucket")).agg(F.max("value").alias("value"))
    return _axis(totals, buckets).join(m, ["session_id", "bucket"], "left").select("session_id", "bucket", "value")


def sample_peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """Largest |sample| / 32768 by bucket of each blob. ``samples``: blob_id, i, sample."""
    n = F.count("*").over(Window.partitionBy("blob_id"))
    at = F.least(F.lit(buckets - 1), F.floor(F.col("i") * buckets / n).cast("int"))
    return samples.withColumn("bucket", at).groupBy("blob_id", "bucket").agg((F.max(F.abs("sample")) / 32768.0).alias("peak"))


def pointer_speeds(ev: DataFrame) -> DataFrame:
    """session_id, sec, value: pixels a second between consecutive moves."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    moves = ev.filter("kind = 'mouse_move' and x is not null and y is not null")
    d = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    dt = (F.col("t") - F.lag("t").over(w)) / 1000
    return moves.select("session_id", "event_id", (F.col("t") / 1000).alias("sec"), F.when(dt > 0, d / dt).alias("value")).filter("value is not null")


def lane_axis(sessions: DataFrame, video: DataFrame) -> DataFrame:
    """session_id, origin_ms, total_sec: where a lane's axis starts and how long it is (video first, else the session)."""
    span = video.groupBy("session_id").agg(F.min("t_start").alias("v0"), F.max("t_end").alias("v1"))
    joined = sessions.join(span, "session_id", "left")
    return joined.select("session_id", F.coalesce("v0", F.lit(0.0)).alias("origin_ms"), (F.coalesce(F.col("v1") - F.col("v0"), F.col("duration_ms")) / 1000).alias("total_sec"))


def marks(ev: DataFrame, kinds: dict[str, str], axis: DataFrame) -> DataFrame:
    """session_id, lane, sec, label of instants; URLs by their place where they have one."""
    lane = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    rows = ev.filter(F.col("kind").isin(*kinds)).join(axis, "session_id")
    return rows.select("session_id", lane[F.col("kind")].alias("lane"), "event_id", F.greatest((F.col("t") - F.col("origin_ms")) / 1000, F.lit(0.0)).alias("sec"), F.coalesce(text.url_prefix(F.col("url")), F.col("url"), F.col("app")).alias("label"))


def all_lanes(lanes: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all lanes with ``lane`` and its place in the given order."""
    tagged = [df.withColumns({"lane": F.lit(name), "lane_no": F.lit(i)}) for i, (name, df) in enumerate(lanes)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def assemble_transcript(pieces: DataFrame) -> DataFrame:
    """session_id, seg_no, transcript: overlapping pieces in order of time, blanks left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("t_start", "piece_no", F.trim("text").alias("x")))))
    return pieces.groupBy("session_id", "seg_no").agg(F.array_join(F.transform(ordered, lambda p: p["x"]), " ").alias("transcript"))


def searchable_text(df: DataFrame, parts: list[str]) -> DataFrame:
    """``text`` of all parts that are not blank, one a line."""
    kept = [F.when(F.trim(p) != "", F.trim(p)) for p in parts]
    return df.withColumn("text", F.concat_ws("\n", *kept))


def shares(df: DataFrame, group: str, value: str, least: float = 0.0) -> DataFrame:
    """Each name's share of its group's total; those below ``least`` fold into ``other``."""
    total = F.sum(value).over(Window.partitionBy(group))
    rows = df.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(0.0))
    return rows.groupBy(group, F.when(F.col("share") < least, "other").otherwise(F.col("name")).alias("name")).agg(F.sum("share").alias("share"))


def tallies(ev: DataFrame, frames: DataFrame | None = None, chunks: DataFrame | None = None, walks: DataFrame | None = None) -> DataFrame:
    """session_id and counts of keys, clicks and focus changes, with the latest app; and of keyframes, audio chunks and
    walks of the element tree (each with session_id) where these are given."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = ev.groupBy("session_id").agg(n("key_down").alias("keys"), n("mouse_down").alias("clicks"), n("focus_change").alias("focus_changes"), F.max_by("app", F.when(F.col("app").isNotNull(), F.struct("t", "event_id"))).alias("latest_app"))
    for name, rows in (("keyframes", frames), ("chunks", chunks), ("walks", walks)):
        if rows is not None:
            # a session may have these and no event
            out = out.join(rows.groupBy("session_id").agg(F.count("*").alias(name)), "session_id", "full_outer").fillna(0)
    return out


# Fixed values of the path fit: points of the velocity profile, the residual that is small enough, how often a span is halved.
VELOCITY_POINTS, FIT_TOLERANCE, FIT_DEPTH = 16, 0.01, 4


def path_features(points: DataFrame) -> DataFrame:
    """Per drag: chord, length, straightness and the sums of the least-squares cubic in arc length.

    ``points``: drag_id, i, x, y, t. ``u`` is the share of the path's length reached at a point. In the
    frame in which the drag leads from (0, 0) to (1, 0), the ends weigh (1 - u)^3 and u^3, and the two
    control points in between solve [s11 s12; s12 s22] c = (r1, r2) for x and for y; ``c1x`` to ``c2y``
    are that solution, or the straight line where there is none.
    """
    w = Window.partitionBy("drag_id").orderBy("i")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    drag = Window.partitionBy("drag_id")
    rows = points.withColumns({"step": step, "_a": F.min_by(F.struct("x", "y"), "i").over(drag), "_z": F.max_by(F.struct("x", "y"), "i").over(drag), "_n": F.count("*").over(drag), "_k": F.row_number().over(w)})
    rows = rows.withColumns({"s": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "length": F.sum("step").over(drag), "chord": F.hypot(F.col("_z.x") - F.col("_a.x"), F.col("_z.y") - F.col("_a.y"))})
    ox, oy, cx, cy = F.col("x") - F.col("_a.x"), F.col("y") - F.col("_a.y"), F.col("_z.x") - F.col("_a.x"), F.col("_z.y") - F.col("_a.y")
    along, across = F.when(F.col("chord") > 1e-6, (ox * cx + oy * cy) / F.pow("chord", 2)), F.when(F.col("chord") > 1e-6, (oy * cx - ox * cy) / F.pow("chord", 2))
    rows = rows.withColumns({"u": F.when(F.col("length") > 0, F.col("s") / F.col("length")).otherwise(0.0), "along": along, "across": across})
    u, inner = F.col("u"), (F.col("_k") > 1) & (F.col("_k") < F.col("_n"))
    b1, b2 = 3 * F.pow(1 - u, 2) * u, 3 * (1 - u) * F.pow(u, 2)
    total = lambda v: F.coalesce(F.sum(F.when(inner, v)), F.lit(0.0))
    rx, ry = F.col("along") - F.pow(u, 3), F.col("across")
    ends = rows.groupBy("drag_id").agg(
        F.max("chord").alias("chord"), F.max("length").alias("length"), F.count("*").alias("n"), (F.max_by("t", "i") - F.min_by("t", "i")).alias("duration"),
        total(b1 * b1).alias("s11"), total(b1 * b2).alias("s12"), total(b2 * b2).alias("s22"),
        total(b1 * rx).alias("r1x"), total(b2 * rx).alias("r2x"), total(b1 * ry).alias("r1y"), total(b2 * ry).alias("r2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    solved = lambda r1, r2, straight: F.when(F.abs(det) < 1e-12, straight).otherwise(((F.col("s22") * F.col(f"r1{r1}") - F.col("s12") * F.col(f"r2{r1}")) if r2 == 1 else (F.col("s11") * F.col(f"r2{r1}") - F.col("s12") * F.col(f"r1{r1}"))) / det)
    return ends.select(
        "drag_id", "n", "duration", "length", "chord", F.when(F.col("length") > 0, F.col("chord") / F.col("length")).otherwise(1.0).alias("straightness"), "s11", "s12", "s22",
        solved("x", 1, 1 / 3).alias("c1x"), solved("y", 1, 0.0).alias("c1y"), solved("x", 2, 2 / 3).alias("c2x"), solved("y", 2, 0.0).alias("c2y"),
    )


def _cubic(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points at ``t`` of the cubic with the four control points ``p``."""
    t = t[:, None]
    return (1 - t) ** 3 * p[0] + 3 * t * (1 - t) ** 2 * p[1] + 3 * t**2 * (1 - t) * p[2] + t**3 * p[3]


def _fit(points: np.ndarray, u: np.ndarray, depth: int) -> list[np.ndarray]:
    """Cubics through the first and the last of ``points``, halved by index until all points lie near."""
    a, z = points[0], points[-1]
    t = u[1:-1, None]
    basis = np.hstack([3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t)])
    rest = points[1:-1] - (1 - t) ** 3 * a - t**3 * z
    normal = basis.T @ basis
    control = np.linalg.solve(normal, basis.T @ rest) if abs(np.linalg.det(normal)) >= 1e-12 else np.stack([a + (z - a) / 3, a + 2 * (z - a) / 3])
    own = np.stack([a, *control, z])
    off = np.linalg.norm(_cubic(u[1:-1], own) - points[1:-1], axis=1).max(initial=0.0)
    if off <= FIT_TOLERANCE or depth == 0 or len(points) < 4:
        return [own]
    half = len(points) // 2
    again = lambda v: (v - v[0]) / (v[-1] - v[0]) if v[-1] > v[0] else np.linspace(0, 1, len(v))
    return _fit(points[: half + 1], again(u[: half + 1]), depth - 1) + _fit(points[half:], again(u[half:]), depth - 1)


def path_curve(xy: np.ndarray, t: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, float]:
    """Cubics in the frame of the chord, duration, progress at 16 even times, and confidence of one drag."""
    straight = [np.array([[0, 0], [1 / 3, 0], [2 / 3, 0], [1, 0]])]
    lasted = float(t[-1] - t[0]) if len(t) > 1 else 0.0
    chord = xy[-1] - xy[0]
    size = float(np.hypot(*chord))
    if len(xy) < 2 or size < 1e-6:
        return straight, lasted, np.linspace(0, 1, VELOCITY_POINTS), 0.0
    unit = (xy - xy[0]) @ np.array([[chord[0], -chord[1]], [chord[1], chord[0]]]) / size**2
    reached = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(unit, axis=0).T))])
    u = reached / reached[-1]
    unit[0], unit[-1] = (0, 0), (1, 0)
    curve = _fit(unit, u, FIT_DEPTH)
    # the chain at u: spans in proportion to their chords
    spans = np.array([np.hypot(*(c[3] - c[0])) for c in curve])
    ends = np.cumsum(spans)
    at = np.searchsorted(ends, u[1:-1] * ends[-1]).clip(0, len(curve) - 1)
    local = np.where(spans[at] > 0, (u[1:-1] * ends[-1] - ends[at] + spans[at]) / np.where(spans[at] > 0, spans[at], 1), 0).clip(0, 1)
    near = np.array([_cubic(local[i : i + 1], curve[c])[0] for i, c in enumerate(at)]).reshape(-1, 2)
    rms = float(np.sqrt(((near - unit[1:-1]) ** 2).sum() / max(1, len(unit) - 2)))
    confidence = round(min(1.0, (len(unit) - 1) / 8) / (1 + 10 * rms), 6)
    times = t[0] + lasted * np.arange(VELOCITY_POINTS) / (VELOCITY_POINTS - 1)
    right = np.searchsorted(t, times).clip(1, len(t) - 1)
    gap = t[right] - t[right - 1]
    share = np.where(gap > 0, (times - t[right - 1]) / np.where(gap > 0, gap, 1), 0)
    velocity = (u[right - 1] + share * (u[right] - u[right - 1])).round(6).clip(0, 1)
    velocity[0], velocity[-1] = 0, 1
    return curve, lasted, velocity, confidence


def paths(points: DataFrame) -> DataFrame:
    """drag_id, duration, confidence, velocity (16 shares) and curve (control points of each cubic) of every drag.

    ``points``: drag_id, i, x, y, t. A drag is one group: what one press of a button holds.
    """
    kind = points.schema["drag_id"].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        curve, lasted, velocity, confidence = path_curve(frame[["x", "y"]].to_numpy(float), frame["t"].to_numpy(float))
        cubics = [dict(zip(("c1x", "c1y", "c2x", "c2y", "ex", "ey"), c[1:].reshape(-1).tolist(), strict=True)) for c in curve]
        return pd.DataFrame({"drag_id": frame["drag_id"].iloc[:1], "duration": [lasted], "confidence": [confidence], "velocity": [velocity.tolist()], "curve": [cubics]})

    cubic = ",".join(f"{c}:double" for c in ("c1x", "c1y", "c2x", "c2y", "ex", "ey"))
    return points.select("drag_id", "i", "x", "y", "t").groupBy("drag_id").applyInPandas(fit, f"drag_id {kind}, duration double, confidence double, velocity array<double>, curve array<struct<{cubic}>>")
