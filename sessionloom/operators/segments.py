"""Cutting sessions: boundaries, segments, windows, typed runs, gestures, pauses and app spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import slices, temporal
from sessionloom.sources.tables import ensure_checkpoint_dir

#: Which reason stands where several fall on one instant (fixed values).
PRIORITY = {"session_start": 101, "session_end": 100, "bookmark": 30, "focus_change": 20, "scene_change": 15, "dwell_gap": 10, "burst_gap": 5, "window": 0}
#: Input that means that somebody did something (fixed values).
MEANINGFUL = ("mouse_down", "key_down", "scroll")
CUTS = ("scene_change", "focus_change", "bookmark")
DWELL_MS, BURST_MS = 3000.0, 1500.0


def session_ends(ev: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """session_id, t_end: the last event, or the session's wall duration where that is later."""
    ends = ev.groupBy("session_id").agg(F.max("t").alias("t_end"))
    if sessions is None:
        return ends
    wall = sessions.select("session_id", (F.col("ended_at") - F.col("started_at")).cast("double").alias("_wall"))
    both = wall.join(ends, "session_id", "full_outer")
    return both.select("session_id", F.coalesce(F.greatest("t_end", "_wall"), F.lit(0.0)).alias("t_end"))


def boundaries(ev: DataFrame, ends: DataFrame, scenes: DataFrame | None = None, *, dwell_ms: float = DWELL_MS, burst_ms: float = BURST_MS, slice: float | None = None) -> DataFrame:
    """session_id, t, reason: one reason an instant, within [0, t_end], or [t_start, t_end] where ``ends`` has both.

    Gaps count where they exceed their threshold; a dwell gap is measured between any two events, a
    burst gap between meaningful ones.
    """
    useful = F.col("kind").isin(*MEANINGFUL)
    rows = slices.carried(ev, {"_before": F.col("t"), "_useful": F.when(useful, F.col("t"))}, ["event_id"], session="session_id", t="t", slice=slice, own=False)
    gaps = rows.withColumns({"_any": F.col("t") - F.col("_before"), "_burst": F.when(useful, F.col("t") - F.col("_useful"))})
    start = F.col("t_start") if "t_start" in ends.columns else F.lit(0.0)
    # all reasons of a row at once, so that the plan holds the events' folds once
    reasons = [F.when(F.col("_any") > dwell_ms, "dwell_gap"), F.when(F.col("_burst") > burst_ms, "burst_gap"), F.when(F.col("kind").isin("focus_change", "bookmark"), F.col("kind"))]
    both = F.array(F.struct(start.alias("t"), F.lit("session_start").alias("reason")), F.struct(F.col("t_end").alias("t"), F.lit("session_end").alias("reason")))
    found = [
        ends.select("session_id", F.inline(both)),
        gaps.select("session_id", "t", F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason")),
    ]
    if scenes is not None:
        found.append(scenes.select("session_id", "t", F.lit("scene_change").alias("reason")))
    every = reduce(DataFrame.unionByName, found).join(ends, "session_id").filter((F.col("t") >= start) & (F.col("t") <= F.col("t_end")))
    weight = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return every.groupBy("session_id", "t").agg(F.max_by("reason", weight[F.col("reason")]).alias("reason"))


def segments(bounds: DataFrame, cuts: tuple[str, ...] = CUTS, *, slice: float | None = None) -> DataFrame:
    """session_id, seg_no, t_start, t_end, reason: one segment from each kept boundary to the next."""
    kept = bounds.filter(F.col("reason").isin("session_start", "session_end", *cuts))
    if slice is not None:  # each of the two folds by slices reads its rows twice
        ensure_checkpoint_dir(bounds.sparkSession)
        kept = kept.checkpoint()
    spans = slices.carried(kept, {"t_end": F.col("t")}, [], session="session_id", t="t", slice=slice, own=False, ahead=True)
    spans = spans.select("session_id", F.col("t").alias("t_start"), "t_end", "reason").filter("t_end is not null")
    return slices.numbered(spans, "seg_no", [], session="session_id", t="t_start", slice=slice)


def subdivide(spans: DataFrame, target: float, stride: float) -> DataFrame:
    """Windows of ``target`` every ``stride`` within each span, none past the one that reaches its end."""
    if stride > target:
        raise ValueError("stride must not exceed target")
    length = F.col("t_end") - F.col("t_start")
    n = F.greatest(F.lit(1.0), F.ceil((length - target) / stride) + 1).cast("int")
    w = spans.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("_start", F.col("t_start") + F.col("_i") * stride)
    w = w.filter(F.col("_start") < F.col("t_end"))
    reason = F.when(F.col("_i") == 0, F.col("reason")).otherwise("window") if "reason" in spans.columns else F.lit("window")
    return w.withColumns({"t_end": F.least(F.col("_start") + target, F.col("t_end")), "reason": reason, "window_no": F.col("_i")}).withColumn("t_start", F.col("_start")).drop("_i", "_start")


def sliding_windows(ends: DataFrame, target: float, stride: float) -> DataFrame:
    """Windows over whole sessions, whatever their boundaries."""
    return subdivide(ends.select("session_id", F.lit(0.0).alias("t_start"), "t_end").filter("t_end > 0"), target, stride)


def typed_runs(keys: DataFrame, *, gap_ms: float = DWELL_MS) -> DataFrame:
    """session_id, run_no, text, t_start, t_end of typed text.

    ``keys``: session_id, t, event_id, kind, char, chord, backspace. A focus change, a chord or a gap
    ends a run; a backspace takes the last character away, and only then moves the run's end. White
    space collapses and blank runs go. Focus changes and chords cut a session into parts by a running
    sum; within a part the exact gap rule is a fold.
    """
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    cut = (F.col("kind") == "focus_change") | ((F.col("kind") == "key_down") & F.coalesce("chord", F.lit(False)))
    parts = keys.withColumn("_part", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("kind") == "key_down") & ~F.coalesce("chord", F.lit(False)))
    typed = parts.filter(F.col("backspace") | (F.length(F.coalesce("char", F.lit(""))) > 0))
    kind = keys.schema["session_id"].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, done, at = None, [], None  # session, text, start and end of the run that goes on
        for frame in frames:
            for session, t, part, char, back in zip(*(frame[c].tolist() for c in ("session_id", "t", "_part", "char", "backspace")), strict=True):
                if (session, part) != at or (open_ and not back and t - open_[3] > gap_ms):
                    done += [open_] if open_ else []
                    open_, at = None, (session, part)
                if back:
                    if open_ and open_[1]:
                        open_[1], open_[3] = open_[1][:-1], t
                elif open_:
                    open_[1], open_[3] = open_[1] + char, t
                else:
                    open_ = [session, char, t, t]
            yield pd.DataFrame(done, columns=["session_id", "text", "t0", "t1"])
            done = []
        if open_:
            yield pd.DataFrame([open_], columns=["session_id", "text", "t0", "t1"])

    held = typed.select("session_id", "_part", F.col("t").cast("double").alias("t"), "event_id", F.coalesce("char", F.lit("")).alias("char"), F.coalesce("backspace", F.lit(False)).alias("backspace"))
    dealt = held.repartition("session_id").sortWithinPartitions("session_id", "_part", "t", "event_id")
    runs = dealt.mapInPandas(fold, f"session_id {kind}, text string, t0 double, t1 double").select("session_id", F.struct("text", "t0", "t1").alias("r"))
    text = F.trim(F.regexp_replace("r.text", r"\s+", " "))
    out = runs.select("session_id", text.alias("text"), F.col("r.t0").alias("t_start"), F.col("r.t1").alias("t_end")).filter("text <> ''")
    return out.withColumn("run_no", F.row_number().over(Window.partitionBy("session_id").orderBy("t_start")))


def pauses(ev: DataFrame, *, dwell_ms: float = DWELL_MS, burst_ms: float = BURST_MS, slice: float | None = None) -> DataFrame:
    """session_id, t_start, t_end, pause: dwell gaps, else burst gaps, each ending at the event that ends it."""
    useful = F.col("kind").isin(*MEANINGFUL)
    rows = slices.carried(ev, {"_b": F.col("t"), "_m": F.when(useful, F.col("t"))}, ["event_id"], session="session_id", t="t", slice=slice, own=False)
    pause = F.when(F.col("t") - F.col("_b") > dwell_ms, "dwell_gap").when(useful & (F.col("t") - F.col("_m") > burst_ms), "burst_gap")
    start = F.when(F.col("t") - F.col("_b") > dwell_ms, F.col("_b")).otherwise(F.col("_m"))
    return rows.select("session_id", start.alias("t_start"), F.col("t").alias("t_end"), pause.alias("pause")).filter("pause is not null")


def boundary_triggers(ev: DataFrame, *, settle_ms: float = 250.0, dwell_ms: float = 3000.0, slice: float | None = None) -> DataFrame:
    """session_id, event_id, t, reason of the moments that ask for a snapshot.

    A focus change, a bookmark, or input at least ``dwell_ms`` after the input before it; what follows
    one of them within ``settle_ms`` folds into it.
    """
    useful = F.col("kind").isin(*MEANINGFUL)
    rows = slices.carried(ev, {"_useful": F.when(useful, F.col("t"))}, ["event_id"], session="session_id", t="t", slice=slice, own=False)
    reason = F.when(F.col("kind").isin("focus_change", "bookmark"), F.col("kind")).when(useful & (F.col("t") - F.col("_useful") >= dwell_ms), "dwell_resume")
    asked = rows.withColumn("reason", reason).drop("_useful").filter("reason is not null")
    return temporal.min_gap(asked, F.lit(settle_ms), slice=slice).select("session_id", "event_id", "t", "reason")


def app_spans(ev: DataFrame, ends: DataFrame) -> DataFrame:
    """session_id, app, t_start, t_end from each focus change to the next, the last to the session's end; empty ones go."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id")
    focus = ev.filter("kind = 'focus_change'").select("session_id", "app", F.col("t").alias("t_start"), F.lead("t").over(w).alias("_next"))
    return focus.join(ends, "session_id").select("session_id", "app", "t_start", F.coalesce("_next", "t_end").alias("t_end")).filter("t_end > t_start")


def clicks(ev: DataFrame, *, drag_px: float = 4.0) -> DataFrame:
    """Each mouse_down with the first mouse_up at or after it: event_id, t, up_t, gesture (click or drag), up_x, up_y."""
    w = Window.partitionBy("session_id").orderBy("t", "event_id").rowsBetween(0, Window.unboundedFollowing)
    up = F.first(F.when(F.col("kind") == "mouse_up", F.struct("t", "x", "y")), ignorenulls=True).over(w)
    downs = ev.withColumn("_up", up).filter("kind = 'mouse_down'")
    moved = F.hypot(F.col("_up.x") - F.col("x"), F.col("_up.y") - F.col("y"))
    return downs.select("session_id", "event_id", "t", F.col("_up.t").alias("up_t"), F.when(moved > drag_px, "drag").otherwise("click").alias("gesture"), F.col("_up.x").alias("up_x"), F.col("_up.y").alias("up_y"))


# Limits of what makes one gesture.
GESTURES = {"multi_click_ms": 400.0, "multi_click_px": 6.0, "drag_px": 4.0, "hover_ms": 800.0, "scroll_gap_ms": 250.0, "idle_ms": 1500.0}
_POINTER = ("mouse_down", "mouse_up", "mouse_move")
_KEYS = ("key_down", "key_up")


def _apart(a, b) -> float:
    return ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5


def _presses(rows: list, drag_px: float) -> Iterator[tuple]:
    """Clicks, drags and buttons without their other half, each with the place of the event that ends it."""
    held, moves = None, []
    for i, e in enumerate(rows):
        if e.kind == "mouse_down":
            if held is not None:
                yield i, {"gesture": "warning", "t_start": held.t, "detail": "press without release"}
            held, moves = e, []
        elif e.kind == "mouse_move" and held is not None:
            moves.append(e)
        elif e.kind == "mouse_up" and held is None:
            yield i, {"gesture": "warning", "t_start": e.t, "detail": "release without press"}
        elif e.kind == "mouse_up":
            found = {"gesture": "click", "t_start": held.t, "t_end": e.t, "x": held.x, "y": held.y, "button": held.button}
            if _apart(held, e) > drag_px:
                found |= {"gesture": "drag", "to_x": e.x, "to_y": e.y, "path": [{"x": p.x, "y": p.y, "t": p.t} for p in (held, *moves, e)]}
            yield i, found
            held = None
    if held is not None:
        yield len(rows), {"gesture": "warning", "t_start": held.t, "detail": "press without release"}


def _hovers(rows: list, still_px: float, least_ms: float) -> Iterator[tuple]:
    """The pointer's last stay before a press, a scroll or anything that is neither pointer nor key.

    A stay begins at the first free move and anew at each move that leaves its beginning; it lasts to
    the last move, so a pause in which nothing moves is none.
    """
    pressed, start, last = False, None, None
    for i, e in enumerate([*rows, None]):
        if e is None or e.kind == "mouse_down" or e.kind not in (*_POINTER, *_KEYS):
            if start is not None and last.t - start.t >= least_ms:
                yield i, {"gesture": "hover", "t_start": start.t, "t_end": last.t, "x": start.x, "y": start.y}
            start = last = None
        elif e.kind == "mouse_move" and not pressed:
            start, last = e if start is None or _apart(start, e) > still_px else start, e
        if e is not None and e.kind in ("mouse_down", "mouse_up"):
            pressed = e.kind == "mouse_down"


def _scrolls(rows: list, gap_ms: float) -> Iterator[tuple]:
    """Runs of scrolls with nothing else and no long gap between them."""
    for i, e in enumerate(rows):
        if e.kind != "scroll":
            continue
        if i and rows[i - 1].kind == "scroll" and e.t - rows[i - 1].t <= gap_ms:
            run |= {"t_end": e.t, "n": run["n"] + 1, "dx": run["dx"] + e.dx, "dy": run["dy"] + e.dy}
        else:
            run = {"gesture": "scroll", "t_start": e.t, "t_end": e.t, "n": 1, "x": e.x, "y": e.y, "dx": e.dx, "dy": e.dy}
        ends = i + 1 == len(rows) or rows[i + 1].kind != "scroll" or rows[i + 1].t - e.t > gap_ms
        if ends:
            yield i + 1, run


def _typing(rows: list) -> Iterator[tuple]:
    """Text between which only keys come, chords, and keys without a character; a release prolongs what it ends."""
    run = None
    for i, e in enumerate([*rows, None]):
        chord = e is not None and e.kind == "key_down" and bool(e.chord)
        if run and (chord or e is None or e.kind not in _KEYS):
            yield i, run | {"n": len(run["detail"])}
            run = None
        if e is None or e.kind not in _KEYS:
            continue
        if chord:
            yield i, {"gesture": "chord", "t_start": e.t, "t_end": e.t, "detail": e.chord}
        elif e.kind == "key_up" and run:
            run["t_end"] = e.t
        elif e.kind == "key_up":
            yield i, {"gesture": "release", "t_start": e.t}
        elif not e.char:
            yield i, {"gesture": "warning", "t_start": e.t, "detail": "key without a character"}
        else:
            run = run or {"gesture": "text", "t_start": e.t, "detail": ""}
            run |= {"t_end": e.t, "detail": run["detail"] + e.char}


def gestures(ev: DataFrame, options: dict[str, float] | None = None) -> DataFrame:
    """session_id, gesture_no, gesture, t_start, t_end, n, detail, x, y, to_x, to_y, button, dx, dy, path.

    ``ev``: session_id, t, event_id, kind, x, y, char, chord (null where the kind has none), and if
    there are any button, dx, dy. Clicks of one button that follow within 400 ms and 6 px of the first
    are one; a press that ends over 4 px away is a drag, with its ``path``; a pointer that moves within
    6 px for 800 ms hovers; scrolls within 250 ms are one run and add up; keys make text, chords stand
    alone. A press or release without the other, and a key without a character, warn. From one gesture
    to the next 1500 ms or more are idle. Each rule runs over a session's rows in order, so a session
    is one group: what one person does in one recording.
    """
    o = GESTURES | (options or {})
    extra = {c: F.col(c) if c in ev.columns else F.lit(v) for c, v in (("button", 1), ("dx", 0.0), ("dy", 0.0))}
    columns = ["gesture_no", "gesture", "t_start", "t_end", "n", "detail", "x", "y", "to_x", "to_y", "button", "dx", "dy", "path"]

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "event_id"])
        frame[["x", "y"]] = frame[["x", "y"]].fillna(0.0)
        rows = list(frame.itertuples(index=False))
        found = [*_scrolls(rows, o["scroll_gap_ms"]), *_typing(rows), *_hovers(rows, o["multi_click_px"], o["hover_ms"]), *_presses(rows, o["drag_px"])]
        order = ("scroll", "text", "hover")  # what an event ends comes before what it is
        found.sort(key=lambda f: (f[0], order.index(f[1]["gesture"]) if f[1]["gesture"] in order else 3))
        told: list[dict] = []
        last: dict | None = None
        for _, g in found:
            if g["gesture"] == "release":
                if last and last["gesture"] == "chord":
                    last["t_end"] = g["t_start"]
                continue
            if g["gesture"] == "warning":
                told.append(g | {"t_end": g["t_start"], "n": 1})
                continue
            if last and g["gesture"] == last["gesture"] == "click" and g["button"] == last["button"] and g["t_start"] - last["t_end"] <= o["multi_click_ms"]:
                if ((g["x"] - last["x"]) ** 2 + (g["y"] - last["y"]) ** 2) ** 0.5 <= o["multi_click_px"]:
                    last |= {"t_end": g["t_end"], "n": last["n"] + 1}
                    continue
            last = {"n": 1} | g
            told.append(last)
        out, before = [], None
        for g in told:
            if g["gesture"] != "warning":
                if before is not None and g["t_start"] - before >= o["idle_ms"]:
                    out.append({"gesture": "idle", "t_start": before, "t_end": g["t_start"], "n": 1})
                before = g["t_end"]
            out.append(g)
        result = pd.DataFrame([g | {"gesture_no": i} for i, g in enumerate(out, 1)], columns=columns)
        result["button"] = result["button"].astype("Int32")
        result.insert(0, "session_id", frame["session_id"].iloc[0])
        for c in ("gesture", "detail", "path"):  # as plain objects, whatever type pandas takes them for
            result[c] = result[c].astype(object).where(result[c].notna(), None)
        return result

    kind = ev.schema["session_id"].dataType.simpleString()
    rows = ev.select("session_id", F.col("t").cast("double").alias("t"), "event_id", "kind", "x", "y", "char", "chord", extra["button"].cast("int").alias("button"), *[F.coalesce(extra[c].cast("double"), F.lit(0.0)).alias(c) for c in ("dx", "dy")])
    return rows.groupBy("session_id").applyInPandas(fold, f"session_id {kind}, gesture_no int, gesture string, t_start double, t_end double, n int, detail string, x double, y double, to_x double, to_y double, button int, dx double, dy double, path array<struct<x:double,y:double,t:double>>")
