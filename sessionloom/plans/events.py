"""Queries over the event table: filters, joins along time, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text
from sessionloom.operators import segments, temporal
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx


def _segments(ev):
    ends = segments.session_ends(ev)
    return segments.segments(segments.boundaries(ev, ends, dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS, slice=fx.SLICE_MS), slice=fx.SLICE_MS), ends


def _with_end(segs):
    return segs.withColumn("session_end", F.max("t_end").over(Window.partitionBy("session_id")))


@query("s1_scan_session", f"WITH {fx.EV} SELECT event_id, session_id, us, kind FROM ev WHERE session_id = 7")
def scan(spark, d):
    return fx.events(spark, d).filter("session_id = 7").select("event_id", "session_id", "us", "kind")


@query("f1_merge_timelines", f"""WITH {fx.EV}, s AS (SELECT session_id, us, 0 AS stream, event_id AS seq FROM ev WHERE kind <> 'scroll' UNION ALL SELECT session_id, us, 1, event_id FROM ev WHERE event_id % 5 = 0)
SELECT session_id, us, stream, seq, row_number() OVER (PARTITION BY session_id ORDER BY us, stream, seq)::INTEGER AS place FROM s""")
def merge(spark, d):
    ev = fx.events(spark, d)
    a = ev.filter("kind <> 'scroll'").select("session_id", "us", F.col("event_id").alias("seq"))
    b = fx.frames(ev).select("session_id", "us", F.col("frame_id").alias("seq"))
    return temporal.merge_timelines([a, b], t="us")


@query("f2_monotonic", f"""WITH {fx.EV}, l AS (SELECT session_id, coalesce(t < lag(t) OVER (PARTITION BY session_id ORDER BY event_id), false) AS b FROM ev)
SELECT session_id, NOT bool_or(b) AS monotonic, count(*) FILTER (WHERE b) AS n_backward FROM l GROUP BY session_id""")
def monotonic(spark, d):
    return temporal.monotonic(fx.events(spark, d), seq="event_id")


@query("f3_clock_alignment", f"""WITH {fx.EV}, c AS (SELECT DISTINCT session_id, session_id * 1000.0::DOUBLE AS o FROM ev WHERE session_id % 3 <> 0)
SELECT event_id, round(us / 1000.0::DOUBLE + o, 6) AS t, o IS NOT NULL AS calibrated FROM ev LEFT JOIN c USING (session_id)""")
def clocks(spark, d):
    ev = fx.events(spark, d)
    known = ev.filter("session_id % 3 <> 0").select("session_id").distinct().select("session_id", F.lit(0.0).alias("device_epoch_ms"), (F.col("session_id") * 1000.0).alias("mono_epoch_ms"))
    return temporal.align_clocks(ev.select("event_id", "session_id", F.col("t").alias("device_ms")), known).select("event_id", F.round("t", 6).alias("t"), "calibrated")


@query("f4_last_n", f"WITH {fx.EV} SELECT event_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, event_id DESC) AS n FROM ev) WHERE n <= 8")
def last_n(spark, d):
    return temporal.last_n(fx.events(spark, d), 8, order=["us", "event_id"]).select("event_id", "session_id")


def _greedy(source: str, gap: str) -> str:
    return f"""WITH RECURSIVE {fx.EV}, src AS ({source}), o AS (SELECT *, {gap} AS gap, row_number() OVER (PARTITION BY session_id ORDER BY t, event_id) AS n FROM src),
f AS (SELECT session_id, n, event_id, t AS last, true AS keep FROM o WHERE n = 1
  UNION ALL SELECT o.session_id, o.n, o.event_id, CASE WHEN o.t - f.last >= o.gap OR o.t < f.last THEN o.t ELSE f.last END, o.t - f.last >= o.gap OR o.t < f.last FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT event_id, session_id FROM f WHERE keep"""


@query("f5_throttle", _greedy("SELECT * FROM ev WHERE kind IN ('mouse_move', 'scroll')", "CASE WHEN k % 3 = 0 THEN 12.0 ELSE 86400000.0 END"))
def throttle(spark, d):
    """Moves with a button down (here: k divides by three) pass the short gap, others the long one."""
    moves = fx.events(spark, d).filter("kind in ('mouse_move', 'scroll')")
    return temporal.min_gap(moves, F.when(F.col("k") % 3 == 0, F.lit(12.0)).otherwise(F.lit(86400000.0)), slice=fx.SLICE_MS).select("event_id", "session_id")


@query("f6_keyframe_budget", _greedy("SELECT * FROM ev WHERE event_id % 5 = 0", "172800000.0"))
def keyframes(spark, d):
    frames = fx.frames(fx.events(spark, d)).withColumnRenamed("frame_id", "event_id")
    return temporal.min_gap(frames, F.lit(172800000.0), slice=fx.SLICE_MS).select("event_id", "session_id")


@query("f7_even_sample", f"""WITH {fx.EV}, o AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) - 1 AS a, count(*) OVER (PARTITION BY session_id) AS n FROM ev),
w AS (SELECT DISTINCT session_id, n, (i * (n - 1)) // 6 AS a FROM (SELECT DISTINCT session_id, n FROM o), range(7) r(i))
SELECT o.event_id, o.session_id FROM o WHERE n <= 7 OR EXISTS (SELECT 1 FROM w WHERE w.session_id = o.session_id AND w.a = o.a)""")
def even(spark, d):
    return temporal.sample_evenly(fx.events(spark, d), 7, order=["us", "event_id"]).select("event_id", "session_id")


_EXCLUDE = f"""{fx.EV}, f AS (SELECT *, CASE WHEN kind = 'focus_change' THEN coalesce(app IN ('app1', 'app4'), false) END AS hit FROM ev),
m AS (SELECT *, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), first_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s FROM f)"""


@query("f8_exclude_apps", f"WITH {_EXCLUDE} SELECT event_id, session_id FROM m WHERE NOT coalesce(s, false)")
def exclude(spark, d):
    return temporal.exclude_focused(fx.events(spark, d), ["App1 ", "app4"], slice=fx.SLICE_MS).filter("not excluded").select("event_id", "session_id")


@query("f8_exclusion_report", f"""WITH {_EXCLUDE} SELECT session_id, count(*) FILTER (WHERE NOT coalesce(s, false)) AS kept, count(*) FILTER (WHERE s) AS dropped,
  coalesce(string_agg(DISTINCT CASE WHEN s AND kind = 'focus_change' THEN app END, ',' ORDER BY CASE WHEN s AND kind = 'focus_change' THEN app END), '') AS apps, bool_or(s IS NULL) AS unattributable FROM m GROUP BY session_id""")
def exclusion_report(spark, d):
    return temporal.exclusion_report(temporal.exclude_focused(fx.events(spark, d), ["App1 ", "app4"], slice=fx.SLICE_MS))


@query("f9_volatile_labels", r"SELECT doc_id FROM (SELECT doc_id, text AS head FROM documents) WHERE NOT (regexp_matches(head, '[0-9]{1,2}:[0-9]{2}') OR regexp_matches(head, '\([ ]*[0-9]+[ ]*\)') OR regexp_matches(head, '^\s*[0-9.,]+\s*%?\s*$') OR regexp_matches(head, '\b[0-9]+\s+(unread|items?|messages?|results?|files?|photos?|selected)\b', 'i') OR regexp_matches(head, '\b(just now|[0-9]+\s+(seconds?|minutes?|hours?|days?)\s+ago)\b', 'i') OR regexp_matches(head, '\b[0-9]+\s*(KB|MB|GB|TB)\b', 'i') OR regexp_matches(head, '^\s*(Edited|Modified)\s*$'))")
def volatile(spark, d):
    """Whole texts as labels: those that last."""
    return fx.table(spark, d, "documents").filter(~text.volatile(F.col("text"))).select("doc_id")


@query("f10_speech", r"SELECT conv_id, turn FROM conversations WHERE NOT regexp_full_match(text, '\s*[(\[*][^)\]*]*[)\]*]\s*')")
def speech(spark, d):
    return fx.table(spark, d, "conversations").filter(~text.non_speech(F.col("text"))).select("conv_id", "turn")


_SEGMENTS = r"list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^\d+$') AND NOT regexp_matches(lower(s), '^[0-9a-f]{8,}$') AND NOT regexp_matches(lower(s), '^[0-9a-f]{8}-[0-9a-f-]{8,}$') AND NOT (regexp_matches(s, '^[A-Za-z0-9_-]{16,}$') AND regexp_matches(s, '[0-9]')))"


@query("f11_url_prefix", f"SELECT page_id, array_to_string(list_concat([regexp_replace(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^www\\.', '')], list_slice({_SEGMENTS}, 1, 3)), '/') AS place FROM pages")
def url_prefix(spark, d):
    return fx.table(spark, d, "pages").select("page_id", text.url_prefix(F.col("url")).alias("place"))


@query("f12_url_terms", "SELECT page_id, url AS term FROM pages UNION SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) FROM pages")
def url_terms(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.explode(text.url_terms(F.col("url"))).alias("term"))


@query("j1_frames_in_segments", f"""WITH {fx.EV}, {fx.SEG}, e AS (SELECT session_id, max(end_us) AS e FROM seg GROUP BY session_id)
SELECT event_id AS frame_id, seg_no::INTEGER AS seg_no FROM ev JOIN seg USING (session_id) JOIN e USING (session_id) WHERE event_id % 5 = 0 AND ev.us >= start_us AND (ev.us < seg.end_us OR (seg.end_us = e.e AND ev.us = e.e))""")
def frames_in_segments(spark, d):
    ev = fx.events(spark, d)
    segs, _ = _segments(ev)
    return temporal.interval_join(fx.frames(ev), _with_end(segs), closed_at="session_end").select("frame_id", "seg_no")


@query("j2_events_in_segments", f"""WITH {fx.EV}, {fx.SEG}, e AS (SELECT session_id, max(end_us) AS e FROM seg GROUP BY session_id)
SELECT session_id, seg_no::INTEGER AS seg_no, kind, count(*) AS n FROM ev JOIN seg USING (session_id) JOIN e USING (session_id) WHERE ev.us >= start_us AND (ev.us < seg.end_us OR (seg.end_us = e.e AND ev.us = e.e)) GROUP BY ALL""")
def events_in_segments(spark, d):
    ev = fx.events(spark, d)
    segs, _ = _segments(ev)
    return temporal.interval_join(ev, _with_end(segs), closed_at="session_end").groupBy("session_id", "seg_no", "kind").agg(F.count("*").alias("n"))


@query("j3_asof", f"""WITH {fx.EV}, r AS (SELECT session_id, us, event_id AS mark FROM ev WHERE kind = 'focus_change')
SELECT event_id, (SELECT max_by(mark, (r.us, mark)) FROM r WHERE r.session_id = ev.session_id AND r.us <= ev.us) AS mark FROM ev WHERE kind = 'key_down'""")
def asof(spark, d):
    ev = fx.events(spark, d)
    marks = ev.filter("kind = 'focus_change'").withColumn("mark", F.col("event_id"))
    return temporal.asof(ev.filter("kind = 'key_down'").select("event_id", "session_id", "t"), marks, ["mark"], slice=fx.SLICE_MS).select("event_id", "mark")


_FOCUS = f"""{fx.EV}, e AS (SELECT *, count(*) FILTER (WHERE kind = 'focus_change') OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS era FROM ev)
SELECT event_id, last_value(app IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS focus_app,
  last_value(url IGNORE NULLS) OVER (PARTITION BY session_id, era ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS focus_url FROM e"""


@query("j4_focus_context", f"WITH {_FOCUS}")
def focus_context(spark, d):
    return temporal.focus_context(fx.events(spark, d), slice=fx.SLICE_MS).select("event_id", "focus_app", "focus_url")


@query("j5_digest_context", f"WITH {_FOCUS}")
def digest_context(spark, d):
    return temporal.digest_context(fx.events(spark, d), slice=fx.SLICE_MS).select("event_id", "focus_app", "focus_url")


@query("j6_window_bounds", f"""WITH {fx.EV} SELECT event_id, (SELECT max_by(x, (f.us, f.event_id)) FROM ev f WHERE f.session_id = ev.session_id AND f.us <= ev.us AND f.kind = 'focus_change' AND f.k % 2 = 0) AS bounds_x FROM ev WHERE event_id % 5 = 0""")
def window_bounds(spark, d):
    """The last focus change that has bounds (here: k is even)."""
    ev = fx.events(spark, d)
    bounds = ev.filter("kind = 'focus_change' and k % 2 = 0").withColumn("bounds_x", F.col("x"))
    return temporal.asof(ev.filter("event_id % 5 = 0").select("event_id", "session_id", "t"), bounds, ["bounds_x"], slice=fx.SLICE_MS).select("event_id", "bounds_x")


def _nearest(order: str) -> str:
    return f"""WITH {fx.EV}, p AS (SELECT w.event_id, f.event_id AS frame_id, abs(w.us - f.us) AS du, f.us FROM ev w LEFT JOIN ev f ON f.session_id = w.session_id AND f.event_id % 5 = 0 WHERE w.kind = 'bookmark')
SELECT event_id, frame_id, du / 1000.0::DOUBLE AS dt FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY du, {order}) AS n FROM p) WHERE n = 1"""


@query("j7_nearest_frame", _nearest("us, frame_id"))
def nearest_frame(spark, d):
    ev = fx.events(spark, d)
    frames = fx.frames(ev).withColumn("event_id", F.col("frame_id"))
    out = temporal.nearest(ev.filter("kind = 'bookmark'").select("event_id", "session_id", "t"), frames, "frame_id", slice=fx.SLICE_MS)
    return out.select("event_id", "frame_id", F.round("dt", 3).alias("dt"))


@query("j8_nearest_frame_later", _nearest("us DESC, frame_id DESC"))
def nearest_later(spark, d):
    ev = fx.events(spark, d)
    frames = fx.frames(ev).withColumn("event_id", F.col("frame_id"))
    out = temporal.nearest(ev.filter("kind = 'bookmark'").select("event_id", "session_id", "t"), frames, "frame_id", prefer_later=True, slice=fx.SLICE_MS)
    return out.select("event_id", "frame_id", F.round("dt", 3).alias("dt"))


@query("j9_exact_or_asof", f"""WITH {fx.EV} SELECT event_id, coalesce(CASE WHEN event_id % 10 = 0 THEN -event_id END, (SELECT max_by(r.event_id, (r.us, r.event_id)) FROM ev r WHERE r.session_id = ev.session_id AND r.us <= ev.us AND r.kind = 'scroll')) AS snap, event_id % 10 = 0 AS exact FROM ev WHERE kind = 'bookmark'""")
def exact_or_asof(spark, d):
    ev = fx.events(spark, d)
    left = ev.filter("kind = 'bookmark'").select("event_id", "session_id", "t")
    exact = left.filter("event_id % 10 = 0").select("event_id", (-F.col("event_id")).alias("snap"))
    right = ev.filter("kind = 'scroll'").select("event_id", "session_id", "t", F.col("event_id").alias("snap"))
    return temporal.exact_or_asof(left, exact, right, "snap", keys=["event_id"], slice=fx.SLICE_MS).select("event_id", "snap", "exact")


_CLIPS = "clip AS (SELECT conv_id AS session_id, turn AS clip_no, turn * 1000 AS c0, turn * 1000 + 1500 AS c1 FROM conversations), span AS (SELECT conv_id AS session_id, turn AS span_no, turn * 1300 AS s0, turn * 1300 + 1300 AS s1 FROM conversations)"


@query("j10_overlap", f"WITH {_CLIPS} SELECT session_id, clip_no, span_no FROM clip JOIN span USING (session_id) WHERE c0 < s1 AND s0 < c1")
def overlap(spark, d):
    turns = fx.table(spark, d, "conversations")
    clip = turns.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("clip_no"), (F.col("turn") * 1000).alias("c0"), (F.col("turn") * 1000 + 1500).alias("c1"))
    span = turns.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("span_no"), (F.col("turn") * 1300).alias("s0"), (F.col("turn") * 1300 + 1300).alias("s1"))
    return temporal.overlap_join(clip, span, a_span=("c0", "c1"), b_span=("s0", "s1")).select("session_id", "clip_no", "span_no")


@query("g1_boundaries", f"WITH {fx.EV}, {fx.SEG} SELECT session_id, us / 1000.0::DOUBLE AS t, reason FROM bnd")
def bounds(spark, d):
    ev = fx.events(spark, d)
    return segments.boundaries(ev, segments.session_ends(ev), dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS, slice=fx.SLICE_MS)


@query("g2_session_ends", f"WITH {fx.EV} SELECT session_id, max(us) / 1000.0::DOUBLE AS t_end FROM ev GROUP BY session_id")
def ends(spark, d):
    return segments.session_ends(fx.events(spark, d))


@query("g3_segments", f"WITH {fx.EV}, {fx.SEG} SELECT session_id, seg_no::INTEGER AS seg_no, start_us / 1000.0::DOUBLE AS t_start, end_us / 1000.0::DOUBLE AS t_end, reason FROM seg")
def segs(spark, d):
    return _segments(fx.events(spark, d))[0]


@query("g4_windows_in_segments", f"""WITH {fx.EV}, {fx.SEG}, w AS (SELECT session_id, seg_no, i, reason, start_us + i * 21600000000 AS s, end_us, start_us FROM seg, range(5000) r(i) WHERE i <= (end_us - start_us) // 21600000000)
SELECT session_id, seg_no::INTEGER AS seg_no, i::INTEGER AS window_no, round(s / 1000.0::DOUBLE, 3) AS t_start, round(least(s + 43200000000, end_us) / 1000.0::DOUBLE, 3) AS t_end, CASE WHEN i = 0 THEN reason ELSE 'window' END AS reason
FROM w WHERE s < end_us AND (i = 0 OR s - 21600000000 + 43200000000 < end_us)""")
def windows(spark, d):
    return segments.subdivide(_segments(fx.events(spark, d))[0], 43200000.0, 21600000.0).select("session_id", "seg_no", "window_no", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "reason")


@query("g5_sliding_windows", f"""WITH {fx.EV}, e AS (SELECT session_id, max(us) AS e FROM ev GROUP BY session_id), w AS (SELECT session_id, e, i, i * 86400000000 AS s FROM e, range(2000) r(i))
SELECT session_id, i::INTEGER AS window_no, s / 1000.0::DOUBLE AS t_start, least(s + 172800000000, e) / 1000.0::DOUBLE AS t_end FROM w WHERE s < e AND (i = 0 OR s + 86400000000 < e)""")
def sliding(spark, d):
    return segments.sliding_windows(segments.session_ends(fx.events(spark, d)), 172800000.0, 86400000.0).select("session_id", "window_no", "t_start", "t_end")


@query("g6_typed_runs")
def typed(spark, d):
    ev = fx.events(spark, d)
    keys = ev.withColumns({"char": F.when(F.col("kind") == "key_down", F.chr(F.lit(97) + F.col("k") % 26)), "chord": F.col("k") % 17 == 0, "backspace": F.col("k") % 7 == 0})
    return segments.typed_runs(keys, gap_ms=fx.DWELL_MS * 4)


@query("g11_boundary_triggers", _greedy(f"SELECT *, CASE WHEN kind IN ('focus_change', 'bookmark') THEN kind WHEN kind IN ('mouse_down', 'key_down', 'scroll') AND t - last_value(CASE WHEN kind IN ('mouse_down', 'key_down', 'scroll') THEN t END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= {fx.DWELL_MS} THEN 'dwell_resume' END AS reason FROM ev QUALIFY reason IS NOT NULL", f"{fx.BURST_MS}"))
def triggers(spark, d):
    return segments.boundary_triggers(fx.events(spark, d), settle_ms=fx.BURST_MS, dwell_ms=fx.DWELL_MS, slice=fx.SLICE_MS).select("event_id", "session_id")


@query("g7_gestures")
def gestures(spark, d):
    ev = fx.events(spark, d).withColumns({"char": F.when(F.col("kind") == "key_down", F.chr(F.lit(97) + F.col("k") % 26)), "chord": F.when(F.col("k") % 17 == 0, F.lit("cmd+s")), "button": 1 + F.col("k") % 2, "dx": F.lit(0), "dy": F.col("k") % 5 - 2})
    hour = 3_600_000.0
    return segments.gestures(ev, {"multi_click_ms": 6 * hour, "hover_ms": 8 * hour, "scroll_gap_ms": 12 * hour, "idle_ms": 48 * hour}).drop("path")


@query("g8_pauses", f"""WITH {fx.EV}, l AS (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b, last_value(CASE WHEN kind IN ('mouse_down', 'key_down', 'scroll') THEN us END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
p AS (SELECT *, CASE WHEN us - b > 86400000000 THEN 'dwell_gap' WHEN kind IN ('mouse_down', 'key_down', 'scroll') AND us - m > 28800000000 THEN 'burst_gap' END AS pause FROM l)
SELECT session_id, CASE pause WHEN 'dwell_gap' THEN b ELSE m END / 1000.0::DOUBLE AS t_start, us / 1000.0::DOUBLE AS t_end, pause FROM p WHERE pause IS NOT NULL""")
def pauses(spark, d):
    return segments.pauses(fx.events(spark, d), dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS, slice=fx.SLICE_MS)


@query("g9_app_spans", f"""WITH {fx.EV}, e AS (SELECT session_id, max(us) AS e FROM ev GROUP BY session_id), f AS (SELECT session_id, app, us, lead(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS n FROM ev WHERE kind = 'focus_change')
SELECT session_id, app, us / 1000.0::DOUBLE AS t_start, coalesce(n, e) / 1000.0::DOUBLE AS t_end FROM f JOIN e USING (session_id) WHERE coalesce(n, e) > us""")
def app_spans(spark, d):
    ev = fx.events(spark, d)
    return segments.app_spans(ev, segments.session_ends(ev))


@query("g10_clicks", f"""WITH {fx.EV}, u AS (SELECT *, first_value(CASE WHEN kind = 'mouse_up' THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM ev)
SELECT session_id, event_id, t, up.t AS up_t, CASE WHEN sqrt((up.x - x) * (up.x - x) + (up.y - y) * (up.y - y)) > 4 THEN 'drag' ELSE 'click' END AS gesture FROM u WHERE kind = 'mouse_down'""")
def clicks(spark, d):
    return segments.clicks(fx.events(spark, d)).drop("up_x", "up_y")
