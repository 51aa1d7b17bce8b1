"""Queries over features and lanes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import features, segments, temporal, tracks, vectors
from sessionloom.plans.events import _segments
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources.tables import ensure_checkpoint_dir

B = 48
_TOTAL = f"{fx.EV}, tot AS (SELECT session_id, max(us) / 1000000.0::DOUBLE AS total FROM ev GROUP BY session_id)"
_IDX = "CASE WHEN total > 0 THEN least(47, greatest(0, floor(us / 1000000.0::DOUBLE / total * 48)::INTEGER)) ELSE 0 END"
_AXIS = "ax AS (SELECT session_id, b::INTEGER AS bucket FROM tot, range(48) r(b))"


def _totals(ev):
    return segments.session_ends(ev).select("session_id", (F.col("t_end") / 1000).alias("total_sec"))


def _samples(ev, value=None):
    return ev.select("session_id", "event_id", (F.col("t") / 1000).alias("sec"), (F.col(value) if value else F.lit(1.0)).alias("value"))


_BEHAVIOUR = f"""{fx.EV}, {fx.SEG}, e AS (SELECT session_id, max(end_us) AS e FROM seg GROUP BY session_id),
j AS (SELECT ev.*, seg_no, start_us, seg.end_us, (seg.end_us - start_us) / 1000.0::DOUBLE AS dur, (ev.us - start_us) / 1000.0::DOUBLE AS rel FROM ev JOIN seg USING (session_id) JOIN e USING (session_id) WHERE ev.us >= start_us AND (ev.us < seg.end_us OR (seg.end_us = e.e AND ev.us = e.e))),
mv AS (SELECT *, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM j WHERE kind = 'mouse_move' WINDOW w AS (PARTITION BY session_id, seg_no ORDER BY us, event_id)),
mg AS (SELECT session_id, seg_no, avg(CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt END) AS speed FROM mv GROUP BY ALL),
bn AS (SELECT session_id, seg_no, b, count(*) AS n FROM (SELECT *, least(7, floor((atan2(dy, dx) + pi()) / (2 * pi()) * 8)) AS b FROM mv WHERE sqrt(dx * dx + dy * dy) > 0) GROUP BY ALL),
en AS (SELECT session_id, seg_no, -sum(n / tn * log2(n / tn)) / 3 AS ent FROM (SELECT *, sum(n) OVER (PARTITION BY session_id, seg_no)::DOUBLE AS tn FROM bn) GROUP BY ALL),
g AS (SELECT session_id, seg_no, count(*) FILTER (WHERE kind = 'mouse_down')::DOUBLE AS c, count(*) FILTER (WHERE kind = 'key_down')::DOUBLE AS k, count(*) FILTER (WHERE kind = 'scroll')::DOUBLE AS s, count(*) FILTER (WHERE kind = 'mouse_move')::DOUBLE AS m,
  count(DISTINCT floor(rel / 250)) AS act, list_value(count(*) FILTER (WHERE q = 0), count(*) FILTER (WHERE q = 1), count(*) FILTER (WHERE q = 2), count(*) FILTER (WHERE q = 3)) AS qs
  FROM (SELECT *, least(3, floor(rel / (dur / 4))) AS q FROM j) GROUP BY ALL),
f AS (SELECT seg.session_id, seg.seg_no, greatest((end_us - start_us) / 1000.0::DOUBLE / 1000, 0.001) AS sec, (end_us - start_us) / 1000.0::DOUBLE AS dur, coalesce(c, 0) AS c, coalesce(k, 0) AS k, coalesce(s, 0) AS s, coalesce(m, 0) AS m, coalesce(act, 0) AS act, qs, coalesce(speed, 0) AS speed, coalesce(ent, 0) AS ent FROM seg LEFT JOIN g USING (session_id, seg_no) LEFT JOIN mg USING (session_id, seg_no) LEFT JOIN en USING (session_id, seg_no)),
v AS (SELECT session_id, seg_no, [c / sec / 5, k / sec / 10, s / sec / 10, m / sec / 60, speed / 5, ent, CASE WHEN c + k > 0 THEN c / (c + k) ELSE 0 END, act / greatest(1, ceil(dur / 250))] AS a, CASE WHEN c + k + s + m > 0 THEN list_transform(qs, lambda z: z / (c + k + s + m)) ELSE [0.0, 0.0, 0.0, 0.0] END AS b FROM f),
o AS (SELECT session_id, seg_no, unnest(list_concat(a, b)) AS val, generate_subscripts(list_concat(a, b), 1) - 1 AS dim FROM v),
bh AS (SELECT session_id, seg_no::INTEGER AS seg_no, dim::INTEGER AS dim, round(least(greatest(coalesce(val, 0), 0), 1), 6) + 0.0 AS value FROM o)"""


@query("a1_behaviour", f"WITH {_BEHAVIOUR} SELECT * FROM bh")
def behaviour(spark, d):
    ensure_checkpoint_dir(spark)
    ev = fx.events(spark, d).checkpoint()  # boundaries read it six times
    out = features.behaviour(ev, _segments(ev)[0])
    return out.select("session_id", "seg_no", F.posexplode("v").alias("dim", "value")).select("session_id", "seg_no", "dim", (F.round("value", 6) + 0.0).alias("value"))


@query("entry_sessions_like_this", f"WITH {_BEHAVIOUR}, mn AS (SELECT session_id, dim, round(avg(value), 5) AS v FROM bh GROUP BY ALL), ds AS (SELECT q.session_id AS query_id, b.session_id AS id, round(sqrt(sum((q.v - b.v) ** 2)), 6) AS distance FROM mn q JOIN mn b ON q.session_id % 50 = 0 AND q.dim = b.dim AND q.session_id <> b.session_id GROUP BY ALL) SELECT query_id, n::INTEGER AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS n FROM ds) WHERE n <= 5")
def sessions_like_this(spark, d):
    """Behaviour vectors of all segments, averaged by session, and the five nearest of every session whose id divides by 50."""
    ensure_checkpoint_dir(spark)
    ev = fx.events(spark, d).checkpoint()  # boundaries read it six times
    vecs = features.behaviour(ev, _segments(ev)[0])
    mean = vecs.groupBy("session_id").agg(F.array(*[F.round(F.avg(F.round(F.col("v")[i], 6)), 5) for i in range(12)]).alias("v")).select(F.col("session_id").alias("id"), "v")
    mean = mean.checkpoint()  # both sides of the search read it
    return vectors.knn(mean.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), mean, 5, skip_self=True)


@query("a2_digest")
def digest(spark, d):
    ev = fx.events(spark, d)
    segs, _ = _segments(ev)
    starts = segs.select("session_id", "seg_no", F.col("t_start").alias("t"), F.col("seg_no").cast("long").alias("event_id"))
    context = temporal.focus_context(ev).select("session_id", "t", "event_id", F.col("focus_app").alias("app"), F.col("focus_url").alias("url"))
    ev = ev.withColumn("title", F.when(F.col("k") % 3 == 0, F.concat(F.lit("Page "), (F.col("k") % 7).cast("string"))))
    labels = ev.filter("kind = 'mouse_down' and k % 4 = 0").select("session_id", "event_id", F.concat(F.lit("Button "), (F.col("k") % 5).cast("string")).alias("label"))
    return features.digest(ev, segs, focus=temporal.asof(starts, context, ["app", "url"], strict=True), clicked=labels)


@query("a3_bucket_counts", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, count(*) AS n FROM ev JOIN tot USING (session_id) GROUP BY ALL) SELECT session_id, bucket, coalesce(n, 0) AS n FROM ax LEFT JOIN n USING (session_id, bucket)")
def counts(spark, d):
    ev = fx.events(spark, d)
    return features.bucket_counts(_samples(ev), _totals(ev), B)


@query("a4_bucket_max", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, max(x) AS v FROM ev JOIN tot USING (session_id) GROUP BY ALL) SELECT session_id, bucket, coalesce(v, 0) AS value FROM ax LEFT JOIN n USING (session_id, bucket)")
def peaks(spark, d):
    ev = fx.events(spark, d)
    return features.bucket_max(_samples(ev, "x"), _totals(ev), B)


@query("a5_bucket_hold", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, max_by(x, (us, event_id)) AS v FROM ev JOIN tot USING (session_id) WHERE kind = 'mouse_move' GROUP BY ALL) SELECT session_id, bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS value FROM ax LEFT JOIN n USING (session_id, bucket)")
def hold(spark, d):
    ev = fx.events(spark, d)
    return features.bucket_hold(_samples(ev.filter("kind = 'mouse_move'"), "x"), _totals(ev), B)


@query("a6_smoothed_rate", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, count(*) AS n FROM ev JOIN tot USING (session_id) GROUP BY ALL) SELECT session_id, bucket, round(sum(coalesce(n, 0)) OVER w / (count(*) OVER w * 0.2::DOUBLE), 6) AS value FROM ax LEFT JOIN n USING (session_id, bucket) WINDOW w AS (PARTITION BY session_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rate(spark, d):
    ev = fx.events(spark, d)
    return features.smoothed_rate(features.bucket_counts(_samples(ev), _totals(ev), B), 0.2).withColumn("value", F.round("value", 6))


@query("a7_normalised", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, max(x) AS v FROM ev JOIN tot USING (session_id) WHERE kind = 'mouse_move' GROUP BY ALL), p AS (SELECT session_id, bucket, v, greatest(max(v) OVER (PARTITION BY session_id), 0) AS peak FROM ax LEFT JOIN n USING (session_id, bucket)) SELECT session_id, bucket, round(CASE WHEN v IS NOT NULL THEN CASE WHEN peak > 0 THEN v / peak ELSE 0 END END, 6) AS value, coalesce(peak, 0) AS peak FROM p")
def normalised(spark, d):
    ev = fx.events(spark, d)
    at = features.bucket_index(F.col("sec"), F.col("total_sec"), B)
    lane = _samples(ev.filter("kind = 'mouse_move'"), "x").join(_totals(ev), "session_id").groupBy("session_id", at.alias("bucket")).agg(F.max("value").alias("value"))
    axis = features._axis(_totals(ev), B).join(lane, ["session_id", "bucket"], "left")
    return features.normalised(axis).withColumn("value", F.round("value", 6))


@query("a8_audio_peaks", "WITH b AS (SELECT conv_id AS session_id, turn * 2.0::DOUBLE AS s, turn FROM conversations), tot AS (SELECT session_id, max(s) + 2.0::DOUBLE AS total FROM b GROUP BY session_id), p AS (SELECT session_id, s + (i + 0.5::DOUBLE) * 0.5::DOUBLE AS sec, ((turn * 7 + i * 3) % 10) / 10.0::DOUBLE AS v FROM b, range(4) r(i)), m AS (SELECT session_id, least(15, greatest(0, floor(sec / total * 16)::INTEGER)) AS bucket, max(v) AS value FROM p JOIN tot USING (session_id) GROUP BY ALL), ax AS (SELECT session_id, i::INTEGER AS bucket FROM tot, range(16) r(i)) SELECT session_id, bucket, value FROM ax LEFT JOIN m USING (session_id, bucket)")
def audio(spark, d):
    turns = fx.table(spark, d, "conversations")
    blobs = turns.select(F.col("conv_id").alias("session_id"), (F.col("turn") * 2.0).alias("start_sec"), F.lit(2.0).alias("duration_sec"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("turn") * 7 + i * 3) % 10) / 10.0).alias("peaks"))
    totals = blobs.groupBy("session_id").agg((F.max("start_sec") + 2.0).alias("total_sec"))
    return features.merge_peaks(blobs, totals, 16)


@query("a9_sample_peaks", "WITH s AS (SELECT l_orderkey AS blob_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, (l_partkey * 37 % 65536) - 32768 AS v, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT blob_id, least(3, floor(i * 4 / n::DOUBLE)::INTEGER) AS bucket, max(abs(v)) / 32768.0::DOUBLE AS peak FROM s GROUP BY ALL")
def pcm(spark, d):
    from pyspark.sql.window import Window

    li = fx.table(spark, d, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return features.sample_peaks(li.select(F.col("l_orderkey").alias("blob_id"), i.alias("i"), (F.col("l_partkey") * 37 % 65536 - 32768).alias("sample")), 4)


@query("a10_pointer_speed", f"WITH {fx.EV}, m AS (SELECT session_id, event_id, t / 1000 AS sec, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, (t - lag(t) OVER w) / 1000 AS dt FROM ev WHERE kind = 'mouse_move' WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)) SELECT session_id, event_id, round(sec, 6) AS sec, round(d / dt, 6) AS value FROM m WHERE dt > 0")
def speed(spark, d):
    return features.pointer_speeds(fx.events(spark, d)).select("session_id", "event_id", F.round("sec", 6).alias("sec"), F.round("value", 6).alias("value"))


@query("a11_pointer_x", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, max_by(x / 1920, (us, event_id)) AS v FROM ev JOIN tot USING (session_id) WHERE kind IN ('mouse_move', 'mouse_down') GROUP BY ALL) SELECT session_id, bucket, round(last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY bucket ROWS UNBOUNDED PRECEDING), 7) AS value FROM ax LEFT JOIN n USING (session_id, bucket)")
def pointer(spark, d):
    ev = fx.events(spark, d).withColumn("share", F.col("x") / 1920)
    return features.bucket_hold(_samples(ev.filter("kind in ('mouse_move', 'mouse_down')"), "share"), _totals(ev), B).withColumn("value", F.round("value", 7))


def _screens(ev):
    """A third of the sessions know their displays."""
    return ev.filter("session_id % 3 = 0").groupBy("session_id").agg(F.min("t").alias("t"), F.lit(2560.0).alias("right"), F.lit(1440.0).alias("bottom"))


_BOUNDS = f"""bs AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 2560 ELSE greatest(1, max(x)) END AS bw, CASE WHEN session_id % 3 = 0 THEN 1440 ELSE greatest(1, max(y)) END AS bh FROM ev GROUP BY session_id),
hd AS (SELECT session_id, {_IDX} AS bucket, max_by({{'x': x / bw, 'y': y / bh}}, (us, event_id)) AS v FROM ev JOIN tot USING (session_id) JOIN bs USING (session_id) WHERE kind = 'mouse_move' GROUP BY ALL),
ho AS (SELECT session_id, bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS h FROM ax LEFT JOIN hd USING (session_id, bucket))"""


@query("a11_pointer_xy", f"WITH {_TOTAL}, {_AXIS}, {_BOUNDS} SELECT session_id, bucket, round(h.x, 6) AS x, round(h.y, 6) AS y FROM ho")
def pointer_xy(spark, d):
    """Both lanes, by the displays or else by the farthest point seen."""
    ev = fx.events(spark, d)
    out = tracks.pointer_lane(ev, _totals(ev).select("session_id", F.lit(0.0).alias("origin_ms"), "total_sec"), B, _screens(ev))
    return out.select("session_id", "bucket", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _rate_lane(ev, kind):
    lane = features.bucket_counts(_samples(ev.filter(F.col("kind") == kind)), _totals(ev), B)
    return features.normalised(features.smoothed_rate(lane, 0.25))


@query("a12_event_rates", f"WITH {_TOTAL}, {_AXIS}, n AS (SELECT session_id, {_IDX} AS bucket, count(*) AS n FROM ev JOIN tot USING (session_id) WHERE kind = 'key_down' GROUP BY ALL), r AS (SELECT session_id, bucket, sum(coalesce(n, 0)) OVER w / (count(*) OVER w * 0.25::DOUBLE) AS v FROM ax LEFT JOIN n USING (session_id, bucket) WINDOW w AS (PARTITION BY session_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), p AS (SELECT *, max(v) OVER (PARTITION BY session_id) AS peak FROM r) SELECT session_id, bucket, round(CASE WHEN peak > 0 THEN v / peak ELSE 0 END, 6) AS value, round(peak, 6) AS peak FROM p")
def rates(spark, d):
    return _rate_lane(fx.events(spark, d), "key_down").withColumns({"value": F.round("value", 6), "peak": F.round("peak", 6)})


@query("a13_marks", f"WITH {fx.EV} SELECT session_id, CASE kind WHEN 'url_change' THEN 'web' WHEN 'bookmark' THEN 'markers' ELSE 'apps' END AS lane, event_id, round(greatest(us / 1000.0::DOUBLE / 1000, 0), 6) AS sec, CASE kind WHEN 'url_change' THEN 'site' || (k % 5) || '.example/docs/a' WHEN 'focus_change' THEN app END AS label FROM ev WHERE kind IN ('url_change', 'bookmark', 'focus_change')")
def marks(spark, d):
    ev = fx.events(spark, d)
    axis = segments.session_ends(ev).select("session_id", F.lit(0.0).alias("origin_ms"))
    return features.marks(ev, {"url_change": "web", "bookmark": "markers", "focus_change": "apps"}, axis).withColumn("sec", F.round("sec", 6))


@query("a16_tallies", f"WITH {fx.EV} SELECT session_id, count(*) FILTER (WHERE kind = 'key_down') AS keys, count(*) FILTER (WHERE kind = 'mouse_down') AS clicks, count(*) FILTER (WHERE kind = 'focus_change') AS focus_changes, max_by(app, (us, event_id)) FILTER (WHERE app IS NOT NULL) AS latest_app, count(*) FILTER (WHERE event_id % 5 = 0) AS keyframes, coalesce(any_value(c.n), 0) AS chunks, count(*) FILTER (WHERE kind = 'mouse_up') AS walks FROM ev LEFT JOIN (SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id IN (SELECT session_id FROM ev) GROUP BY conv_id) c USING (session_id) GROUP BY session_id")
def tallies(spark, d):
    """Turns of the conversation of a session's number are its audio chunks."""
    ev = fx.events(spark, d)
    chunks = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).join(ev.select("session_id").distinct(), "session_id", "left_semi")
    return features.tallies(ev, fx.frames(ev), chunks, ev.filter("kind = 'mouse_up'"))


@query("a17_transcripts", "SELECT conv_id AS session_id, (turn // 2)::INTEGER AS seg_no, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> '') AS transcript FROM conversations GROUP BY ALL")
def transcripts(spark, d):
    turns = fx.table(spark, d, "conversations")
    return features.assemble_transcript(turns.select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 2).cast("int").alias("seg_no"), (F.col("turn") * 1000).alias("t_start"), F.col("turn").alias("piece_no"), "text"))


@query("a18_searchable_text", "SELECT conv_id, turn, concat_ws(chr(10), nullif(trim(role), ''), nullif(trim(CASE WHEN turn % 2 = 0 THEN text END), '')) AS text FROM conversations")
def searchable(spark, d):
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("body"))
    return features.searchable_text(turns, ["role", "body"]).select("conv_id", "turn", "text")


@query("a20_shares", "WITH s AS (SELECT o_orderstatus AS g, o_orderpriority AS name, round(sum(o_totalprice)) AS v FROM orders GROUP BY ALL), p AS (SELECT *, v / sum(v) OVER (PARTITION BY g) AS share FROM s) SELECT g, CASE WHEN share < 0.2 THEN 'other' ELSE name END AS name, round(sum(share), 6) AS share FROM p GROUP BY ALL")
def stage_shares(spark, d):
    per = fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("name")).agg(F.round(F.sum("o_totalprice")).alias("v"))
    return features.shares(per, "g", "v", 0.2).withColumn("share", F.round("share", 6))


@query("a21_paths")
def paths(spark, d):
    ev = fx.events(spark, d).filter("kind in ('mouse_move', 'scroll')")
    points = ev.select(F.col("session_id").alias("drag_id"), F.row_number().over(Window.partitionBy("session_id").orderBy("t", "event_id")).alias("i"), "x", "y", "t")
    sums = features.path_features(points).select("drag_id", "n", *[F.round(c, 4).alias(c) for c in ("length", "chord", "straightness", "s11", "s12", "s22", "c1x", "c1y", "c2x", "c2y")])
    return sums.join(features.paths(points).select("drag_id", "confidence", F.size("curve").alias("cubics"), F.round(F.col("velocity")[8], 4).alias("halfway")), "drag_id")


@query("a23_lane_axis", f"WITH {fx.EV}, e AS (SELECT session_id, max(us) / 1000.0::DOUBLE AS dur FROM ev GROUP BY session_id), v AS (SELECT session_id, min(t) AS v0, max(t) AS v1 FROM ev WHERE event_id % 5 = 0 AND session_id % 2 = 0 GROUP BY session_id) SELECT session_id, round(coalesce(v0, 0), 6) AS origin_ms, round(coalesce(v1 - v0, dur) / 1000, 6) AS total_sec FROM e LEFT JOIN v USING (session_id)")
def axis(spark, d):
    ev = fx.events(spark, d)
    sessions = segments.session_ends(ev).select("session_id", F.col("t_end").alias("duration_ms"))
    video = fx.frames(ev).filter("session_id % 2 = 0").select("session_id", F.col("t").alias("t_start"), F.col("t").alias("t_end"))
    return features.lane_axis(sessions, video).select("session_id", F.round("origin_ms", 6).alias("origin_ms"), F.round("total_sec", 6).alias("total_sec"))


_RATE = "SELECT session_id, {no}, 'input', '{lane}', bucket, NULL, NULL, CASE WHEN p > 0 THEN v / p ELSE 0 END, NULL, p, NULL FROM (SELECT *, max(v) OVER (PARTITION BY session_id) AS p FROM (SELECT ax.session_id, ax.bucket, CASE WHEN total > 0 THEN coalesce(n, 0) / (total / 48) ELSE 0 END AS v FROM ax JOIN tot USING (session_id) LEFT JOIN (SELECT session_id, {idx} AS bucket, count(*) AS n FROM ev JOIN tot USING (session_id) WHERE kind = '{kind}' GROUP BY ALL) USING (session_id, bucket)))"
_LANES = f"""WITH {_TOTAL}, {_AXIS}, {fx.SEG}, sn AS (SELECT session_id, seg_no, start_us / 1000000.0::DOUBLE AS s, end_us / 1000000.0::DOUBLE AS e, reason FROM seg),
cl AS (SELECT session_id, event_id, us / 1000000.0::DOUBLE AS s FROM ev WHERE kind = 'bookmark' AND session_id % 4 = 0),
au AS (SELECT ev.session_id, {_IDX.replace('us / 1000000.0::DOUBLE', '(us / 1000000.0::DOUBLE + (i + 0.5::DOUBLE) * 1800)')} AS bucket, max(((k + i * 3) % 10) / 10.0::DOUBLE) AS v FROM ev JOIN tot USING (session_id), range(2) r(i) WHERE kind = 'bookmark' AND us / 1000000.0::DOUBLE + (i + 0.5::DOUBLE) * 1800 <= total GROUP BY ALL),
mk AS (SELECT DISTINCT session_id FROM ev WHERE kind = 'bookmark'),
up AS (SELECT *, first_value(CASE WHEN kind = 'mouse_up' THEN {{'t': t, 'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u FROM ev),
sp AS (SELECT session_id, us, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, (t - lag(t) OVER w) / 1000 AS dt FROM ev WHERE kind = 'mouse_move' WINDOW w AS (PARTITION BY session_id ORDER BY us, event_id)),
{_BOUNDS},
pl AS (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b, last_value(CASE WHEN kind IN ('mouse_down', 'key_down', 'scroll') THEN us END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev),
ps AS (SELECT session_id, CASE WHEN us - b > 86400000000 THEN b ELSE m END AS s, us, us - b > 86400000000 AS long FROM pl WHERE us - b > 86400000000 OR (kind IN ('mouse_down', 'key_down', 'scroll') AND us - m > 28800000000)),
ln(session_id, lane_no, band, lane, "at", start_sec, end_sec, value, value2, peak, label) AS (
SELECT session_id, 0, 'screen', 'frames', event_id, us / 1000000.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, event_id::VARCHAR FROM ev WHERE event_id % 5 = 0
UNION ALL SELECT session_id, 1, 'screen', 'apps', round(us / 1000.0::DOUBLE)::BIGINT, us / 1000000.0::DOUBLE, coalesce(n, e) / 1000000.0::DOUBLE, NULL, NULL, NULL, app FROM (SELECT session_id, app, us, lead(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS n FROM ev WHERE kind = 'focus_change') JOIN (SELECT session_id, max(us) AS e FROM ev GROUP BY session_id) USING (session_id) WHERE coalesce(n, e) > us
UNION ALL SELECT session_id, 2, 'screen', 'web', event_id, us / 1000000.0::DOUBLE, NULL, NULL, NULL, NULL, 'site' || (k % 5) || '.example/docs/a' FROM ev WHERE kind = 'url_change'
UNION ALL SELECT session_id, 3, 'screen', 'ax', event_id, us / 1000000.0::DOUBLE, NULL, NULL, NULL, NULL, CASE WHEN k % 2 = 0 THEN 'keyframe' ELSE 'boundary' END || ' · ' || (k % 7) || ' elements · ' || k || 'ms' FROM ev WHERE kind = 'mouse_up'
UNION ALL SELECT session_id, 4, 'segments', 'level-1', seg_no, s, e, NULL, NULL, NULL, CASE WHEN seg_no % 5 > 0 THEN reason ELSE 'summary missing' END FROM sn
UNION ALL SELECT session_id, 5, 'segments', 'caption', round(s * 1000)::BIGINT, s, e, NULL, NULL, NULL, reason FROM sn WHERE seg_no % 2 = 0
UNION ALL SELECT session_id, 6, 'audio', 'transcript', event_id, s, s + 1, NULL, NULL, NULL, 'clip ' || event_id FROM cl
UNION ALL SELECT session_id, 6, 'audio', 'transcript', round(s * 1000)::BIGINT, s, e, NULL, NULL, NULL, 'said ' || seg_no FROM sn WHERE seg_no % 3 = 0 AND session_id NOT IN (SELECT session_id FROM cl)
UNION ALL SELECT session_id, 7, 'audio', 'audio-mic', bucket, NULL, NULL, CASE WHEN v IS NOT NULL THEN CASE WHEN p > 0 THEN v / p ELSE 0 END END, NULL, p, NULL FROM (SELECT session_id, bucket, v, greatest(coalesce(max(v) OVER (PARTITION BY session_id), 0), 0) AS p FROM ax JOIN mk USING (session_id) LEFT JOIN au USING (session_id, bucket))
UNION ALL {_RATE.format(no=8, lane='typing', kind='key_down', idx=_IDX)}
UNION ALL SELECT session_id, 9, 'input', 'clicks', event_id, us / 1000000.0::DOUBLE, NULL, NULL, NULL, NULL, CASE WHEN sqrt((u.x - x) ** 2 + (u.y - y) ** 2) > 4 THEN 'drag ' || round(u.t - t)::BIGINT || 'ms · ' || round(sqrt((u.x - x) ** 2 + (u.y - y) ** 2))::BIGINT || 'px' ELSE 'click' END FROM up WHERE kind = 'mouse_down'
UNION ALL {_RATE.format(no=10, lane='scroll', kind='scroll', idx=_IDX)}
UNION ALL SELECT session_id, 11, 'input', 'mouse-speed', bucket, NULL, NULL, CASE WHEN p > 0 THEN v / p ELSE 0 END, NULL, p, NULL FROM (SELECT *, max(v) OVER (PARTITION BY session_id) AS p FROM (SELECT ax.session_id, ax.bucket, greatest(coalesce(v, 0), 0) AS v FROM ax LEFT JOIN (SELECT session_id, {_IDX} AS bucket, max(d / dt) AS v FROM sp JOIN tot USING (session_id) WHERE dt > 0 GROUP BY ALL) USING (session_id, bucket)))
UNION ALL SELECT session_id, 12, 'input', 'mouse-xy', bucket, NULL, NULL, h.x, h.y, 1.0, NULL FROM ho
UNION ALL SELECT session_id, 13, 'input', 'idle', round(us / 1000.0::DOUBLE)::BIGINT, s / 1000000.0::DOUBLE, us / 1000000.0::DOUBLE, NULL, NULL, NULL, CASE WHEN long THEN 'idle ' ELSE 'pause ' END || round((us - s) / 1000000.0::DOUBLE, 1)::DECIMAL(24, 1)::VARCHAR || 's' FROM ps
UNION ALL SELECT session_id, 14, 'marks', 'markers', event_id, us / 1000000.0::DOUBLE, NULL, NULL, NULL, NULL, 'bookmark' FROM ev WHERE kind = 'bookmark')
SELECT session_id, lane_no::INTEGER AS lane_no, band, lane, "at", round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, round(value, 6) AS value, round(value2, 6) AS value2, round(peak, 6) AS peak, label FROM ln"""


def _rounded(name, places):
    """As DuckDB rounds: the scaled double to the nearest whole number, not the number's shortest decimal form."""
    return (F.round(F.col(name) * 10.0**places) / 10.0**places).alias(name)


@query("a24_all_lanes", _LANES)
def lanes(spark, d):
    """Fifteen lanes: walks are mouse_up events, clips and audio begin at bookmarks, a third of the sessions know their displays."""
    ev = fx.events(spark, d)
    segs = _segments(ev)[0]
    spoken = segs.select("session_id", F.lit("action").alias("granularity"), "t_start", "t_end", F.when(F.col("seg_no") % 3 == 0, F.concat(F.lit("said "), F.col("seg_no").cast("string"))).alias("transcript"), F.when(F.col("seg_no") % 2 == 0, F.col("reason")).alias("caption"), F.lit(None).cast("string").alias("app_caption"))
    marked = ev.filter("kind = 'bookmark'")
    out = tracks.session_tracks(
        ev, _totals(ev).select("session_id", F.lit(0.0).alias("origin_ms"), "total_sec"), B, frames=fx.frames(ev), segs=spoken, dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS,
        walks=ev.filter("kind = 'mouse_up'").select("session_id", F.col("event_id").alias("walk_id"), "t", F.when(F.col("k") % 2 == 0, "keyframe").otherwise("boundary").alias("reason"), (F.col("k") % 7).alias("n_elements"), F.col("k").alias("walk_ms")),
        levels=segs.select("session_id", F.lit(1).alias("level"), F.col("seg_no").alias("node_id"), "t_start", "t_end", F.when(F.col("seg_no") % 5 > 0, F.col("reason")).alias("text")),
        clips=marked.filter("session_id % 4 = 0").select("session_id", F.col("event_id").alias("clip_no"), F.col("t").alias("t_start"), (F.col("t") + 1000).alias("t_end"), F.concat(F.lit("clip "), F.col("event_id").cast("string")).alias("text")),
        audio=marked.select("session_id", F.lit("mic").alias("media"), (F.col("t") / 1000).alias("start_sec"), F.lit(3600.0).alias("duration_sec"), F.transform(F.array(F.lit(0), F.lit(1)), lambda i: ((F.col("k") + i * 3) % 10) / 10.0).alias("peaks")),
        displays=_screens(ev),
    )
    return out.select("session_id", "lane_no", "band", "lane", "at", _rounded("start_sec", 3), _rounded("end_sec", 3), *[_rounded(c, 6) for c in ("value", "value2", "peak")], "label")
