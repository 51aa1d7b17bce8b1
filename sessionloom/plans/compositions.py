"""Queries over compositions, and streams run over the event table as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import library, routes, segments, temporal, traces, vectors
from sessionloom.plans.events import _segments
from sessionloom.plans.graphs import _ST, _steps, _WK, _walks
from sessionloom.plans.hierarchies import _E, _edges
from sessionloom.plans.registry import query
from sessionloom.plans.search import _patches, _SIM
from sessionloom.plans.spaces import _boxes, _BOX
from sessionloom.sources import fixtures as fx
from sessionloom.sources import tables


@query("s3_media_bytes", "SELECT page_id, octet_length(encode(html))::INTEGER AS length, sha256(html) AS digest FROM pages WHERE length(html) > 0")
def media(spark, d):
    """Pages laid end to end in a media file for every 64 of them, and each page read back as a byte range."""
    pages = fx.table(spark, d, "pages").filter("length(html) > 0").select("page_id", "html", F.floor(F.col("page_id") / 64).alias("bucket"), F.octet_length("html").alias("length"))
    path = f"{tables.shared_dir(spark)}/media-{uuid.uuid4().hex}"
    files = pages.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda p: p["html"]), "").alias("value"))
    files.write.partitionBy("bucket").text(path)
    before = Window.partitionBy("bucket").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pages.select("page_id", F.concat(F.lit("bucket="), F.col("bucket").cast("string")).alias("name"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int").alias("offset"), "length")
    return tables.media_bytes(spark, path, ranges, folder=True).select("page_id", "length", F.sha2("bytes", 256).alias("digest"))


@query("f13_coerce_elements", f"WITH {_BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY idx)::INTEGER AS n FROM bx WHERE region_id % 6 <> 0) SELECT frame_id AS snapshot_id, n - 1 AS idx, CASE WHEN n > 1 THEN n - 2 END AS parent, n - 1 AS depth, role FROM k")
def coerce(spark, d):
    tables.ensure_checkpoint_dir(spark)
    b = _boxes(spark, d)
    role = F.when(F.col("region_id") % 6 == 0, F.lit(None)).otherwise(F.col("role"))
    e = F.struct(role.alias("role"), "label", F.lit("").alias("identifier"), "x", "y", "w", "h", "focused", F.when(F.col("idx") > 1, (F.col("idx") - 2).cast("int")).alias("parent"))
    snaps = b.groupBy(F.col("frame_id").alias("snapshot_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("idx", e.alias("e")))), lambda s: s["e"])).alias("elements"))
    return tables.coerce_elements(snaps).select("snapshot_id", "idx", "parent", "depth", "role")


_KEYS = f"{fx.EV}, mp AS (SELECT session_id, us, event_id FROM ev WHERE kind = 'bookmark'), ky AS (SELECT event_id, session_id, us, k % 5 AS code, k FROM ev WHERE kind = 'key_down')"


@query("f16_decode_keys", f"WITH {_KEYS}, j AS (SELECT ky.*, (SELECT max_by(mp.event_id, (mp.us, mp.event_id)) FROM mp WHERE mp.session_id = ky.session_id AND mp.us <= ky.us) AS m FROM ky) SELECT event_id, CASE WHEN m IS NULL THEN NULL WHEN k % 7 = 0 THEN 'p' || code || (m % 2) ELSE CASE WHEN k % 3 = 0 AND k % 11 = 0 THEN 'B' WHEN k % 11 = 0 THEN 'A' WHEN k % 3 = 0 THEN 'S' ELSE 'p' END || code || (m % 2) END AS char, CASE WHEN k % 7 <> 0 AND m IS NOT NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'alt' END, CASE WHEN k % 7 = 0 THEN 'cmd' END, CASE WHEN k % 3 = 0 THEN 'shift' END], lambda x: x IS NOT NULL), '+') END AS held FROM j")
def decode(spark, d):
    """Scancodes 30 to 34 of a keymap that each bookmark brings."""
    ev = fx.events(spark, d)
    code = lambda i, p: F.concat(F.lit(f"{p}{i}"), (F.col("event_id") % 2).cast("string"))
    entries = [x for i in range(5) for x in (F.lit(library.VIRTUAL_KEYS[30 + i]), F.array(*[code(i, p) for p in "pSAB"]))]
    maps = ev.filter("kind = 'bookmark'").select("session_id", "event_id", "t", F.create_map(*entries).alias("map"))
    mods = F.filter(F.array(F.when(F.col("k") % 7 == 0, "cmd"), F.when(F.col("k") % 3 == 0, "shift"), F.when(F.col("k") % 11 == 0, "alt")), lambda m: m.isNotNull())
    keys = ev.filter("kind = 'key_down'").select("session_id", "event_id", "t", (30 + F.col("k") % 5).alias("scancode"), mods.alias("modifiers"))
    return library.decode_keys(keys, maps).select("event_id", "char", F.array_join("held", "+").alias("held"))


@query("a14_presence_lanes", "WITH s AS (SELECT conv_id AS session_id, CASE WHEN turn % 3 = 0 THEN 'task' ELSE 'action' END AS g, turn * 1000.0::DOUBLE AS t_start, turn * 1000.0::DOUBLE + 1000 AS t_end, text AS transcript, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS caption FROM conversations), n AS (SELECT session_id, g, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT session_id, max_by(g, (n, g)) AS g FROM n GROUP BY session_id), r AS (SELECT s.* FROM s JOIN f USING (session_id, g)) SELECT session_id, 'transcript' AS lane, t_start, t_end, transcript AS text FROM r WHERE trim(transcript) <> '' UNION ALL SELECT session_id, 'caption', t_start, t_end, caption FROM r WHERE trim(caption) <> ''")
def presence(spark, d):
    t = fx.table(spark, d, "conversations")
    at = F.col("turn") * 1000.0
    return library.presence_lanes(t.select(F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 3 == 0, "task").otherwise("action").alias("granularity"), at.alias("t_start"), (at + 1000).alias("t_end"), F.col("text").alias("transcript"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("caption"), F.lit(None).cast("string").alias("app_caption")))


@query("a15_level_lanes", "WITH n AS (SELECT o_orderkey AS node_id, o_custkey AS session_id, o_orderkey % 3 AS level FROM orders) SELECT session_id, level, node_id, CASE WHEN node_id % 5 <> 0 THEN 's' || node_id END AS text, bool_and(node_id % 5 = 0 OR node_id % 4 <> 0) OVER (PARTITION BY session_id, level) AS templated FROM n")
def levels(spark, d):
    nodes = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 3).alias("level"))
    said = nodes.filter("node_id % 5 <> 0").select("node_id", F.concat(F.lit("s"), F.col("node_id").cast("string")).alias("summary"), F.when(F.col("node_id") % 4 == 0, "model").otherwise("template").alias("source"))
    return library.level_lanes(nodes, said)


@query("t14_frame_recall", f"WITH {fx.EV}, {_SIM} SELECT session_id % 5 AS query_id, event_id AS id, NULL::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY session_id % 5 ORDER BY event_id) AS n FROM ev WHERE event_id % 5 = 0) WHERE n <= 30 AND session_id % 5 > 0 UNION ALL SELECT query_id, id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM sc WHERE query_id = 0) WHERE n <= 30")
def recall(spark, d):
    """The first query has vectors, the others only a scope."""
    frames = fx.frames(fx.events(spark, d))
    scope = frames.select((F.col("session_id") % 5).alias("query_id"), F.col("session_id").alias("segment_id")).distinct()
    base = _patches(spark, d)
    scored = vectors.maxsim(base.filter("id = 0").select(F.col("id").alias("query_id"), "patches"), base, 30)
    return library.frame_recall(scored, scope, frames.select(F.col("session_id").alias("segment_id"), "frame_id"), 30)


_TASKS = "sm AS (SELECT 'n' || n_nationkey AS id, n_name AS summary FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region WHERE r_regionkey > 0), tk AS (SELECT clo.x AS id, min_by(summary, depth) AS task FROM clo JOIN sm ON sm.id = clo.a GROUP BY clo.x)"


def _tasks(spark, d):
    """The tree of customers below nations below regions, with summaries of some nations and regions."""
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region").filter("r_regionkey > 0")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    said = nation.filter("n_nationkey % 2 = 0").select(name("n", "n_nationkey"), F.col("n_name").alias("summary")).unionByName(region.select(name("r", "r_regionkey"), F.col("r_name").alias("summary")))
    return {"edges": _edges(spark, d), "summaries": said}


@query("t20_enriched_hits", f"WITH RECURSIVE {fx.EV}, {_E}, {_TASKS}, en AS (SELECT session_id, max(us) AS e FROM ev GROUP BY session_id) SELECT session_id % 9 AS query_id, event_id AS frame_id, session_id, round(session_id * 1000 + us / 1000.0::DOUBLE, 3) AS wall_ms, round(us / 1000000.0::DOUBLE, 6) AS offset_sec, round(e / 1000000.0::DOUBLE, 6) AS session_sec, (SELECT max_by(f.app, (f.us, f.event_id)) FROM ev f WHERE f.session_id = ev.session_id AND f.us <= ev.us AND f.kind = 'focus_change') AS app, task FROM ev JOIN en USING (session_id) LEFT JOIN tk ON tk.id = 'c' || (1 + event_id % 120) WHERE event_id % 5 = 0")
def enriched(spark, d):
    ev = fx.events(spark, d)
    frames = fx.frames(ev)
    sessions = segments.session_ends(ev).select("session_id", (F.col("session_id") * 1000).alias("started_at"), "t_end")
    out = library.enrich_hits(frames.select((F.col("session_id") % 9).alias("query_id"), "frame_id", F.concat(F.lit("c"), (1 + F.col("frame_id") % 120).cast("string")).alias("segment_id")), frames.select("frame_id", "session_id", "t"), sessions, ev.filter("kind = 'focus_change'"), **_tasks(spark, d))
    return out.withColumns({"wall_ms": F.round("wall_ms", 3), "offset_sec": F.round("offset_sec", 6), "session_sec": F.round("session_sec", 6)})


@query("t21_moments", f"WITH RECURSIVE {_BOX}, {_E}, {_TASKS}, hl AS (SELECT frame_id, string_agg(role || ' \"' || label || '\" (' || CASE WHEN idx % 2 = 0 THEN 'label+patch' ELSE 'patch' END || ')', ', ' ORDER BY idx % 3 DESC, region_id) AS regions FROM bx WHERE idx % 4 > 0 GROUP BY frame_id), lb AS (SELECT frame_id, string_agg(label, ',' ORDER BY idx) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY idx) AS n FROM bx WHERE label <> '') WHERE n <= 3 GROUP BY frame_id) SELECT o_orderkey AS frame_id, 'order of ' || o_custkey AS texts, labels, task, regions FROM orders LEFT JOIN lb ON lb.frame_id = o_orderkey LEFT JOIN hl ON hl.frame_id = o_orderkey LEFT JOIN tk ON tk.id = 'c' || o_custkey")
def moments(spark, d):
    o = fx.table(spark, d, "orders")
    segment = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("segment_id")
    b = _boxes(spark, d)
    shown = b.filter("idx % 4 > 0").select("frame_id", "region_id", "role", "label", F.when(F.col("idx") % 2 == 0, F.array(F.lit("label"), F.lit("patch"))).otherwise(F.array(F.lit("patch"))).alias("matched_by"), (F.col("idx") % 3).alias("strength"))
    texts = o.select(segment, F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("text")).distinct()
    out = library.moment(o.select(F.col("o_orderkey").alias("frame_id")), o.select(F.col("o_orderkey").alias("frame_id"), segment), texts, b, 3, highlights=shown, **_tasks(spark, d))
    return out.select("frame_id", F.array_join("texts", ",").alias("texts"), F.array_join("labels", ",").alias("labels"), "task", F.array_join("regions", ", ").alias("regions"))


@query("r8_region_job")
def region_job(spark, d):
    tables.ensure_checkpoint_dir(spark)
    ev = fx.events(spark, d)
    segs, _ = _segments(ev)
    segs = segs.withColumn("segment_id", F.concat_ws("-", F.col("session_id").cast("string"), F.col("seg_no").cast("string"))).select("session_id", "segment_id", "t_start", "t_end")
    frames = fx.frames(ev)
    # frames have ids that divide by five, so elements of other ids are left out before they are numbered
    elements = _boxes(spark, d).filter("frame_id % 5 = 0").join(frames.select("frame_id"), "frame_id", "left_semi")
    return library.region_job(frames, segs, ev, elements, size=(1920.0, 1080.0)).select("frame_id", "region_id", "source", F.round("priority", 6).alias("priority"))


def _elements(spark, d):
    b = _boxes(spark, d)
    role = F.when(F.col("idx") % 5 == 0, "AXTabGroup").otherwise("AXButton")
    return b.select(F.col("frame_id").alias("snapshot_id"), "idx", F.when(F.col("idx") > 1, F.col("idx") - 1).alias("parent"), role.alias("role"), "label", F.when(F.col("idx") % 4 == 0, F.concat(F.lit("id"), F.col("idx").cast("string"))).otherwise("").alias("identifier"), F.col("idx").alias("depth"), "focused")


_ARGS = "CASE WHEN idx % 4 = 0 THEN 'identifier=id' || idx WHEN label <> '' THEN 'label=' || label END"
_LISTED = f"""{_BOX}, st AS (SELECT *, {_ARGS} AS a, CASE WHEN idx % 4 = 0 THEN 'id' || idx ELSE label END AS descriptor FROM bx WHERE idx < 5 AND {_ARGS} IS NOT NULL),
ls AS (SELECT frame_id, 'ax_exists(' || a || ',role=Button)' AS key, row_number() OVER (PARTITION BY frame_id ORDER BY min((idx, descriptor)), a) AS ord FROM st GROUP BY frame_id, a)"""


@query("m1_element_predicates", f"WITH {_LISTED} SELECT frame_id AS snapshot_id, key, ord::INTEGER AS ord FROM ls WHERE ord <= 64")
def element_predicates(spark, d):
    return traces.element_predicates(_elements(spark, d))


@query("m1_predicates", f"""WITH {_LISTED}, fo AS (SELECT frame_id, min(idx) AS idx FROM bx WHERE focused GROUP BY frame_id), o AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders), e AS (
SELECT id, 0 AS part, 0 AS i, 'app' AS kind, 'app(app=app' || (c % 9) || ')' AS key FROM o UNION ALL SELECT id, 0, 1, 'url', 'url(prefix=site' || (c % 7) || '.example/docs)' FROM o
UNION ALL SELECT id, 0, 2, 'display', 'display(h=1080,id=d1,w=1920)' FROM o UNION ALL SELECT id, 0, 3, 'file', 'file(path=/f/' || id || ')' FROM o WHERE id % 5 = 0
UNION ALL SELECT frame_id, 1, 0, 'ax_focused', 'ax_focused(' || a || ',role=Button)' FROM st JOIN fo USING (frame_id, idx) UNION ALL SELECT frame_id, 2, ord, 'ax_exists', key FROM ls WHERE ord <= 64)
SELECT id AS snapshot_id, kind, key, row_number() OVER (PARTITION BY id ORDER BY part, i)::INTEGER AS ord FROM e""")
def predicates(spark, d):
    el = _elements(spark, d)
    frame = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.concat(F.lit("app"), (F.col("o_custkey") % 9).cast("string")).alias("app"), F.concat(F.lit("https://www.site"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example/docs/"), F.col("o_orderkey").cast("string")).alias("url"))
    frame = frame.withColumns({"displays": F.array(F.struct(F.lit("d1").alias("id"), F.lit(1920).alias("w"), F.lit(1080).alias("h"))), "files": F.when(F.col("snapshot_id") % 5 == 0, F.array(F.concat(F.lit("/f/"), F.col("snapshot_id").cast("string"))))})
    return traces.predicates(el, frame)


@query("m3_anchors", f"""WITH {fx.EV}, {_BOX}, p AS (SELECT region_id AS point_id, frame_id, frame_id % 150 AS session_id, frame_id * 1000 * 1000 AS us, x + w / 2 AS px, y + h / 2 AS py FROM bx WHERE idx = 1),
s AS (SELECT frame_id, idx, role || '[' || (row_number() OVER (PARTITION BY frame_id, idx // 2, role ORDER BY idx) - 1) || ']' AS s FROM bx),
h AS (SELECT point_id, bx.*, row_number() OVER (PARTITION BY point_id ORDER BY floor(log2(idx)) DESC, w * h, idx) AS r FROM p JOIN bx USING (frame_id) WHERE px BETWEEN x AND x + w AND py BETWEEN y AND y + h),
n AS (SELECT point_id, max_by(ev.x, (ev.us, event_id)) AS wx, max_by(ev.y, (ev.us, event_id)) AS wy FROM p JOIN ev ON ev.session_id = p.session_id AND kind = 'focus_change' AND ev.us <= p.us GROUP BY point_id)
SELECT p.point_id, h.role, nullif(h.label, '') AS label, CASE WHEN h.idx % 4 = 0 THEN 'id' || h.idx END AS identifier, concat_ws('>', s3.s, s2.s, s1.s, s0.s) AS path, g.region_id, px - wx AS rel_x, py - wy AS rel_y
FROM p JOIN h ON h.point_id = p.point_id AND r = 1 LEFT JOIN (SELECT point_id, min_by(region_id, (w * h, region_id)) AS region_id FROM h WHERE label <> '' GROUP BY point_id) g ON g.point_id = p.point_id JOIN s s0 ON s0.frame_id = h.frame_id AND s0.idx = h.idx LEFT JOIN s s1 ON s1.frame_id = h.frame_id AND s1.idx = h.idx // 2 LEFT JOIN s s2 ON s2.frame_id = h.frame_id AND s2.idx = h.idx // 4 LEFT JOIN s s3 ON s3.frame_id = h.frame_id AND s3.idx = h.idx // 8 LEFT JOIN n ON n.point_id = p.point_id""")
def anchors(spark, d):
    b = _boxes(spark, d)
    points = b.filter("idx = 1").select(F.col("region_id").alias("point_id"), F.col("frame_id").alias("snapshot_id"), "frame_id", (F.col("frame_id") % 150).alias("session_id"), F.col("region_id").alias("event_id"), (F.col("frame_id") * 1000.0).alias("t"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    windows = fx.events(spark, d).filter("kind = 'focus_change'").select("session_id", "event_id", "t", F.col("x").alias("wx"), F.col("y").alias("wy"))
    return library.build_anchors(points, b.withColumns({"snapshot_id": F.col("frame_id"), "parent": F.when(F.col("idx") > 1, F.floor(F.col("idx") / 2)), "depth": F.floor(F.log2(F.col("idx").cast("double"))), "identifier": F.when(F.col("idx") % 4 == 0, F.concat(F.lit("id"), F.col("idx").cast("string"))).otherwise("")}), b, windows)


@query("m5_waits", f"WITH {_ST}, s AS (SELECT sess AS session_id, row_number() OVER (PARTITION BY sess ORDER BY t, ord) AS n, f, g, t - lag(t) OVER (PARTITION BY sess ORDER BY t, ord) AS gap FROM st) SELECT session_id, n::INTEGER AS n, CASE WHEN f <> g THEN 'app(' || g || ')' ELSE 'warning: nothing to wait for' END AS wait, greatest(3000, round(3 * coalesce(gap, 0) / 1000.0::DOUBLE)) AS timeout FROM s")
def waits(spark, d):
    s = _steps(spark, d)
    w = Window.partitionBy("session_id").orderBy("t", "ord")
    e = s.select("session_id", F.row_number().over(w).alias("n"), "from_place", "to_place", (F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0)) / 1000.0).alias("gap_ms"))
    state = lambda c: e.select("session_id", "n", F.lit("app").alias("kind"), F.concat(F.lit("app("), F.col(c), F.lit(")")).alias("key"))
    return traces.waits(state("from_place"), state("to_place"), e.select("session_id", "n", "gap_ms"))


@query("m11_variables", f"WITH {fx.EV} SELECT 'slot' || (k % 9) AS slot FROM ev WHERE kind = 'key_down' GROUP BY ALL HAVING count(DISTINCT k % 18) > 1")
def variables(spark, d):
    ev = fx.events(spark, d).filter("kind = 'key_down'")
    return traces.slots(ev.select(F.concat(F.lit("slot"), (F.col("k") % 9).cast("string")).alias("slot"), F.concat(F.lit("v"), (F.col("k") % 18).cast("string")).alias("text"))).filter("variable").select("slot")


@query("m12_rebuild_report", f"WITH {fx.EV}, f AS (SELECT *, CASE WHEN kind = 'focus_change' THEN coalesce(app = 'app2', false) END AS hit FROM ev), m AS (SELECT *, coalesce(coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), first_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), false) AS s FROM f), e AS (SELECT session_id, count(*) AS n FROM ev WHERE kind = 'mouse_down' AND session_id % 6 <> 0 GROUP BY session_id) SELECT session_id, count(*) FILTER (WHERE NOT s) AS n_events, coalesce(any_value(n), 0) AS n_edges, any_value(n) IS NULL AS skipped, coalesce(string_agg(DISTINCT CASE WHEN s AND kind = 'focus_change' THEN app END, ','), '') AS apps FROM m LEFT JOIN e USING (session_id) GROUP BY session_id")
def rebuild(spark, d):
    ev = fx.events(spark, d)
    return library.rebuild_report(temporal.exclude_focused(ev, ["app2"]), ev.filter("kind = 'mouse_down' and session_id % 6 <> 0"))


@query("m23_flow_variables", f"WITH {_WK}, ed AS (SELECT k, unnest(edges) AS e, generate_subscripts(edges, 1) AS i FROM wk), a AS (SELECT k, split_part(e, '>', 2) AS app, min(i) AS i FROM ed GROUP BY ALL), s AS (SELECT k, string_agg(DISTINCT 't' || length(e) % 4, ',' ORDER BY 't' || length(e) % 4) AS samples FROM ed GROUP BY k) SELECT a.k AS route_key, samples, string_agg(app, ',' ORDER BY i, app) AS apps FROM a JOIN s USING (k) GROUP BY ALL")
def flow_variables(spark, d):
    w = _walks(spark, d)
    e = w.select(F.explode("edges").alias("edge_id")).distinct()
    return library.flow_variables(w, e.select("edge_id", F.concat(F.lit("t"), (F.length("edge_id") % 4).cast("string")).alias("text")), e.select("edge_id", F.element_at(F.split("edge_id", ">"), 2).alias("app")))


@query("m27_walk_marks", f"WITH {_WK}, r AS (SELECT k, list(sess) AS live FROM wk GROUP BY k), x AS (SELECT k, unnest(live) AS sess, live FROM r), s AS (SELECT sess AS session_id, min(t) AS started_at FROM st GROUP BY sess) SELECT k AS habit_id, session_id, started_at, split_part(sess, '-', 1)::BIGINT % 2 = 1 AS gained, row_number() OVER (PARTITION BY k ORDER BY started_at, session_id)::INTEGER AS place FROM x JOIN s ON session_id = sess")
def walk_marks(spark, d):
    w = _walks(spark, d)
    live = routes.frequent_routes(w).select(F.col("route_key").alias("habit_id"), F.col("sessions").alias("live"))
    bound = live.withColumn("sessions", F.filter("live", lambda s: F.element_at(F.split(s, "-"), 1).cast("long") % 2 == 0))
    return library.walk_marks(bound, w.select("session_id", F.col("t_start").alias("started_at")))
