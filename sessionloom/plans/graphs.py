"""Queries over walks and states: a session is a user's day, a place the kind of an event."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import evaluate, rebuild, routes, segments, traces
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources.tables import ensure_checkpoint_dir, shared_dir

DAY = 86_400_000_000


def _steps(spark, d):
    ev = fx.events(spark, d).withColumn("session", F.concat_ws("-", F.col("session_id").cast("string"), F.floor(F.col("us") / (4 * DAY)).cast("string")))
    w = Window.partitionBy("session").orderBy("us", "event_id")
    s = ev.select(F.col("session").alias("session_id"), F.col("us").alias("t"), F.col("event_id").alias("ord"), F.lag("kind").over(w).alias("from_place"), F.col("kind").alias("to_place"), F.col("us").alias("t_end")).filter("from_place is not null")
    return s.withColumn("edge_id", F.concat_ws(">", "from_place", "to_place"))


_ST = f"{fx.EV}, st AS (SELECT * FROM (SELECT session_id || '-' || (us // {4 * DAY}) AS sess, us AS t, event_id AS ord, lag(kind) OVER (PARTITION BY session_id, us // {4 * DAY} ORDER BY us, event_id) AS f, kind AS g, session_id FROM ev) WHERE f IS NOT NULL)"
_WK = f"""{_ST}, fl AS (SELECT sess, 0 AS o, t, ord, f AS p FROM (SELECT *, row_number() OVER (PARTITION BY sess ORDER BY t, ord) AS n FROM st) WHERE n = 1 UNION ALL SELECT sess, 1, t, ord, g FROM st),
dd AS (SELECT *, lag(p) OVER (PARTITION BY sess ORDER BY o, t, ord) AS b FROM fl), pl AS (SELECT sess, list(p ORDER BY o, t, ord) AS places FROM dd WHERE b IS NULL OR b <> p GROUP BY sess),
eg AS (SELECT sess, list(f || '>' || g ORDER BY t, ord) AS edges, min(t) AS t0, max(t) AS t1 FROM st GROUP BY sess), wk AS (SELECT sess, places, array_to_string(places, ' → ') AS k, edges, t0, t1 FROM pl JOIN eg USING (sess))"""


def _walks(spark, d):
    return routes.walks(_steps(spark, d))


@query("m16_walks", f"WITH {_WK} SELECT sess AS session_id, k AS route_key, len(edges)::INTEGER AS n_edges, t0 AS t_start, t1 AS t_end FROM wk")
def walks(spark, d):
    return _walks(spark, d).select("session_id", "route_key", F.size("edges").alias("n_edges"), "t_start", "t_end")


_RT = f"{_WK}, rt AS (SELECT k, any_value(places) AS places, count(*) AS n FROM wk GROUP BY k)"


@query("m21_frequent_routes", f"WITH {_RT}, ne AS (SELECT k, count(DISTINCT e) AS n_edges FROM (SELECT k, unnest(edges) AS e FROM wk) GROUP BY k) SELECT k AS route_key, n AS n_sessions, n_edges::INTEGER AS n_edges FROM rt JOIN ne USING (k)")
def frequent(spark, d):
    return routes.frequent_routes(_walks(spark, d)).select("route_key", "n_sessions", "n_edges")


def _routes(spark, d):
    return routes.frequent_routes(_walks(spark, d))


@query("m17_similarity", f"WITH {_RT}, p AS (SELECT a.k AS a_key, b.k AS b_key, a.places AS x, b.places AS y FROM rt a JOIN rt b ON a.k <> b.k AND a.places[1] = b.places[1] AND a.places[-1] = b.places[-1] AND length(a.k) % 50 = 0) SELECT a_key, b_key, round(len(list_intersect(list_distinct(x), list_distinct(y)))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM p")
def similar(spark, d):
    """Routes whose key has a length divisible by 50, against all that begin and end alike."""
    ensure_checkpoint_dir(spark)
    r = _routes(spark, d).select("route_key", "places", F.struct(F.element_at("places", 1).alias("f"), F.element_at("places", -1).alias("l")).alias("ends")).checkpoint()  # read four times
    return routes.shared(r.filter("length(route_key) % 50 = 0"), r, "ends").select("a_key", "b_key", F.round("jaccard", 6).alias("jaccard"))


@query("m17_lcs")
def lcs(spark, d):
    """Routes whose key has a length divisible by 50, against all that begin alike."""
    ensure_checkpoint_dir(spark)
    r = _routes(spark, d).select("route_key", "places", F.element_at("places", 1).alias("f")).checkpoint()  # read four times
    return routes.against(r.filter("length(route_key) % 50 = 0"), r, "f").select("a_key", "b_key", "lcs", "gap", F.round("lcs_ratio", 6).alias("lcs_ratio"))


_CP = f"""{_RT}, l1 AS (SELECT k, list_concat(list_slice(places, 1, i - 1), list_slice(places, i + 1, len(places))) AS p FROM rt, range(2, len(places)) r(i)), l2 AS (SELECT k, list_concat(list_slice(p, 1, i - 1), list_slice(p, i + 1, len(p))) AS p FROM l1, range(2, len(p)) r(i)),
fm AS (SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT k, places[1:1] FROM rt WHERE len(places) IN (2, 3) AND places[1] = places[-1])"""


@query("m18_compatible", f"WITH {_CP} SELECT DISTINCT least(fm.k, rt.k) AS a_key, greatest(fm.k, rt.k) AS b_key FROM fm JOIN rt ON fm.p = rt.places AND fm.k <> rt.k")
def compatible(spark, d):
    return routes.compatible_pairs(_routes(spark, d))


@query("m19_clusters")
def clusters(spark, d):
    ensure_checkpoint_dir(spark)
    return routes.cluster_routes(_routes(spark, d))


@query("e4_rule_sweep")
def rule_sweep(spark, d):
    """Clusters under each rule, on all routes."""
    ensure_checkpoint_dir(spark)
    r = _routes(spark, d).checkpoint()
    out = None
    for name, rule in (("exact", {"rule": "exact"}), ("insertions 1", {"budget": 1}), ("insertions 2", {"budget": 2}), ("jaccard", {"rule": "jaccard", "least": 0.9}), ("lcs", {"rule": "lcs", "least": 0.9})):
        one = routes.cluster_routes(r, **rule).agg(F.lit(name).alias("rule"), F.countDistinct("canonical").alias("clusters"), F.count("*").alias("routes"))
        out = one if out is None else out.unionByName(one)
    return out


@query("e5_key_stability", f"WITH {_WK}, a AS (SELECT DISTINCT k FROM wk WHERE t0 < {15 * DAY}), b AS (SELECT DISTINCT k FROM wk WHERE t0 >= {15 * DAY}) SELECT k AS route_key, 'lost' AS change FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'gained' FROM b WHERE k NOT IN (SELECT k FROM a)")
def stability(spark, d):
    w = _walks(spark, d)
    return evaluate.key_stability(w.filter(F.col("t_start") < 15 * DAY), w.filter(F.col("t_start") >= 15 * DAY))


_TRANSFER = f"""WITH RECURSIVE {_RT}, r2 AS (SELECT k AS route_id, places, len(places) AS n_steps FROM rt WHERE n > 1), sp2 AS (SELECT route_id, unnest(places) AS node, generate_subscripts(places, 1) - 1 AS step FROM r2),
tl AS (SELECT session_id, kind AS node, list(DISTINCT t) AS ts FROM ev GROUP BY ALL), ss AS (SELECT DISTINCT session_id, session_id % 3 <> 0 AS held_out FROM ev),
tr AS (SELECT route_id, session_id, -1::BIGINT AS step, -1e300::DOUBLE AS t, 0 AS m FROM r2, ss
  UNION ALL SELECT tr.route_id, tr.session_id, tr.step + 1, coalesce(list_min(list_filter(ts, lambda x: x >= tr.t)), tr.t), tr.m + (list_min(list_filter(ts, lambda x: x >= tr.t)) IS NOT NULL)::INTEGER FROM tr JOIN sp2 ON sp2.route_id = tr.route_id AND sp2.step = tr.step + 1 LEFT JOIN tl ON tl.session_id = tr.session_id AND tl.node = sp2.node)
SELECT route_id, held_out, count(*) AS n, count(*) FILTER (WHERE m = n_steps) AS whole, round(sum(m::DOUBLE / n_steps) / count(*), 6) AS mean_share FROM tr JOIN r2 USING (route_id) JOIN ss USING (session_id) WHERE step = n_steps - 1 GROUP BY route_id, held_out"""


@query("e6_transfer", _TRANSFER)
def transfer(spark, d):
    """Routes that two sessions share (of others no session is left to hold out) in all sessions; every third is a control."""
    r = _routes(spark, d).filter("n_sessions > 1")
    steps = r.select(F.col("route_key").alias("route_id"), F.posexplode("places").alias("step", "node"))
    ev = fx.events(spark, d).select("session_id", F.col("kind").alias("node"), "t")
    out = evaluate.transfer_report(steps, ev, ev.filter("session_id % 3 = 0").select("session_id"))
    return out.withColumn("mean_share", F.round("mean_share", 6))


@query("m20_route_names", f"WITH {_WK}, sm AS (SELECT session_id || '-' || (us // {4 * DAY}) AS sess, k % 3 AS level, us - 2 * {DAY} AS s0, us + 2 * {DAY} AS s1, 'task ' || (k % 5) AS name FROM ev WHERE kind = 'bookmark'), v AS (SELECT k, sess, name, row_number() OVER (PARTITION BY k, sess ORDER BY level, -(least(t1, s1) - greatest(t0, s0)), name) AS r FROM wk JOIN sm USING (sess) WHERE 2 * (least(t1, s1) - greatest(t0, s0)) > t1 - t0), n AS (SELECT k, name, count(*) AS votes, min(sess) AS first FROM v WHERE r = 1 GROUP BY ALL) SELECT k AS route_key, name, votes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, first) AS r FROM n) WHERE r = 1")
def names(spark, d):
    ev = fx.events(spark, d).filter("kind = 'bookmark'")
    said = ev.select(F.concat_ws("-", F.col("session_id").cast("string"), F.floor(F.col("us") / (4 * DAY)).cast("string")).alias("session_id"), (F.col("k") % 3).alias("level"), (F.col("us") - 2 * DAY).alias("s_start"), (F.col("us") + 2 * DAY).alias("s_end"), F.concat(F.lit("task "), (F.col("k") % 5).cast("string")).alias("name"))
    return routes.route_names(_walks(spark, d).select("route_key", "session_id", "t_start", "t_end"), said)


@query("m22_flow_walks", f"WITH {_WK} SELECT k AS route_key, array_to_string(edges, ',') AS path, any_value(len(edges))::INTEGER AS length, count(DISTINCT sess) AS sessions FROM wk GROUP BY ALL")
def flow_walks(spark, d):
    return routes.flow_walks(_walks(spark, d))


@query("m22_flow_steps", f"WITH {_WK}, n AS (SELECT k, count(DISTINCT sess) AS n FROM wk GROUP BY k), e AS (SELECT k, edge, count(DISTINCT sess) AS o FROM (SELECT k, sess, unnest(edges) AS edge FROM wk) GROUP BY ALL) SELECT k AS route_key, edge AS edge_id, o AS observations, o = n AS every_recording FROM e JOIN n USING (k)")
def flow_steps(spark, d):
    return routes.flow_steps(_walks(spark, d))


@query("m24_ways", f"WITH {_WK} SELECT k AS route_key, array_to_string(list_sort(list_distinct(list(len(edges))), 'DESC'), ',') AS lengths FROM wk GROUP BY k")
def ways(spark, d):
    return routes.ways(_walks(spark, d)).select("route_key", F.array_join(F.col("lengths").cast("array<string>"), ",").alias("lengths"))


def _habits(spark, d):
    """Habits are the routes of the first half of users' sessions; live routes those of all."""
    w = _walks(spark, d)
    early = routes.frequent_routes(w.filter(F.col("t_start") < 15 * DAY)).filter("n_sessions > 1")
    habit = early.select(F.col("route_key").alias("habit_id"), F.when(F.length("route_key") % 3 == 0, F.concat(F.col("route_key"), F.lit(" → gone"))).otherwise(F.col("route_key")).alias("route_key"), "sessions")
    return habit, routes.frequent_routes(w).select("route_key", "sessions")


_HB = f"""{_WK}, ea AS (SELECT k, list(DISTINCT sess) AS s FROM wk WHERE t0 < {15 * DAY} GROUP BY k HAVING count(DISTINCT sess) > 1), hb AS (SELECT k AS habit_id, CASE WHEN length(k) % 3 = 0 THEN k || ' → gone' ELSE k END AS key, s FROM ea),
lv AS (SELECT k, list(DISTINCT sess) AS live FROM wk GROUP BY k), ex AS (SELECT habit_id, 'exact' AS state, key AS bound_key, s, live FROM hb JOIN lv ON key = k), ot AS (SELECT * FROM hb WHERE habit_id NOT IN (SELECT habit_id FROM ex)),
ov AS (SELECT habit_id, s, k, live FROM ot JOIN lv ON 2 * len(list_intersect(s, live)) > len(s)), oc AS (SELECT habit_id, count(*) AS c, min(k) AS k FROM ov GROUP BY habit_id),
rs AS (SELECT habit_id, CASE WHEN c IS NULL THEN 'orphaned' WHEN c = 1 THEN 'rebound' ELSE 'ambiguous' END AS state, CASE WHEN c = 1 THEN lv.k END AS bound_key, s, CASE WHEN c = 1 THEN live END AS live FROM ot LEFT JOIN oc USING (habit_id) LEFT JOIN lv ON lv.k = oc.k),
bd AS (SELECT * FROM ex UNION ALL SELECT * FROM rs)"""


@query("m25_bind_habits", f"WITH {_HB} SELECT habit_id, state, bound_key, (len(s) - coalesce(len(list_intersect(s, live)), 0))::INTEGER AS lost, coalesce(len(live) - len(list_intersect(s, live)), 0)::INTEGER AS gained FROM bd")
def bind(spark, d):
    return routes.bind_habits(*_habits(spark, d))


@query("m26_habit_conflicts", f"WITH {_HB}, cl AS (SELECT bound_key AS k, count(*) AS n FROM bd WHERE bound_key IS NOT NULL GROUP BY ALL) SELECT k AS route_key, 'duplicate' AS issue FROM cl WHERE n > 1 UNION ALL SELECT k, 'unclaimed' FROM lv WHERE k NOT IN (SELECT k FROM cl)")
def conflicts(spark, d):
    habit, live = _habits(spark, d)
    return routes.habit_conflicts(routes.bind_habits(habit, live), live)


_FACTS = f"""{_CP}, pr AS (SELECT DISTINCT least(fm.k, rt.k) AS a, greatest(fm.k, rt.k) AS b FROM fm JOIN rt ON fm.p = rt.places AND fm.k <> rt.k), nf AS (SELECT k, count(*) AS n_folded FROM (SELECT a AS k FROM pr UNION ALL SELECT b FROM pr) GROUP BY k),
w AS (SELECT k, count(DISTINCT len(edges)) AS ways, count(DISTINCT split_part(sess, '-', 2)::INTEGER % 3) AS n_names FROM wk GROUP BY k),
es AS (SELECT k, x AS e, count(DISTINCT sess) AS c FROM (SELECT k, sess, unnest(edges) AS x FROM wk) GROUP BY ALL), sh AS (SELECT k, count(*) FILTER (WHERE c < n) AS part, avg((length(e) % 2 = 1)::INTEGER) AS share FROM es JOIN rt USING (k) GROUP BY k)"""


@query("m28_cautions", f"WITH {_FACTS} SELECT k AS route_key, unnest(list_filter([CASE WHEN n = 1 THEN 'seen once' END, CASE WHEN n_names > 1 THEN 'names disagree' END, CASE WHEN n_folded > 0 THEN 'variants folded' END, CASE WHEN ways > 1 THEN 'several ways' END, CASE WHEN part > 0 THEN 'steps not in every recording' END, CASE WHEN share > 0.5 THEN 'mostly coordinates' END, CASE WHEN list_contains(places, 'mouse_up') THEN 'states that cannot be located' END], lambda c: c IS NOT NULL)) AS caution FROM rt JOIN w USING (k) JOIN sh USING (k) LEFT JOIN nf USING (k)")
def cautions(spark, d):
    """All seven; a session's name follows from its number, elements are known of edges whose name has an even length."""
    walked = _walks(spark, d)
    names = walked.select("session_id", F.concat(F.lit("task "), (F.element_at(F.split("session_id", "-"), 2).cast("int") % 3).cast("string")).alias("name"))
    edges = walked.select(F.explode("edges").alias("edge_id")).distinct().select("edge_id", (F.length("edge_id") % 2 == 0).alias("has_ax"))
    lost = spark.createDataFrame([("mouse_up",)], "place string")
    return routes.cautions(routes.route_facts(walked, names, routes.compatible_pairs(_routes(spark, d)), edges, lost))


_EDGE = f"{_ST}, eg AS (SELECT f, g, count(*) AS n, count(*) FILTER (WHERE ord % 2 = 0) AS a, count(*) FILTER (WHERE ord % 4 = 0) AS s FROM st GROUP BY ALL), co AS (SELECT f, g, 1 / (1 + n * CASE WHEN a > 0 THEN s::DOUBLE / a ELSE 0.5 END) AS c FROM eg)"


def _edges(spark, d):
    s = _steps(spark, d)
    g = s.groupBy(F.col("from_place").alias("from_node"), F.col("to_place").alias("to_node")).agg(F.count("*").alias("observations"), F.count_if(F.col("ord") % 2 == 0).alias("attempts"), F.count_if(F.col("ord") % 4 == 0).alias("successes"))
    return routes.edge_costs(g)


@query("m29_cheapest_paths", f"WITH RECURSIVE {_EDGE}, pt AS (SELECT f AS source, f AS node, 0.0::DOUBLE AS c, 0 AS h FROM (SELECT DISTINCT f FROM co) UNION ALL SELECT source, g, pt.c + co.c, h + 1 FROM pt JOIN co ON pt.node = co.f AND co.f <> co.g WHERE h < 4) SELECT source, node, round(min(c), 6) AS cost FROM pt GROUP BY ALL")
def cheapest(spark, d):
    ensure_checkpoint_dir(spark)
    e = _edges(spark, d)
    return routes.cheapest(e, e.select(F.col("from_node").alias("node")).distinct()).withColumn("cost", F.round("cost", 6))


@query("m30_brittleness", f"WITH {_ST}, b AS (SELECT f || '>' || g AS edge_id, avg((ord % 2 = 0)::INTEGER) AS s FROM st GROUP BY ALL) SELECT edge_id, round(s, 6) AS share, s < 0.5 AS brittle FROM b")
def brittle(spark, d):
    return routes.brittleness(_steps(spark, d).select("edge_id", (F.col("ord") % 2 == 0).alias("has_ax"))).withColumn("share", F.round("share", 6))


def _predicates(spark, d):
    """An order is a node; each line asserts its flag, status and supplier modulo 5."""
    li = fx.table(spark, d, "lineitem")
    args = F.create_map(F.lit("supp"), (F.col("l_suppkey") % 5).cast("string"), F.lit("status"), F.col("l_linestatus"))
    rows = li.select((F.col("l_orderkey") % 50).alias("session_id"), F.col("l_orderkey").alias("node_id"), F.col("l_returnflag").alias("kind"), traces.predicate_key(F.col("l_returnflag"), args).alias("key"))
    return rows.distinct()


_PR = "pr AS (SELECT DISTINCT l_orderkey % 50 AS session_id, l_orderkey AS node_id, l_returnflag AS kind, l_returnflag || '(status=' || l_linestatus || ',supp=' || (l_suppkey % 5) || ')' AS key FROM lineitem)"


@query("m2_predicate_keys", f"WITH {_PR} SELECT node_id, key FROM pr")
def predicate_keys(spark, d):
    return _predicates(spark, d).select("node_id", "key")


@query("m9_merge_nodes", f"WITH {_PR} SELECT session_id, node_id, sha256(string_agg(key, chr(1) ORDER BY key)) AS state, count(*)::INTEGER AS n_predicates FROM pr GROUP BY ALL")
def merge_nodes(spark, d):
    return traces.merge_nodes(_predicates(spark, d))


_NX = f"{_PR}, nd AS (SELECT session_id, node_id, sha256(string_agg(key, chr(1) ORDER BY key)) AS state FROM pr GROUP BY ALL), nx AS (SELECT session_id, node_id, lead(node_id) OVER (PARTITION BY session_id ORDER BY node_id) AS nxt, state, lead(state) OVER (PARTITION BY session_id ORDER BY node_id) AS nstate FROM nd)"


@query("m9_merge_edges", f"WITH {_NX} SELECT state AS from_state, nstate AS to_state, 'sig' || (node_id % 2) AS signature, count(*) AS observations, count(DISTINCT session_id) AS sessions FROM nx WHERE nxt IS NOT NULL GROUP BY ALL")
def merge_edges(spark, d):
    states = traces.merge_nodes(_predicates(spark, d))
    w = Window.partitionBy("session_id").orderBy("node_id")
    e = states.select("session_id", F.col("node_id").alias("from_node"), F.lead("node_id").over(w).alias("to_node"), F.concat(F.lit("sig"), (F.col("node_id") % 2).cast("string")).alias("signature")).filter("to_node is not null")
    return traces.merge_edges(e, states)


@query("m4_anchor_keys", f"WITH {fx.EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'ax:/win/' || (k % 4) || ':L' || (k % 5) ELSE 'pt:D' || (k % 2) || ':' || floor(x / 16 + 0.5)::BIGINT || ',' || floor(y / 16 + 0.5)::BIGINT END AS key FROM ev")
def anchors(spark, d):
    ev = fx.events(spark, d)
    path = F.when(F.col("k") % 3 == 0, F.concat(F.lit("/win/"), (F.col("k") % 4).cast("string")))
    return ev.select("event_id", traces.anchor_key(path, F.concat(F.lit("L"), (F.col("k") % 5).cast("string")), F.concat(F.lit("D"), (F.col("k") % 2).cast("string")), F.col("x"), F.col("y")).alias("key"))


@query("m5_lift", f"WITH {fx.EV}, {fx.SEG}, ed AS (SELECT session_id, us AS s, lead(us) OVER w AS e, lead(reason) OVER w AS reason, row_number() OVER w - 1 AS n FROM bnd WINDOW w AS (PARTITION BY session_id ORDER BY us)) SELECT session_id, n::INTEGER AS n, ed.reason, (SELECT count(*) FROM ev WHERE ev.session_id = ed.session_id AND kind IN ('mouse_down', 'key_down') AND ev.us >= s AND ev.us < e)::INTEGER AS n_actions FROM ed WHERE e IS NOT NULL")
def lift(spark, d):
    ensure_checkpoint_dir(spark)
    ev = fx.events(spark, d).select("event_id", "session_id", "t", "kind").checkpoint()  # read six times
    ev = ev.repartition(traces.lift_parts(ev, ev.count()), "session_id")
    bounds = segments.boundaries(ev, segments.session_ends(ev), dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS)
    acts = ev.filter("kind in ('mouse_down', 'key_down')").select("session_id", "t", F.col("event_id").alias("ord"), F.col("kind").alias("action"))
    return traces.lift(bounds, acts).select("session_id", "n", "reason", F.size("actions").alias("n_actions"))


@query("m6_identity", f"WITH {_PR}, kd AS (SELECT node_id, key, CASE kind WHEN 'A' THEN 'app' WHEN 'N' THEN 'ax_focused' ELSE 'ax_exists' END AS kind FROM pr) SELECT node_id, key FROM kd WHERE kind = 'app' OR (kind = 'ax_focused' AND node_id % 2 = 0) OR (kind = 'ax_exists' AND (contains(key, 'supp=1') OR (node_id % 3 = 0 AND contains(key, 'supp=2'))))")
def identity(spark, d):
    kind = F.when(F.col("kind") == "A", "app").when(F.col("kind") == "N", "ax_focused").otherwise("ax_exists")
    p = _predicates(spark, d).select("node_id", "key", kind.alias("kind"))
    return traces.identity(p, p.filter("kind = 'ax_exists' and key like '%supp=1%'").select("node_id", "key"), p.filter("node_id % 2 = 0").select("node_id").distinct(), p.filter("kind = 'ax_exists' and node_id % 3 = 0 and key like '%supp=2%'").select("node_id", "key"))


@query("m7_slots", f"WITH {fx.EV} SELECT 'slot' || (k % 9) AS slot, string_agg(DISTINCT 'v' || (k % 18), ',' ORDER BY 'v' || (k % 18)) AS samples, count(DISTINCT k % 18) > 1 AS variable FROM ev WHERE kind = 'key_down' GROUP BY ALL")
def slots(spark, d):
    ev = fx.events(spark, d).filter("kind = 'key_down'")
    out = traces.slots(ev.select(F.concat(F.lit("slot"), (F.col("k") % 9).cast("string")).alias("slot"), F.concat(F.lit("v"), (F.col("k") % 18).cast("string")).alias("text")))
    return out.select("slot", F.array_join("samples", ",").alias("samples"), "variable")


@query("m8_signatures", f"WITH {fx.EV}, ac AS (SELECT session_id, event_id, CASE WHEN kind = 'mouse_down' AND k % 3 = 0 THEN 'drag:a' || (k % 7) || '->b' || (k % 2) || ':left' WHEN kind = 'mouse_down' THEN 'click:a' || (k % 7) || ':left:1' WHEN kind = 'scroll' THEN 'scroll:a' || (k % 7) || ':' || sign(k % 5 - 2)::INTEGER || ',' || sign(k % 3 - 1)::INTEGER WHEN k % 5 = 0 THEN 'chord:cmd+s' ELSE 'type' END AS s FROM ev WHERE kind IN ('mouse_down', 'key_down', 'scroll')) SELECT session_id AS edge_id, string_agg(s, '|' ORDER BY event_id) AS signature FROM ac GROUP BY session_id")
def signatures(spark, d):
    ev = fx.events(spark, d).filter("kind in ('mouse_down', 'key_down', 'scroll')")
    name = lambda p, n: F.concat(F.lit(p), (F.col("k") % n).cast("string"))
    kind = F.when((F.col("kind") == "mouse_down") & (F.col("k") % 3 == 0), "drag").when(F.col("kind") == "mouse_down", "click").when(F.col("kind") == "scroll", "scroll").when(F.col("k") % 5 == 0, "chord").otherwise("type")
    acts = ev.select(
        F.col("session_id").alias("edge_id"), F.col("event_id").alias("ord"), kind.alias("kind"), name("a", 7).alias("anchor_key"), name("b", 2).alias("to_key"), F.lit("left").alias("button"), F.lit(1).alias("count"),
        (F.col("k") % 5 - 2).alias("dx"), (F.col("k") % 3 - 1).alias("dy"), F.array(F.lit("cmd"), F.lit("s")).alias("keys"), F.lit(None).cast("string").alias("until"),
    )
    return traces.edge_signature(acts)


@query("m10_near_match", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(q.e, b.e), 6) AS score FROM v q JOIN v b ON q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s), t AS (SELECT query_id, max(CASE WHEN n = 1 THEN id END) AS id, max(score) AS b, max(CASE WHEN n = 2 THEN score END) AS c FROM r WHERE n <= 2 GROUP BY query_id) SELECT query_id, CASE WHEN b >= 0.4 AND b - c >= 0.03 THEN id END AS match, CASE WHEN b < 0.4 THEN 'none' WHEN b - c >= 0.03 THEN 'match' ELSE 'ambiguous' END AS verdict FROM t")
def near_match(spark, d):
    from sessionloom.operators import vectors

    base = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array("embedding").alias("patches"))
    two = vectors.nearest(base.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "patches"), base, 2, "cosine", skip_self=True)
    return traces.near_match(two.select("query_id", "id", F.round("score", 6).alias("score")), least=0.4)


@query("m13_labels", f"WITH {_PR} SELECT node_id, concat_ws(' — ', min(CASE kind WHEN 'A' THEN key END), coalesce(min(CASE kind WHEN 'N' THEN key END), min(CASE kind WHEN 'R' THEN key END))) AS label FROM pr GROUP BY node_id")
def labels(spark, d):
    kind = F.when(F.col("kind") == "A", "app").when(F.col("kind") == "N", "url").otherwise("ax_focused")
    return traces.node_label(_predicates(spark, d).select("node_id", kind.alias("kind"), F.col("key").alias("value")))




@query("m14_ranks", "WITH RECURSIVE e AS (SELECT DISTINCT 's' || o_custkey AS f, 's' || (o_orderkey // 10) AS g FROM orders), en AS (SELECT 's1' AS node UNION SELECT f FROM e WHERE f NOT IN (SELECT g FROM e WHERE f <> g)), rr AS (SELECT node, 0 AS h FROM en UNION SELECT g, h + 1 FROM rr JOIN e ON f = node WHERE h < 30) SELECT node, min(h)::INTEGER AS rank FROM rr GROUP BY node")
def ranks(spark, d):
    o = fx.table(spark, d, "orders")
    e = o.select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("from_node"), F.concat(F.lit("s"), F.floor(F.col("o_orderkey") / 10).cast("string")).alias("to_node")).distinct()
    return traces.ranks(e, spark.createDataFrame([("s1",)], "node string"))


@query("m15_provenance", f"WITH {_ST} SELECT f || '>' || g AS edge_id, sess AS session_id, session_id * 10 AS started_at, round(greatest((t - 1000) / 1000.0::DOUBLE, 0), 6) AS offset_sec FROM st WHERE session_id % 4 <> 0")
def provenance(spark, d):
    s = _steps(spark, d)
    user = F.element_at(F.split("session_id", "-"), 1).cast("long")
    known = s.select("session_id").distinct().filter(user % 4 != 0).select("session_id", (user * 10).alias("started_at"), F.lit(1000).alias("origin_ms"))
    return traces.provenance(s.select("edge_id", "session_id", F.col("t").alias("t_start")), known).withColumn("offset_sec", F.round("offset_sec", 6))


@query("j18_verify", f"WITH {_PR}, ob AS (SELECT DISTINCT key FROM pr WHERE node_id % 100 = 0), ms AS (SELECT node_id, count(*) AS n, count(*) FILTER (WHERE kind = 'A') AS a FROM pr WHERE key NOT IN (SELECT key FROM ob WHERE NOT contains(key, 'supp=4')) GROUP BY node_id) SELECT DISTINCT pr.node_id, n IS NULL AS satisfied, coalesce(n, 0) AS n_violations, coalesce(a, 0) AS assertable, coalesce(n - a, 0) AS achievable FROM pr LEFT JOIN ms USING (node_id)")
def verify(spark, d):
    p = _predicates(spark, d).withColumn("reach", F.when(F.col("kind") == "A", "assertable").otherwise("achievable"))
    return traces.verify(p, p.filter("node_id % 100 = 0 and key not like '%supp=4%'").select("key"))


@query("j19_locate", f"WITH {_PR}, nd AS (SELECT node_id, key FROM pr), ob AS (SELECT node_id AS snapshot_id, key FROM pr WHERE node_id % 50 = 0), sz AS (SELECT node_id, count(*) AS size FROM nd GROUP BY node_id), mt AS (SELECT snapshot_id, nd.node_id, size, rank() OVER (PARTITION BY snapshot_id ORDER BY size DESC) AS r FROM (SELECT snapshot_id, nd.node_id, count(*) AS c FROM ob JOIN nd USING (key) GROUP BY ALL) nd JOIN sz USING (node_id) WHERE c = size), b AS (SELECT snapshot_id, count(*) AS n, min(node_id) AS node_id FROM mt WHERE r = 1 GROUP BY snapshot_id) SELECT DISTINCT ob.snapshot_id, CASE WHEN n = 1 THEN b.node_id END AS node_id, CASE WHEN n IS NULL THEN 'nowhere' WHEN n = 1 THEN 'located' ELSE 'ambiguous' END AS verdict FROM ob LEFT JOIN b USING (snapshot_id)")
def locate(spark, d):
    p = _predicates(spark, d)
    return traces.locate(p.select("node_id", "key"), p.filter("node_id % 50 = 0").select(F.col("node_id").alias("snapshot_id"), "key"))


_EL = "el AS (SELECT l_orderkey // 100 AS snapshot_id, l_orderkey * 10 + l_linenumber AS idx, CASE WHEN l_partkey % 4 = 0 THEN 'id' || (l_partkey % 50) ELSE '' END AS identifier, '/w/' || (l_partkey % 30) AS path, 'r' || (l_suppkey % 3) AS role, 'L' || (l_partkey % 11) AS label FROM lineitem), wa AS (SELECT l_orderkey * 10 + l_linenumber AS want_id, l_orderkey // 100 AS snapshot_id, CASE WHEN l_partkey % 3 = 0 THEN 'id' || (l_partkey % 60) ELSE '' END AS identifier, CASE WHEN l_partkey % 2 = 0 THEN '/w/' || (l_partkey % 45) ELSE '' END AS path, 'r' || (l_suppkey % 4) AS role, 'L' || (l_partkey % 13) AS label FROM lineitem)"


@query("j20_lookup", f"WITH {_EL}, a AS (SELECT want_id, min(idx) AS a FROM wa JOIN el USING (snapshot_id, identifier) WHERE identifier <> '' GROUP BY want_id), b AS (SELECT want_id, min(idx) AS b FROM wa JOIN el USING (snapshot_id, path) WHERE path <> '' GROUP BY want_id), c AS (SELECT want_id, min(idx) AS c FROM wa JOIN el USING (snapshot_id, role, label) GROUP BY want_id) SELECT want_id, coalesce(a, b, c) AS idx, CASE WHEN a IS NOT NULL THEN 'identifier' WHEN b IS NOT NULL THEN 'path' WHEN c IS NOT NULL THEN 'label' END AS rung FROM wa LEFT JOIN a USING (want_id) LEFT JOIN b USING (want_id) LEFT JOIN c USING (want_id)")
def lookup(spark, d):
    li = fx.table(spark, d, "lineitem")
    s = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    key, snap = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.floor(F.col("l_orderkey") / 100).alias("snapshot_id")
    el = li.select(snap, key.alias("idx"), F.when(F.col("l_partkey") % 4 == 0, s("id", "l_partkey", 50)).otherwise("").alias("identifier"), s("/w/", "l_partkey", 30).alias("path"), s("r", "l_suppkey", 3).alias("role"), s("L", "l_partkey", 11).alias("label"))
    wanted = li.select(key.alias("want_id"), snap, F.when(F.col("l_partkey") % 3 == 0, s("id", "l_partkey", 60)).otherwise("").alias("identifier"), F.when(F.col("l_partkey") % 2 == 0, s("/w/", "l_partkey", 45)).otherwise("").alias("path"), s("r", "l_suppkey", 4).alias("role"), s("L", "l_partkey", 13).alias("label"))
    return traces.lookup(wanted, el)


@query("j21_resolve", "WITH c AS (SELECT l_orderkey AS want_id, CASE l_linenumber % 4 WHEN 0 THEN 'identifier' WHEN 1 THEN 'path' WHEN 2 THEN 'label' ELSE 'point' END AS rung, l_linenumber::BIGINT * 1000000 + l_partkey * 100 + l_suppkey % 100 AS idx, l_partkey % 9 + 1 AS depth, (l_partkey % 400 + 100)::DOUBLE AS area, CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 300 + 100)::DOUBLE END AS ra, (l_partkey % 40)::DOUBLE AS cd FROM lineitem), k AS (SELECT *, CASE rung WHEN 'identifier' THEN 1.0::DOUBLE WHEN 'path' THEN least(1, greatest(0.55::DOUBLE, 0.95::DOUBLE - 0.035::DOUBLE * (depth - 1))) WHEN 'label' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS ceil FROM c), z AS (SELECT *, round(ceil * CASE WHEN ra IS NULL THEN 1 ELSE least(area, ra) / greatest(area, ra) * greatest(0, 1 - cd / 100) END, 6) AS conf FROM k) SELECT want_id, rung, idx, conf AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY ceil DESC, conf DESC, idx) AS n FROM z WHERE conf >= 0.25) WHERE n = 1")
def resolve(spark, d):
    li = fx.table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 4
    c = li.select(F.col("l_orderkey").alias("want_id"), F.when(n == 0, "identifier").when(n == 1, "path").when(n == 2, "label").otherwise("point").alias("rung"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("idx"), (F.col("l_partkey") % 9 + 1).alias("depth"), (F.col("l_partkey") % 400 + 100).cast("double").alias("area"), F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 300 + 100).cast("double")).alias("recorded_area"), (F.col("l_partkey") % 40).cast("double").alias("centre_distance"), F.lit(100.0).alias("recorded_diagonal"))
    return traces.resolve(c)


_PT = "'pt:D0:' || floor({0}x / 16 + 0.5)::BIGINT || ',' || floor({0}y / 16 + 0.5)::BIGINT"
_LIFTED = f"""{fx.EV}, fc AS (SELECT *, CASE WHEN kind = 'focus_change' THEN coalesce(app = 'app2', false) END AS hit FROM ev),
mk AS (SELECT *, coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), first_value(hit IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS gone FROM fc),
kp AS (SELECT * EXCLUDE (hit, gone), count(*) FILTER (WHERE kind = 'focus_change') OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS era FROM mk WHERE NOT coalesce(gone, false)),
sp AS (SELECT session_id, min(us) AS s0, max(us) AS s1 FROM kp GROUP BY session_id),
ca AS (SELECT session_id, s0 AS us, 'session_start' AS reason, 101 AS p FROM sp UNION ALL SELECT session_id, s1, 'session_end', 100 FROM sp UNION ALL SELECT session_id, us, kind, CASE kind WHEN 'bookmark' THEN 30 ELSE 20 END FROM kp WHERE kind IN ('bookmark', 'focus_change')
  UNION ALL SELECT session_id, us, 'dwell_gap', 10 FROM (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b FROM kp) WHERE us - b > 86400000000
  UNION ALL SELECT session_id, us, 'burst_gap', 5 FROM (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b FROM kp WHERE kind IN ('mouse_down', 'key_down', 'scroll')) WHERE us - b > 28800000000),
bd AS (SELECT session_id, us, arg_max(reason, p) AS reason FROM ca GROUP BY session_id, us),
cx AS (SELECT session_id, us, event_id, last_value(app IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS fa,
  last_value(url IGNORE NULLS) OVER (PARTITION BY session_id, era ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS fu FROM kp),
at_ AS (SELECT * FROM cx QUALIFY row_number() OVER (PARTITION BY session_id, us ORDER BY event_id DESC) = 1),
nd AS (SELECT session_id, us, reason, row_number() OVER (PARTITION BY session_id ORDER BY us) - 1 AS n, 'app(app=' || fa || ')' AS ka, 'url(prefix=' || regexp_replace(fu, '^https://www\\.(site[0-9]\\.example/docs)/[0-9]+/a$', '\\1/a') || ')' AS ku,
  fa, regexp_replace(fu, '^https://www\\.(site[0-9]\\.example/docs)/[0-9]+/a$', '\\1/a') AS pl FROM bd JOIN at_ USING (session_id, us)),
ns AS (SELECT *, sha256(concat_ws(chr(1), ka, ku)) AS state, coalesce(nullif(concat_ws(' — ', fa, pl), ''), 'no state') AS label FROM nd),
ed AS (SELECT session_id, n, us AS e0, lead(us) OVER w AS e1, lead(reason) OVER w AS reason, state AS f, lead(state) OVER w AS g, ka, ku, lead(ka) OVER w AS nka, lead(ku) OVER w AS nku FROM ns WINDOW w AS (PARTITION BY session_id ORDER BY n)),
up AS (SELECT *, first_value(CASE WHEN kind = 'mouse_up' THEN {{'x': x, 'y': y}} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u FROM kp),
ru AS (SELECT session_id, us, row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) AS ord FROM (SELECT *, lag(us) OVER (PARTITION BY session_id, era ORDER BY us, event_id) AS b FROM kp WHERE kind = 'key_down') WHERE b IS NULL OR us - b > 345600000000),
ac AS (SELECT session_id, us, event_id AS ord, CASE WHEN sqrt((u.x - x) * (u.x - x) + (u.y - y) * (u.y - y)) > 4 THEN 'drag' ELSE 'click' END AS kind,
    CASE WHEN sqrt((u.x - x) * (u.x - x) + (u.y - y) * (u.y - y)) > 4 THEN 'drag:' || {_PT.format('')} || '->' || {_PT.format('u.')} || ':left' ELSE 'click:' || {_PT.format('')} || ':left:1' END AS sig FROM up WHERE kind = 'mouse_down'
  UNION ALL SELECT session_id, us, event_id, 'scroll', 'scroll:' || {_PT.format('')} || ':0,0' FROM kp WHERE kind = 'scroll' UNION ALL SELECT session_id, us, ord, 'type', 'type' FROM ru),
ia AS (SELECT ed.session_id, ed.n, ac.us, ac.ord, ac.kind, ac.sig FROM ed JOIN sp USING (session_id) JOIN ac ON ac.session_id = ed.session_id AND ac.us >= e0 AND (ac.us < e1 OR (e1 = s1 AND ac.us = e1)) WHERE e1 IS NOT NULL
  UNION ALL SELECT session_id, n, e1, 4611686018427387904, 'wait', 'wait:' || CASE WHEN nka IS NOT NULL AND nka IS DISTINCT FROM ka THEN nka WHEN nku IS NOT NULL AND nku IS DISTINCT FROM ku THEN nku ELSE 'warning: nothing to wait for' END FROM ed WHERE reason IN ('dwell_gap', 'burst_gap')),
sg AS (SELECT session_id, n, string_agg(sig, '|' ORDER BY us, ord, kind) AS signature FROM ia GROUP BY session_id, n),
stp AS (SELECT session_id, f AS from_state, g AS to_state, coalesce(signature, '') AS signature FROM ed LEFT JOIN sg USING (session_id, n) WHERE e1 IS NOT NULL)"""
_GRAPH_EDGES = f"WITH {_LIFTED} SELECT from_state, to_state, signature, count(*) AS observations, count(DISTINCT session_id) AS sessions FROM stp GROUP BY ALL"


def _lifted(ev):
    return rebuild.lift(ev.withColumn("char", F.when(F.col("kind") == "key_down", F.chr(F.lit(97) + F.col("k") % 26))), ["app2"], dwell_ms=fx.DWELL_MS, burst_ms=fx.BURST_MS, typed_gap_ms=4 * fx.DWELL_MS)


@query("m12_rebuild", _GRAPH_EDGES)
def rebuilt_edges(spark, d):
    """From events to the merged edges of all sessions."""
    return rebuild.merged_edges(_lifted(fx.events(spark, d)).steps)


@query("m12_rebuild_nodes", f"WITH {_LIFTED} SELECT state, min(label) AS label, count(*) AS visits, count(DISTINCT session_id) AS sessions FROM ns GROUP BY state")
def rebuilt_nodes(spark, d):
    return rebuild.merged_nodes(_lifted(fx.events(spark, d)).visits)


@query("m9_graph_by_batch", _GRAPH_EDGES)
def graph_by_batch(spark, d):
    """The same graph kept up by three batches: of two thirds of the sessions an early part first, then whole sessions again."""
    store = rebuild.GraphStore(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex}")
    ev = fx.events(spark, d)
    for batch, part in enumerate((ev.filter("session_id % 3 <> 0 and event_id % 4 <> 0"), ev.filter("session_id % 3 = 1"), ev.filter("session_id % 3 <> 1"))):
        store.apply(_lifted(part), part.select("session_id"), batch)
    return store.edges()
