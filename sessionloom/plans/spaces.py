"""Queries over regions and points."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import boxes
from sessionloom.operators import spatial
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources.tables import ensure_checkpoint_dir

_BOX = """bx AS (SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS idx, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS region_id,
  (l_partkey * 7 % 1500)::DOUBLE AS x, (l_suppkey * 13 % 900)::DOUBLE AS y, (40 + l_partkey % 400)::DOUBLE AS w, (20 + l_suppkey % 300)::DOUBLE AS h, CASE WHEN l_partkey % 5 = 0 THEN 'AXGroup' ELSE 'button' END AS role, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'p' || (l_partkey % 9) END AS label, l_linenumber % 4 = 0 AS focused FROM lineitem)"""


def _boxes(spark, d):
    li = fx.table(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    # numbered first, so that only the keys are shuffled
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("idx")).select(
        F.col("l_orderkey").alias("frame_id"), "idx", (F.col("l_orderkey") * 100 + F.col("idx")).alias("region_id"),
        (F.col("l_partkey") * 7 % 1500).cast("double").alias("x"), (F.col("l_suppkey") * 13 % 900).cast("double").alias("y"), (40 + F.col("l_partkey") % 400).cast("double").alias("w"), (20 + F.col("l_suppkey") % 300).cast("double").alias("h"),
        F.when(F.col("l_partkey") % 5 == 0, "AXGroup").otherwise("button").alias("role"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string"))).alias("label"), (F.col("l_linenumber") % 4 == 0).alias("focused"),
    )


_IOU = "round(CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - i > 0 THEN i / ({a}.w * {a}.h + {b}.w * {b}.h - i) ELSE 0 END, 6)"


@query("a22_box_overlap", f"WITH {_BOX}, p AS (SELECT a, b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM bx a JOIN bx b ON a.frame_id = b.frame_id AND a.idx < b.idx) SELECT a.region_id AS a_id, b.region_id AS b_id, {_IOU.format(a='a', b='b')} AS iou FROM p WHERE i > 0")
def overlaps(spark, d):
    b = _boxes(spark, d)
    pair = lambda p: b.select("frame_id", F.struct("region_id", "idx", "x", "y", "w", "h").alias(p))
    met = pair("a").join(pair("b"), "frame_id").filter("a.idx < b.idx").withColumn("iou", boxes.iou(F.col("a"), F.col("b")))
    return met.filter("iou > 0").select(F.col("a.region_id").alias("a_id"), F.col("b.region_id").alias("b_id"), F.round("iou", 6).alias("iou"))


@query("r1_element_filter", f"WITH {_BOX} SELECT region_id, 2.0::DOUBLE + (label <> '')::INTEGER + 2 * focused::INTEGER AS priority FROM bx WHERE role <> 'AXGroup' AND w * h >= 2000 AND w * h <= 0.05::DOUBLE * 1920 * 1080")
def element_filter(spark, d):
    return spatial.element_regions(_boxes(spark, d), 1920, 1080, min_area=2000, max_share=0.05).select("region_id", "priority")


@query("r2_collapse")
def collapse(spark, d):
    return spatial.collapse(spatial.element_regions(_boxes(spark, d), 1920, 1080), 0.2).select("frame_id", "region_id", "priority")


@query("r3_weighted_points", f"WITH {fx.EV} SELECT event_id, CASE kind WHEN 'mouse_down' THEN 3.0::DOUBLE WHEN 'mouse_move' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ev WHERE kind IN ('mouse_down', 'mouse_up', 'scroll', 'mouse_move')")
def weighted(spark, d):
    return spatial.weighted_points(fx.events(spark, d)).select("event_id", "weight")


def _points(spark, d):
    return spatial.weighted_points(fx.events(spark, d)).select(F.col("session_id").alias("frame_id"), F.col("event_id").alias("point_id"), "x", "y", "weight")


_DB = f"""{fx.EV}, pt AS (SELECT session_id AS f, event_id AS p, x, y, CASE kind WHEN 'mouse_down' THEN 3.0::DOUBLE WHEN 'mouse_move' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ev WHERE kind IN ('mouse_down', 'mouse_up', 'scroll', 'mouse_move')),
nb AS (SELECT a.f, a.p, b.p AS q, b.w FROM pt a JOIN pt b ON a.f = b.f AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6400),
co AS (SELECT f, p FROM nb GROUP BY f, p HAVING sum(w) >= 3 - 1e-9),
ed AS (SELECT nb.f, nb.p, nb.q FROM nb JOIN co USING (f, p) JOIN co c2 ON c2.f = nb.f AND c2.p = nb.q),
re AS (SELECT f, p, p AS q FROM co UNION SELECT re.f, re.p, ed.q FROM re JOIN ed ON re.f = ed.f AND re.q = ed.p),
lb AS (SELECT f, p, min(q) AS l FROM re GROUP BY f, p), nm AS (SELECT f, p, dense_rank() OVER (PARTITION BY f ORDER BY l) - 1 AS c FROM lb),
bo AS (SELECT nb.f, nb.q AS p, min(c) AS c FROM nb JOIN nm USING (f, p) GROUP BY nb.f, nb.q),
cl AS (SELECT pt.*, coalesce(nm.c, bo.c, -1) AS cluster FROM pt LEFT JOIN nm USING (f, p) LEFT JOIN bo USING (f, p))"""


@query("r4_dbscan", f"WITH RECURSIVE {_DB} SELECT f AS frame_id, p AS point_id, cluster::INTEGER AS cluster FROM cl")
def dbscan(spark, d):
    ensure_checkpoint_dir(spark)
    return spatial.dbscan(_points(spark, d))


@query("r5_hotspots", f"WITH RECURSIVE {_DB}, g AS (SELECT f, cluster, min(x) - 48 AS x0, min(y) - 48 AS y0, max(x) + 48 AS x1, max(y) + 48 AS y1, sum(w) AS w FROM cl WHERE cluster >= 0 GROUP BY ALL) SELECT f AS frame_id, cluster::INTEGER AS cluster, greatest(x0, 0) AS x, greatest(y0, 0) AS y, least(x1, 1920) - greatest(x0, 0) AS w, least(y1, 1080) - greatest(y0, 0) AS h, round(1 + least(w / 9, 1), 6) AS priority FROM g")
def hotspots(spark, d):
    ensure_checkpoint_dir(spark)
    points = _points(spark, d)
    out = spatial.hotspots(points, spatial.dbscan(points), 1920, 1080)
    return out.select("frame_id", "cluster", "x", "y", "w", "h", F.round("priority", 6).alias("priority"))


_GRID = "WITH f AS (SELECT c_custkey AS frame_id, (800 + c_custkey % 7 * 100)::DOUBLE AS width, 900.0::DOUBLE AS height FROM customer), t AS (SELECT frame_id, r, c, width, height, c * (width / 4) - width / 4 * 0.15::DOUBLE / 2 AS x, r * (height / 3) - height / 3 * 0.15::DOUBLE / 2 AS y, width / 4 * 1.15::DOUBLE AS w, height / 3 * 1.15::DOUBLE AS h FROM f, range(3) a(r), range(4) b(c)) SELECT frame_id, r::INTEGER AS r, c::INTEGER AS c, round(greatest(x, 0), 4) AS x, round(greatest(y, 0), 4) AS y, round(least(x + w, width) - greatest(x, 0), 4) AS w, round(least(y + h, height) - greatest(y, 0), 4) AS h FROM t"


@query("r6_grid", _GRID)
def grid(spark, d):
    frames = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("frame_id"), (800 + F.col("c_custkey") % 7 * 100).cast("double").alias("width"), F.lit(900.0).alias("height"))
    return spatial.grid(frames).select("frame_id", "r", "c", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h")])


@query("r7_fuse")
def fuse(spark, d):
    b = spatial.element_regions(_boxes(spark, d), 1920, 1080)
    other = b.withColumns({"source": F.lit("hotspot"), "priority": F.lit(1.5), "region_id": F.col("region_id") + 50, "x": F.col("x") + 3.0})
    return spatial.fuse(b.unionByName(other), most=6).select("frame_id", "region_id", "source", "priority")


@query("j11_smallest_hit", f"WITH {_BOX}, p AS (SELECT frame_id, region_id AS point_id, x + w / 2 AS px, y + h / 2 AS py FROM bx WHERE idx = 1), m AS (SELECT point_id, region_id, row_number() OVER (PARTITION BY point_id ORDER BY w * h, region_id) AS n FROM p JOIN bx USING (frame_id) WHERE label <> '' AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h) SELECT point_id, region_id FROM m WHERE n = 1")
def smallest(spark, d):
    b = _boxes(spark, d)
    points = b.filter("idx = 1").select("frame_id", F.col("region_id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    return spatial.smallest_hit(points, b)


@query("j12_deepest_hit", f"WITH {_BOX}, p AS (SELECT frame_id, region_id AS point_id, x + w / 2 AS px, y + h / 2 AS py FROM bx WHERE idx = 1), m AS (SELECT point_id, idx, row_number() OVER (PARTITION BY point_id ORDER BY idx % 3 DESC, w * h, idx) AS n FROM p JOIN bx USING (frame_id) WHERE px BETWEEN x AND x + w AND py BETWEEN y AND y + h) SELECT point_id, idx FROM m WHERE n = 1")
def deepest(spark, d):
    b = _boxes(spark, d).withColumns({"snapshot_id": F.col("frame_id"), "depth": F.col("idx") % 3})
    points = b.filter("idx = 1").select("snapshot_id", F.col("region_id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    return spatial.deepest_hit(points, b)


def _displays(spark):
    return spark.createDataFrame([(s, o, n, x, 0.0, 960.0, 800.0, p) for s in range(0, 3) for o, n, x, p in ((0, "D1", 0.0, False), (1, "D2", 960.0, True)) if s], "part int, ord int, display string, x double, y double, w double, h double, primary boolean")


@query("j13_displays", f"WITH {fx.EV} SELECT event_id AS point_id, CASE WHEN session_id % 3 = 0 THEN 'D0' WHEN x <= 960 AND y <= 800 THEN 'D1' ELSE 'D2' END AS display FROM ev")
def displays(spark, d):
    ev = fx.events(spark, d)
    shown = ev.select("session_id").distinct().withColumn("part", (F.col("session_id") % 3).cast("int")).join(_displays(spark), "part").drop("part")
    return spatial.display_of(ev.select("session_id", F.col("event_id").alias("point_id"), "x", "y"), shown)


@query("j14_outside_displays", f"WITH {fx.EV} SELECT event_id AS box_id, session_id % 3 = 0 OR y >= 800 OR x >= 1920 AS outside FROM ev")
def outside(spark, d):
    ev = fx.events(spark, d)
    shown = ev.select("session_id").distinct().withColumn("part", (F.col("session_id") % 3).cast("int")).join(_displays(spark), "part").drop("part")
    return spatial.outside_displays(ev.select("session_id", F.col("event_id").alias("box_id"), "x", "y", F.lit(10.0).alias("w"), F.lit(10.0).alias("h")), shown)


@query("f14_nesting", f"WITH {_BOX}, m AS (SELECT i.frame_id AS snapshot_id, i.idx, o.idx AS parent, row_number() OVER (PARTITION BY i.frame_id, i.idx ORDER BY o.w * o.h, o.idx DESC) AS n FROM bx i JOIN bx o ON i.frame_id = o.frame_id AND o.x <= i.x + 1 AND o.y <= i.y + 1 AND o.x + o.w >= i.x + i.w - 1 AND o.y + o.h >= i.y + i.h - 1 AND (o.w * o.h > i.w * i.h OR (o.w * o.h = i.w * i.h AND o.idx < i.idx))) SELECT bx.frame_id AS snapshot_id, bx.idx, parent FROM bx LEFT JOIN m ON m.snapshot_id = bx.frame_id AND m.idx = bx.idx AND n = 1")
def nesting(spark, d):
    return spatial.nest(_boxes(spark, d).withColumnRenamed("frame_id", "snapshot_id"))


@query("f15_dhash", "WITH p AS (SELECT vec_id AS frame_id, list_transform(range(0, 72), lambda i: floor(embedding[i % 64 + 1]::DOUBLE * 1000)) AS px FROM embeddings) SELECT frame_id, (list_sum(list_transform(range(0, 64), lambda b: CASE WHEN b > 0 AND px[b // 8 * 9 + b % 8 + 1] > px[b // 8 * 9 + b % 8 + 2] THEN 1::HUGEINT << (63 - b)::INTEGER ELSE 0::HUGEINT END)) - CASE WHEN px[1] > px[2] THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END)::BIGINT AS phash FROM p")
def dhash(spark, d):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.element_at("embedding", i % 64 + 1).cast("double") * 1000))
    return spatial.dhash(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), pixels.alias("pixels")))
