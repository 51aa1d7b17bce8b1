"""Queries over trees: region > nation > customer > order, and a customer's orders as children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import fusion, hierarchy
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources.tables import ensure_checkpoint_dir


def _edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pair = lambda t, a, b: fx.table(spark, d, t).select(a.alias("parent_id"), b.alias("child_id"))
    return reduce(DataFrame.unionByName, [
        pair("nation", name("r", "n_regionkey"), name("n", "n_nationkey")), pair("customer", name("n", "c_nationkey"), name("c", "c_custkey")),
        pair("orders", name("c", "o_custkey"), name("o", "o_orderkey")),
    ])


_E = "e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), ids AS (SELECT p AS id FROM e UNION SELECT c FROM e), clo AS (SELECT id AS a, id AS x, 0 AS depth FROM ids UNION ALL SELECT a, e.c, depth + 1 FROM clo JOIN e ON e.p = clo.x)"


@query("j16_leaves", f"WITH RECURSIVE {_E} SELECT a AS id, x AS leaf FROM clo WHERE x NOT IN (SELECT p FROM e) AND a IN (SELECT 'n' || n_nationkey FROM nation)")
def leaves(spark, d):
    return hierarchy.leaves(_edges(spark, d), fx.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))


@query("j17_nearest_summary", f"WITH RECURSIVE {_E}, s AS (SELECT 'n' || n_nationkey AS id, n_name AS summary FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region) SELECT i.id, min_by(summary, depth) AS summary FROM (SELECT 'c' || c_custkey AS id FROM customer) i LEFT JOIN clo ON clo.x = i.id LEFT JOIN s ON s.id = clo.a WHERE summary IS NOT NULL GROUP BY i.id")
def summaries(spark, d):
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    said = nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("summary")).unionByName(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("summary")))
    return hierarchy.nearest_summary(_edges(spark, d), fx.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")), said)


@query("t13_scope", f"WITH RECURSIVE {_E} SELECT DISTINCT x AS leaf FROM clo WHERE a IN ('n1', 'c5', 'o9') AND x NOT IN (SELECT p FROM e)")
def scope(spark, d):
    hits = spark.createDataFrame([("n1",), ("c5",), ("o9",)], "id string")
    return hierarchy.leaves(_edges(spark, d), hits).select("leaf").distinct()


@query("t12_collapse")
def collapse(spark, d):
    """Hits on customers, nations and orders, ranked by a hash: the best of related ones stay."""
    ensure_checkpoint_dir(spark)
    edges = _edges(spark, d)
    ids = edges.select(F.col("child_id").alias("id"))
    hits = ids.withColumn("query_id", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(7)))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.crc32(F.reverse("id").cast("binary")), "id")))
    return fusion.collapse_related(hits.select("query_id", "id", "rank"), hierarchy.closure(edges).select("ancestor", "descendant"))


def _children(spark, d):
    """A customer's orders by date; seconds are days apart, each of length 1 to 20."""
    o = fx.table(spark, d, "orders")
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double")
    rows = o.select(F.col("o_custkey").cast("string").alias("block"), idx.alias("idx"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("child_id"), F.concat(F.lit("buy "), F.substring("o_orderpriority", 1, 1)).alias("text"), F.col("o_orderpriority").alias("app"), F.col("o_orderstatus").alias("url"), day.alias("start_sec"), (day + F.col("o_orderkey") % 20).alias("end_sec"))
    return rows.withColumn("barrier", F.col("idx") % 10 == 9)


_CH = "ch AS (SELECT o_custkey::VARCHAR AS block, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx, 'o' || o_orderkey AS child_id, 'buy ' || substr(o_orderpriority, 1, 1) AS text, o_orderpriority AS app, o_orderstatus AS url, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE + o_orderkey % 20 AS t FROM orders)"
_BL = f"{_CH}, bl AS (SELECT *, sum((idx % 10 = 9 OR coalesce(pb, false))::INTEGER) OVER (PARTITION BY block ORDER BY idx ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, lag(idx % 10 = 9) OVER (PARTITION BY block ORDER BY idx) AS pb FROM ch))"
_GR = f"""{_BL}, sc AS (SELECT *, count(*) OVER (PARTITION BY block, part) AS n, row_number() OVER w AS rn, CASE WHEN app = lag(app) OVER w THEN 2 ELSE 0 END + CASE WHEN url = lag(url) OVER w THEN 1 ELSE 0 END + CASE WHEN s - lag(t) OVER w <= 1 THEN 1 WHEN s - lag(t) OVER w >= 3 THEN -1 ELSE 0 END AS score FROM bl WINDOW w AS (PARTITION BY block, part ORDER BY idx)),
mg AS (SELECT *, rn > 1 AND row_number() OVER (PARTITION BY block, part ORDER BY rn = 1, score DESC, idx) <= n - ceil(n / 2.0) AS merged FROM sc), gr AS (SELECT *, sum((NOT merged)::INTEGER) OVER (PARTITION BY block, part ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM mg)"""


def _groups(spark, d):
    return hierarchy.structural_groups(hierarchy.barrier_blocks(_children(spark, d)))


@query("h1_children", f"WITH {_CH} SELECT block, idx::INTEGER AS idx, child_id, text, app, url, s AS start_sec, t AS end_sec FROM ch")
def children(spark, d):
    return _children(spark, d).drop("barrier")


@query("h2_barriers", f"WITH {_BL} SELECT child_id, part::BIGINT AS part FROM bl")
def barriers(spark, d):
    return hierarchy.barrier_blocks(_children(spark, d)).select("child_id", "part")


@query("h3_cap_split")
def cap_split(spark, d):
    rows = _children(spark, d).withColumn("part", F.lit(0))
    return hierarchy.split_at_gaps(rows, 8).groupBy("block", "part").agg(F.min("idx").alias("first"), F.count("*").alias("n"))


@query("h4_structural_groups", f"WITH {_GR} SELECT child_id, part::BIGINT AS part, grp::BIGINT AS grp FROM gr")
def structural(spark, d):
    return _groups(spark, d).select("child_id", "part", "grp")


@query("h5_admission", f"WITH {_GR}, z AS (SELECT block, part, grp, count(*) AS n FROM gr GROUP BY ALL) SELECT block, count(*) < sum(n) AND max(n) >= 2 AS qualifies FROM z GROUP BY block")
def admission(spark, d):
    return hierarchy.level_qualifies(_groups(spark, d))


@query("h6_valid_partition", f"WITH {_CH} SELECT block, block::BIGINT % 3 <> 0 OR count(*) < 2 AS valid FROM ch GROUP BY block")
def partition(spark, d):
    """Ranges of one child each; those of every third customer lack their first."""
    rows = _children(spark, d)
    n = rows.groupBy("block").agg(F.count("*").alias("n"))
    ranges = rows.join(n, "block").filter((F.col("block").cast("long") % 3 != 0) | (F.col("idx") > 0) | (F.col("n") < 2))
    return hierarchy.valid_partition(ranges.select("block", F.col("idx").alias("start"), (F.col("idx") + 1).alias("end")), n)


@query("h7_rollup", f"WITH {_GR}, r AS (SELECT block, part, grp, count(*) AS n, max_by(t, idx) - min(s) AS dur, list_reduce(list(app ORDER BY idx), lambda x, y: x) AS a, list(app ORDER BY idx) AS apps FROM gr GROUP BY ALL) SELECT block, part::BIGINT AS part, grp::BIGINT AS grp, n, array_to_string(list_transform(list_filter(range(1, len(apps) + 1), lambda i: list_position(apps, apps[i]) = i), lambda i: apps[i]), ', ') || ' · ' || n || ' action' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' · ' || dur::BIGINT || '.0s' AS summary FROM r")
def rollup(spark, d):
    return hierarchy.rollup(_groups(spark, d), 1).select("block", "part", "grp", "n", "summary")


@query("h8_nodes", f"WITH {_GR} SELECT block, min(s) AS t_start, max_by(t, idx) AS t_end, count(*) AS n_children FROM gr GROUP BY block, part, grp HAVING count(*) >= 2")
def nodes(spark, d):
    groups = _groups(spark, d)
    made, edges = hierarchy.materialise(groups, hierarchy.rollup(groups, 1))
    n = edges.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    return made.join(n, "node_id").select("block", "t_start", "t_end", "n_children")


@query("h9_outline", "WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey), al AS (SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS root, 0 AS depth, [{'t': r_regionkey::DOUBLE, 'i': 'r' || r_regionkey}] AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, [{'t': n_regionkey::DOUBLE, 'i': 'r' || n_regionkey}, {'t': n_nationkey::DOUBLE, 'i': 'n' || n_nationkey}] FROM nation UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2, [{'t': n_regionkey::DOUBLE, 'i': 'r' || n_regionkey}, {'t': c_nationkey::DOUBLE, 'i': 'n' || c_nationkey}, {'t': c_custkey::DOUBLE, 'i': 'c' || c_custkey}] FROM c) SELECT id, root, depth, false AS orphan, row_number() OVER (PARTITION BY root ORDER BY p)::INTEGER AS place FROM al")
def outline(spark, d):
    edges = _edges(spark, d).filter("child_id not like 'o%'")
    ids = edges.select(F.col("child_id").alias("id")).union(edges.select("parent_id")).union(fx.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")))).distinct()
    return hierarchy.outline(edges, ids.withColumn("t_start", F.substring("id", 2, 20).cast("double")))


@query("a19_brief", f"WITH {_CH}, b AS (SELECT block, string_agg(text || ' (' || (idx % 5) || ')', ' > ' ORDER BY idx) AS steps, list(app ORDER BY idx) AS apps FROM ch GROUP BY block HAVING count(*) >= 2) SELECT block AS session_id, steps, array_to_string(list_transform(list_filter(range(1, len(apps) + 1), lambda i: list_position(apps, apps[i]) = i), lambda i: apps[i]), ', ') AS apps FROM b")
def brief(spark, d):
    rows = _children(spark, d)
    return hierarchy.session_brief(rows.select(F.col("block").alias("session_id"), "idx", F.col("text").alias("name"), F.lit(1.0).alias("seconds"), (F.col("idx") % 5).alias("actions"), "app"))
