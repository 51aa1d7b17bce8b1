"""Stored trees over segments: closures, ancestors, composition of levels, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.sources.tables import ensure_checkpoint_dir


def closure(edges: DataFrame, nodes: DataFrame | None = None, most: int = 64) -> DataFrame:
    """ancestor, descendant, depth (a node is its own at depth 0). ``edges``: parent_id, child_id.

    One join a level: trees of segments are a few levels deep however many nodes they have.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    ids = edges.select(F.col("parent_id").alias("id")).union(edges.select("child_id"))
    ids = (ids if nodes is None else ids.union(nodes.select("id"))).distinct()
    out = ids.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"))
    front = out
    for depth in range(1, most):
        front = front.join(edges, front["descendant"] == edges["parent_id"]).select("ancestor", F.col("child_id").alias("descendant"), F.lit(depth).alias("depth")).checkpoint()
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"the tree is deeper than {most}, or holds a cycle")


def leaves(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, leaf: the descendants without children; a leaf is its own."""
    all_ = closure(edges, ids)
    return ids.join(all_, F.col("id") == F.col("ancestor")).join(edges.select(F.col("parent_id").alias("descendant")).distinct(), "descendant", "left_anti").select("id", F.col("descendant").alias("leaf")).distinct()


def nearest_summary(edges: DataFrame, ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """id, summary of the nearest ancestor (itself first) that has one; null where none has."""
    up = ids.join(closure(edges, ids), F.col("id") == F.col("descendant"), "left")
    found = up.join(summaries.select(F.col("id").alias("ancestor"), "summary"), "ancestor").groupBy("id").agg(F.min_by("summary", "depth").alias("summary"))
    return ids.join(found, "id", "left")


def barrier_blocks(children: DataFrame) -> DataFrame:
    """children (block, idx, barrier, ...) with ``part``: cut before and after each barrier."""
    w = Window.partitionBy("block").orderBy("idx")
    edge = (F.col("barrier") | F.coalesce(F.lag("barrier").over(w), F.lit(False))).cast("int")
    return children.withColumn("part", F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def split_at_gaps(children: DataFrame, cap: int = 24, rounds: int = 64) -> DataFrame:
    """Parts of more than ``cap`` children cut at their largest gap until none is larger.

    On equal gaps a change of app goes first, then the leftmost. Each round cuts every large part
    once; a part that is large after all rounds raises an error.
    """
    ensure_checkpoint_dir(children.sparkSession)
    rows = children.withColumn("part", F.col("part").cast("string"))
    for _ in range(rounds):
        w = Window.partitionBy("block", "part")
        o = w.orderBy("idx")
        seen = rows.withColumns({"_n": F.count("*").over(w), "_gap": F.col("start_sec") - F.lag("end_sec").over(o), "_new": (~F.col("app").eqNullSafe(F.lag("app").over(o))).cast("int")})
        if seen.filter(F.col("_n") > cap).isEmpty():
            return rows
        rank = F.row_number().over(w.orderBy(F.desc_nulls_last("_gap"), F.desc("_new"), "idx"))
        cut = seen.withColumn("_cut", (F.col("_n") > cap) & (rank == 1))
        side = F.sum(F.col("_cut").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0))
        rows = cut.withColumn("part", F.when(F.col("_n") > cap, F.concat("part", F.lit("."), side.cast("string"))).otherwise(F.col("part"))).select(*children.columns).checkpoint()
    raise ValueError(f"a part is still larger than {cap} after {rounds} rounds")


def structural_groups(children: DataFrame) -> DataFrame:
    """children with ``grp``: each part of n merged at its most coherent seams to ceil(n / 2) groups.

    A seam's score depends on its two neighbours alone (same app 2, same URL 1, a gap of 1 s or less
    1, of 3 s or more -1), so the best n - ceil(n / 2) seams go, leftmost first on a tie.
    """
    w = Window.partitionBy("block", "part")
    o = w.orderBy("idx")
    gap = F.col("start_sec") - F.lag("end_sec").over(o)
    same = lambda c: F.coalesce((F.col(c) == F.lag(c).over(o)).cast("int"), F.lit(0))
    score = 2 * same("app") + same("url") + F.when(gap <= 1, 1).when(gap >= 3, -1).otherwise(0)
    rows = children.withColumns({"_n": F.count("*").over(w), "_first": F.row_number().over(o) == 1, "_score": score})
    rank = F.row_number().over(w.orderBy("_first", F.desc("_score"), "idx"))
    rows = rows.withColumn("_merged", ~F.col("_first") & (rank <= F.col("_n") - F.ceil(F.col("_n") / 2)))
    return rows.withColumn("grp", F.sum((~F.col("_merged")).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_n", "_first", "_score", "_merged")


def level_qualifies(groups: DataFrame) -> DataFrame:
    """block, qualifies: fewer groups than children, and some group of two or more."""
    sizes = groups.groupBy("block", "part", "grp").agg(F.count("*").alias("n"))
    return sizes.groupBy("block").agg(((F.count("*") < F.sum("n")) & (F.max("n") >= 2)).alias("qualifies"))


def valid_partition(ranges: DataFrame, sizes: DataFrame) -> DataFrame:
    """block, valid: whether ranges [start, end) are non-empty, follow each other, and cover 0..n."""
    o = Window.partitionBy("block").orderBy("start")
    follows = F.col("start") == F.coalesce(F.lag("end").over(o), F.lit(0))
    checked = ranges.withColumn("_ok", follows & (F.col("end") > F.col("start"))).groupBy("block").agg(F.min("_ok").alias("ok"), F.max("end").alias("end"))
    return sizes.join(checked, "block", "left").select("block", F.coalesce(F.col("ok") & (F.col("end") == F.col("n")), F.lit(False)).alias("valid"))


def rollup(groups: DataFrame, level: int, *, most: int = 200) -> DataFrame:
    """block, part, grp, n, t_start, t_end, summary of each group: apps, count and seconds, or the children's names.

    The seconds are written with one decimal.
    """
    keys = ["block", "part", "grp"]
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.trim("text").alias("text"), "app")))
    g = groups.groupBy(*keys).agg(ordered.alias("c"), F.count("*").alias("n"), F.min("start_sec").alias("t_start"), F.max_by("end_sec", "idx").alias("t_end"))
    distinct = lambda f: F.array_distinct(F.filter(F.transform("c", lambda c: c[f]), lambda v: v.isNotNull() & (v != "")))
    names = F.array_join(distinct("text"), "; ")
    short = F.when(F.length(names) > most, F.concat(F.rtrim(F.substring(names, 1, most)), F.lit("…"))).otherwise(names)
    noun = F.concat(F.lit("action" if level == 1 else "group"), F.when(F.col("n") == 1, "").otherwise("s"))
    apps = F.array_join(distinct("app"), ", ")
    counted = F.concat_ws(" · ", F.when(apps != "", apps), F.concat(F.col("n").cast("string"), F.lit(" "), noun), F.concat(F.format_string("%.1f", F.round(F.col("t_end") - F.col("t_start"), 1)), F.lit("s")))
    return g.select(*keys, "n", "t_start", "t_end", (F.when(names != "", short).otherwise(counted) if level >= 2 else counted).alias("summary"))


def materialise(groups: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, block, t_start, t_end, summary) of groups of two or more, and edges; singletons pass through.

    Ids are hashes of where a node lies, so a second run gives the same ones.
    """
    key = F.substring(F.sha2(F.concat_ws("|", "block", "part", "grp"), 256), 1, 16)
    nodes = summaries.filter("n >= 2").select(key.alias("node_id"), "block", "part", "grp", "t_start", "t_end", "summary")
    edges = groups.join(nodes.select("block", "part", "grp", "node_id"), ["block", "part", "grp"]).select(F.col("node_id").alias("parent_id"), F.col("child_id"))
    return nodes.drop("part", "grp"), edges


def frames_below(edges: DataFrame, ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, frame_id of every frame linked to a node or to one of its descendants."""
    return ids.join(closure(edges, ids), F.col("id") == F.col("ancestor")).join(links.withColumnRenamed("segment_id", "descendant"), "descendant").select("id", "frame_id").distinct()


def outline(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, depth, place: nodes in preorder, siblings by t_start and id; ``orphan`` marks those with a parent that is not there.

    ``nodes``: id, t_start.
    """
    up = closure(edges, nodes)
    own = nodes.select(F.col("id").alias("ancestor"), F.struct("t_start", "id").alias("key"))
    path = up.join(own, "ancestor").groupBy(F.col("descendant").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "key"))).alias("p"), F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("root"))
    missing = edges.join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(F.col("child_id").alias("id")).distinct().withColumn("orphan", F.lit(True))
    rows = path.join(nodes.select("id"), "id", "left_semi").join(missing, "id", "left").select("id", "root", "depth", F.transform("p", lambda x: x["key"]).alias("path"), F.coalesce("orphan", F.lit(False)).alias("orphan"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path"))).drop("path")


def session_brief(children: DataFrame) -> DataFrame:
    """session_id, steps, apps of sessions with two or more root steps. ``children``: session_id, idx, name, seconds, actions, app."""
    g = children.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "seconds", "actions", "app"))).alias("c"), F.count("*").alias("n"))
    apps = F.array_distinct(F.filter(F.transform("c", lambda c: c["app"]), lambda a: a.isNotNull()))
    steps = F.transform("c", lambda c: F.concat(c["name"], F.lit(" ("), c["actions"].cast("string"), F.lit(")")))
    return g.filter("n >= 2").select("session_id", F.array_join(steps, " > ").alias("steps"), F.array_join(apps, ", ").alias("apps"))
