"""Compositions of several operators: key decoding, lanes, hit enrichment, moments, regions, rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import hierarchy, spatial, temporal
from sessionloom.sources import tables

# Modifiers that make a key a command, and the virtual key of each scancode: letters A to Z, digits 1 to 0, then punctuation and space.
COMMANDS = ("cmd", "ctrl")
VIRTUAL_KEYS = {
    30: 0, 48: 11, 46: 8, 32: 2, 18: 14, 33: 3, 34: 5, 35: 4, 23: 34, 36: 38, 37: 40, 38: 37, 50: 46, 49: 45, 24: 31, 25: 35, 16: 12, 19: 15, 31: 1, 20: 17, 22: 32, 47: 9, 17: 13, 45: 7, 21: 16, 44: 6,
    2: 18, 3: 19, 4: 20, 5: 21, 6: 23, 7: 22, 8: 26, 9: 28, 10: 25, 11: 29,
    12: 27, 13: 24, 26: 33, 27: 30, 43: 42, 39: 41, 40: 39, 41: 50, 51: 43, 52: 47, 53: 44, 57: 49,
}


def decode_keys(keys: DataFrame, keymaps: DataFrame) -> DataFrame:
    """keys with ``char`` and ``held``: the character by the keymap in force, and the modifiers still listed.

    ``keys``: session_id, event_id, t, scancode, modifiers (array); ``keymaps``: session_id, event_id,
    t, map (virtual key to an array of the plain, shift, alt and alt-shift characters). A command takes
    the plain column and keeps its modifiers; a decoded character uses its modifiers up; a key that no
    keymap knows has no character.
    """
    codes = F.create_map(*[F.lit(v) for pair in VIRTUAL_KEYS.items() for v in pair])
    rows = temporal.asof(keys, keymaps, ["map"])
    has = lambda m: F.array_contains("modifiers", m).cast("int")
    command = F.arrays_overlap("modifiers", F.array(*[F.lit(c) for c in COMMANDS]))
    column = F.when(command, F.lit(1)).otherwise(1 + has("shift") + 2 * has("alt"))
    char = F.nullif(F.try_element_at(F.col("map")[codes[F.col("scancode")]], column), F.lit(""))
    kept = F.when(char.isNotNull() & ~command, F.array().cast("array<string>")).otherwise(F.array_sort("modifiers"))
    return rows.withColumn("char", char).withColumn("held", kept).drop("map")


def presence_lanes(segs: DataFrame) -> DataFrame:
    """session_id, lane, t_start, t_end, text: spans with a transcript, caption or app caption of the session's commonest granularity.

    ``segs``: session_id, granularity, t_start, t_end, transcript, caption, app_caption.
    """
    n = segs.groupBy("session_id", "granularity").agg(F.count("*").alias("n"))
    finest = n.groupBy("session_id").agg(F.max_by("granularity", F.struct("n", "granularity")).alias("granularity"))
    rows = segs.join(finest, ["session_id", "granularity"], "left_semi")
    lanes = F.explode(F.array(*[F.struct(F.lit(c).alias("lane"), F.col(c).alias("text")) for c in ("transcript", "caption", "app_caption")]))
    return rows.select("session_id", "t_start", "t_end", lanes.alias("l")).select("session_id", "l.lane", "t_start", "t_end", "l.text").filter(F.trim("text") != "")


def level_lanes(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """session_id, level, node_id, t_start, t_end, text, templated: a lane a level; the flag tells levels of template text alone."""
    rows = nodes.join(summaries.select("node_id", F.col("summary").alias("text"), "source"), "node_id", "left")
    w = Window.partitionBy("session_id", "level")
    return rows.withColumn("templated", F.min((F.coalesce("source", F.lit("template")) == "template")).over(w)).drop("source")


def frame_recall(scored: DataFrame | None, scope: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance: a query's frames of a multi-vector search (query_id, id, score), and for queries that it
    finds none for, k of the frames of their scope's segments, without a distance.

    ``scope``: query_id, segment_id; ``links``: segment_id, frame_id.
    """
    if scored is not None:
        scope = scope.join(scored.select("query_id").distinct(), "query_id", "left_anti")
    found = scope.join(links, "segment_id").select("query_id", F.col("frame_id").alias("id")).distinct()
    w = Window.partitionBy("query_id").orderBy("id")
    plain = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select("query_id", "id", F.lit(None).cast("double").alias("distance"))
    return plain if scored is None else scored.select("query_id", "id", F.col("score").alias("distance")).unionByName(plain)


def task_summaries(ids: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """segment_id, task: the summary of the nearest node at or above a segment that has one (J17)."""
    found = hierarchy.nearest_summary(edges, ids.select(F.col("segment_id").alias("id")).filter("id is not null").distinct(), summaries)
    return found.select(F.col("id").alias("segment_id"), F.col("summary").alias("task"))


def enrich_hits(hits: DataFrame, frames: DataFrame, sessions: DataFrame, focus: DataFrame, edges: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """hits with session_id, wall clock, offset, the session's length, the app in force and the task the segment belongs to.

    ``hits``: query_id, frame_id, segment_id (null if none is known); ``frames``: frame_id, session_id, t;
    ``sessions``: session_id, started_at, t_end; ``focus``: session_id, event_id, t, app; ``edges`` and
    ``summaries``: the tree of segments and what was said of its nodes.
    """
    rows = hits.join(frames, "frame_id").join(sessions, "session_id")
    rows = temporal.asof(rows.withColumn("event_id", F.col("frame_id")), focus, ["app"])
    columns = ["query_id", "frame_id", "session_id", (F.col("started_at") + F.col("t")).alias("wall_ms"), (F.col("t") / 1000).alias("offset_sec"), (F.col("t_end") / 1000).alias("session_sec"), "app"]
    if edges is None or summaries is None:
        return rows.select(*columns)
    return rows.join(task_summaries(hits, edges, summaries), "segment_id", "left").select(*columns, "task")


def moment(frames: DataFrame, links: DataFrame, segs: DataFrame, elements: DataFrame, most: int = 40, *, edges: DataFrame | None = None, summaries: DataFrame | None = None, highlights: DataFrame | None = None) -> DataFrame:
    """frame_id, texts, labels: the texts of a frame's segments and at most ``most`` labels, both in order; with a tree
    and summaries its ``task``, that of its first segment which has one; with ``highlights`` (frame_id, region_id, role,
    label, matched_by, strength) its matched ``regions``, the strongest first.
    """
    said = frames.select("frame_id").join(links, "frame_id").join(segs.select("segment_id", "text"), "segment_id").groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda s: s["text"]).alias("texts"))
    w = Window.partitionBy("frame_id").orderBy("idx")
    seen = elements.filter(F.length("label") > 0).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda s: s["label"]).alias("labels"))
    out = frames.select("frame_id").join(said, "frame_id", "left").join(seen, "frame_id", "left")
    if edges is not None and summaries is not None:
        tasks = links.join(task_summaries(links, edges, summaries).filter("task is not null"), "segment_id").groupBy("frame_id").agg(F.min_by("task", "segment_id").alias("task"))
        out = out.join(tasks, "frame_id", "left")
    if highlights is not None:
        name = F.concat(F.coalesce("role", F.lit("region")), F.lit(' "'), F.coalesce("label", F.lit("")), F.lit('" ('), F.array_join("matched_by", "+"), F.lit(")"))
        met = highlights.select("frame_id", F.struct((-F.col("strength")).alias("s"), "region_id", name.alias("name")).alias("h")).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list("h")), lambda h: h["name"]).alias("regions"))
        out = out.join(met, "frame_id", "left")
    return out


def primary_segments(frames: DataFrame, segs: DataFrame) -> DataFrame:
    """frame_id, session_id, segment_id, t_start, t_end: the shortest segment that holds a frame, ends included."""
    held = temporal.interval_join(frames.select("frame_id", "session_id", "t"), segs.withColumn("_end", F.col("t_end")), closed_at="_end")
    best = F.min_by(F.struct("segment_id", "t_start", "t_end"), F.struct(F.col("t_end") - F.col("t_start"), "segment_id"))
    return held.groupBy("frame_id", "session_id").agg(best.alias("s")).select("frame_id", "session_id", "s.*")


def region_job(frames: DataFrame, segs: DataFrame, ev: DataFrame, elements: DataFrame, *, size: tuple[float, float], most: int = 14) -> DataFrame:
    """frame_id, region_id, source, priority and box: elements, hotspots of the frame's segment, and a grid, fused.

    ``frames``: frame_id, session_id, t; ``segs``: session_id, segment_id, t_start, t_end;
    ``elements``: frame_id, region_id, role, label, focused and box. A frame is dealt as one row, its tiles are
    made where it lies.
    """
    span = primary_segments(frames, segs).drop("segment_id").withColumn("_end", F.col("t_end"))
    inside = temporal.interval_join(spatial.weighted_points(ev), span, closed_at="_end")
    points = spatial.clustered(inside.select("frame_id", F.col("event_id").alias("point_id"), "x", "y", "weight"))
    hot = spatial.hotspots(points, None, *size)
    box = ["source", "priority", "x", "y", "w", "h"]
    name = lambda prefix, *cols: F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in cols]).alias("region_id")
    ax = spatial.collapse(spatial.element_regions(elements, *size).select("frame_id", "region_id", *box, "role", "label"))
    each = ax.select("frame_id", name("ax", "region_id"), *box).unionByName(hot.select("frame_id", name("hot", "cluster"), *box))
    each = each.select("frame_id", F.struct("region_id", *box).alias("one"))
    dealt = each.unionByName(frames.select("frame_id", F.lit(None).cast(each.schema["one"].dataType).alias("one"))).repartition("frame_id")
    tile = lambda t: F.struct(F.concat_ws(":", F.lit("grid"), t["r"].cast("string"), t["c"].cast("string")).alias("region_id"), *[t[c].alias(c) for c in box])
    tiles = F.transform(spatial.tiles(F.lit(float(size[0])), F.lit(float(size[1]))), tile)
    every = dealt.select("frame_id", F.inline(F.when(F.col("one").isNull(), tiles).otherwise(F.array("one"))))
    return spatial.fuse(every, most=most, dealt=True)


def element_paths(elements: DataFrame) -> DataFrame:
    """elements with ``path``, ``role[i]>role[j]`` from the root. One join a level, as deep as the deepest element.

    Elements that hang on a circle of parents, or on one that is absent, have no path.
    """
    tables.ensure_checkpoint_dir(elements.sparkSession)
    w = Window.partitionBy("snapshot_id", "parent", "role").orderBy("idx")
    step = F.concat(F.col("role"), F.lit("["), (F.row_number().over(w) - 1).cast("string"), F.lit("]"))
    steps = elements.select("snapshot_id", "idx", "parent", step.alias("step")).checkpoint()
    front = steps.filter("parent is null").select("snapshot_id", "idx", F.col("step").alias("path"))
    out = front
    while True:
        above = front.select("snapshot_id", F.col("idx").alias("parent"), F.col("path").alias("above"))
        front = steps.join(above, ["snapshot_id", "parent"]).select("snapshot_id", "idx", F.concat_ws(">", "above", "step").alias("path")).checkpoint()
        if front.isEmpty():
            return elements.join(out, ["snapshot_id", "idx"], "left")
        out = out.unionByName(front)


def build_anchors(points: DataFrame, elements: DataFrame, regions: DataFrame, windows: DataFrame) -> DataFrame:
    """point_id with the element hit (role, label, identifier, path), the smallest region, and the point relative to its window.

    ``points``: point_id, snapshot_id, frame_id, session_id, event_id, t, x, y; ``elements``: snapshot_id, idx,
    parent, depth, role, label, identifier and box; ``windows``: session_id, event_id, t, wx, wy. A path
    leads from the root: each step is a role and its place (from 0) among siblings of that role.
    """
    placed = element_paths(elements)
    hit = spatial.deepest_hit(points, elements)
    hit = points.select("point_id", "snapshot_id").join(hit, "point_id").join(placed.select("snapshot_id", "idx", "role", F.nullif("label", F.lit("")).alias("label"), F.nullif("identifier", F.lit("")).alias("identifier"), "path"), ["snapshot_id", "idx"])
    region = spatial.smallest_hit(points.select("frame_id", "point_id", "x", "y"), regions)
    rows = temporal.asof(points, windows, ["wx", "wy"]).join(hit.select("point_id", "role", "label", "identifier", "path"), "point_id", "left").join(region, "point_id", "left")
    return rows.select("point_id", "role", "label", "identifier", "path", "region_id", (F.col("x") - F.col("wx")).alias("rel_x"), (F.col("y") - F.col("wy")).alias("rel_y"))


def rebuild_report(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, n_events, n_edges, skipped, apps of a full rebuild: sessions without edges are skipped."""
    kept = temporal.exclusion_report(marked)
    n = edges.groupBy("session_id").agg(F.count("*").alias("n_edges"))
    rows = kept.join(n, "session_id", "left")
    return rows.select("session_id", F.col("kept").alias("n_events"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.col("n_edges").isNull().alias("skipped"), "apps")


def walk_marks(bound: DataFrame, sessions: DataFrame) -> DataFrame:
    """habit_id, session_id, started_at, gained, place: a habit's sessions in time, those it gained marked.

    ``bound``: habit_id, sessions (written from), live (of the bound route).
    """
    rows = bound.select("habit_id", "sessions", F.explode("live").alias("session_id")).select("habit_id", "session_id", (~F.array_contains("sessions", F.col("session_id"))).alias("gained"))
    return rows.join(sessions.select("session_id", "started_at"), "session_id").withColumn("place", F.row_number().over(Window.partitionBy("habit_id").orderBy("started_at", "session_id")))


def flow_variables(walked: DataFrame, samples: DataFrame, apps: DataFrame) -> DataFrame:
    """route_key, apps (in order), samples (distinct, sorted) of each route. ``samples``: edge_id, text; ``apps``: edge_id, app."""
    edges = walked.select("route_key", F.posexplode("edges").alias("i", "edge_id"))
    said = edges.join(samples, "edge_id").groupBy("route_key").agg(F.array_join(F.array_sort(F.collect_set("text")), ",").alias("samples"))
    seen = edges.join(apps, "edge_id").groupBy("route_key", "app").agg(F.min("i").alias("i")).groupBy("route_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "app"))), lambda s: s["app"]), ",").alias("apps"))
    return walked.select("route_key").distinct().join(said, "route_key", "left").join(seen, "route_key", "left")
