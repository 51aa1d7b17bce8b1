"""Regions of frames: element filters, hotspots, grids, fusion, hit tests, nesting."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import boxes
from sessionloom.operators.density import clustered, dbscan  # noqa: F401

# Fixed values.
DROP_ROLES = ("window", "application", "group", "unknown", "layout-area", "splitter", "scrollarea")
EVENT_WEIGHTS = {"mouse_down": 3.0, "mouse_up": 1.0, "scroll": 1.0, "mouse_move": 0.2}
BOX = ("x", "y", "w", "h")

#: So many kept boxes of a frame are compared one by one.
FEW = 24


def element_regions(elements: DataFrame, width: float, height: float, *, min_area: float = 64, max_share: float = 0.5) -> DataFrame:
    """Elements of useful size and role as regions: priority 2, one more with a label, two more in focus."""
    role = F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), "(?i)^AX", ""))
    size = F.greatest(F.col("w"), F.lit(0.0)) * F.greatest(F.col("h"), F.lit(0.0))
    kept = elements.filter((size >= min_area) & (size <= max_share * max(1.0, width * height)) & ~role.isin(*DROP_ROLES))
    priority = 2.0 + F.when(F.length("label") > 0, 1.0).otherwise(0.0) + F.when(F.coalesce("focused", F.lit(False)), 2.0).otherwise(0.0)
    return kept.withColumns({"source": F.lit("ax"), "priority": priority})


class _Kept:
    """Boxes kept so far, by the powers of two of their sides and their corner's cell there.

    Two boxes overlap by more than ``threshold`` only if their widths, and their heights, are within that
    ratio of each other, so a box asks few cells, however many boxes there are.
    """

    def __init__(self, threshold: float):
        self.levels = math.ceil(-math.log2(threshold)) if 0 < threshold < 1 else 0 if threshold >= 1 else None
        self.cells: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}
        self.boxes: list[tuple[float, float, float, float]] = []

    def add(self, box: tuple[float, float, float, float]) -> None:
        x, y, w, h = box
        if w > 0 and h > 0:  # an empty box overlaps nothing
            level = math.frexp(w)[1], math.frexp(h)[1]
            self.cells.setdefault(level, {}).setdefault((math.floor(x / 2.0 ** level[0]), math.floor(y / 2.0 ** level[1])), []).append(len(self.boxes))
        self.boxes.append(box)

    def near(self, box: tuple[float, float, float, float]) -> Iterable[int]:
        if self.levels is None or len(self.boxes) <= FEW:
            return range(len(self.boxes))
        x, y, w, h = box
        if not (w > 0 and h > 0):
            return ()
        found: list[int] = []
        lw, lh = math.frexp(w)[1], math.frexp(h)[1]
        for (a, b), cells in self.cells.items():
            if abs(a - lw) > self.levels or abs(b - lh) > self.levels:
                continue
            sx, sy = 2.0**a, 2.0**b
            for cx in range(math.floor((x - sx) / sx), math.floor((x + w) / sx) + 1):
                for cy in range(math.floor((y - sy) / sy), math.floor((y + h) / sy) + 1):
                    found += cells.get((cx, cy), ())
        return sorted(found)

    def first_hit(self, box: tuple[float, float, float, float], threshold: float) -> int | None:
        x, y, w, h = box
        size = max(w, 0.0) * max(h, 0.0)
        for i in self.near(box):
            kx, ky, kw, kh = self.boxes[i]
            iw, ih = min(kx + kw, x + w) - max(kx, x), min(ky + kh, y + h) - max(ky, y)
            both = iw * ih if iw > 0 and ih > 0 else 0.0
            union = max(kw, 0.0) * max(kh, 0.0) + size - both
            if (both / union if union > 0 else 0.0) > threshold:
                return i
        return None


#: Frames of at most so many regions are folded together.
SMALL = 64


def _fold_small(box: np.ndarray, source: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, times) of the regions of frames of one size: whether each is kept, and how often one of another source that goes lifts it.

    ``box``: x, y, w and h of each region; ``first``: where each frame begins. All frames go on by one region at a time.
    """
    kept, times = np.zeros(len(box), dtype=bool), np.zeros(len(box), dtype=np.int64)
    size = len(box) // max(len(first), 1)
    at = first[:, None] + np.arange(size)
    x, y, w, h = (box[:, i][at] for i in range(4))
    area = np.where(w > 0, w, 0.0) * np.where(h > 0, h, 0.0)
    stays, kind, rows = np.zeros((len(first), size), dtype=bool), source[at], np.arange(len(first))
    for i in range(size):
        iw = np.minimum((x + w)[:, :i], (x + w)[:, i, None]) - np.maximum(x[:, :i], x[:, i, None])
        ih = np.minimum((y + h)[:, :i], (y + h)[:, i, None]) - np.maximum(y[:, :i], y[:, i, None])
        both = np.where((iw > 0) & (ih > 0), iw * ih, 0.0)
        union = area[:, :i] + area[:, i, None] - both
        share = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        hit = stays[:, :i] & (share > threshold)
        stays[:, i] = ~hit.any(axis=1)
        if i:
            j = hit.argmax(axis=1)
            lifts = ~stays[:, i] & (kind[rows, j] != kind[:, i])
            np.add.at(times, at[rows, j][lifts], 1)
    kept[at] = stays
    return kept, times


def _fold(regions: DataFrame, order: list[Column], threshold: float, boost: float, most: int | None = None, dealt: bool = False) -> DataFrame:
    """Per frame, in order: a region that overlaps a kept one more than ``threshold`` goes; another source lifts that one.

    Rows are dealt by frame and sorted; a task reads frame after frame and holds some batches. Small frames of one
    size are folded together, by arrays. ``most``: so many stay of a frame, of highest priority and then least region_id.
    ``dealt``: the caller has dealt the rows by frame.
    """
    keys = {f"_o{i}": o for i, o in enumerate(order)}
    by_frame = regions.withColumns(keys) if dealt else regions.withColumns(keys).repartition("frame_id")
    by_frame = by_frame.sortWithinPartitions("frame_id", *keys).select(*regions.columns)

    def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What is kept of whole frames."""
        frame = batch.column("frame_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        box = np.column_stack([pc.fill_null(batch.column(c).cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False) for c in BOX])
        source = batch.column("source").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        size = np.diff(np.r_[first, len(frame)])
        kept, times = np.zeros(len(frame), dtype=bool), np.zeros(len(frame), dtype=np.int64)
        for n in np.unique(size[size <= SMALL]):
            of = first[size == n]
            at = (of[:, None] + np.arange(n)).ravel()
            kept[at], times[at] = _fold_small(box[at], source[at], np.arange(len(of)) * n, threshold)
        for start, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            near, rows = _Kept(threshold), []
            for row, one in enumerate(box[start : start + n].tolist(), start):
                hit = near.first_hit(tuple(one), threshold)
                if hit is None:
                    near.add(tuple(one))
                    rows.append(row)
                elif source[rows[hit]] != source[row]:
                    times[rows[hit]] += 1
            kept[rows] = True
        rows = np.flatnonzero(kept)
        if boost:
            priority, n = batch.column("priority").cast(pa.float64()), times[rows]
            lifted = priority.take(pa.array(rows)).to_numpy(zero_copy_only=False).copy()
            for i in range(int(n.max(initial=0))):  # one after the other, as sums are rounded
                lifted[n > i] += boost
            values = pa.array(lifted, mask=priority.take(pa.array(rows)).is_null().to_numpy(zero_copy_only=False)).cast(batch.schema.field("priority").type)
            batch = batch.take(pa.array(rows))
            batch = batch.set_column(batch.schema.get_field_index("priority"), batch.schema.field("priority"), values)
        else:
            batch = batch.take(pa.array(rows))
        if most is not None:
            table = pa.table({"frame": frame[rows], "priority": batch.column("priority"), "region": batch.column("region_id")})
            best = pc.sort_indices(table, sort_keys=[("frame", "ascending"), ("priority", "descending"), ("region", "ascending")]).to_numpy()
            of = frame[rows][best]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
            batch = batch.take(pa.array(best[place < most]))
        return batch

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the frame that goes on
        for batch in batches:
            if not len(batch):
                continue
            at = batch.column("frame_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            goes_on = int(np.flatnonzero(np.r_[-1, at] != at[-1])[-1])  # where the last frame begins
            same = not held or held[0].column("frame_id")[0].as_py() == batch.column("frame_id")[0].as_py()
            if goes_on or not same:
                yield folded(_joined([*held, batch.slice(0, goes_on)]))
                held = []
            held.append(batch.slice(goes_on))
        if held:
            yield folded(_joined(held))

    return by_frame.mapInArrow(fold, regions.schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def collapse(regions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Of regions that nearly coincide, that of highest priority, then of least area. A frame holds a bounded number."""
    size = F.greatest(F.col("w"), F.lit(0.0)) * F.greatest(F.col("h"), F.lit(0.0))
    return _fold(regions, [-F.col("priority"), size, F.col("region_id")], threshold, 0.0)


def fuse(regions: DataFrame, *, threshold: float = 0.5, most: int = 14, boost: float = 1.5, dealt: bool = False) -> DataFrame:
    """Non-maximum suppression over all sources; agreement of two sources lifts a region; the best ``most`` stay."""
    return _fold(regions, [-F.col("priority"), F.col("region_id")], threshold, boost, most, dealt)


def weighted_points(ev: DataFrame) -> DataFrame:
    """Events with a place and a kind that counts, with their weight."""
    weight = F.create_map(*[F.lit(v) for pair in EVENT_WEIGHTS.items() for v in pair])
    return ev.filter(F.col("kind").isin(*EVENT_WEIGHTS) & F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("weight", weight[F.col("kind")])


def hotspots(points: DataFrame, clusters: DataFrame | None, width: float, height: float, *, pad: float = 48.0, scale: float = 9.0) -> DataFrame:
    """A padded box around each cluster, in the frame; priority 1 to 2 by its weight. Without ``clusters``, points have their cluster."""
    rows = points.filter("cluster >= 0") if clusters is None else points.join(clusters.filter("cluster >= 0"), ["frame_id", "point_id"])
    b = rows.groupBy("frame_id", "cluster").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.sum("weight").alias("weight"))
    box = boxes.clamp(F.col("x0") - pad, F.col("y0") - pad, F.col("x1") - F.col("x0") + 2 * pad, F.col("y1") - F.col("y0") + 2 * pad, width, height)
    return b.select("frame_id", "cluster", box.alias("b"), F.lit("hotspot").alias("source"), (1 + F.least(F.col("weight") / scale, F.lit(1.0))).alias("priority")).select("frame_id", "cluster", *[F.col(f"b.{c}").alias(c) for c in BOX], "source", "priority")


def tiles(width: Column, height: Column, *, cols: int = 4, rows: int = 3, overlap: float = 0.15, priority: float = 0.5) -> Column:
    """The overlapping tiles of a frame, cut at its edges, as an array."""
    sx, sy = width / F.lit(cols), height / F.lit(rows)

    def tile(r: int, c: int) -> Column:
        x, y = F.lit(c) * sx - sx * overlap / 2, F.lit(r) * sy - sy * overlap / 2
        x0, y0 = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
        w, h = F.least(x + sx * (1 + overlap), width) - x0, F.least(y + sy * (1 + overlap), height) - y0
        return F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), x0.alias("x"), y0.alias("y"), w.alias("w"), h.alias("h"), F.lit("grid").alias("source"), F.lit(priority).alias("priority"))

    return F.filter(F.array(*[tile(r, c) for r in range(rows) for c in range(cols)]), lambda t: (t["w"] > 0) & (t["h"] > 0))


def grid(frames: DataFrame, *, cols: int = 4, rows: int = 3, overlap: float = 0.15, priority: float = 0.5) -> DataFrame:
    """Overlapping tiles of each frame (frame_id, width, height), cut at its edges."""
    return frames.select("frame_id", F.inline(tiles(F.col("width"), F.col("height"), cols=cols, rows=rows, overlap=overlap, priority=priority)))


#: Levels of the tree of squares that boxes are kept on: sides up to 2 ** 30, every second one.
LEVELS = range(-10, 31, 2)


def holding(points: DataFrame, shapes: DataFrame, key: str, margin: float = 0.0) -> DataFrame:
    """Every (point, box) of one ``key`` where the box, wider by ``margin`` on each side, holds the point's (px, py).

    A box stands on the few squares that it reaches at the level of its longer side; a point asks its own
    square of each level that boxes stand on. So points meet boxes that are near for their size, and not
    all of a screen's.
    """
    side = F.greatest(F.col("w"), F.col("h")).cast("double") + 2 * margin
    level = F.coalesce(F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(F.when(side > 0, side)) / 2) * 2), F.lit(LEVELS[0])).cast("int")
    known = shapes.filter((F.col("w") >= 0) & (F.col("h") >= 0)).withColumn("_at", level)
    levels = sorted(r["_at"] for r in known.select("_at").distinct().collect())  # as many as LEVELS at most
    cell = lambda v, at: F.floor(v / F.pow(F.lit(2.0), F.col(at))).cast("long")
    across = lambda low, size: F.explode(F.sequence(cell(F.col(low) - margin, "_at"), cell(F.col(low) + F.col(size) + margin, "_at")))
    spread = known.withColumn("_sx", across("x", "w")).withColumn("_sy", across("y", "h")).withColumnRenamed(key, "_key")
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumns({"_px": cell(F.col("px"), "_level"), "_py": cell(F.col("py"), "_level")})
    meet = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_at")) & (F.col("_px") == F.col("_sx")) & (F.col("_py") == F.col("_sy"))
    inside = (F.col("px") >= F.col("x") - margin) & (F.col("px") <= F.col("x") + F.col("w") + margin) & (F.col("py") >= F.col("y") - margin) & (F.col("py") <= F.col("y") + F.col("h") + margin)
    return asked.join(spread, meet & inside).drop("_level", "_px", "_py", "_key", "_at", "_sx", "_sy")


def smallest_hit(points: DataFrame, regions: DataFrame) -> DataFrame:
    """point_id, region_id: the labelled region of the frame that holds a point, the smallest."""
    b = F.struct(*BOX)
    met = holding(points.select("frame_id", "point_id", F.col("x").alias("px"), F.col("y").alias("py")), regions.filter(F.length("label") > 0), "frame_id")
    return met.groupBy("point_id").agg(F.min_by("region_id", F.struct(boxes.area(b), "region_id")).alias("region_id"))


def deepest_hit(points: DataFrame, elements: DataFrame) -> DataFrame:
    """point_id, idx: the deepest element that holds a point, the smaller and then the earlier on a tie."""
    b = F.struct(*BOX)
    met = holding(points.select("snapshot_id", "point_id", F.col("x").alias("px"), F.col("y").alias("py")), elements, "snapshot_id")
    return met.groupBy("point_id").agg(F.max_by("idx", F.struct("depth", -boxes.area(b), -F.col("idx"))).alias("idx"))


def display_of(points: DataFrame, displays: DataFrame) -> DataFrame:
    """point_id, display: the one that holds the point, else the primary, else the first, else D0."""
    per = displays.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ord", "display", "x", "y", "w", "h", "primary"))).alias("ds"))
    rows = points.join(per, "session_id", "left")
    holds = F.filter("ds", lambda s: boxes.contains(s, F.col("x"), F.col("y")))
    first = lambda a: F.try_element_at(a, F.lit(1))["display"]
    return rows.select("point_id", F.coalesce(first(holds), first(F.filter("ds", lambda s: s["primary"])), first(F.col("ds")), F.lit("D0")).alias("display"))


def outside_displays(shapes: DataFrame, displays: DataFrame) -> DataFrame:
    """box_id, outside: whether a box overlaps none of the session's displays."""
    per = displays.groupBy("session_id").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("ds"))
    b = F.struct(*BOX)
    return shapes.join(per, "session_id", "left").select("box_id", (~F.coalesce(F.exists("ds", lambda s: boxes.intersection(s, b) > 0), F.lit(False))).alias("outside"))


def nest(elements: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """snapshot_id, idx, parent: the smallest larger box of the snapshot that holds an element, within a pixel.

    Of equal boxes the earlier holds the later. An element meets the boxes that hold its middle.
    """
    size = lambda p: F.col(f"{p}w") * F.col(f"{p}h")
    inner = elements.select("snapshot_id", "idx", *[F.col(c).alias(f"i{c}") for c in BOX], (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    outer = elements.select("snapshot_id", F.col("idx").alias("oi"), *BOX)
    # a box within the tolerance holds the middle within it too, but for rounding
    met = holding(inner, outer, "snapshot_id", tolerance + 1e-6).filter(
        (F.col("x") <= F.col("ix") + tolerance) & (F.col("y") <= F.col("iy") + tolerance) & (F.col("x") + F.col("w") >= F.col("ix") + F.col("iw") - tolerance) & (F.col("y") + F.col("h") >= F.col("iy") + F.col("ih") - tolerance)
        & ((size("") > size("i")) | ((size("") == size("i")) & (F.col("oi") < F.col("idx"))))
    )
    best = met.groupBy("snapshot_id", "idx").agg(F.min_by("oi", F.struct(size(""), -F.col("oi"))).alias("parent"))
    return elements.select("snapshot_id", "idx").join(best, ["snapshot_id", "idx"], "left")


def depths(nested: DataFrame, most: int = 64) -> DataFrame:
    """snapshot_id, idx, depth from parents, one level a round; raises where elements lie deeper than ``most``."""
    known = nested.filter("parent is null").select("snapshot_id", "idx", F.lit(0).alias("depth"))
    front, out = known, known
    for depth in range(1, most + 1):
        front = nested.join(front.select("snapshot_id", F.col("idx").alias("parent")), ["snapshot_id", "parent"]).select("snapshot_id", "idx", F.lit(depth).alias("depth")).checkpoint()
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError(f"elements lie deeper than {most} levels")


def dhash(thumbs: DataFrame) -> DataFrame:
    """frame_id, phash: 64 bits of a 9 by 8 grey thumbnail, one where a pixel is brighter than its right neighbour.

    ``thumbs``: frame_id, pixels (72 values by rows).
    """
    at = lambda r, c: F.element_at("pixels", r * 9 + c + 1)
    bits = [F.when(at(r, c) > at(r, c + 1), F.shiftleft(F.lit(1).cast("long"), 63 - (r * 8 + c))).otherwise(F.lit(0).cast("long")) for r in range(8) for c in range(8)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return thumbs.select("frame_id", out.alias("phash"))
