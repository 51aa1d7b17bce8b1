"""Clusters of points by weighted density, over a grid whose dense cells need no pairs of points.

Cells have a diagonal of ``eps``, so all points of a cell are neighbours: where a cell's weight alone makes
a point core, all its points are, and they are one cluster. Distances are taken between a light cell's
points (few, since their weight is below the bound) and neighbouring cells that reach over ``eps``, and
between cells that may touch. A cell that lies within ``eps`` as a whole is taken as one weight. Frames of few
points need no grid: a task clusters them by arrays, all of one size at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells that can hold a neighbour: two rings without the corners.
AROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a or b) and abs(a) + abs(b) < 4]
#: Of two cells with so many pairs of points or less, the pairs are joined; of more, a tree search tells whether any is near.
PAIRS = 4096
#: Frames of so many points or less are clustered in a task; most pairs of points that it holds at once.
SMALL, HELD = 64, 2_000_000
CELL = ["frame_id", "cx", "cy"]
SITE = ["frame_id", "x", "y"]


def _gap(x0: Column, x1: Column, u0: Column, u1: Column) -> Column:
    """Least distance of two intervals."""
    return F.greatest(F.lit(0.0), u0 - x1, x0 - u1)


def _reach(x0: Column, x1: Column, u0: Column, u1: Column) -> Column:
    """Greatest distance of points of two intervals."""
    return F.greatest(u1 - x0, x1 - u0)


def _span(cells: DataFrame, *more: Column) -> DataFrame:
    return cells.groupBy(*CELL).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), *more)


def any_within(a: np.ndarray, b: np.ndarray, eps2: float) -> bool:
    """Whether a point of ``a`` (rows of x, y) is within the distance of one of ``b``: halves whose boxes are too far apart are left out."""
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        p0, p1, q0, q1 = p.min(0), p.max(0), q.min(0), q.max(0)
        if (np.maximum(0.0, np.maximum(q0 - p1, p0 - q1)) ** 2).sum() > eps2:
            continue
        if (np.maximum(q1 - p0, p1 - q0) ** 2).sum() <= eps2:
            return True
        if len(p) * len(q) <= PAIRS:
            d = p[:, None, :] - q[None, :, :]
            if (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] <= eps2).any():
                return True
            continue
        split_p = (p1 - p0).max() * len(p) >= (q1 - q0).max() * len(q) and len(p) > 1 or len(q) == 1
        whole, other = (p, q) if split_p else (q, p)
        axis = int(np.argmax(whole.max(0) - whole.min(0)))
        half = len(whole) // 2
        order = np.argpartition(whole[:, axis], half)
        for part in (whole[order[:half]], whole[order[half:]]):
            todo.append((part, other) if split_p else (other, part))
    return False


def _touching(eps: float):
    def touching(table: pa.Table) -> pa.Table:
        at = np.column_stack((table["x"].to_numpy(), table["y"].to_numpy()))
        side = table["side"].to_numpy()
        a, b = at[side == 0], at[side == 1]
        near = len(a) > 0 and len(b) > 0 and any_within(a, b, eps * eps)
        return table.slice(0, 1 if near else 0).select(["frame_id", "cx", "cy", "dx", "dy"])

    return touching


def _few(x: np.ndarray, y: np.ndarray, weight: np.ndarray, eps2: float, enough: float) -> np.ndarray:
    """Clusters of the points of frames of one size: a row is a frame, its points in the order of their ids."""
    n = x.shape[1]
    dx, dy = x[:, None, :] - x[:, :, None], y[:, None, :] - y[:, :, None]
    near = dx * dx + dy * dy <= eps2
    core = (near * weight[:, None, :]).sum(axis=2) >= enough
    to = near & core[:, None, :]
    least = lambda value: np.where(to, value[:, None, :], n).min(axis=2)
    label = np.where(core, np.arange(n), n)
    while True:  # labels only fall, so this ends
        fell = np.where(core, least(label), n)
        if (fell == label).all():
            break
        label = fell
    number = np.cumsum(label == np.arange(n), axis=1) - 1
    own = np.where(core, np.take_along_axis(number, np.minimum(label, n - 1), axis=1), n)
    cluster = least(own)
    return np.where(cluster == n, -1, cluster)


def _small(eps2: float, enough: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``cluster`` to rows of small frames and null to others; rows come by frame and point, and of a large frame few are held."""

    def done(rows: pa.RecordBatch, going: object) -> pa.RecordBatch:
        frame = rows.column("frame_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        x, y, weight = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "weight"))
        first = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        size = np.diff(np.r_[first, len(frame)])
        small = size <= SMALL
        small[0] &= rows.column("frame_id")[0].as_py() != going
        cluster, known = np.zeros(len(frame), dtype=np.int32), np.zeros(len(frame), dtype=bool)
        for n in np.unique(size[small]):
            of = first[small & (size == n)]
            step = max(1, HELD // int(n * n))
            for i in range(0, len(of), step):
                at = of[i : i + step, None] + np.arange(n)
                cluster[at], known[at] = _few(x[at], y[at], weight[at], eps2, enough), True
        return rows.append_column("cluster", pa.array(cluster, mask=~known))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = None, object()  # rows of the frame that goes on, and the large frame whose rows have gone out already
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            frame = rows.column("frame_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cut, last = int(np.flatnonzero(np.r_[-1, frame] != frame[-1])[-1]), rows.column("frame_id")[-1].as_py()
            large = len(rows) - cut > SMALL or last == going
            cut = len(rows) if large else cut
            if cut:
                yield done(rows.slice(0, cut), going)
            held, going = (None, last) if large else (rows.slice(cut), object())
        if held is not None:
            yield done(held, going)

    return each


def clustered(points: DataFrame, *, eps: float = 80.0, min_weight: float = 3.0) -> DataFrame:
    """frame_id, point_id, x, y, weight, cluster of ``points``, as ``dbscan`` has them."""
    each = points.select("frame_id", "point_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "weight")])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema)
    found = each.repartition("frame_id").sortWithinPartitions("frame_id", "point_id").mapInArrow(_small(eps * eps, min_weight - 1e-9), f"{schema}, cluster int").checkpoint()
    rest = found.filter("cluster is null").drop("cluster")
    if rest.isEmpty():
        return found
    by_grid = _by_grid(rest, eps=eps, min_weight=min_weight)
    return found.filter("cluster is not null").unionByName(rest.join(by_grid, ["frame_id", "point_id"]))


def dbscan(points: DataFrame, *, eps: float = 80.0, min_weight: float = 3.0) -> DataFrame:
    """frame_id, point_id, cluster (-1 for noise) by weighted density.

    ``points``: frame_id, point_id, x, y, weight. A point is core if the weight within eps, its own
    included, reaches ``min_weight``. Cores that are neighbours share the least core id; clusters are
    numbered by it, and a border point takes the least number among its core neighbours'.
    """
    return clustered(points, eps=eps, min_weight=min_weight).select("frame_id", "point_id", "cluster")


def _by_grid(points: DataFrame, *, eps: float, min_weight: float) -> DataFrame:
    """The same for frames of any number of points. Points of one place are one site from the start."""
    enough, eps2 = min_weight - 1e-9, eps * eps
    side = eps / math.sqrt(2.0) * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    sites = points.groupBy(*SITE).agg(F.sum("weight").alias("weight"), F.min("point_id").alias("p")).withColumns({"cx": cell("x"), "cy": cell("y")}).checkpoint()
    cells = _span(sites, F.sum("weight").alias("total")).checkpoint()
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    box = [F.col(c) for c in ("x0", "x1", "y0", "y1")]

    def neighbours(some: DataFrame, others: DataFrame) -> DataFrame:
        """Each site with the cells around it that come within eps, and ``_all``, whether all of a cell does."""
        asked = some.select(*SITE, F.col("cx").alias("ox"), F.col("cy").alias("oy"), around.alias("s")).select(*SITE, (F.col("ox") + F.col("s.a")).alias("cx"), (F.col("oy") + F.col("s.b")).alias("cy"))
        x, y = F.col("x"), F.col("y")
        near = F.pow(_gap(x, x, *box[:2]), F.lit(2.0)) + F.pow(_gap(y, y, *box[2:]), F.lit(2.0))
        fx, fy = _reach(x, x, *box[:2]), _reach(y, y, *box[2:])
        return asked.join(others, CELL).filter(near <= eps2 * (1 + 1e-9)).withColumn("_all", fx * fx + fy * fy <= eps2)

    def meeting(split: DataFrame, others: DataFrame) -> DataFrame:
        """Sites with the single others within eps in the cells that reach over it."""
        to = others.withColumnsRenamed({"x": "u", "y": "v"})
        dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
        return split.join(to, CELL).filter(dx * dx + dy * dy <= eps2)

    light = sites.join(cells.filter(F.col("total") < enough).select(*CELL, "total"), CELL)
    found = neighbours(light, cells.withColumnRenamed("total", "there"))
    whole = found.filter("_all").select(*SITE, F.col("there").alias("more"))
    single = meeting(found.filter("not _all").select(*SITE, *CELL[1:]), sites.select(*SITE, "cx", "cy", F.col("weight").alias("more"))).select(*SITE, "more")
    more = whole.unionByName(single).groupBy(*SITE).agg(F.sum("more").alias("more"))
    light_cores = light.join(more, SITE, "left").filter(F.col("total") + F.coalesce("more", F.lit(0.0)) >= enough).select(*SITE, "p", "cx", "cy")
    cores = sites.join(cells.filter(F.col("total") >= enough).select(*CELL), CELL, "left_semi").select(*SITE, "p", "cx", "cy").unionByName(light_cores).checkpoint()

    nodes = _span(cores, F.min("p").alias("p"), F.count("*").alias("n")).checkpoint()
    edges = _edges(nodes, cores, eps).checkpoint()
    label = _components(nodes.select(*CELL, "p"), edges)
    numbers = label.select("frame_id", "label").distinct().withColumn("cluster", F.dense_rank().over(Window.partitionBy("frame_id").orderBy("label")) - 1)
    clusters = label.join(numbers, ["frame_id", "label"]).select(*CELL, "cluster").checkpoint()

    in_cores = cores.join(clusters, CELL).select(*SITE, "cluster")
    rest = light.select(*SITE, "cx", "cy").join(light_cores.select(*SITE), SITE, "left_anti")
    own = rest.join(clusters, CELL).select(*SITE, "cluster")
    found = neighbours(rest, nodes.join(clusters, CELL))
    single = meeting(found.filter("not _all").select(*SITE, *CELL[1:], "cluster"), cores.select(*SITE, "cx", "cy")).select(*SITE, "cluster")
    border = own.unionByName(found.filter("_all").select(*SITE, "cluster")).unionByName(single).groupBy(*SITE).agg(F.min("cluster").alias("cluster"))
    known = in_cores.unionByName(border)
    return points.select("frame_id", "point_id", "x", "y").join(known, SITE, "left").select("frame_id", "point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _edges(nodes: DataFrame, cores: DataFrame, eps: float) -> DataFrame:
    """frame_id, cx, cy, dx, dy: neighbouring cells with cores within eps of each other, each pair once."""
    eps2 = eps * eps
    half = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND if (a, b) > (0, 0)]))
    one = nodes.select(*CELL, "x0", "x1", "y0", "y1", F.col("n").alias("n"), half.alias("s"))
    one = one.select("frame_id", F.col("cx"), F.col("cy"), F.col("s.a").alias("dx"), F.col("s.b").alias("dy"), "x0", "x1", "y0", "y1", "n").withColumns({"ux": F.col("cx") + F.col("dx"), "uy": F.col("cy") + F.col("dy")})
    two = nodes.select("frame_id", F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y0").alias("v0"), F.col("y1").alias("v1"), F.col("n").alias("m"))
    x, y, u, v = ([F.col(a), F.col(b)] for a, b in (("x0", "x1"), ("y0", "y1"), ("u0", "u1"), ("v0", "v1")))
    near = F.pow(_gap(*x, *u), F.lit(2.0)) + F.pow(_gap(*y, *v), F.lit(2.0))
    fx, fy = _reach(*x, *u), _reach(*y, *v)
    pairs = one.join(two, ["frame_id", "ux", "uy"]).filter(near <= eps2 * (1 + 1e-9)).withColumn("_all", fx * fx + fy * fy <= eps2).checkpoint()
    key = ["frame_id", "cx", "cy", "dx", "dy"]
    open_ = pairs.filter("not _all")
    a = cores.select("frame_id", "cx", "cy", "x", "y")
    b = cores.select("frame_id", F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("x").alias("u"), F.col("y").alias("v"))
    ax, ay = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    few = open_.filter(F.col("n") * F.col("m") <= PAIRS).select(*key, "ux", "uy")
    few = few.join(a, CELL).join(b, ["frame_id", "ux", "uy"]).filter(ax * ax + ay * ay <= eps2).select(*key).distinct()
    many = open_.filter(F.col("n") * F.col("m") > PAIRS)
    # of many, those within eps of the other cell's box
    close = lambda p0, p1, c: F.pow(F.greatest(F.lit(0.0), F.col(p0) - F.col(c), F.col(c) - F.col(p1)), F.lit(2.0))
    first = many.join(a, CELL).filter(close("u0", "u1", "x") + close("v0", "v1", "y") <= eps2 * (1 + 1e-9)).select(*key, "x", "y", F.lit(0).alias("side"))
    second = many.join(b, ["frame_id", "ux", "uy"]).filter(close("x0", "x1", "u") + close("y0", "y1", "v") <= eps2 * (1 + 1e-9)).select(*key, F.col("u").alias("x"), F.col("v").alias("y"), F.lit(1).alias("side"))
    rows = first.unionByName(second)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema)
    touching = rows.groupBy(*key).applyInArrow(_touching(eps), schema)
    return pairs.filter("_all").select(*key).unionByName(few).unionByName(touching)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cell, label: the least id of the cells that a cell reaches."""
    far = {"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy"), "dx": -F.col("dx"), "dy": -F.col("dy")}
    both = edges.unionByName(edges.withColumns(far)).withColumns({"ux": F.col("cx") + F.col("dx"), "uy": F.col("cy") + F.col("dy")})
    ids = nodes.select(*CELL, "p")
    inner = both.join(ids, CELL).join(ids.select("frame_id", F.col("cx").alias("ux"), F.col("cy").alias("uy"), F.col("p").alias("q")), ["frame_id", "ux", "uy"]).select("frame_id", "p", "q").checkpoint()
    label = ids.select("frame_id", "p", F.col("p").alias("label"))
    while not inner.isEmpty():  # labels only fall, so this ends
        spread = inner.join(label.withColumnRenamed("p", "q"), ["frame_id", "q"]).groupBy("frame_id", "p").agg(F.min("label").alias("near"))
        # one hop to the least neighbour, one more to that neighbour's own label
        hop = label.join(spread, ["frame_id", "p"], "left").select("frame_id", "p", F.col("label").alias("was"), F.least("label", "near").alias("m"))
        jump = hop.join(label.select("frame_id", F.col("p").alias("m"), F.col("label").alias("far")), ["frame_id", "m"], "left").select("frame_id", "p", "was", F.least("m", F.coalesce("far", "m")).alias("label")).checkpoint()
        label = jump.select("frame_id", "p", "label")
        if jump.filter("was <> label").isEmpty():
            break
    return ids.join(label, ["frame_id", "p"]).select(*CELL, "label")
