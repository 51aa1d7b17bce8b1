"""Near duplicates among vectors: all pairs above a cosine, by dual traversal of cover trees.

Unit vectors at cosine c lie sqrt(2 - 2c) apart, so a cosine threshold is a distance. The upper
levels of each label's tree are tables: a node with too many rows is split among a few of its own
rows as centres, every row goes to the nearest, and a node's covering radius is its farthest row.
Pairs of nodes go down together, level by level, and a pair is dropped as soon as its centres are
farther apart than both radii and the threshold allow. Below, a leaf of bounded size is a cover tree
in arrays, with levels of halving radii, and the surviving pairs of leaves are traversed in tasks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import stored
from sessionloom.llm.graph import components

#: Rows of a leaf, and most centres of a split.
LEAF_ROWS, FAN = 2048, 16
SLACK = 1e-9


class CoverTree:
    """Nested levels over unit vectors. Points of a node lie together: ``order[low:high]``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        self._build(np.arange(len(x)), 0)

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[a] @ self.x[b].T)))

    def _build(self, points: np.ndarray, low: int) -> int:
        """A node over ``points``, first of which is its centre; they fill ``order`` from ``low`` on."""
        me = len(self.centre)
        reach = self._distances(points[:1], points)[0]
        self.centre.append(int(points[0]))
        self.radius.append(float(reach.max()) if len(points) > 1 else 0.0)
        self.low.append(low)
        self.high.append(low + len(points))
        self.children.append([])
        self.order[low : low + len(points)] = points
        if len(points) == 1:
            return me
        # centres of the next level: no two within half this node's radius, and all points within it
        half = self.radius[me] / 2
        centres, nearest = [0], reach.copy()
        owner = np.zeros(len(points), np.int64)
        while nearest.max() > half or len(centres) == 1:
            far = int(nearest.argmax()) if nearest.max() > half else 1
            if nearest.max() <= SLACK:  # nothing left to tell apart: every point is its own child
                centres, owner = list(range(len(points))), np.arange(len(points))
                break
            d = self._distances(points[far : far + 1], points)[0]
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(centres)
            owner[far], nearest[far] = len(centres), 0.0
            centres.append(far)
        at = low
        for i, c in enumerate(centres):
            mine = np.nonzero(owner == i)[0]
            mine = points[np.concatenate([[c], mine[mine != c]])]
            self.children[me].append(self._build(mine, at))
            at += len(mine)
        return me


def _merge(parent: list[int], a: int, b: int) -> None:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a != b:
        parent[max(a, b)] = min(a, b)


def _stars(linked: np.ndarray) -> list[tuple[int, int, bool]]:
    """(row, its component's first row) and (column, that row) of a table of links; the flag tells columns."""
    rows, cols = np.nonzero(linked.any(1))[0], np.nonzero(linked.any(0))[0]
    part = linked[np.ix_(rows, cols)]
    label, none = np.arange(len(rows)), len(rows)
    while True:
        col = np.where(part, label[:, None], none).min(0, initial=none)
        new = np.minimum(label, np.where(part, col[None, :], none).min(1, initial=none))
        if (new == label).all():
            break
        label = new
    return [(int(r), int(rows[k]), False) for r, k in zip(rows, label, strict=True)] + [(int(c), int(rows[k]), True) for c, k in zip(cols, col, strict=True)]


def traverse(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Weights of the partners of each point of ``a`` and of ``b``, and the forest of links over both.

    ``same``: both are one tree, so a point's partners are all counted on the first side. Links are
    decided by the cosine itself; distances only prune, and only with ``SLACK`` to spare.
    """
    near = np.sqrt(2 - 2 * threshold)
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    parent = list(range(len(a.x) + (0 if same else len(b.x))))
    shift = 0 if same else len(a.x)
    radius_a, radius_b, centre_a, centre_b = map(np.array, (a.radius, b.radius, a.centre, b.centre))
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        kids_p, kids_q = np.array(a.children[p] or [p]), np.array(b.children[q] or [q])
        i, j = centre_a[kids_p], centre_b[kids_q]
        cosine = a.x[i] @ b.x[j].T
        apart = np.sqrt(np.maximum(0, 2 - 2 * cosine))
        spread = radius_a[kids_p][:, None] + radius_b[kids_q][None, :]
        point = np.array([not a.children[k] for k in kids_p])[:, None] & np.array([not b.children[k] for k in kids_q])[None, :]
        linked = point & (cosine >= threshold)
        if same:
            linked &= i[:, None] != j[None, :]
        if linked.any():
            na_add = linked @ wb[j]
            np.add.at(na, i, na_add)
            if not same:
                np.add.at(nb, j, wa[i] @ linked)
            for at, head, column in _stars(linked):
                _merge(parent, int(j[at]) + shift if column else int(i[at]), int(i[head]))
        rest = ~point & (apart <= spread + near + SLACK)
        # all of one node links to all of the other: counted without going down
        whole = rest & (apart + spread <= near - SLACK)
        if same:
            whole &= kids_p[:, None] != kids_q[None, :]
        for r, c in zip(*np.nonzero(whole), strict=True):
            left, right = a.order[a.low[kids_p[r]] : a.high[kids_p[r]]], b.order[b.low[kids_q[c]] : b.high[kids_q[c]]]
            na[left] += wb[right].sum()
            if not same:
                nb[right] += wa[left].sum()
            for x in left.tolist():
                _merge(parent, x, int(right[0]) + shift)
            for y in right.tolist():
                _merge(parent, y + shift, int(left[0]))
        stack += [(int(kids_p[r]), int(kids_q[c])) for r, c in zip(*np.nonzero(rest & ~whole), strict=True)]
    return na, nb, parent


def _leaf(frame: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(frame["v"].to_numpy()).astype(np.float64)
    tree = CoverTree(x)
    data = pickle.dumps((frame["rep"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), x.astype(np.float32) if (x.astype(np.float32) == x).all() else x, tree.order, tree.centre, tree.radius, tree.low, tree.high, tree.children), protocol=5)
    return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "node": frame["node"].iloc[:1], "tree": [data]})


def _load(data: bytes) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    ids, n, x, *rest = pickle.loads(data)
    tree = CoverTree.__new__(CoverTree)
    tree.x = x.astype(np.float64)
    tree.order, tree.centre, tree.radius, tree.low, tree.high, tree.children = rest
    return ids, n, tree


def _pair(a: bytes, b: bytes, same: bool, threshold: float):
    ia, wa, ta = _load(a)
    ib, wb, tb = (ia, wa, ta) if same else _load(b)
    na, nb, parent = traverse(ta, tb, wa, wb, threshold, same)
    ids = ia.tolist() if same else [*ia.tolist(), *ib.tolist()]
    counts = [(i, n) for i, n in zip([*ia.tolist(), *([] if same else ib.tolist())], [*na.tolist(), *([] if same else nb.tolist())], strict=True) if n]
    edges = []
    for x in range(len(parent)):
        root = x
        while parent[root] != root:
            root = parent[root]
        if root != x:
            edges.append((ids[x], ids[root]))
    return counts, edges


def usable(vectors: DataFrame, label: str, vector: str, id_col: str) -> Column:
    """A label, an id, and a vector of finite components that are not all zero."""
    x = F.col(vector)
    return F.coalesce(
        F.col(label).isNotNull() & F.col(id_col).isNotNull() & x.isNotNull() & (F.size(vector) > 0)
        & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists(x, lambda c: c != 0),
        F.lit(False),
    )


def _at_unit_length(frames):
    """Vectors at length one, safe for components of any size."""
    for frame in frames:
        units = []
        for e in frame["e"]:
            x = np.asarray(e, np.float64)
            x = x / np.abs(x).max()
            units.append(x / np.sqrt(x @ x))
        yield frame[["rep", "n", "node"]].assign(v=units)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def _upper_levels(rows: DataFrame, leaf_rows: int, fan: int) -> tuple[DataFrame, DataFrame | None, int]:
    """``rows`` with the leaf node of each, the nodes (parent, node, centre, radius), and the depth."""
    nodes, depth = None, 0
    while depth < 24:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > leaf_rows)
        big = stored(sizes)
        if big.isEmpty():
            break
        depth += 1
        wanted = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(1.5 * F.col("size") / leaf_rows)))
        draw = F.pmod(F.xxhash64("rep", F.lit(depth)), F.lit(2**31)) / float(2**31)
        # about four times the centres wanted are drawn by hash, whatever the node's size
        drawn = rows.join(big, "node").withColumn("h", draw).filter(F.col("h") < 4 * wanted / F.col("size"))
        order = Window.partitionBy("node").orderBy("h", "rep")
        drawn = drawn.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= wanted)
        centres = stored(drawn.select("node", "k", "v"))
        several = centres.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", F.col("v").alias("c")))).alias("centres"))
        near = F.array_min(F.transform("centres", lambda s: F.struct(_distance_of(F.col("v"), s["c"]).alias("d"), s["k"].alias("k"))))
        moved = rows.join(several, "node", "left").withColumn("near", near)
        at = F.when(F.col("near").isNotNull(), F.concat_ws("/", "node", F.col("near.k").cast("string"))).otherwise(F.col("node"))
        rows = stored(moved.select("rep", "n", "v", at.alias("node"), F.col("near.d").alias("d")))
        reach = rows.filter("d is not null").groupBy("node").agg(F.max("d").alias("radius"))
        level = centres.select(F.col("node").alias("parent"), F.concat_ws("/", "node", F.col("k").cast("string")).alias("node"), F.col("v").alias("centre")).join(reach, "node")
        nodes = level if nodes is None else nodes.unionByName(level)
        rows = rows.drop("d")
    return rows, None if nodes is None else stored(nodes), depth


def _distance_of(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def _node_pairs(leaves: DataFrame, nodes: DataFrame | None, depth: int, near: float) -> DataFrame:
    """Pairs (a <= b) of leaf nodes that may hold a link, by going down from every root with itself."""
    if nodes is None:
        return leaves.select(F.col("node").alias("a"), F.col("node").alias("b"))
    roots = nodes.select(F.element_at(F.split("node", "/"), 1).alias("r")).union(leaves.select(F.element_at(F.split("node", "/"), 1).alias("r"))).distinct()
    pairs = roots.select(F.col("r").alias("a"), F.col("r").alias("b"))
    # a leaf stands for itself on every further level
    itself = leaves.join(nodes, "node", "left").select(F.col("node").alias("parent"), "node", "centre", "radius")
    kids = stored(nodes.select("parent", "node", "centre", "radius").union(itself))
    for _ in range(depth):
        ka = kids.select(F.col("parent").alias("a"), F.col("node").alias("ka"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        kb = kids.select(F.col("parent").alias("b"), F.col("node").alias("kb"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        met = pairs.join(ka, "a").join(kb, "b").filter((F.col("a") != F.col("b")) | (F.col("ka") <= F.col("kb")))
        close = F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ka") == F.col("kb")) | (_distance("ca", "cb") <= F.col("ra") + F.col("rb") + near + 1e-6)
        pairs = stored(met.filter(close).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")))
    return pairs


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", leaf_rows: int = LEAF_ROWS, fan: int = FAN,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows are compared within a label and a dimension. A null label or vector, a zero vector, and one
    with null or non-finite components link with nothing and are components of their own; so is a row
    without an id, which has no component_id and is kept. Equal
    vectors are one in the tree and count as often as they occur. Repeated ids are separate rows of
    one vector each. Other columns are ignored; an empty table gives no rows.
    """
    near = float(np.sqrt(2 - 2 * threshold))
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("e")).withColumn("ok", usable(vectors, "label", "e", "vec_id"))
    every = source.select("vec_id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.col("e")).alias("e"))
    distinct = stored(every.filter("ok").groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    root = F.concat_ws(":", F.col("label").cast("string"), F.size("e").cast("string"))
    named = distinct.select("rep", "n", F.regexp_replace(root, "/", "_").alias("node"), "e")
    units = named.mapInPandas(_at_unit_length, "rep long, n long, node string, v array<double>")
    rows, nodes, depth = _upper_levels(stored(units), leaf_rows, fan)
    # a node that could not be split further is cut by hash
    sizes = stored(rows.groupBy("node").agg(F.ceil(F.count("*") / leaf_rows).alias("parts")))
    part = F.pmod(F.xxhash64("rep", F.lit(99)), F.col("parts"))
    leaves = rows.join(sizes, "node").select("rep", "n", "v", "node", F.concat_ws("#", "node", part.cast("string")).alias("leaf"))
    trees = stored(leaves.groupBy("leaf").applyInPandas(_leaf, "leaf string, node string, tree binary"))
    pairs = _node_pairs(sizes.select("node"), nodes, depth, near)
    names = trees.select("leaf", "node")
    met = pairs.join(names.select(F.col("node").alias("a"), F.col("leaf").alias("la")), "a").join(names.select(F.col("node").alias("b"), F.col("leaf").alias("lb")), "b")
    met = met.filter((F.col("a") != F.col("b")) | (F.col("la") <= F.col("lb"))).select("la", "lb")

    def task(batches):
        kinds = [pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        for batch in batches:
            for a, b, same in zip(*batch.columns, strict=True):
                counts, edges = _pair(a.as_py(), b.as_py(), same.as_py(), threshold)
                yield pa.RecordBatch.from_arrays([pa.array([counts], kinds[0]), pa.array([edges], kinds[1])], ["counts", "edges"])

    both = met.repartition(F.col("la"), F.col("lb")).join(trees.select(F.col("leaf").alias("la"), F.col("tree").alias("ta")), "la").join(trees.select(F.col("leaf").alias("lb"), F.col("tree").alias("tb")), "lb")
    same = F.col("la") == F.col("lb")
    found = stored(both.select("ta", "tb", same.alias("same")).mapInArrow(task, "counts array<struct<id:long,n:long>>, edges array<struct<a:long,b:long>>"))
    partners = found.select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("partners"))
    classes = components(found.select(F.inline("edges")))
    known = stored(
        distinct.join(partners.withColumnRenamed("id", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "e", (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    # a row that takes no part has a key of its own, so that such rows don't meet in one task
    own = F.when(~F.col("ok"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    joined = every.withColumn("own", own).join(known.withColumn("own", F.lit(-1).cast("long")), ["label", "e", "own"], "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
