"""Merkle manifest of a table, with a version of the tree for each changed row that shares all other nodes.

Leaves of a group (a source) lie in order; every three consecutive nodes become one above them, until one
is left, the group's subroot; subroots become the root the same way. A tree is cut into aligned blocks of
3 ** LEVELS leaves, so a block's inner nodes need its own leaves only: blocks are folded in tasks, their
roots are the leaves of the next round, and rounds grow with the logarithm of a group's rows. On the way
back each block gets the path above it once, and its leaves share it.

A changed leaf makes a version: within its block the ancestors of that leaf are copied with their new
digests, their siblings are the nodes of the original tree, and the version goes on along the block's path
up to a root of its own. Nothing else is copied, and no version sees another.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import stored

#: Levels of the tree in an aligned block: 729 leaves.
LEVELS = 6
FAN = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*columns):
    """Digest of a row: each value with its length in bytes, or ``-`` for null."""
    said = []
    for c in columns:
        value = c.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said), 256)


def levels_of(leaves: list[str], total: int, most: int = LEVELS) -> list[list[str]]:
    """The levels of a block, its leaves first; ``total`` nodes of the whole group lie on the lowest one."""
    found = [leaves]
    while total > 1 and len(found) <= most:
        below = found[-1]
        found.append([h(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
        total = -(-total // FAN)
    return found


def steps(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """From a leaf of a block to the block's root: its place among the nodes of its run, and the others, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        run = nodes[first : first + FAN]
        path.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= FAN
    return path


def copied(digest: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The nodes that a version has for itself: a leaf with ``digest`` and its ancestors, all others being shared."""
    nodes = [digest]
    for place, others in path:
        nodes.append(h(*others[:place], nodes[-1], *others[place:]))
    return nodes


def _write(path: list[tuple[int, list[str]]]) -> str:
    return "".join(f"{place}{''.join(others)};" for place, others in path)


def _read(text: str) -> list[tuple[int, list[str]]]:
    return [(int(s[0]), [s[i : i + 64] for i in range(1, len(s), 64)]) for s in text.split(";")[:-1]]


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 within the group, and ``n``, the group's rows. No group is one task.

    Rows are dealt by range of (group, order) and sorted in their partitions; places then follow from
    the counts of the partitions before, which is one small row a partition and group.
    """
    twin = F.monotonically_increasing_id()  # so that equal rows spread as well
    keys = [group, *order]
    placed = rows.withColumn("_twin", twin).repartitionByRange(*keys, "_twin").sortWithinPartitions(*keys, "_twin").drop("_twin")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    whole, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    counts = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    return placed.join(counts, [group, "_part"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = _sorted(table)
    total = table["n"][0].as_py()
    top = levels_of(table["digest"].to_pylist(), total)[-1][0]
    return pa.table({"g": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-total // FAN**LEVELS)], "digest": [top]}, pa.schema([("g", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / FAN**LEVELS).cast("long"))


def build(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of (g, idx, n, digest): the leaves first, last one row a group with its root."""
    rounds = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        rounds.append(stored(_blocks(rounds[-1].select("g", "idx", "n", "digest")).groupBy("g", "block").applyInArrow(_fold, "g string, idx long, n long, digest string")))
        most = -(-most // FAN**LEVELS)
    return rounds


PATH = "g string, idx long, path string, subroot string, root string"


def _down(left: pa.Table, right: pa.Table) -> pa.Table:
    left = _sorted(left)
    above, sub, root = (right[c][0].as_py() for c in ("path", "subroot", "root"))
    levels = levels_of(left["digest"].to_pylist(), left["n"][0].as_py()) if len(left) else [[]]
    paths = [_write(steps(levels, i)) + above for i in range(len(left))]
    return pa.table({"g": left["g"], "idx": left["idx"], "path": pa.array(paths, pa.string()), "subroot": pa.array([sub] * len(left), pa.string()), "root": pa.array([root] * len(left), pa.string())})


FOUND = "row string, g string, idx long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, copies array<string>, verified boolean"


def _versions(left: pa.Table, right: pa.Table) -> pa.Table:
    left = _sorted(left)
    above, sub, root = _read(right["path"][0].as_py()), right["subroot"][0].as_py(), right["root"][0].as_py()
    leaves = left["digest"].to_pylist()
    levels = levels_of(leaves, left["n"][0].as_py())
    proofs, folded, copies = [], [], []
    for i, (base, changed) in enumerate(zip(leaves, left["changed"].to_pylist())):
        path = steps(levels, i) + above
        proofs.append(h(*(x for _, others in path for x in others)))
        # a version from the changed leaf; without one the original path gives the original root
        nodes = copied(changed or base, path)
        folded.append(nodes[-1])
        copies.append(nodes if changed and changed != base else [])
    n = len(left)
    return pa.table({
        "row": left["row"], "g": left["g"], "idx": left["idx"], "leaf": left["digest"], "subroot": pa.array([sub] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "copies": pa.array(copies, pa.list_(pa.string())), "verified": pa.array([x == root for x in folded], pa.bool_()),
    })


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs and versions of ``leaves`` (row string, g string, order_by, digest, changed).

    ``g`` groups the leaves, in its binary order; ``order_by`` orders them within it, equal ones by digest.
    ``changed`` is a leaf's new digest, or null. Returns a row a leaf: its subroot, the root, the digest of
    its siblings from the lowest level to the highest, the root that its version ends in, the nodes that
    the version copies (itself first, none if nothing changed), and whether that root is the original one.
    An empty table gives an empty one; a lone leaf is its own root.
    """
    base = stored(ranked(leaves, "g", "order_by", "digest"))
    rounds = build(base)
    subroots = rounds[-1].select("g", "digest").withColumnRenamed("g", "name").withColumn("g", F.lit(""))
    tops = stored(ranked(subroots, "g", "name", "digest"))
    above = build(tops)
    roots = above[-1].select("g", F.lit(0).cast("long").alias("idx"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = _descend(above, roots, len(above) - 2)
    # a group's path starts at its subroot
    paths = tops.join(paths.drop("g", "subroot"), "idx").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    paths = _descend(rounds, paths, len(rounds) - 2, last=1)
    left = _blocks(base).select("row", "g", "block", "idx", "n", "digest", "changed")
    return left.groupBy("g", "block").cogroup(paths.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(_versions, FOUND)


def _descend(rounds: list[DataFrame], paths: DataFrame, start: int, last: int = 0) -> DataFrame:
    """Paths of the nodes of round ``last``, given those of the last round's nodes."""
    for i in range(start, last - 1, -1):
        nodes = _blocks(rounds[i]).select("g", "block", "idx", "n", "digest")
        paths = nodes.groupBy("g", "block").cogroup(paths.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(_down, PATH)
    return paths


def tampered(docs: DataFrame, columns=COLUMNS) -> DataFrame:
    """Leaves of ``docs`` for ``manifest``: where crc32 of the id is even, changed is the leaf without line feeds in the text.

    A row without an id is never changed and comes first in its source; a null text stays null. Other
    columns, whatever their names, take no part.
    """
    c = {x: F.col(x) for x in columns}
    without = {**c, "text": F.translate(c["text"], "\n", "")}
    even = F.crc32(c["doc_id"].cast("string")) % 2 == 0
    group = F.coalesce(F.concat(F.lit("="), c["source"]), F.lit("-"))  # null before every name
    return docs.select(
        c["doc_id"].cast("string").alias("row"), group.alias("g"), c["doc_id"].alias("order_by"), leaf(*c.values()).alias("digest"), F.when(even, leaf(*without.values())).alias("changed")
    )


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text), checked against a copy without line feeds in some texts.

    Leaves are hashed once, without a shuffle; only ids and digests are sorted, grouped and joined after that.
    Repeated rows are leaves of their own.
    """
    found = manifest(stored(tampered(docs)))
    return found.select(F.col("row").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.size("copies").cast("long").alias("n_copied"))
