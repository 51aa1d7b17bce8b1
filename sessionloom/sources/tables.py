"""Table sources, sinks and upkeep: upserts, reconciliation, cascades, catalogues."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the session's ``spark.checkpoint.dir``; sets a temporary folder only in local runs without one."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(found)


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def media_bytes(spark: SparkSession, path: str, ranges: DataFrame, folder: bool = False) -> DataFrame:
    """ranges (name, offset, length, ...) with ``bytes`` of that range of the named file under ``path``.

    ``folder``: a file goes by the name of its folder. A file's ranges are gathered before they meet
    its bytes, so the bytes move once.
    """
    name = F.element_at(F.split("path", "/"), -2 if folder else -1).alias("name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name, "content")
    asked = ranges.groupBy("name").agg(F.collect_list(F.struct(*ranges.columns)).alias("r"))
    each = F.transform("r", lambda r: r.withField("bytes", F.substring(F.col("content"), r["offset"] + 1, r["length"])))
    return files.join(asked, "name").select(F.inline(each))


def namespace(view: Column, provider: Column, model: Column, dims: Column) -> Column:
    """``view:provider:model:dims``; fails on a colon in a part or on dims that are not above 0."""
    bad = view.contains(":") | provider.contains(":") | model.contains(":") | (dims <= 0)
    made = F.concat_ws(":", view, provider, model, dims.cast("string"))
    return F.when(F.assert_true(~bad, F.lit("a part holds a colon, or dims are not positive")).isNull(), made)


def namespace_parts(name: Column) -> Column:
    p = F.split(name, ":")
    return F.struct(p[0].alias("view"), p[1].alias("provider"), p[2].alias("model"), p[3].cast("int").alias("dims"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Old rows whose keys are not written again, and one new row for each key (the latest version, if given)."""
    fresh = new
    if version:
        fresh = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), version).alias("r")).select("r.*")
    else:
        fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def reconcile(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """key, problem: children without a parent are orphans, parents without a child are missing."""
    orphan = children.join(parents, key, "left_anti").select(key, F.lit("orphan").alias("problem"))
    return orphan.unionByName(parents.join(children, key, "left_anti").select(key, F.lit("missing").alias("problem")))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "session_id") -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def purge_derived(tables: dict[str, DataFrame], derived: set[str], sessions: DataFrame) -> dict[str, DataFrame]:
    """Derived tables without the given sessions' rows, captured tables as they are; the same when done twice."""
    return {name: cascade_delete({name: df}, sessions)[name] if name in derived else df for name, df in tables.items()}


def catalogue(sessions: DataFrame, children: dict[str, DataFrame], sizes: DataFrame | None = None, purposes: DataFrame | None = None) -> DataFrame:
    """Sessions with a count of each child table (and bytes, purpose): each child is counted before it is joined."""
    out = sessions
    for name, df in children.items():
        out = out.join(df.groupBy("session_id").agg(F.count("*").alias(f"n_{name}")), "session_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    if sizes is not None:
        out = out.join(sizes.groupBy("session_id").agg(F.sum("bytes").alias("bytes")), "session_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    if purposes is not None:
        out = out.join(purposes.select("session_id", "purpose"), "session_id", "left")
    if {"started_at", "ended_at"} <= set(sessions.columns):
        out = out.withColumn("duration", F.greatest(F.lit(0).cast("long"), F.col("ended_at") - F.col("started_at")))
    return out


def coerce_elements(snapshots: DataFrame, json_col: str = "elements") -> DataFrame:
    """snapshot_id, idx, parent, depth and the fields of each well-formed element of a JSON array.

    Elements without a role or a box go; indexes and parents are renumbered past them, and an element
    whose parent went hangs from the nearest ancestor that stayed.
    """
    kind = "array<struct<role:string,label:string,identifier:string,x:double,y:double,w:double,h:double,focused:boolean,parent:int>>"
    rows = snapshots.select("snapshot_id", F.from_json(json_col, kind).alias("es"))
    ok = lambda e: F.coalesce((F.length(e["role"]) > 0) & e["x"].isNotNull() & e["y"].isNotNull() & (e["w"] >= 0) & (e["h"] >= 0), F.lit(False))
    asked = rows.select("snapshot_id", F.transform("es", ok).alias("ok"), F.transform("es", lambda e: e["parent"]).alias("up"), "es")
    sid = snapshots.schema["snapshot_id"].dataType.simpleString()
    placed = "at array<int>, idx array<bigint>, parent array<bigint>, depth array<int>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            found = [_placed(good, up) for good, up in zip(batch.column("ok").to_pylist(), batch.column("up").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("snapshot_id"), batch.column("es"), *[pa.array([f[i] for f in found], k) for i, k in enumerate(ints)]], ["snapshot_id", "es", "at", "idx", "parent", "depth"])

    out = asked.mapInArrow(place, f"snapshot_id {sid}, es {kind}, {placed}").select("snapshot_id", "es", F.inline(F.arrays_zip("at", "idx", "parent", "depth")))
    e = F.col("es")[F.col("at")]
    return out.select("snapshot_id", "idx", "parent", e.alias("e"), "depth").select("snapshot_id", "idx", "parent", "e.role", "e.label", "e.identifier", "e.x", "e.y", "e.w", "e.h", F.coalesce("e.focused", F.lit(False)).alias("focused"), "depth")


def _placed(ok: list[bool] | None, up: list[int | None] | None) -> tuple[list, list, list, list]:
    """(at, idx, parent, depth) of the elements of a snapshot that stay and hang from a root; those on a circle have no depth and go."""
    n = len(ok or ())
    number, kept = [], 0
    for good in ok or ():
        number.append(kept)
        kept += good
    over: list[int | None] = [None] * n  # the nearest ancestor that stayed
    depth: list[int | None] = [None] * n
    state = bytearray(n)  # 1: on the way, 2: done
    for first in range(n):
        path, i = [], first
        while i is not None and 0 <= i < n and not state[i]:
            state[i] = 1
            path.append(i)
            i = up[i]
        lost = i is not None and 0 <= i < n and (state[i] == 1 or depth[i] is None)
        for i in reversed(path):
            state[i] = 2
            j = up[i]
            if lost:
                continue
            inside = j is not None and 0 <= j < n
            over[i] = (j if ok[j] else over[j]) if inside else None
            # of an element that goes, the depth that its children have
            depth[i] = (depth[j] + ok[j] if inside else 0)
    stay = [i for i in range(n) if ok[i] and depth[i] is not None]
    return stay, [number[i] for i in stay], [None if over[i] is None else number[over[i]] for i in stay], [depth[i] for i in stay]
