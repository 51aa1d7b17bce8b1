"""Evaluation: known answers, sweeps of constants, stability of keys, transfer."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators.vectors import highlights

from sessionloom.operators import fusion
from sessionloom.sources.tables import ensure_checkpoint_dir

#: Most routes and sessions, and moments of sessions, of two blocks that meet in a task; blocks of sessions at least.
BLOCK_ROUTES, BLOCK_SESSIONS, BLOCK_MOMENTS, LANES = 100_000, 5_000, 1_000_000, 24


def known_answers(scores: DataFrame) -> DataFrame:
    """query_id, rank, top1, top5, rr, margin of each query's right answer.

    ``scores``: query_id, group, score, gold (boolean); identical documents are one group.
    """
    best = scores.groupBy("query_id", "group").agg(F.max("score").alias("score"), F.max("gold").alias("gold"))
    w = Window.partitionBy("query_id")
    other = F.max(F.when(~F.col("gold"), F.col("score"))).over(w)
    ranked = best.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "group")), "margin": F.col("score") - other})
    return ranked.filter("gold").select("query_id", "rank", (F.col("rank") == 1).alias("top1"), (F.col("rank") <= 5).alias("top5"), (1 / F.col("rank")).alias("rr"), "margin")


def rrf_sweep(lists: DataFrame, answers: DataFrame, ks: list[float]) -> DataFrame:
    """k, mean_rank, recall5 of the answers under each fusion constant. ``answers``: query_id, id."""
    wide = lists.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    fused = wide.groupBy("k", "query_id", "id").agg(F.round(F.sum(1 / (F.col("k") + F.col("rank"))), 9).alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "id")))
    return ranked.join(answers, ["query_id", "id"]).groupBy("k").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg((F.col("rank") <= 5).cast("double")), 6).alias("recall5"))


def floor_sweep(scores: DataFrame, floors: list[float], most: int = 8) -> DataFrame:
    """floor, boxes, cells, answered: boxes that highlights draw at each share of a frame's best, the cells they come from, and queries with any."""
    best = F.max("score").over(Window.partitionBy("query_id", "frame_id"))
    rows = scores.withColumns({"_best": best, "floor": F.explode(F.array(*[F.lit(f) for f in floors]))})
    kept = rows.filter((F.col("score") > 0) & (F.col("score") >= F.col("floor") * F.col("_best")))
    cells = kept.groupBy("floor").agg(F.count("*").alias("cells"), F.countDistinct("query_id").alias("answered"))
    drawn = reduce(DataFrame.unionByName, [highlights(scores, floor=f, most=most).withColumn("floor", F.lit(f)) for f in floors])
    return cells.join(drawn.groupBy("floor").agg(F.count("*").alias("boxes")), "floor").select("floor", "boxes", "cells", "answered")


def key_stability(before: DataFrame, after: DataFrame, key: str = "route_key") -> DataFrame:
    """route_key, change: keys that two builds do not share."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("change", F.lit("gained")))


def transfer(steps: DataFrame, verified: DataFrame) -> DataFrame:
    """route_id, session_id, matched, n_steps: how many of a route's states a session shows in order.

    ``steps``: route_id, step, node; ``verified``: session_id, node, t. Each state takes the earliest
    moment at or after the one before it; a state that is not found is passed over.
    """
    times = verified.groupBy("session_id", "node").agg(F.array_sort(F.collect_set("t")).alias("times"))
    seen = steps.join(times, "node").groupBy("route_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("step", "times"))).alias("s"))

    def move(state, s):
        at = F.array_min(F.filter(s["times"], lambda t: t >= state["t"]))
        return F.struct(F.coalesce(at, state["t"]).alias("t"), (state["n"] + at.isNotNull().cast("int")).alias("n"))

    start = F.struct(F.lit(float("-inf")).alias("t"), F.lit(0).alias("n"))
    n = steps.groupBy("route_id").agg(F.count("*").alias("n_steps"))
    return seen.select("route_id", "session_id", F.aggregate("s", start, move)["n"].alias("matched")).join(n, "route_id")


def _tree(code: np.ndarray, size: np.ndarray) -> tuple[list[tuple[np.ndarray, dict[int, slice]]], np.ndarray]:
    """Levels of the prefixes of some routes, (parent, letter -> its prefixes), and each route's place in its last level."""
    start, at, parents, levels = np.cumsum(size) - size, np.zeros(len(size), dtype=np.int64), 1, []
    for depth in range(size.max(initial=0)):
        on = np.flatnonzero(size > depth)
        prefixes, at[on] = np.unique(code[start[on] + depth] * parents + at[on], return_inverse=True)
        letter = prefixes // parents
        begin = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]])
        levels.append((prefixes % parents, {int(letter[i]): slice(i, j) for i, j in zip(begin, [*begin[1:], len(letter)], strict=True)}))
        parents = len(prefixes)
    return levels, at


def _walked(levels: list, times: dict[int, np.ndarray]):
    """How many states of each prefix a session shows in order, level after level; ``times``: moments of each letter, ascending."""
    moments = np.unique(np.concatenate(list(times.values())))
    shown = {}
    for letter, t in times.items():
        own = np.searchsorted(moments, t)
        follow = np.searchsorted(own, np.arange(len(moments)))
        found = follow < len(own)
        shown[letter] = np.where(found, own[np.minimum(follow, len(own) - 1)], np.arange(len(moments))), found
    now = n = np.zeros(1, dtype=np.int64)
    for parent, by in levels:
        now, n = now[parent], n[parent]
        for letter in by.keys() & shown.keys():
            (after, found), part = shown[letter], by[letter]
            n[part] += found[now[part]]
            now[part] = after[now[part]]
        yield n


def transfer_report(steps: DataFrame, verified: DataFrame, controls: DataFrame) -> DataFrame:
    """route_id, held_out, n, whole, mean_share: how routes carry over to held-out sessions and to controls.

    ``controls``: session_id of the sessions that must not show a route. A session without any state
    of a route counts with a share of 0. Every route is looked for in every session, block by block: a block's
    routes are a tree of prefixes, a prefix is followed once a session, and a pair of blocks leaves two rows a route.
    """
    ensure_checkpoint_dir(steps.sparkSession)
    marked = verified.select("session_id").distinct().join(controls.select("session_id", F.lit(False).alias("held_out")).distinct(), "session_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(True)))
    totals = marked.groupBy("held_out").agg(F.count("*").alias("n"))  # two rows at most
    known = steps.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda s: s["node"]).alias("nodes")).checkpoint()
    shown = verified.filter("node is not null and t is not null").groupBy("session_id", "node").agg(F.array_sort(F.collect_set(F.col("t").cast("double"))).alias("t"))
    shown = shown.groupBy("session_id").agg(F.collect_list(F.struct("node", "t")).alias("shown")).join(marked, "session_id").checkpoint()
    n_routes = known.count()
    sized = shown.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.aggregate("shown", F.lit(0), lambda a, s: a + F.size(s["t"]))), F.lit(0)).alias("moments")).first()
    blocks = max(1, -(-n_routes // BLOCK_ROUTES))
    lanes = max(-(-LANES // blocks), -(-sized["n"] // BLOCK_SESSIONS), -(-sized["moments"] // BLOCK_MOMENTS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(int(n))).cast("int")
    left = known.select(every(lanes).alias("_lane"), deal("route_id", blocks).alias("_block"), "route_id", "nodes")
    right = shown.select(deal("session_id", lanes).alias("_lane"), every(blocks).alias("_block"), "held_out", "shown")

    def count(some: pa.Table, table: pa.Table) -> pa.Table:
        ids, nodes, seen = (c.combine_chunks() for c in (some["route_id"], some["nodes"], table["shown"]))
        size = nodes.value_lengths().to_numpy(zero_copy_only=False)
        words = nodes.flatten().dictionary_encode()
        levels, at = _tree(words.indices.fill_null(len(words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), size)
        ends = [np.unique(at[size == d + 1]) for d in range(len(levels))]
        whole, matched = ([np.zeros((2, len(e)), dtype=np.int64) for e in ends] for _ in range(2))
        letters = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        each = seen.flatten()
        code = np.array([letters.get(w, -1) for w in each.field("node").to_pylist()], dtype=np.int64)
        long, moments = each.field("t").value_lengths().to_numpy(zero_copy_only=False), each.field("t").flatten().to_numpy(zero_copy_only=False)
        until, last = np.cumsum(long), np.cumsum(seen.value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        for stop, held in zip(last, table["held_out"].to_pylist(), strict=True):
            times = {int(code[i]): moments[until[i] - long[i] : until[i]] for i in range(first, stop) if code[i] >= 0}
            first = stop
            for d, n in enumerate(_walked(levels, times) if times else ()):
                n = n[ends[d]]
                matched[d][int(held)] += n
                whole[d][int(held)] += n == d + 1
        out = []
        for d, e in enumerate(ends):
            of = np.flatnonzero(size == d + 1)
            out += [(of, np.full(len(of), h), x[h][at_end], y[h][at_end]) for at_end in [np.searchsorted(e, at[of])] for x, y in [(whole[d], matched[d])] for h in (0, 1)]
        of, held, n, m = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 4
        return pa.table({"route_id": ids.take(pa.array(of)), "held_out": pa.array(held.astype(bool)), "whole": pa.array(n), "matched": pa.array(m), "n_steps": pa.array(size[of].astype(np.int64))})

    counted = left.groupBy("_lane", "_block").cogroup(right.groupBy("_lane", "_block")).applyInArrow(count, f"route_id {known.schema['route_id'].dataType.simpleString()}, held_out boolean, whole long, matched long, n_steps long")
    seen = counted.groupBy("route_id", "held_out").agg(F.sum("whole").alias("whole"), (F.sum("matched") / F.max("n_steps")).alias("share"))
    kinds = known.select("route_id").withColumn("held_out", F.explode(F.array(F.lit(True), F.lit(False)))).join(F.broadcast(totals), "held_out")
    return kinds.join(seen, ["route_id", "held_out"], "left").select("route_id", "held_out", "n", F.coalesce("whole", F.lit(0)).alias("whole"), (F.coalesce("share", F.lit(0.0)) / F.col("n")).alias("mean_share"))


__all__ = ["floor_sweep", "fusion", "key_stability", "known_answers", "rrf_sweep", "transfer", "transfer_report"]
