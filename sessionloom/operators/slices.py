"""Folds along a session's time that don't need the session in one task.

A session is cut into slices of time, and rows move by (session, slice). Each slice is first folded to
what it leaves behind (its last mark, its number of rows, or a throttle's state after it for each state
before it); these totals, a row a slice, are scanned in order; and what comes in from the slices before
is applied within each slice. So a session of any length is worked on by as many tasks as it has slices.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A row without a time is before all others.
UNTIMED = -(1 << 62)


def slice_of(t: str, width: float) -> Column:
    return F.coalesce(F.floor(F.col(t) / width).cast("long"), F.lit(UNTIMED))


def carried(rows: DataFrame, values: dict[str, Column], order: list[str], *, session: str, t: str, slice: float | None, own: bool = True, ahead: bool = False) -> DataFrame:
    """``rows`` with the last value of each of ``values`` that is not null at or before a row, in the order of (t, *order).

    ``own`` tells whether a row's own value counts, ``ahead`` looks for the first one at or after instead.
    A value that may itself be null goes into a struct. Without ``slice`` a session is one window.
    """
    keys = [t, *order]
    by = [F.desc(c) for c in keys] if ahead else [F.asc(c) for c in keys]
    until = 0 if own else -1
    marked = rows.withColumns(values)
    if slice is None:
        w = Window.partitionBy(session).orderBy(*by).rowsBetween(Window.unboundedPreceding, until)
        return marked.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in values})
    cut = marked.withColumn("_slice", slice_of(t, slice))
    w = Window.partitionBy(session, "_slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, until)
    pick = F.min_by if ahead else F.max_by
    place = F.struct(*[F.col(c) for c in keys])
    totals = cut.groupBy(session, "_slice").agg(*[pick(name, F.when(F.col(name).isNotNull(), place)).alias(name) for name in values])
    over = Window.partitionBy(session).orderBy(F.desc("_slice") if ahead else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    come = totals.select(F.col(session).alias("_in_session"), F.col("_slice").alias("_in_slice"), *[F.last(name, ignorenulls=True).over(over).alias(f"_in_{name}") for name in values])
    met = cut.join(come, F.col(session).eqNullSafe(F.col("_in_session")) & (F.col("_slice") == F.col("_in_slice")), "left")
    found = met.withColumns({name: F.coalesce(F.last(name, ignorenulls=True).over(w), F.col(f"_in_{name}")) for name in values})
    return found.drop("_slice", "_in_session", "_in_slice", *[f"_in_{name}" for name in values])


def numbered(rows: DataFrame, name: str, order: list[str], *, session: str, t: str, slice: float | None) -> DataFrame:
    """``rows`` with their place from 1 within the session, in the order of (t, *order)."""
    keys = [t, *order]
    if slice is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(session).orderBy(*keys)))
    cut = rows.withColumn("_slice", slice_of(t, slice))
    over = Window.partitionBy(session).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(session, "_slice").agg(F.count("*").alias("_n"))
    come = counts.select(F.col(session).alias("_in_session"), F.col("_slice").alias("_in_slice"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    met = cut.join(come, F.col(session).eqNullSafe(F.col("_in_session")) & (F.col("_slice") == F.col("_in_slice")), "left")
    place = F.row_number().over(Window.partitionBy(session, "_slice").orderBy(*keys)) + F.col("_before")
    return met.withColumn(name, place.cast("int")).drop("_slice", "_in_session", "_in_slice", "_before")


# ------------------------------------------------------------------ throttles


def throttle_after(times: list[float], gaps: list[float], start: float) -> tuple[list[float], list[float]]:
    """What a throttle that enters a slice has kept last when it leaves, by what it had kept last before.

    A row is kept if it is its ``gap`` or more after the last kept one. Returns (upto, last): a state
    before of at most upto[i] (and more than upto[i - 1]) leaves as last[i]; a later one passes unchanged;
    one that has kept nothing yet leaves as last[0]. States that have kept the same row go on as one, so
    a row is looked at once, and only states before ``start``, the slice's beginning, are told apart.
    """
    upto: list[float] = []
    alive: deque[tuple[float, list[int]]] = deque()  # (last kept, states before), ascending
    for n, (at, gap) in enumerate(zip(times, gaps, strict=True)):
        reach = at - gap  # states whose last row is at most this keep the row
        met: list[int] = []
        while alive and alive[0][0] <= reach:
            met += alive.popleft()[1]
        if n == 0:
            upto.append(reach if reach == reach else float("-inf"))
            met.append(0)
        elif upto[-1] < start and reach > upto[-1]:
            met.append(len(upto))
            upto.append(reach)
        if met:
            alive.append((at, met))
    last = [0.0] * len(upto)
    for at, states in alive:
        for i in states:
            last[i] = at
    return upto, last


def leaving(upto: list[float], last: list[float], before: float | None) -> float:
    if before is None:
        return last[0]
    i = bisect_left(upto, before)
    return last[i] if i < len(upto) else before


def throttled(df: DataFrame, gap: Column, *, session: str, t: str, seq: str, slice: float) -> DataFrame:
    """The rows that ``temporal.min_gap`` keeps, by slices of a session."""
    cut = df.withColumns({"_gap": gap.cast("double"), "_slice": slice_of(t, slice)})
    kind, names = df.schema[session].dataType.simpleString(), df.columns
    numbers = lambda batch, c: pc.fill_null(batch.column(c).cast(pa.float64(), safe=False), math.nan).to_pylist()

    # rows are read in order, session after session, slice after slice: no group has a frame of its own
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, times, gaps, ids = None, [], [], None

        def made(found: list) -> pa.RecordBatch:
            cut = [(*key, *throttle_after(at, least, float(key[1]) * slice)) for key, at, least in found]
            kinds = (ids, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cut], k) for i, k in enumerate(kinds)], [session, "_slice", "upto", "last"])

        for batch in batches:
            ids, found = batch.schema.field(session).type, []
            for own, part, at, least in zip(batch.column(session).to_pylist(), batch.column("_slice").to_pylist(), numbers(batch, t), numbers(batch, "_gap"), strict=True):
                if (own, part) != of:
                    if of is not None:
                        found.append((of, times, gaps))
                    of, times, gaps = (own, part), [], []
                times.append(at)
                gaps.append(least)
            yield made(found)
        if of is not None:
            yield made([(of, times, gaps)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            before = []
            for own, upto, last in zip(*(batch.column(c).to_pylist() for c in (session, "upto", "last")), strict=True):
                if (own,) != of:
                    of, state = (own,), None
                before.append(state)
                state = leaving(upto, last, state)
            yield pa.RecordBatch.from_arrays([batch.column(session), batch.column("_slice"), pa.array(before, pa.float64())], [session, "_slice", "_before"])

    laid = cut.select(session, "_slice", F.col(t).cast("double").alias(t), seq, "_gap").repartition(session, "_slice").sortWithinPartitions(session, "_slice", t, seq)
    totals = laid.mapInArrow(fold, f"`{session}` {kind}, _slice long, upto array<double>, last array<double>")
    come = totals.repartition(session).sortWithinPartitions(session, "_slice").mapInArrow(scan, f"`{session}` {kind}, _slice long, _before double")
    met = cut.join(come.select(F.col(session).alias("_in_session"), F.col("_slice").alias("_in_slice"), "_before"), F.col(session).eqNullSafe(F.col("_in_session")) & (F.col("_slice") == F.col("_in_slice")), "left")
    dealt = met.drop("_in_session", "_in_slice").repartition(session, "_slice").sortWithinPartitions(session, "_slice", t, seq)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, None
        for batch in batches:
            kept = []
            for *own, at, least, before in zip(batch.column(session).to_pylist(), batch.column("_slice").to_pylist(), numbers(batch, t), numbers(batch, "_gap"), batch.column("_before").to_pylist(), strict=True):
                if own != of:
                    of, last = own, before
                hit = last is None or at - last >= least or at < last
                kept.append(hit)
                if hit:
                    last = at
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    return dealt.mapInArrow(keep, df.schema)
