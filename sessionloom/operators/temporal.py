"""Joins and folds along time: as-of, nearest, interval and overlap joins, forward fills, throttles.

Each works on all sessions at once and moves rows by session, never globally; with ``slice``, a length
of time, they move by (session, slice), so that a long session is many tasks' work (see ``slices``). Ties
in time need a second ordering column, since a DataFrame has no input order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.operators import slices
from sessionloom.sources.tables import ensure_checkpoint_dir

#: Levels of the time tree that intervals are kept on: lengths up to 2 ** 62, down to 2 ** -20, every second one.
LEVELS = range(-20, 63, 2)


def merge_timelines(streams: list[DataFrame], *, session: str = "session_id", t: str = "t", seq: str = "seq") -> DataFrame:
    """All rows in one table with ``stream`` and their place in the session; equal times keep the order of streams."""
    tagged = [df.withColumn("stream", F.lit(i)) for i, df in enumerate(streams)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(t, "stream", seq)))


def monotonic(df: DataFrame, *, session: str = "session_id", t: str = "t", seq: str = "seq") -> DataFrame:
    """session, monotonic, n_backward: whether time never goes back in the order of ``seq``."""
    back = F.col(t) < F.lag(t).over(Window.partitionBy(session).orderBy(seq))
    return df.select(session, F.coalesce(back, F.lit(False)).alias("b")).groupBy(session).agg((~F.max("b")).alias("monotonic"), F.sum(F.col("b").cast("long")).alias("n_backward"))


def asof(left: DataFrame, right: DataFrame, values: list[str], *, session: str = "session_id", t: str = "t", seq: str = "event_id", forward: bool = False, strict: bool = False, slice: float | None = None) -> DataFrame:
    """``left`` with the right row's values that are latest at or before its time (or earliest at or after).

    One shuffle: both sides are stacked and the last right row is carried along. Among right rows of one
    time the one of greatest ``seq`` counts, going forward the one of least. ``strict`` leaves out equal times.
    """
    carry = F.struct(*[F.col(v) for v in values])
    blank = F.lit(None).cast(right.select(carry.alias("c")).schema["c"].dataType)
    # of equal times, marks come before the rows that may see them; going forward the order is turned round
    mark_side = 0 if strict == forward else 1
    marks = right.select(F.col(session).alias("_s"), F.col(t).alias("_t"), F.lit(mark_side).alias("_side"), F.col(seq).cast("long").alias("_seq"), carry.alias("_mark"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_row"))
    rows = left.select(F.col(session).alias("_s"), F.col(t).alias("_t"), F.lit(1 - mark_side).alias("_side"), F.lit(0).cast("long").alias("_seq"), blank.alias("_mark"), F.struct("*").alias("_row"))
    found = slices.carried(marks.unionByName(rows), {"_found": F.col("_mark")}, ["_side", "_seq"], session="_s", t="_t", slice=slice, ahead=forward).filter("_row is not null")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, value: str, *, session: str = "session_id", t: str = "t", seq: str = "event_id", prefer_later: bool = False, slice: float | None = None) -> DataFrame:
    """``left`` with the ``value`` of the right row nearest in time, and ``dt`` from it.

    At equal distance the earlier row, or the later one with ``prefer_later``. A session without
    right rows gives nulls.
    """
    r = right.select(session, t, seq, F.col(value).alias("_v"), F.col(t).alias("_vt"))
    before = asof(left, r.select(session, t, seq, F.struct("_v", "_vt").alias("_b")), ["_b"], session=session, t=t, seq=seq, slice=slice)
    both = asof(before, r.select(session, t, seq, F.struct("_v", "_vt").alias("_a")), ["_a"], session=session, t=t, seq=seq, forward=True, slice=slice)
    db, da = F.col(t) - F.col("_b._vt"), F.col("_a._vt") - F.col(t)
    take_after = F.col("_b").isNull() | (F.col("_a").isNotNull() & ((da <= db) if prefer_later else (da < db)))
    pick = F.when(take_after, F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_p", pick).select(*left.columns, F.col("_p._v").alias(value), F.abs(F.col(t) - F.col("_p._vt")).alias("dt"))


def _levels(intervals: DataFrame, start: str, end: str) -> tuple[DataFrame, list[int]]:
    """``intervals`` with ``_level``, that of the least tree nodes they are no longer than, and the levels that there are."""
    length = (F.col(end) - F.col(start)).cast("double")
    level = F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(F.when(length > 0, length)) / 2) * 2).cast("int")
    ensure_checkpoint_dir(intervals.sparkSession)
    known = intervals.filter(F.col(end) >= F.col(start)).withColumn("_level", F.coalesce(level, F.lit(LEVELS[0]))).checkpoint()  # read twice
    return known, sorted(r["_level"] for r in known.select("_level").distinct().collect())  # as many as LEVELS at most


def stab(points: DataFrame, intervals: DataFrame, on: Column, *, session: str, t: str, start: str, end: str) -> DataFrame:
    """Every (point, interval) of a session with start <= t <= end and ``on``, joined by equal nodes of a time tree.

    A node of level l spans 2 ** l of time. An interval stands at the level of its length, on the two nodes
    (three, where rounding moves one) that it reaches; a point asks its node of each level that intervals
    stand on, a part of its path to the root. So rows of both sides are bounded by the number of levels
    and not by length, and intervals of all lengths meet points close by only.
    """
    known, levels = _levels(intervals, start, end)
    node = lambda c: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    spread = known.withColumn("_node", F.explode(F.sequence(node(start), node(end)))).withColumnsRenamed({session: "_session", "_level": "_at", "_node": "_of"})
    path = F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))
    asked = points.withColumn("_level", path).withColumn("_node", node(t))
    meet = (F.col(session) == F.col("_session")) & (F.col("_level") == F.col("_at")) & (F.col("_node") == F.col("_of"))
    return asked.join(spread, meet & (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end)) & on).drop("_level", "_node", "_session", "_at", "_of")


def interval_join(points: DataFrame, intervals: DataFrame, *, session: str = "session_id", t: str = "t", start: str = "t_start", end: str = "t_end", closed_at: str | None = None) -> DataFrame:
    """Every (point, interval) of a session with start <= t < end.

    ``closed_at`` names the column with the session's end: an interval that ends there holds its end too.
    """
    right = F.col(t) < F.col(end)
    if closed_at:
        right = right | ((F.col(end) == F.col(closed_at)) & (F.col(t) == F.col(end)))
    return stab(points, intervals, right, session=session, t=t, start=start, end=end)


def overlap_join(a: DataFrame, b: DataFrame, *, session: str = "session_id", a_span: tuple[str, str], b_span: tuple[str, str], strict: bool = True) -> DataFrame:
    """Every pair of intervals of a session that overlap; touching ends count unless ``strict``.

    The later of both starts lies in the other interval, so a pair is found once, as a point in an interval.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    meet = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) if strict else (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))
    meet = meet & (F.col(a0) <= F.col(a1)) & (F.col(b0) <= F.col(b1))
    columns = [*a.columns, *[c for c in b.columns if c != session]]
    later_a = stab(a, b, meet, session=session, t=a0, start=b0, end=b1).select(*columns)
    later_b = stab(b, a, meet & (F.col(a0) < F.col(b0)), session=session, t=b0, start=a0, end=a1).select(*columns)
    return later_a.unionByName(later_b)


def min_gap(df: DataFrame, gap: Column, *, session: str = "session_id", t: str = "t", seq: str = "event_id", slice: float | None = None) -> DataFrame:
    """The rows kept by a throttle: the first of a session, and each that is ``gap`` or more after the last kept.

    What is kept depends on what was kept before: rows are dealt and sorted by session and folded in one
    pass, with one time as the state; no session is held as a whole. With ``slice`` they are dealt by
    (session, slice), and the state that enters a slice is found first; gaps should be well below it.
    """
    if slice is not None:
        return slices.throttled(df, gap, session=session, t=t, seq=seq, slice=slice)
    dealt = df.withColumn("_gap", gap.cast("double")).repartition(session).sortWithinPartitions(session, t, seq)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last = None, None
        for frame in frames:
            kept = []
            for own, at, least in zip(frame[session].tolist(), frame[t].tolist(), frame["_gap"].tolist(), strict=True):
                keep = own != of or at - last >= least or at < last
                kept.append(keep)
                if keep:
                    of, last = own, at
            yield frame[kept].drop(columns="_gap")

    return dealt.mapInPandas(fold, df.schema)


def last_n(df: DataFrame, n: int, *, session: str = "session_id", order: list[str]) -> DataFrame:
    """The last n rows of each session."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sample_evenly(df: DataFrame, k: int, *, session: str = "session_id", order: list[str]) -> DataFrame:
    """k rows of each session at even steps, first and last among them; sessions of k or fewer stay whole."""
    w = Window.partitionBy(session)
    at, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    rows = df.withColumns({"_at": at, "_n": n})
    if k <= 1:
        return rows.filter(F.col("_at") < k).drop("_at", "_n")
    # row `at` is taken if it is floor(i * (n - 1) / (k - 1)) for some i
    i = F.ceil(F.col("_at") * (k - 1) / (F.col("_n") - 1))
    hit = F.floor(i * (F.col("_n") - 1) / F.lit(k - 1)) == F.col("_at")
    return rows.filter((F.col("_n") <= k) | hit).drop("_at", "_n")


def exclude_focused(ev: DataFrame, apps: list[str], *, session: str = "session_id", t: str = "t", seq: str = "event_id", slice: float | None = None) -> DataFrame:
    """Every row with ``excluded`` and ``unattributable``: whether an excluded app had focus at its time.

    Rows before a session's first focus change take that one's state; a session without any focus
    change is kept whole and marked.
    """
    focus = F.when(F.col("kind") == "focus_change", F.coalesce(F.lower("app").isin([a.strip().lower() for a in apps]), F.lit(False)))
    so_far = slices.carried(ev, {"_so_far": focus}, [seq], session=session, t=t, slice=slice)
    both = slices.carried(so_far, {"_ahead": focus}, [seq], session=session, t=t, slice=slice, ahead=True)
    state = F.coalesce("_so_far", "_ahead")
    return both.withColumns({"excluded": F.coalesce(state, F.lit(False)), "unattributable": state.isNull()}).drop("_so_far", "_ahead")


def exclusion_report(marked: DataFrame, *, session: str = "session_id") -> DataFrame:
    """Per session: kept, dropped, the excluded apps that were seen, and whether focus was ever known."""
    hit = F.col("excluded") & (F.col("kind") == "focus_change")
    return marked.groupBy(session).agg(
        F.sum((~F.col("excluded")).cast("long")).alias("kept"), F.sum(F.col("excluded").cast("long")).alias("dropped"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("app")))), ",").alias("apps"), F.max("unattributable").alias("unattributable"),
    )


def _context(ev: DataFrame, url: Column, session: str, t: str, seq: str, slice: float | None) -> DataFrame:
    focus = F.col("kind") == "focus_change"
    rows = slices.carried(ev, {"focus_app": F.when(focus, F.col("app")), "_url": url}, [seq], session=session, t=t, slice=slice)
    return rows.withColumn("focus_url", F.col("_url.url")).drop("_url")


def focus_context(ev: DataFrame, *, session: str = "session_id", t: str = "t", seq: str = "event_id", slice: float | None = None) -> DataFrame:
    """Every row with ``focus_app`` and ``focus_url``: a focus change forgets the URL of the app before."""
    forgotten = F.struct(F.lit(None).cast("string").alias("url"))
    url = F.when(F.col("kind") == "focus_change", forgotten).when((F.col("kind") == "url_change") & F.col("url").isNotNull(), F.struct("url"))
    return _context(ev, url, session, t, seq, slice)


def digest_context(ev: DataFrame, *, session: str = "session_id", t: str = "t", seq: str = "event_id", slice: float | None = None) -> DataFrame:
    """As ``focus_context``, but a focus change may bring a URL, and a URL change inherits the app."""
    url = F.when((F.col("kind") == "focus_change") | ((F.col("kind") == "url_change") & F.col("url").isNotNull()), F.struct("url"))
    return _context(ev, url, session, t, seq, slice)


def align_clocks(df: DataFrame, clocks: DataFrame, *, session: str = "session_id", device_t: str = "device_ms") -> DataFrame:
    """Device times onto the session's clock by its one calibration; ``calibrated`` tells whether it has one."""
    offset = clocks.select(session, (F.col("mono_epoch_ms") - F.col("device_epoch_ms")).alias("_offset"))
    joined = df.join(offset, session, "left")
    return joined.withColumns({"t": F.col(device_t) + F.col("_offset"), "calibrated": F.col("_offset").isNotNull()}).drop("_offset")


def exact_or_asof(left: DataFrame, exact: DataFrame, right: DataFrame, value: str, *, keys: list[str], session: str = "session_id", t: str = "t", seq: str = "event_id", slice: float | None = None) -> DataFrame:
    """The value recorded for the very key, else the latest at or before."""
    own = left.join(exact.select(*keys, F.col(value).alias("_exact")), keys, "left")
    found = asof(own, right, [value], session=session, t=t, seq=seq, slice=slice)
    return found.select(*left.columns, F.coalesce("_exact", value).alias(value), F.col("_exact").isNotNull().alias("exact"))
