"""Sliced folds and the time-tree join against plain loops, and their plans."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from sessionloom.operators import segments, slices, temporal

SCHEMA = "session_id string, event_id long, t double, kind string, app string, url string"


def rows(seed, n=400, sessions=3, span=300):
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.choice(["focus_change", "url_change", "key_down", "scroll", "mouse_move", "bookmark"])
        out.append((f"s{r.randrange(sessions)}" if r.random() < 0.9 else None, i, float(r.randrange(-span // 4, span)), kind, r.choice(["a", "b", None]) if kind == "focus_change" else None, r.choice(["u", "v", None]) if kind in ("url_change", "focus_change") else None))
    return out


def table(spark, seed, **more):
    return spark.createDataFrame(rows(seed, **more), SCHEMA)


def same(a, b):
    assert a.columns == b.columns
    got, want = (sorted((tuple(r) for r in x.collect()), key=str) for x in (a, b))
    assert got == want and got


def plan(df):
    return df._jdf.queryExecution().toString()


def test_sliced_asof_is_the_plain_one(spark):
    for seed, width in ((1, 7.0), (2, 50.0), (3, 1000.0)):
        ev = table(spark, seed)
        marks = ev.filter("kind = 'focus_change'").select("session_id", "t", "event_id", F.col("event_id").alias("mark"), F.col("app").alias("mark_app"))
        left = ev.filter("kind in ('key_down', 'scroll')")
        for forward in (False, True):
            for strict in (False, True):
                one = temporal.asof(left, marks, ["mark", "mark_app"], forward=forward, strict=strict)
                same(temporal.asof(left, marks, ["mark", "mark_app"], forward=forward, strict=strict, slice=width), one)
        same(temporal.nearest(left, marks, "mark", slice=width), temporal.nearest(left, marks, "mark"))
        exact = left.filter("event_id % 3 = 0").select("event_id", (-F.col("event_id")).alias("mark"))
        same(temporal.exact_or_asof(left, exact, marks, "mark", keys=["event_id"], slice=width), temporal.exact_or_asof(left, exact, marks, "mark", keys=["event_id"]))


def test_sliced_asof_matches_a_loop(spark):
    found = rows(9)
    ev = spark.createDataFrame(found, SCHEMA).filter("session_id is not null")
    marks = ev.filter("kind = 'focus_change'").withColumn("mark", F.col("event_id"))
    got = {r.event_id: r.mark for r in temporal.asof(ev.filter("kind = 'key_down'").select("session_id", "event_id", "t"), marks, ["mark"], slice=20.0).collect()}
    by = {}
    for s, i, t, kind, *_ in found:
        if s and kind == "focus_change":
            by.setdefault(s, []).append((t, i))
    for its in by.values():
        its.sort()
    want = {}
    for s, i, t, kind, *_ in found:
        if s and kind == "key_down":
            at = bisect_right(by.get(s, []), (t, 1 << 60))
            want[i] = by[s][at - 1][1] if at else None
    assert got == want


def test_sliced_contexts_and_cuts_are_the_plain_ones(spark):
    for seed, width in ((4, 9.0), (5, 60.0)):
        ev = table(spark, seed)
        for f in (temporal.focus_context, temporal.digest_context):
            same(f(ev, slice=width), f(ev))
        same(temporal.exclude_focused(ev, ["A"], slice=width), temporal.exclude_focused(ev, ["A"]))
        known = ev.filter("session_id is not null")
        ends = segments.session_ends(known)
        plain = segments.boundaries(known, ends, dwell_ms=5.0, burst_ms=3.0)
        sliced = segments.boundaries(known, ends, dwell_ms=5.0, burst_ms=3.0, slice=width)
        same(sliced, plain)
        same(segments.segments(sliced, slice=width), segments.segments(plain))
        same(segments.pauses(known, dwell_ms=5.0, burst_ms=3.0, slice=width), segments.pauses(known, dwell_ms=5.0, burst_ms=3.0))
        same(segments.boundary_triggers(known, settle_ms=4.0, dwell_ms=5.0, slice=width), segments.boundary_triggers(known, settle_ms=4.0, dwell_ms=5.0))


def test_contexts_match_a_loop(spark):
    found = [x for x in rows(6) if x[0]]
    got = {r.event_id: (r.focus_app, r.focus_url) for r in temporal.focus_context(spark.createDataFrame(found, SCHEMA), slice=30.0).collect()}
    at = {}
    for s, i, t, kind, app, url in sorted(found, key=lambda x: (x[0], x[2], x[1])):
        was = at.get(s, (None, None))
        if kind == "focus_change":
            was = (app if app is not None else was[0], None)
        elif kind == "url_change" and url is not None:
            was = (was[0], url)
        at[s] = was
        assert got[i] == was


def test_sliced_throttle_matches_a_loop(spark):
    for seed, width in ((7, 25.0), (8, 90.0), (9, 6.0)):
        ev = table(spark, seed).withColumn("own", F.when(F.col("event_id") % 3 == 0, 2.0).when(F.col("event_id") % 3 == 1, 11.0).otherwise(0.0))
        got = {r.event_id for r in temporal.min_gap(ev, F.col("own"), slice=width).collect()}
        kept, last = set(), {}
        for s, i, t, *_ in sorted(rows(seed), key=lambda x: (str(x[0]), x[2], x[1])):
            if s not in last or t - last[s] >= (2.0, 11.0, 0.0)[i % 3]:
                last[s] = t
                kept.add(i)
        assert got == kept


def test_what_a_slice_leaves_behind():
    r = random.Random(1)
    for _ in range(300):
        times = sorted(float(r.randrange(100, 160)) for _ in range(r.randint(1, 30)))
        gaps = [r.choice([0.0, 3.0, 17.0, 40.0]) for _ in times]
        upto, last = slices.throttle_after(times, gaps, 100.0)
        for before in (None, *range(20, 100, 3), 99.5):
            state = before
            for t, g in zip(times, gaps):
                if state is None or t - state >= g:
                    state = t
            assert slices.leaving(upto, last, before) == state


def test_a_long_session_is_many_tasks_work(spark):
    n = 60_000
    ev = spark.range(n).select(F.lit("hot").alias("session_id"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 97 == 0, "focus_change").otherwise("key_down").alias("kind"))
    marks = ev.filter("kind = 'focus_change'").withColumn("mark", F.col("event_id"))
    found = temporal.asof(ev.filter("kind = 'key_down'"), marks, ["mark"], slice=1000.0)
    assert "hashpartitioning(_s#" in plan(found) and "_slice#" in plan(found)
    assert found.filter("mark <> event_id - event_id % 97").isEmpty() and found.count() == n - marks.count()
    cut = ev.withColumn("_slice", slices.slice_of("t", 1000.0)).repartition(16, "session_id", "_slice").groupBy(F.spark_partition_id()).count().collect()
    assert len(cut) > 8 and max(r["count"] for r in cut) < n / 4
    assert temporal.min_gap(ev, F.lit(10.0), slice=1000.0).count() == n / 10


def test_places_of_sliced_sessions(spark):
    ev = table(spark, 10)
    same(slices.numbered(ev, "n", ["event_id"], session="session_id", t="t", slice=13.0), slices.numbered(ev, "n", ["event_id"], session="session_id", t="t", slice=None))


def test_intervals_of_all_lengths_meet_by_few_nodes(spark):
    r = random.Random(2)
    points = [(r.choice("ab"), i, r.choice([float(r.randrange(0, 2000)), r.random() * 3])) for i in range(150)]
    spans = [(r.choice("ab"), i, s, s + r.choice([0.0, 0.001, 1.0, 7.5, 64.0, 1500.0])) for i, s in enumerate(float(r.randrange(0, 2000)) / 2 for _ in range(150))] + [("a", 900, 5.0, 4.0), ("b", 901, -1e9, 1e12)]
    p, s = spark.createDataFrame(points, "session_id string, p int, t double"), spark.createDataFrame(spans, "session_id string, s int, t_start double, t_end double")
    got = sorted((x.p, x.s) for x in temporal.interval_join(p, s).collect())
    assert got == sorted((i, j) for a, i, t in points for b, j, x, y in spans if a == b and x <= t < y)
    both = temporal.overlap_join(s, s.withColumnsRenamed({"s": "o", "t_start": "o0", "t_end": "o1"}), a_span=("t_start", "t_end"), b_span=("o0", "o1"), strict=False)
    assert sorted((x.s, x.o) for x in both.collect()) == sorted((i, j) for a, i, x, y in spans for b, j, u, v in spans if a == b and x <= v and u <= y and x <= y and u <= v)
    known, levels = temporal._levels(s, "t_start", "t_end")
    node = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))
    assert known.select((node("t_end") - node("t_start")).alias("n")).agg(F.max("n")).first()[0] <= 2 and len(levels) <= len(temporal.LEVELS)


def test_one_session_with_intervals_of_all_lengths(spark):
    p = spark.range(20_000).select(F.lit(1).alias("session_id"), F.col("id").alias("p"), F.col("id").cast("double").alias("t"))
    s = spark.range(500).select(F.lit(1).alias("session_id"), F.col("id").alias("s"), (F.col("id") * 40.0).alias("t_start"), (F.col("id") * 40.0 + F.pow(F.lit(2.0), (F.col("id") % 6).cast("double"))).alias("t_end"))
    assert temporal.interval_join(p, s).count() == sum(2 ** (i % 6) for i in range(500))


def test_sliced_throttle_tells_sessions_apart(spark):
    """One without an id, and ids beyond what a double can hold, in batches that cut sessions."""
    rows = [(s, i, float(i % 7 * 60 + i), 100.0) for s in (None, 2**53, 2**53 + 1, 2**53 + 2) for i in range(40)]
    rows = [(s, n, t, g) for n, (s, _, t, g) in enumerate(rows)]
    want = set()
    for session in {r[0] for r in rows}:
        last = None
        for _, n, t, g in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            if last is None or t - last >= g:
                want.add(n)
                last = t
    df = spark.createDataFrame(rows, "session_id long, event_id long, t double, gap double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.event_id for r in temporal.min_gap(df, F.col("gap"), slice=150.0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
