"""Routes that sessions share: walks, keys, similarity, clustering, naming, binding of habits, paths."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from sessionloom.sources.tables import ensure_checkpoint_dir

ARROW = " → "


def deduped(items: Column) -> Column:
    """An array without elements that equal the one before."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.element_at(items, F.when(i == 0, 1).otherwise(i))))


def walks(steps: DataFrame) -> DataFrame:
    """session_id, places, edges, t_start, t_end, route_key of each session's walk.

    ``steps``: session_id, t, ord, edge_id, from_place, to_place (null places are skipped), t_end.
    Consecutive equal places are one; a session without places is dropped.
    """
    g = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", "ord", "edge_id", "from_place", "to_place"))).alias("s"), F.min("t").alias("t_start"), F.max("t_end").alias("t_end"))
    every = F.concat(F.array(F.col("s")[0]["from_place"]), F.transform("s", lambda x: x["to_place"]))
    rows = g.withColumn("_p", F.filter(every, lambda p: p.isNotNull())).withColumn("places", deduped(F.col("_p"))).filter(F.size("places") > 0)
    return rows.select("session_id", "places", F.transform("s", lambda x: x["edge_id"]).alias("edges"), "t_start", "t_end", F.array_join("places", ARROW).alias("route_key"))


def frequent_routes(walked: DataFrame) -> DataFrame:
    """route_key, places, n_sessions, n_edges, sessions: sessions that share a route, most first; ``place_no`` orders them."""
    g = walked.groupBy("route_key").agg(F.first("places").alias("places"), F.countDistinct("session_id").alias("n_sessions"), F.array_sort(F.collect_set("session_id")).alias("sessions"), F.size(F.array_distinct(F.flatten(F.collect_set("edges")))).alias("n_edges"))
    return g


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays: a row of the table is one whole number, a bit a place."""
    out = []
    for x, y in zip(a, b, strict=True):
        at: dict = {}
        for i, p in enumerate(x):
            at[p] = at.get(p, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for p in y:
            met = row & at.get(p, 0)
            row = (row + met | row - met) & full
        out.append(len(x) - row.bit_count())
    return pd.Series(out, dtype="int32")


def similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with lcs, gap (extra places of the longer if it holds the shorter, else null), lcs_ratio and jaccard."""
    x, y = F.col(a), F.col(b)
    rows = pairs.withColumn("lcs", lcs(x, y))
    short, both = F.least(F.size(x), F.size(y)), F.size(F.array_union(x, y))
    return rows.withColumns({
        "gap": F.when(F.col("lcs") == short, F.abs(F.size(x) - F.size(y))),
        "lcs_ratio": F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(2 * F.col("lcs") / (F.size(x) + F.size(y))),
        "jaccard": F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both),
    })


#: Routes of two blocks whose pairs a task makes.
BLOCK_ASKED, BLOCK_BASE = 320, 2_000


def _common(code_a: np.ndarray, size_a: np.ndarray, code_b: np.ndarray, size_b: np.ndarray, words: int) -> np.ndarray:
    """``lcs`` of all pairs of two lots of routes: a row of numbers a step, a bit a place; numbers of any length for long routes."""
    out = np.zeros((len(size_a), len(size_b)), dtype=np.int32)
    begin_a, begin_b, order = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, np.argsort(-size_b, kind="stable")
    for rows, kind in ((np.flatnonzero(size_a < 64), np.uint64), (np.flatnonzero(size_a >= 64), object)):
        if not len(rows):
            continue
        at, full = np.zeros((len(rows), words), dtype=kind), np.zeros((len(rows), 1), dtype=kind)
        for i, r in enumerate(rows):
            full[i, 0] = kind((1 << int(size_a[r])) - 1) if kind is np.uint64 else (1 << int(size_a[r])) - 1
            for j, c in enumerate(code_a[begin_a[r] : begin_a[r] + size_a[r]]):
                at[i, c] |= kind(1 << j) if kind is np.uint64 else 1 << j
        row = np.repeat(full, len(size_b), axis=1)  # routes of the second lot from the longest on
        for step in range(int(size_b.max(initial=0))):
            n = int((size_b > step).sum())
            now = row[:, :n]
            met = now & at[:, code_b[begin_b[order[:n]] + step]]
            row[:, :n] = (now + met | now - met) & full
        left = np.bitwise_count(row).astype(np.int32) if kind is np.uint64 else np.vectorize(int.bit_count, otypes=[np.int32])(row)
        out[np.ix_(rows, order)] = size_a[rows, None] - left
    return out


def against(asked: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """a_key, b_key, lcs, gap, lcs_ratio (see ``similarity``) of each asked route and each other route of the same ``by``.

    Both: route_key, places, ``by``. Places go to tasks once a pair of blocks, not once a pair of routes.
    """
    met = _in_blocks(asked, base, by, lambda code_a, size_a, code_b, size_b, words: {"lcs": _common(code_a, size_a, code_b, size_b, words)}, "lcs int")
    both = F.col("a_size") + F.col("b_size")
    gap = F.when(F.col("lcs") == F.least("a_size", "b_size"), F.abs(F.col("a_size") - F.col("b_size")))
    return met.select("a_key", "b_key", "lcs", gap.alias("gap"), F.when(both == 0, 1.0).otherwise(2 * F.col("lcs") / both).alias("lcs_ratio"))


def shared(asked: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """a_key, b_key, jaccard (see ``similarity``) of each asked route and each other route of the same ``by``, as ``against``."""
    return _in_blocks(asked, base, by, lambda *lots: {"jaccard": _jaccards(*lots)}, "jaccard double").select("a_key", "b_key", "jaccard")


def _jaccards(code_a: np.ndarray, size_a: np.ndarray, code_b: np.ndarray, size_b: np.ndarray, words: int) -> np.ndarray:
    """Shares of common places of all pairs of two lots of routes by a matrix product over the places of the first."""
    known = np.unique(code_a)
    at = np.full(words, -1)
    at[known] = np.arange(len(known))

    def table(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(size)), size)
        distinct = np.unique(row * max(words, 1) + code)
        row, code = distinct // max(words, 1), at[distinct % max(words, 1)]
        out = np.zeros((len(size), len(known)), dtype=np.float32)
        out[row[code >= 0], code[code >= 0]] = 1
        return out, np.bincount(row, minlength=len(size))

    (a, n_a), (b, n_b) = table(code_a, size_a), table(code_b, size_b)
    both = np.rint(a @ b.T).astype(np.int64)
    every = n_a[:, None] + n_b[None, :] - both
    return np.where(every == 0, 1.0, both / np.maximum(every, 1))


def _in_blocks(asked: DataFrame, base: DataFrame, by: str, measure, kind: str) -> DataFrame:
    """a_key, b_key, a_size, b_size and what ``measure`` finds of each asked route and each other one of the same ``by``, block by block."""
    n = asked.groupBy(by).agg(F.count("*").alias("n_a")).join(base.groupBy(by).agg(F.count("*").alias("n_b")), by).withColumns({"n_a": F.ceil(F.col("n_a") / BLOCK_ASKED), "n_b": F.ceil(F.col("n_b") / BLOCK_BASE)})
    deal = lambda c: F.pmod(F.xxhash64("route_key"), F.col(c)).alias(f"_{c}")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(f"_{c}")
    own = lambda df: df.select(F.col(by).alias("_by"), F.col("route_key").alias("route_key"), F.col("places").alias("places"))
    n = n.withColumnRenamed(by, "_by")
    left = own(asked).join(n, "_by").select(F.col("_by").alias("_b"), deal("n_a"), every("n_b"), F.col("route_key").alias("a_key"), F.col("places").alias("a"))
    right = own(base).join(n, "_by").select(F.col("_by").alias("_b"), every("n_a"), deal("n_b"), F.col("route_key").alias("b_key"), F.col("places").alias("b"))

    def pairs(some: pa.Table, table: pa.Table) -> pa.Table:
        a, b = some["a"].combine_chunks(), table["b"].combine_chunks()
        size_a, size_b = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
        words = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False)
        found = measure(code[: size_a.sum()], size_a, code[size_a.sum() :], size_b, len(words.dictionary))
        keys = pa.concat_arrays([some["a_key"].combine_chunks(), table["b_key"].combine_chunks()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        i, j = np.nonzero(keys[: len(size_a), None] != keys[None, len(size_a) :])
        ends = {"a_size": pa.array(size_a[i].astype(np.int32)), "b_size": pa.array(size_b[j].astype(np.int32))}
        return pa.table({"a_key": some["a_key"].take(pa.array(i)), "b_key": table["b_key"].take(pa.array(j)), **ends, **{c: pa.array(v[i, j]) for c, v in found.items()}})

    keys = ["_b", "_n_a", "_n_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pairs, f"a_key string, b_key string, a_size int, b_size int, {kind}")


def shortened(places: Column, budget: int) -> Column:
    """All distinct forms of an array with one to ``budget`` elements left out between its first and its last.

    Of one that begins and ends alike the single element is a form too, where the budget reaches it.
    """
    def without_one(a: Column) -> Column:
        inner = F.when(F.size(a) > 2, F.sequence(F.lit(2), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(inner, lambda i: F.concat(F.slice(a, 1, i - 1), F.slice(a, i + 1, F.size(a))))

    level = every = without_one(places)
    for _ in range(budget - 1):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        every = F.concat(every, level)
    alike = (F.size(places) > 1) & (F.size(places) - 1 <= budget) & (F.element_at(places, 1) == F.element_at(places, -1))
    return F.array_distinct(F.concat(every, F.when(alike, F.array(F.slice(places, 1, 1))).otherwise(F.array().cast("array<array<string>>"))))


def compatible_pairs(routes: DataFrame, *, rule: str = "insertions", budget: int = 2, least: float = 0.8) -> DataFrame:
    """a_key, b_key of routes that a rule calls the same work.

    Insertions need equal first and last places: the longer route, with as many places left out in
    between as the budget allows, is the shorter one, so pairs meet by an equal join on what is left.
    A route of n places has about n ** budget such forms. The other rules are joins of sets: see ``alike``.
    """
    one = routes.select("route_key", "places")
    if rule == "exact":
        return routes.select(F.col("route_key").alias("a_key"), F.col("route_key").alias("b_key")).filter(F.lit(False))
    if rule == "insertions":
        held = one.select(F.col("route_key").alias("long"), F.explode(shortened(F.col("places"), budget)).alias("form"))
        met = held.join(one.select(F.col("route_key").alias("short"), F.col("places").alias("form")), "form").filter("long <> short")
        return met.select(F.least("long", "short").alias("a_key"), F.greatest("long", "short").alias("b_key")).distinct()
    if rule == "lcs":
        return _common_pairs(one, least)
    return similarity(alike(one, "jaccard", least)).filter(F.col("jaccard") >= least).select("a_key", "b_key")


#: Most forms of a route that are posted.
FORMS = 2_000


def _left_out(length: int, least: float) -> int:
    """How many places a route can lack in what it shares with another: most where the other is all of it."""
    return math.floor(length * (1 - least / (2 - least)) + 1e-9)


def _common_pairs(one: DataFrame, least: float) -> DataFrame:
    """a_key, b_key of routes whose common subsequence is at least ``least`` of both, as ``similarity`` has it.

    Such a subsequence is what is left of each when the places it lacks are left out, so routes meet by an
    equal join on that. Routes that have more than ``FORMS`` such forms meet by the set join.
    """
    most = lambda n: sum(math.comb(n, d) for d in range(_left_out(n, least) + 1))
    longest = next(n for n in itertools.count() if most(n + 1) > FORMS or n >= FORMS)  # least = 1 has one form at any length

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part, at, out, left = batch.slice(start, 500), [], [], []
                for i, places in enumerate(part.column("places").to_pylist()):
                    words = [f"{len(p)}:{p}" for p in places]
                    for d in range(_left_out(len(words), least) + 1):
                        some = {"".join(c) for c in itertools.combinations(words, len(words) - d)}
                        at += [i] * len(some)
                        out += some
                        left += [len(words) - d] * len(some)
                key = part.column("route_key").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, part.column("n").take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(left, pa.int32())], ["route_key", "n", "form", "left"])

    sized = one.select("route_key", "places", F.size("places").alias("n"))
    posted = sized.filter(F.col("n").between(1, longest)).mapInArrow(forms, f"route_key {one.schema['route_key'].dataType.simpleString()}, n int, form string, left int")
    side = lambda p: posted.select("form", "left", F.col("route_key").alias(f"{p}_key"), F.col("n").alias(f"{p}_n"))
    met = side("a").join(side("b"), ["form", "left"]).filter((F.col("a_key") < F.col("b_key")) & (2 * F.col("left") / (F.col("a_n") + F.col("b_n")) >= least)).select("a_key", "b_key").distinct()
    if sized.filter(F.col("n") > longest).isEmpty():
        return met
    near = sized.filter(F.col("n") >= math.floor(longest * least / (2 - least))).select("route_key", "places")
    return met.unionByName(similarity(alike(near, "dice", least, above=longest)).filter(F.col("lcs_ratio") >= least).select("a_key", "b_key"))


def alike(routes: DataFrame, measure: str, least: float, above: int = 0) -> DataFrame:
    """a_key, b_key, a, b: the pairs of routes that may reach ``least``, a set join by prefixes (of pairs with one of more than ``above`` elements).

    Places are put in order from the rarest to the most common; for the longest common subsequence ("dice",
    twice the common part over both lengths) a place's n-th visit is an element of its own, for "jaccard"
    places are distinct. Two sets that alike share one of the few rarest elements of each (its prefix), so
    only these are posted; lengths that differ too much, and elements after which too little is left to
    share, do not meet.
    """
    share = {"jaccard": least / (1 + least), "dice": least / 2}[measure]  # of both sizes, what must be common
    seen = F.transform("places", lambda p, i: F.struct(p.alias("p"), F.size(F.filter(F.slice("places", 1, i), lambda q: q == p)).alias("n")))
    elements = F.transform(F.array_distinct("places"), lambda p: F.struct(p.alias("p"), F.lit(0).alias("n"))) if measure == "jaccard" else seen
    each = routes.select("route_key", F.explode(elements).alias("e"))
    rarity = each.groupBy("e").agg(F.count("*").alias("uses"))
    ordered = each.join(rarity, "e").groupBy("route_key").agg(F.array_sort(F.collect_list(F.struct("uses", "e"))).alias("es"))
    size = F.size("es")
    # the least that any partner must share: the smallest partner has size * ratio elements
    ratio = least if measure == "jaccard" else least / (2 - least)
    prefix = F.least(size, F.greatest(F.lit(1), size - F.ceil(size * ratio - 1e-9) + 1)).cast("int")
    posted = ordered.select("route_key", size.alias("size"), F.posexplode(F.slice("es", F.lit(1), prefix)).alias("at", "e")).select("route_key", "size", "at", F.col("e.e").alias("e"))
    side = lambda p: posted.select("e", F.col("route_key").alias(f"{p}_key"), F.col("size").alias(f"{p}_size"), F.col("at").alias(f"{p}_at"))
    need = (F.col("a_size") + F.col("b_size")) * share - 1e-9
    met = side("a").join(side("b"), "e").filter((F.greatest("a_size", "b_size") > above) & (F.col("a_key") < F.col("b_key")) & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * ratio - 1e-9))
    met = met.filter(F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= need).select("a_key", "b_key").distinct()
    places = lambda p: routes.select(F.col("route_key").alias(f"{p}_key"), F.col("places").alias(p))
    return met.join(places("a"), "a_key").join(places("b"), "b_key")


def _families(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """route_key, family: least key that compatible pairs lead to, spreading along links and along what neighbours know."""
    ensure_checkpoint_dir(keys.sparkSession)
    links = pairs.select(F.col("a_key").alias("x"), F.col("b_key").alias("y")).union(pairs.select("b_key", "a_key")).checkpoint()
    label = keys.select(F.col("route_key").alias("x"), F.col("route_key").alias("family"))
    while True:  # labels only fall, so this ends
        near = links.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("family").alias("near"))
        hop = label.join(near, "x", "left").select("x", F.col("family").alias("was"), F.least("family", F.coalesce("near", "family")).alias("m"))
        new = hop.join(label.select(F.col("x").alias("m"), F.col("family").alias("far")), "m").select("x", "was", F.least("m", "far").alias("family")).checkpoint()
        label = new.select("x", "family")
        if new.filter("was <> family").isEmpty():
            break
    return label.withColumnRenamed("x", "route_key")


def _assign(frame: pd.DataFrame) -> pd.DataFrame:
    """id, canonical, declined of some routes of a family in order of ``id``.

    ``cls``: a route's kind; ``near``: the kinds here that fit it; ``open``: clusters from before whose members all fit it.
    """
    fits: dict[int, set] = {}
    added: dict[int, set] = {}  # the kinds that a cluster took here
    within: dict[int, set] = {}  # the clusters here that hold a kind
    made, out, none = set(), [], set()
    frame = frame.sort_values("id")
    for key, kind, near, before in zip(frame["id"].tolist(), frame["cls"].tolist(), frame["near"], frame["open"], strict=True):
        if kind not in fits:
            fits[kind] = set() if near is None else set(near.tolist())
        mine, open_ = fits[kind], set() if before is None else set(before.tolist())
        here = set().union(*(within[k] for k in mine if k in within))
        take = [c for c in open_ | here if (c in open_ or c in made) and added.get(c, none) <= mine]
        home = take[0] if len(take) == 1 else key
        if home == key:
            made.add(key)
        added.setdefault(home, set()).add(kind)
        within.setdefault(kind, set()).add(home)
        out.append((key, home, home == key and bool(take)))
    return pd.DataFrame(out, columns=["id", "canonical", "declined"])


ASSIGNED = "id long, canonical long, declined boolean"
#: Routes of large families that are assigned in a round; routes of a partition.
ROUND_ROWS, PART_ROWS = 50_000, 5_000


def _assigned_in_rounds(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``cluster_routes`` for families of any size, lot after lot in order: which clusters a lot's routes fit is found by joins.

    ``rows``: id, cls, family, lot; ``links``: x, y of kinds that fit, in both directions. Of a family, a
    task holds the routes of one lot, with what of it fits among themselves and the clusters that are open to them.
    """
    links = links.join(rows.select(F.col("cls").alias("x")).distinct(), "x", "left_semi").checkpoint()
    lots = sorted(r["lot"] for r in rows.select("lot").distinct().collect())  # one a ``ROUND_ROWS`` routes
    done, held = None, None  # (id, canonical, declined), (canonical, cls) of what is assigned
    for lot in lots:
        now = rows.filter(F.col("lot") == lot).select("id", "cls", "family")
        kinds = now.select("cls").distinct()
        mine = links.join(kinds.withColumnRenamed("cls", "x"), "x", "left_semi")
        near = mine.join(kinds.withColumnRenamed("cls", "y"), "y", "left_semi").groupBy(F.col("x").alias("cls")).agg(F.collect_list("y").alias("near"))
        asked = now.join(near, "cls", "left")
        if held is None:
            asked = asked.withColumn("open", F.lit(None).cast("array<bigint>"))
        else:
            met = mine.join(held.withColumnRenamed("cls", "y"), "y").groupBy("x", "canonical").agg(F.count("*").alias("met"))
            fit = met.join(held.groupBy("canonical").agg(F.count("*").alias("met")), ["canonical", "met"], "left_semi")
            asked = asked.join(fit.groupBy(F.col("x").alias("cls")).agg(F.collect_list("canonical").alias("open")), "cls", "left")
        new = asked.groupBy("family").applyInPandas(_assign, ASSIGNED).checkpoint()
        more = new.join(now, "id").select("canonical", "cls")
        done = new if done is None else done.unionByName(new)
        held = (more if held is None else held.unionByName(more)).distinct().checkpoint()
    return done


#: Most routes of a family that one task assigns; larger families are assigned in rounds.
FAMILY_ROWS = 5_000


def cluster_routes(routes: DataFrame, *, family_rows: int = FAMILY_ROWS, **rule) -> DataFrame:
    """route_key, canonical, declined: routes in order of sessions, length and key, each joining a cluster only if
    compatible with all its members and no other cluster would take it too.

    Routes go by numbers that ascend in that order. Routes of one set of places are one kind where only the set
    counts (jaccard), so their pairs are not made; else a route is a kind of its own. Only kinds linked by
    compatible pairs can meet, so each family of them is assigned on its own: a family of one kind is one
    cluster, others go in one task up to ``family_rows`` routes, and in rounds above.
    """
    ensure_checkpoint_dir(routes.sparkSession)
    routes = routes.select("route_key", "places", "n_sessions").checkpoint()
    n = routes.count()
    lots = max(1, -(-n // ROUND_ROWS))
    parts = max(lots, -(-n // PART_ROWS), routes.sparkSession.sparkContext.defaultParallelism)
    order = [F.desc("n_sessions"), F.size("places"), F.col("route_key")]
    dealt = routes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keys = dealt.select(F.monotonically_increasing_id().alias("id"), F.floor(F.spark_partition_id() * lots / parts).alias("lot"), "route_key", "places").checkpoint()
    sets = rule.get("rule") == "jaccard"
    if sets:
        kinds = keys.groupBy(F.array_sort(F.array_distinct("places")).alias("places")).agg(F.min("id").alias("cls")).checkpoint()
        rows = keys.select("id", "lot", F.array_sort(F.array_distinct("places")).alias("places")).join(kinds, "places").select("id", "lot", "cls")
    else:
        kinds, rows = keys.select(F.col("id").alias("cls"), "places"), keys.select("id", "lot", F.col("id").alias("cls"))
    pairs = compatible_pairs(kinds.select(F.col("cls").alias("route_key"), "places"), **rule).checkpoint()
    links = pairs.select(F.col("a_key").alias("x"), F.col("b_key").alias("y")).union(pairs.select("b_key", "a_key"))
    families = _families(links.select(F.col("x").alias("route_key")).distinct(), pairs).select(F.col("route_key").alias("cls"), "family")
    rows = rows.join(families, "cls", "left").withColumn("family", F.coalesce("family", "cls")).checkpoint()
    sizes = rows.groupBy("family").agg(F.count("*").alias("n"), (F.min("cls") == F.max("cls")).alias("one"), F.min("id").alias("first")).checkpoint()
    found = rows.join(sizes.filter("one"), "family").select("id", F.col("first").alias("canonical"), F.lit(False).alias("declined"))
    if sets:
        links = links.union(kinds.select(F.col("cls").alias("x"), F.col("cls").alias("y")))
    whole = rows.join(sizes.filter(~F.col("one") & (F.col("n") <= family_rows)), "family", "left_semi")
    near = links.join(whole.select(F.col("cls").alias("x")).distinct(), "x", "left_semi").groupBy(F.col("x").alias("cls")).agg(F.collect_list("y").alias("near"))
    small = whole.join(near, "cls", "left").select("id", "cls", "family", "near", F.lit(None).cast("array<bigint>").alias("open"))
    found = found.unionByName(small.groupBy("family").applyInPandas(_assign, ASSIGNED))
    large = sizes.filter(~F.col("one") & (F.col("n") > family_rows)).select("family")
    if not large.isEmpty():
        found = found.unionByName(_assigned_in_rounds(rows.join(large, "family", "left_semi"), links))
    names = keys.select(F.col("id").alias("canonical"), F.col("route_key").alias("name"))
    return found.join(keys.select("id", "route_key"), "id").join(names, "canonical").select("route_key", F.col("name").alias("canonical"), "declined")


def route_names(spans: DataFrame, summaries: DataFrame) -> DataFrame:
    """route_key, name, votes: each walk votes for the lowest summary that covers more than half of it; first seen wins a tie.

    ``spans``: route_key, session_id, t_start, t_end; ``summaries``: session_id, level, s_start, s_end, name.
    """
    cover = F.least("t_end", "s_end") - F.greatest("t_start", "s_start")
    met = spans.join(summaries, "session_id").filter(cover * 2 > F.col("t_end") - F.col("t_start"))
    vote = met.groupBy("route_key", "session_id").agg(F.min_by("name", F.struct("level", -cover, "name")).alias("name"))
    n = vote.groupBy("route_key", "name").agg(F.count("*").alias("votes"), F.min("session_id").alias("first"))
    return n.groupBy("route_key").agg(F.min_by(F.struct("name", "votes"), F.struct(-F.col("votes"), "first")).alias("b")).select("route_key", "b.name", "b.votes")


def flow_walks(walked: DataFrame) -> DataFrame:
    """route_key, path, length, sessions: the distinct edge paths of each route."""
    return walked.groupBy("route_key", F.array_join("edges", ",").alias("path")).agg(F.size(F.first("edges")).alias("length"), F.countDistinct("session_id").alias("sessions"))


def flow_steps(walked: DataFrame) -> DataFrame:
    """route_key, edge_id, observations, every_recording: how many of a route's sessions take each edge."""
    total = walked.groupBy("route_key").agg(F.countDistinct("session_id").alias("n"))
    seen = walked.select("route_key", "session_id", F.explode(F.array_distinct("edges")).alias("edge_id")).groupBy("route_key", "edge_id").agg(F.countDistinct("session_id").alias("observations"))
    return seen.join(total, "route_key").select("route_key", "edge_id", "observations", (F.col("observations") == F.col("n")).alias("every_recording"))


def ways(walked: DataFrame) -> DataFrame:
    """route_key, lengths: distinct path lengths, longest first."""
    return walked.groupBy("route_key").agg(F.sort_array(F.collect_set(F.size("edges")), asc=False).alias("lengths"))


def bind_habits(habits: DataFrame, routes: DataFrame) -> DataFrame:
    """habit_id, state, bound_key, lost, gained: a habit's route by key, else the only route with over half its sessions.

    ``habits``: habit_id, route_key, sessions; ``routes``: route_key, sessions. Several such routes are
    ambiguous, none leaves the habit orphaned.
    """
    exact = habits.join(routes.select("route_key", F.col("sessions").alias("live")), "route_key").select("habit_id", F.lit("exact").alias("state"), F.col("route_key").alias("bound_key"), "sessions", "live")
    other = habits.join(exact.select("habit_id"), "habit_id", "left_anti")
    shared = other.select("habit_id", F.explode("sessions").alias("s")).join(routes.select(F.col("route_key").alias("r"), F.explode("sessions").alias("s")), "s").groupBy("habit_id", "r").agg(F.count("*").alias("overlap"))
    good = shared.join(other.select("habit_id", F.size("sessions").alias("n")), "habit_id").filter("overlap * 2 > n").groupBy("habit_id").agg(F.count("*").alias("c"), F.min("r").alias("r"))
    rest = other.join(good, "habit_id", "left").join(routes.select(F.col("route_key").alias("r"), F.col("sessions").alias("live")), "r", "left")
    one = F.col("c") == 1
    rest = rest.select("habit_id", F.when(F.col("c").isNull(), "orphaned").when(one, "rebound").otherwise("ambiguous").alias("state"), F.when(one, F.col("r")).alias("bound_key"), "sessions", F.when(one, F.col("live")).alias("live"))
    every = exact.unionByName(rest)
    none = F.array().cast("array<string>")
    return every.select("habit_id", "state", "bound_key", F.when(F.col("live").isNull(), F.size("sessions")).otherwise(F.size(F.array_except("sessions", F.coalesce("live", none)))).alias("lost"), F.coalesce(F.size(F.array_except("live", "sessions")), F.lit(0)).alias("gained"))


def habit_conflicts(bound: DataFrame, routes: DataFrame) -> DataFrame:
    """route_key, issue: routes that several habits claim, and those that none does."""
    claims = bound.filter("bound_key is not null").groupBy(F.col("bound_key").alias("route_key")).agg(F.count("*").alias("n"))
    return claims.filter("n > 1").select("route_key", F.lit("duplicate").alias("issue")).unionByName(routes.select("route_key").join(claims, "route_key", "left_anti").select("route_key", F.lit("unclaimed").alias("issue")))


def route_facts(walked: DataFrame, names: DataFrame, pairs: DataFrame, targets: DataFrame, unlocatable: DataFrame) -> DataFrame:
    """What ``cautions`` reads of each route, from its walks.

    ``walked``: as ``walks``; ``names``: session_id, name that its recording was given; ``pairs``: a_key,
    b_key of routes that were folded; ``targets``: edge_id, has_ax; ``unlocatable``: place.
    """
    known = walked.select("route_key", "session_id", "places", "edges")
    base = known.groupBy("route_key").agg(F.countDistinct("session_id").alias("n_sessions"), F.countDistinct(F.size("edges")).alias("n_ways"), F.first("places").alias("places"))
    named = known.join(names, "session_id").groupBy("route_key").agg(F.countDistinct("name").alias("n_names"))
    folded = pairs.select(F.col("a_key").alias("route_key")).unionByName(pairs.select(F.col("b_key").alias("route_key"))).groupBy("route_key").agg(F.count("*").alias("n_folded"))
    each = known.select("route_key", "session_id", F.explode(F.array_distinct("edges")).alias("edge_id")).groupBy("route_key", "edge_id").agg(F.countDistinct("session_id").alias("n"))
    steps = each.join(base.select("route_key", "n_sessions"), "route_key").join(targets, "edge_id", "left").groupBy("route_key").agg(F.count_if(F.col("n") < F.col("n_sessions")).alias("partial_steps"), F.avg((~F.coalesce("has_ax", F.lit(False))).cast("double")).alias("coordinate_share"))
    lost = base.select("route_key", F.explode(F.array_distinct("places")).alias("place")).join(unlocatable, "place", "left_semi").groupBy("route_key").agg(F.count("*").alias("unlocatable"))
    out = base.drop("places")
    for more in (named, folded, steps, lost):
        out = out.join(more, "route_key", "left")
    return out.fillna(0)


def cautions(routes: DataFrame) -> DataFrame:
    """route_key, caution: one row for each reason to doubt a route.

    ``routes``: route_key, n_sessions, n_names, n_folded, n_ways, partial_steps, coordinate_share, unlocatable.
    """
    said = F.array(
        F.when(F.col("n_sessions") == 1, "seen once"), F.when(F.col("n_names") > 1, "names disagree"), F.when(F.col("n_folded") > 0, "variants folded"),
        F.when(F.col("n_ways") > 1, "several ways"), F.when(F.col("partial_steps") > 0, "steps not in every recording"),
        F.when(F.col("coordinate_share") > 0.5, "mostly coordinates"), F.when(F.col("unlocatable") > 0, "states that cannot be located"),
    )
    return routes.select("route_key", F.explode(F.filter(said, lambda c: c.isNotNull())).alias("caution"))


def edge_costs(edges: DataFrame) -> DataFrame:
    """edges with cost 1 / (1 + observations * success rate), half for edges never tried."""
    rate = F.when(F.col("attempts") > 0, F.col("successes") / F.col("attempts")).otherwise(0.5)
    return edges.withColumn("cost", 1 / (1 + F.col("observations") * rate))


def cheapest(edges: DataFrame, sources: DataFrame, rounds: int = 100) -> DataFrame:
    """source, node, cost: cheapest way from each source to every node it reaches, relaxed until nothing improves."""
    ensure_checkpoint_dir(edges.sparkSession)
    hops = edges.filter("from_node <> to_node").groupBy("from_node", "to_node").agg(F.min("cost").alias("step")).checkpoint()
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    for _ in range(rounds):
        farther = best.join(hops, F.col("node") == F.col("from_node")).select("source", F.col("to_node").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))
        new = best.unionByName(farther).groupBy("source", "node").agg(F.min("cost").alias("cost")).checkpoint()
        if new.join(best, ["source", "node", "cost"], "left_anti").isEmpty():
            return new
        best = new
    raise ValueError(f"costs did not settle in {rounds} rounds")


def brittleness(targets: DataFrame, least: float = 0.5) -> DataFrame:
    """edge_id, share, brittle: share of an edge's targets (edge_id, has_ax) that are described, and whether it is low."""
    g = targets.groupBy("edge_id").agg(F.avg(F.col("has_ax").cast("double")).alias("share"))
    return g.withColumn("brittle", F.col("share") < least)
