"""Periodic runs of words: stretches that repeat a shorter one, and texts with the repeats taken out.

A run's Lyndon root starts at a place whose longest Lyndon word, under one order of the words or its
inverse, has the run's period. Both Lyndon arrays come from the first phase of a grouping suffix sorter:
suffixes are grouped by their first word, groups are taken from the highest to the lowest, and each
suffix to whose left the group's context can be appended moves to a new group. When no group is left a
suffix's context is its longest Lyndon prefix; no suffix array is made. Roots are then extended by the
longest common extensions to both sides.

Only stretches in which every eight words occur again near by can hold a run that is long enough, so only
these are sorted: a run of length >= max(24, 3 * period) has each of its eight-word strings twice, and
so does whatever would extend it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import by_size, free_name, give_back, small_batches

LEAST, TIMES, GRAM = 24, 3, 8
CHUNK = 1 << 20


def lyndon(w: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, a prefix being less than what it starts."""
    n = len(w)
    symbols = sorted(set(w))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in w]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length, down, up = [1] * len(symbols), list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    # left[i + 1]: nearest place at or before i whose suffix is in a group still to come, plus one
    left = list(range(n + 1))
    now = len(symbols) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = []
        for i in own:
            left[i + 1] = i
        times: dict[int, int] = {}
        for i in own:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i + 1] = j
            if j:
                times[j - 1] = times.get(j - 1, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((k, group[j]), []).append(j)
        for (k, old), places in sorted(moved.items(), key=lambda x: -x[0][0]):
            new = len(length)
            length.append(length[old] + k * length[now])
            members.append(places)
            # directly above the old group
            up.append(up[old])
            down.append(old)
            down[up[old]] = new  # the group now taken is above it, if no other
            up[old] = new
            for j in places:
                group[j] = new
        now = down[now]
    return [length[g] for g in group]


def _same(w: list[int], i: int, j: int) -> int:
    """How many words from i on equal those from j on, i < j."""
    n, k, step = len(w), 0, 8
    while j + k + step <= n and w[i + k : i + k + step] == w[j + k : j + k + step]:
        k, step = k + step, step * 2
    while step:
        if j + k + step <= n and w[i + k : i + k + step] == w[j + k : j + k + step]:
            k += step
        step //= 2
    return k


def runs(w: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``w`` whose length is at least ``least`` and ``times`` periods, sorted."""
    n = len(w)
    if n < 2:
        return []
    found: set[tuple[int, int, int]] = set()
    back = w[::-1]
    at = np.asarray(w)
    for order in (w, [-x for x in w]):
        roots = np.asarray(lyndon(order))
        i = np.arange(n)
        end = np.minimum(i + roots, n - 1)
        some = np.flatnonzero((i + roots < n) & (roots * times <= n) & (at == at[end]))
        last: dict[int, int] = {}
        for i, p in zip(some.tolist(), roots[some].tolist()):
            if i + p < last.get(p, 0):  # in the run found before
                continue
            after = _same(w, i, i + p)
            before = _same(back, n - i - p, n - i)
            last[p] = i + p + after
            length = before + p + after
            if length >= max(least, times * p, 2 * p):
                found.add((i - before, length, p))
    return sorted(found)


def stretches(words: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches of ``words`` that may hold runs; ``owner`` is the number of each word's text, ascending.

    Eight words are compared by a hash, so a stretch may hold none; no run is outside.
    """
    n = len(words) - GRAM + 1
    if n < 1 or least < 3 * GRAM or times < 3:
        whole = np.flatnonzero(np.diff(owner, prepend=-1))
        return list(zip(whole.tolist(), [*whole[1:].tolist(), len(words)]))
    # over words of other texts a hash holds both owners' words, and is left out below
    h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xA0761D6478BD642F) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    h = h + owner[:n].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    places = np.flatnonzero(owner[:n] == owner[GRAM - 1 :])
    near = np.full(n, n, np.int64)
    order = places[np.argsort(h[places], kind="stable")]
    alike = h[order[1:]] == h[order[:-1]]
    apart = np.where(alike, order[1:] - order[:-1], n)
    near[order[1:]] = apart
    near[order[:-1]] = np.minimum(near[order[:-1]], apart)
    while True:
        marked = near < n
        edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return []
        # a period is at most a third of its run, and the run lies in one stretch
        size = ends - starts + GRAM - 1
        bound = np.where(size >= least, size // times, 0)
        limit = np.zeros(n, np.int64)
        limit[marked] = np.repeat(bound, ends - starts)
        far = marked & (near > limit)
        if not far.any():
            return [(s, e + GRAM - 1) for s, e in zip(starts.tolist(), ends.tolist())]
        near[far] = n


class Words:
    """Texts of one slice as numbers of words, equal words having equal numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def read(self, text: bytes) -> array:
        """Words are cut at ASCII space and tab to carriage return, which is what ``bytes.split`` does."""
        said, at = array("i"), 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            if end < len(text):  # up to the end of the word
                rest = re.compile(rb"[ \t-\r]").search(text, end)
                end = rest.start() if rest else len(text)
            some = text[at:end].split()
            for x in set(some) - self.numbers.keys():
                self.numbers[x] = len(self.words)
                self.words.append(x)
            said.extend(map(self.numbers.__getitem__, some))
            at = end
        return said

    def join(self, numbers) -> bytes:
        return b" ".join(map(self.words.__getitem__, numbers))


def planted(key: str | None, words: array) -> array:
    """A tenth of the texts, by crc32 of the decimal key, with a tail that repeats itself."""
    n = len(words)
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


OUT = pa.schema([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _texts(least: int, times: int, plant: bool):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                yield work(part)
        give_back()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        book = Words()
        said = [book.read((x or "").encode()) for x in part.column(1).to_pylist()]
        if plant:
            said = [planted(None if k is None else str(k), x) for k, x in zip(part.column(0).to_pylist(), said)]
        sizes = np.asarray([len(x) for x in said])
        first = np.concatenate(([0], np.cumsum(sizes)))
        every = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x, np.int32) for x in said if len(x)]])
        of = np.repeat(np.arange(len(said)), sizes)
        found: list[list[tuple[int, int, int]]] = [[] for _ in said]
        for text, some in groupby(stretches(every, of, least, times), key=lambda x: int(of[x[0]])):
            for start, end in some:
                found[text] += [(start - int(first[text]) + s, n, p) for s, n, p in runs(every[start:end].tolist(), least, times)]
        collapsed = []
        for numbers, its in zip(said, found):
            if its:
                kept = np.ones(len(numbers), bool)
                for s, n, p in its:
                    kept[s + p : s + n] = False
                numbers = np.frombuffer(numbers, np.int32)[kept].tolist()
            collapsed.append(book.join(numbers).decode())
        its = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(x, key=lambda r: (r[0], r[2]))] for x in found]
        return pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(its, OUT[0].type), pa.array(collapsed, pa.string())], [*[f.name for i, f in enumerate(part.schema) if i != 1], *OUT.names])

    return slices


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, plant: bool = False) -> DataFrame:
    """key, runs (start, length, period by words; by start, then period) and the text without repeats, a row for each row.

    A run is a stretch with smallest period p and length >= max(least, times * p) that no word beside it
    extends; all its words after the first p go from ``collapsed``, whose words are joined by one space.
    A null text has no words, like an empty one. Rows are worked on where they lie, in slices of about 1 MB
    of text; a longer text comes alone and takes some ten numbers a word of its repeating stretches. Repeated
    rows and keys give a row each, other columns are not looked at. ``plant`` repeats the tail of a tenth of
    the texts first (for queries and tests). ``times`` below 2 finds nothing that ``times`` = 2 does not.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_texts(least, times, plant), schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number of runs, the run of the greatest length / period, and digests of all runs and of the collapsed text."""
    name = free_name(found)
    # compared exactly, as products; ties go to the smaller start, then period, which is the order of the array
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn(name, best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"{name}.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr(f"1000 * `{name}`.length div `{name}`.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
