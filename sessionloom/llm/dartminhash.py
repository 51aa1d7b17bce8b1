"""Near duplicates by DartMinHash signatures of word shingles.

A document is a weighted set: each run of five words, weighted by how often it occurs. Every unit of
an element's weight, times every unit of time, is a region into which a hashed number of darts
(Poisson, mean one) falls; each dart has a hashed place in its region and a hashed coordinate. The
darts of a document are those within its elements' weights and before a time that makes their number
about k ln k. Of those that hit a coordinate the earliest is kept: two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Signatures are cut into bands;
documents that agree in a band are compared exactly.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import by_size, give_back, stored
from sessionloom.llm.graph import components

WORDS, BANDS, ROWS = 5, 32, 6
#: Most ids that are sent to every executor to pick out texts; above, ids and texts are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Parts into which the texts of a bucket are dealt, so that one bucket is not one task's.
SALTS = 16
#: Bytes of texts that are signed together; a longer text is signed alone.
SIGNED_BYTES = 1 << 19
_WORD = re.compile(r"\w+")
_CACHE: dict[str, int] = {}
_CACHE_ROWS = 100_000

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word (run of letters, digits, underscores; lower case) in order."""
    words = _WORD.findall(text.lower()) if text else []
    if len(_CACHE) > _CACHE_ROWS:
        _CACHE.clear()
    for w in set(words):
        if w not in _CACHE:
            _CACHE[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted hashes) and how often each occurs; a text of fewer words is one shingle."""
    n = min(words, len(hashes))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        x = x * _D + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(_mix(x + np.uint64(n * int(_A) % 2**64)), return_counts=True)


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int, seed: int = 1) -> np.ndarray:
    """One row of k dart hashes per weighted set (none may be empty). Weights may be any positive numbers."""
    out = np.zeros((len(elements), k), np.uint64)
    todo, darts = np.arange(len(elements)), k * (math.log(k) + 3)
    while len(todo):
        until = np.array([darts / weights[i].sum() for i in todo])
        row, key, cell, weight = [], [], [], []
        for r, i in enumerate(todo):
            units = np.ceil(weights[i]).astype(np.int64)
            row.append(np.full(units.sum(), r))
            key.append(np.repeat(elements[i], units))
            cell.append(np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units))
            weight.append(np.repeat(weights[i], units))
        row, key, cell, weight = map(np.concatenate, (row, key, cell, weight))
        key = _mix(key + cell.astype(np.uint64) * _D + np.uint64(seed * int(_C) % 2**64))
        # regions: every unit of weight, at every unit of time up to the document's end
        spans = np.ceil(until[row]).astype(np.int64)
        at = np.repeat(np.arange(len(row)), spans)
        time = np.arange(len(at)) - np.repeat(np.cumsum(spans) - spans, spans)
        region = _mix(key[at] + (time.astype(np.uint64) + np.uint64(1)) * _A)
        number = np.searchsorted(_POISSON, _unit(region), "right")
        thrown = np.repeat(np.arange(len(at)), number)
        nth = np.arange(len(thrown)) - np.repeat(np.cumsum(number) - number, number)
        dart = _mix(region[thrown] + (nth.astype(np.uint64) + np.uint64(1)) * _B)
        when = time[thrown] + _unit(_mix(dart + _A))
        unit = at[thrown]
        hit = (when < until[row[unit]]) & (cell[unit] + _unit(_mix(dart + _D)) < weight[unit])
        dart, when, unit = dart[hit], when[hit], unit[hit]
        slot = row[unit] * k + (_mix(dart + _C) % np.uint64(k)).astype(np.int64)
        first = np.full(len(todo) * k, np.inf)
        np.minimum.at(first, slot, when)
        won = when == first[slot]
        found = np.zeros(len(todo) * k, np.uint64)
        found[slot[won]] = dart[won]
        full = np.isfinite(first).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = found.reshape(len(todo), k)[full]
        todo, darts = todo[~full], 2 * darts  # a coordinate that no dart hit yet: throw longer
    return out


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        x = _mix(x * _D + parts[:, :, i])
    return _mix(x + np.arange(bands, dtype=np.uint64) * _A).astype(np.int64)


def sign(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, same (equal for texts of equal words; null without words), number of shingles and band keys of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, SIGNED_BYTES, 64):
                hashes = [word_hashes(t) for t in part.column(1).to_pylist()]
                some = [i for i, h in enumerate(hashes) if len(h)]
                sets = [shingles(hashes[i], words) for i in some]
                keys = _band_keys(signatures([e for e, _ in sets], [n.astype(np.float64) for _, n in sets], bands * rows), bands, rows) if some else np.empty((0, bands), np.int64)
                counts = np.zeros(len(hashes), np.int64)
                counts[some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys.reshape(-1)))
                same = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in hashes]
                total = [max(0, len(h) - words + 1) or 1 for h in hashes]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(total, pa.int32()), lists], ["doc_id", "same", "total", "bands"])
        _CACHE.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, same binary, total int, bands array<long>")


def _dealt(texts: DataFrame, by: DataFrame, how: str = "inner") -> DataFrame:
    """``texts`` (key, rep, ...) joined to ``by`` (one row a key).

    The texts of a bucket are dealt to ``SALTS`` parts by their hash and each part meets its own copy
    of the bucket's row, so a bucket that holds a third of all texts is not one task's.
    """
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(SALTS)).cast("int"))
    copies = by.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["key", "salt"], how).drop("salt")


def _similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two shingle sets: sum of the lesser counts by sum of the greater."""
    (ha, na), (hb, nb) = ((np.frombuffer(x[: len(x) * 2 // 3], np.uint64), np.frombuffer(x[len(x) * 2 // 3 :], np.uint32).astype(np.int64)) for x in (a, b))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    least = int(np.minimum(na[ia], nb[ib]).sum())
    return least / (int(na.sum()) + int(nb.sum()) - least)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and shingle set of the rows named in ``ids``, one row an id."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1):
                sets = [shingles(word_hashes(t), words) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.tobytes() + n.astype(np.uint32).tobytes() for h, n in sets], pa.binary())], ["doc_id", "shingles"])
        _CACHE.clear()
        give_back()

    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    found = docs.select("doc_id", "text").join(near, "doc_id", "left_semi").mapInArrow(task, f"doc_id {kind}, shingles binary")
    return found.dropDuplicates(["doc_id"])


def verify(docs: DataFrame, pairs: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole texts have at least that similarity."""
    pairs = stored(pairs)
    sets = stored(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), words))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    kinds = [pairs.schema[c].dataType.simpleString() for c in ("a", "b")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_similarity(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])
        give_back()

    return stored(both.select("a", "b", "sa", "sb").mapInArrow(task, f"a {kinds[0]}, b {kinds[1]}, similarity double").filter(F.col("similarity") >= threshold))


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """One row a block: ids, classes and units (shingle and count) of its texts."""
    units = []
    for x in frame["shingles"]:
        h, n = np.frombuffer(x[: len(x) * 2 // 3], np.uint64), np.frombuffer(x[len(x) * 2 // 3 :], np.uint32).astype(np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        units.append(_mix(np.repeat(h, n) + nth.astype(np.uint64) * _D))
    give_back()
    data = pickle.dumps((frame["rep"].to_numpy(np.int64), frame["c"].to_numpy(np.int64), np.array([len(u) for u in units]), np.concatenate(units)), protocol=5)
    return pd.DataFrame({"home": frame["home"].iloc[:1], "part": frame["part"].iloc[:1], "low": [frame["c"].min()], "high": [frame["c"].max()], "texts": [data]})


def _across(a: bytes, b: bytes, threshold: float) -> list[tuple[int, int]]:
    """Links that join classes between the texts of two blocks: a forest, not all pairs."""
    (ia, ca, na, ua), (ib, cb, nb, ub) = pickle.loads(a), pickle.loads(b)
    common = np.intersect1d(ua, ub)
    least = np.zeros((len(ia), len(ib)), np.float32)

    def table(units: np.ndarray, lengths: np.ndarray, some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(some, units).clip(0, len(some) - 1)
        hit = some[at] == units
        out = np.zeros((len(lengths), len(some)), np.float32)
        out[np.repeat(np.arange(len(lengths)), lengths)[hit], at[hit]] = 1
        return out

    for start in range(0, len(common), 8192):
        some = common[start : start + 8192]
        least += table(ua, na, some) @ table(ub, nb, some).T
    shared = least.astype(np.float64)
    linked = (shared >= threshold * (na[:, None] + nb[None, :] - shared)) & (ca[:, None] != cb[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(ca[i])), root(int(cb[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(ia[i]), int(ib[j])))
    return out


def _links_across(docs: DataFrame, members: DataFrame, threshold: float, words: int, block: int = 128) -> DataFrame:
    """Links between texts of different classes that share a bucket (``members``: key, rep, c).

    Texts live in blocks of at most about ``block``: those of one bucket, the largest that they are
    in, together. Blocks that meet in any bucket are compared whole within a task; what moves is a
    block of texts for each pair of blocks, not a row for each pair of texts.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    homes = _dealt(members, sizes).groupBy("rep").agg(F.max_by("key", F.struct("size", "key")).alias("home"), F.first("c").alias("c"))
    homes = stored(homes)
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = stored(homes.join(parts, "home").select("rep", "c", "home", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")))
    sets = _sets(docs, placed.select(F.col("rep").alias("doc_id")), words).withColumnRenamed("doc_id", "rep")
    blocks = stored(placed.join(sets, "rep").groupBy("home", "part").applyInPandas(_pack, "home long, part int, low long, high long, texts binary"))
    place = F.struct("home", "part")
    there = stored(members.join(placed.select("rep", "home", "part"), "rep").select("key", place.alias("p")).distinct())
    met = there.alias("x").join(there.alias("y"), F.expr("x.key = y.key AND x.p <= y.p")).select(F.col("x.p").alias("p"), F.col("y.p").alias("q")).distinct()
    of = lambda name: blocks.select(place.alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "texts")))
    both = met.join(of("p"), "p").join(of("q"), "q")
    # two blocks of one and the same class have nothing to join
    both = both.filter((F.col("p_low") != F.col("p_high")) | (F.col("q_low") != F.col("q_high")) | (F.col("p_low") != F.col("q_low")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for x, y in zip(batch.column(0), batch.column(1), strict=True) for link in _across(x.as_py(), y.as_py(), threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)], ["a", "b"])
        give_back()

    return stored(both.select("p_texts", "q_texts").mapInArrow(task, "a long, b long"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, class_id for every row: classes are chains of texts with that similarity or more.

    ``docs``: doc_id, text; other columns are ignored. ``class_id`` is the smallest doc_id of a class.
    Texts of equal words are one class and one text in what follows. In every bucket of a band each
    text is compared with the bucket's hub, that which meets most texts over all its buckets; texts
    of a bucket that are still in different classes are then all compared, block by block: no bucket
    is capped, and none gives a row for each of its pairs. With 32 bands of 6 a pair of similarity 0.8 is
    found with probability 0.9999 by its own buckets, and more in a group. A text without words (null,
    empty, punctuation) is a class of its own; rows repeated with one id share its class; an id stands
    for one text (of several under one id any is taken), and ids are whole numbers; a row without id
    gets no class.
    """
    source = docs.select("doc_id", "text")
    signed = stored(sign(source, bands=bands, rows=rows, words=words))
    texts = stored(signed.filter("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("total").alias("total"), F.first("bands").alias("bands")))
    keys = texts.select(F.explode("bands").alias("key"), "rep", "total")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(_dealt(keys, shared))
    # the text that shares buckets with most others is the likeliest centre of a group
    centrality = buckets.groupBy("rep").agg(F.sum("size").alias("met"))
    central = stored(buckets.select("key", "rep", "total").join(centrality, "rep"))
    hubs = central.groupBy("key").agg(F.max_by(F.struct("rep", "total"), F.struct("met", -F.col("rep"))).alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.total").alias("hub_total"))
    buckets = stored(_dealt(central.drop("met"), hubs))
    alike = lambda m, n: F.least(m, n) >= F.lit(threshold) * F.greatest(m, n)  # noqa: E731  else the lengths alone rule a link out
    first = buckets.filter("rep <> hub").filter(alike("total", "hub_total")).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    links = verify(source, first, threshold, words)
    found = stored(components(links.select("a", "b")))
    # what the hubs did not bring together
    members = buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "hub", "rep", "total", F.coalesce("component", "rep").alias("c"))
    split = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    members = stored(_dealt(members, split, "left_semi"))
    more = _links_across(source, members, threshold, words)
    if not more.isEmpty():
        found = stored(components(links.select("a", "b").union(more.select("a", "b"))))
    classes = texts.select("same", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    # texts without words have no class to find: each gets a key of its own, so that they don't meet in one task
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")).cast("binary")
    joined = signed.select("doc_id", F.coalesce("same", alone).alias("same")).join(stored(classes), "same", "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
