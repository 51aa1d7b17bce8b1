"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms of shards.

A byte goes where a string of ``LENGTH`` bytes around it also starts in a document with a smaller id.

1. Texts are dealt to blocks of some MB. Every string of ``LENGTH`` bytes has an anchor, the least hash of
   the ``SEED``-byte strings in it; a block sends each anchor once, with the number of its documents that
   have it, and learns which anchors two documents or more have. Equal strings have equal anchors.
2. A stretch of strings with one such anchor is a piece. A block sends each of its pieces once, with the
   smallest id that has it, so a piece that is everywhere comes once a block. An anchor in very many
   documents is split: each of its strings is a piece of its own, which goes by itself and not by the anchor.
3. Pieces meet by anchor. Where an anchor has equal pieces only, they are each other's repeats. Shards of
   the others are suffix-sorted once, each with its transform, and the shards' transforms are merged:
   suffixes start in the interleave of their first bytes, and each round takes one byte more into account
   by walking the interleave in order and sending each suffix's predecessor (the transform's own step
   back) to the next place of its range. A range that has suffixes of one shard only is settled, since the
   shard knows their order and common prefixes; no suffix is sorted again. Ranges left at ``LENGTH`` bytes
   are the repeated intervals that shards share, and each takes the smallest id in it; those within a
   shard follow from the shard's common prefixes.
4. The answer goes back to the blocks that asked, where spans are joined and cut.

The texts' exchange is used three times and written once. What a key gathers is one entry a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import give_back, small_batches

LENGTH, SEED = 50, 20
#: A block has at most so many bytes (or one text); small tables have FEWEST blocks.
BLOCK, FEWEST, BUFFER = 4 << 20, 64, 1 << 18
#: A hash's bytes that are sent; its part follows from the others, so parts of millions of anchors hardly confuse two, and confused ones only cost time.
SENT = 5
#: An anchor of so many documents is split by its strings.
HOT = 100_000
#: Bytes of pieces merged at once (more if one anchor has more), and of a shard.
UNIT, SHARD = 1 << 20, 1 << 17
LAST = (1 << 63) - 1  # a row without an id

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BYTES = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of ``size`` bytes: of powers of two, put together."""
    h, have, done, out = _BYTES[data], 1, 0, None
    n = len(data) - size + 1
    while True:
        if size & have:
            part = h[done : done + n]
            out = part.copy() if out is None else out * _B + part
            done += have
        if have * 2 > size:
            break
        h = h[:-have] * _A + h[have:]
        h ^= h >> np.uint64(29)
        have *= 2
    out *= _D
    out ^= out >> np.uint64(32)
    out *= _C
    out ^= out >> np.uint64(29)
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n, have = len(h) - width + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:n], h[width - have : width - have + n])


def _buffers(texts: list[bytes]):
    """(first places, texts' numbers, offsets in the text, bytes) of buffers; long texts come in parts that share LENGTH - 1 bytes."""
    at, of, offset, parts, held = [], [], [], [], 0
    for i, text in enumerate(texts):
        for start in range(0, len(text) - LENGTH + 1, BUFFER):
            part = text[start : start + BUFFER + LENGTH - 1]
            at.append(held)
            of.append(i)
            offset.append(start)
            parts.append(part)
            held += len(part)
            if held >= BUFFER:
                yield at, of, offset, parts
                at, of, offset, parts, held = [], [], [], [], 0
    if parts:
        yield at, of, offset, parts


def anchors(texts: list[bytes], seed: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start, strings) of the stretches of strings of LENGTH bytes that have one anchor."""
    seed = seed or SEED
    found: list[tuple[np.ndarray, ...]] = []
    for at, of, offset, parts in _buffers(texts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        least = _least(_seed_hashes(data, seed), LENGTH - seed + 1)
        # strings that start in the last LENGTH - 1 bytes of a part reach into the next one
        sizes = np.asarray([len(p) for p in parts])
        at = np.asarray(at)
        new = np.empty(len(least) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[at] = True
        stop = at + sizes - LENGTH + 1
        new[stop[stop < len(least)]] = True
        edges = np.flatnonzero(new)
        part = np.searchsorted(at, edges[:-1], "right") - 1
        valid = edges[:-1] < stop[part]
        first, part = edges[:-1][valid], part[valid]
        found.append((least[first], np.asarray(of, np.int32)[part], (first - at[part] + np.asarray(offset, np.int64)[part]), np.diff(edges)[valid].astype(np.int32)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*found))


def _distinct(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the number of texts of each, and for each row of ``values`` its place among them."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], of[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    other = new.copy()
    other[1:] |= o[1:] != o[:-1]
    group = np.cumsum(new) - 1
    place = np.empty(len(v), np.int64)
    place[order] = group
    return v[new], np.bincount(group[other], minlength=int(new.sum())), place


def _part(values: np.ndarray, parts: int) -> np.ndarray:
    """The part of each value, by its upper bits, so ascending with the value."""
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(values: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that sorted ``values`` have."""
    own = _part(values, parts)
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1 if len(own) else -1))
    edges = np.append(edges[edges < len(own)], len(own))
    return [(int(own[a]), a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _texts(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and texts of a block, always in the same order."""
    ids = table["id"].to_pylist()
    texts = [x or b"" for x in table["data"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _binary(rows: list) -> pa.Array:
    return pa.array([None if x is None else x.tobytes() for x in rows], pa.binary())


def _ask(parts: int):
    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        values, of, _, _ = anchors(_texts(table)[1])
        values, n, _ = _distinct(values, of)
        cuts = _cuts(values, parts)
        sent = values.view(np.uint8).reshape(-1, 8)[:, :SENT]
        n = np.minimum(n, 65_535).astype(np.uint16)
        give_back()
        return pa.table({
            "part": pa.array([p for p, _, _ in cuts], pa.int64()), "block": pa.array([block] * len(cuts), pa.int64()),
            "hashes": _binary([sent[a:b] for _, a, b in cuts]), "n": _binary([n[a:b] for _, a, b in cuts]),
        })

    return ask


def _answer(hot: int):
    """For each block of a part: 0 for an anchor of one document, 1 of more, 2 of very many."""

    def answer(table: pa.Table) -> pa.Table:
        sent = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint8).reshape(-1, SENT)
        every = np.zeros((len(sent), 8), np.uint8)
        every[:, :SENT] = sent
        every = every.view(np.uint64).ravel()
        n = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint16)
        order = np.argsort(every)
        new = np.ones(len(every), bool)
        new[1:] = np.diff(every[order]) != 0
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        said = np.empty(len(every), np.uint8)
        said[order] = ((total > 1).astype(np.uint8) + (total >= max(2, hot)).astype(np.uint8))[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) // SENT for x in table["hashes"].to_pylist()])
        flags = np.split(said, ends[:-1])
        some = [bool(f.any()) for f in flags]
        give_back()
        return pa.table({"block": table["block"], "part": table["part"], "flags": _binary(flags)}).filter(pa.array(some, pa.bool_()))

    return answer


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays and bytes as one compressed value: pieces overlap and ids repeat, which the shuffle's own codec hardly uses."""
    said = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    return zstandard.ZstdCompressor(level=1).compress(np.asarray([len(x) for x in said], np.int64).tobytes() + b"".join(said))


def _unpack(value: bytes, *kinds: type) -> list:
    """What ``_pack`` took; None as a kind for bytes."""
    data = zstandard.ZstdDecompressor().decompress(value)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds):
        out.append(data[at : at + size] if kind is None else np.frombuffer(data[at : at + size], kind))
        at += size
    return out


PLACE = 40  # a place is a text's number in its block, above so many bits of the offset
PIECES = "bucket long, block long, asked binary"
#: Anchors, sizes, texts, least and greatest ids of pieces, their numbers of places, and the places.
ASKED = (np.uint64, np.int32, None, np.int64, np.int64, np.int32, np.int64)
#: Places of whole pieces with their sizes and smallest ids, and places of spans with their starts and ends in the piece.
TOLD = (np.int64,) * 6


def _own(piece: bytes) -> int:
    """What a string of a split anchor goes by instead of it, so that strings of one anchor lie in many buckets."""
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little")


def _pieces(parts: int, buckets: int):
    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[bytes, list[int]] = {}
        own: list[int] = []
        ids, block = [], 0
        if len(left) and len(right):
            block = left["block"][0].as_py()
            ids, texts = _texts(left)
            values, of, start, n = anchors(texts)
            distinct, _, place = _distinct(values, of)
            cuts = {p: (a, b) for p, a, b in _cuts(distinct, parts)}
            flags = np.zeros(len(distinct), np.uint8)
            for p, f in zip(right["part"].to_pylist(), right["flags"].to_pylist()):
                flags[slice(*cuts[p])] = np.frombuffer(f, np.uint8)
            flags = flags[place]
            some = np.flatnonzero(flags)
            some = some[np.argsort(values[some], kind="stable")]  # by bucket
            for v, i, s, k, flag in zip(values[some].tolist(), of[some].tolist(), start[some].tolist(), n[some].tolist(), flags[some].tolist()):
                text = texts[i]
                for a in (s,) if flag == 1 else range(s, s + k):
                    piece = text[a : (s + k if flag == 1 else a + 1) + LENGTH - 1]
                    had = found.get(piece)
                    if had is None:
                        found[piece] = [i << PLACE | a]
                        own.append(v if flag == 1 else _own(piece))
                    else:
                        had.append(i << PLACE | a)
        by = np.argsort(np.asarray(own, np.uint64), kind="stable").tolist()  # split pieces have buckets of their own
        texts, held, own = list(found), list(found.values()), [own[i] for i in by]
        texts, held = [texts[i] for i in by], [held[i] for i in by]
        places = np.asarray([x for its in held for x in its], np.int64)
        counts = np.asarray([len(x) for x in held], np.int32)
        at = np.concatenate(([0], np.cumsum(counts)))
        of_place = np.asarray(ids, np.int64)[places >> PLACE]
        least, most = (f.reduceat(of_place, at[:-1]) if len(at) > 1 else of_place for f in (np.minimum, np.maximum))
        values = np.asarray(own, np.uint64)
        cuts = _cuts(values, buckets)
        size = np.asarray([len(x) for x in texts], np.int32)
        rows = [_pack(values[a:b], size[a:b], b"".join(texts[a:b]), least[a:b], most[a:b], counts[a:b], places[at[a] : at[b]]) for _, a, b in cuts]
        give_back()
        return pa.table({"bucket": pa.array([p for p, _, _ in cuts], pa.int64()), "block": pa.array([block] * len(cuts), pa.int64()), "asked": pa.array(rows, pa.binary())})

    return pieces


# ------------------------------------------------------------------ transforms


class Shard:
    """Suffixes of some pieces by rank: where they start, their first eight bytes, and whether LENGTH bytes equal those of the rank before.

    A byte is a symbol from 1, the end of a piece is 0. Suffixes that end within LENGTH bytes are alone.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        padded = np.concatenate((data, np.zeros(LENGTH, np.uint8)))
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n].astype(np.uint64)
        ends = np.flatnonzero(data == 0)
        to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
        short = to_end < 8
        drop = (np.uint64(8) * (np.uint64(8) - np.minimum(to_end, 8).astype(np.uint64)))[short]
        key[short] = np.where(drop >= 64, np.uint64(0), (key[short] >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63)))
        order = np.argsort(key, kind="stable")
        name = np.empty(n, np.int64)
        new = np.ones(n, bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | short[order][1:]
        name[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        have = 8
        while have < LENGTH:
            step = min(have, LENGTH - have)
            open_ = np.ones(n + 1, bool)
            open_[:n] = new
            mixed = np.flatnonzero(~(open_[:-1] & open_[1:]))  # in ranges of more than one
            if not len(mixed):
                break
            x = order[mixed]
            pair = name[x] * np.int64(n) + name[np.minimum(x + step, n - 1)]
            by = np.argsort(pair, kind="stable")
            x, pair = x[by], pair[by]
            order[mixed] = x
            edge = np.ones(len(x), bool)
            edge[1:] = pair[1:] != pair[:-1]
            edge |= to_end[x] < have + step  # ends are alone
            new[mixed] = edge
            name[x] = np.maximum.accumulate(np.where(edge, mixed, 0))
            have += step
        self.order, self.key, self.repeats = order, key[order], ~new
        self.short = short[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        #: The transform's step back: rank of the suffix one symbol longer (of a whole piece: its own end's, never used).
        self.back = rank[np.maximum(order - 1, 0)]
        self.forth = rank[np.minimum(order + 1, n - 1)]
        self.symbol = data[order]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of suffixes of two shards or more with LENGTH bytes in common: (suffixes, where each interval begins).

    A suffix is its rank plus the sizes of the shards before.
    """
    sizes = [len(s.order) for s in shards]
    shift = np.concatenate(([0], np.cumsum(sizes)))
    n = int(shift[-1])
    if len(shards) == 1:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    back = np.concatenate([s.back + k for s, k in zip(shards, shift)]).astype(np.int32)
    forth = np.concatenate([s.forth + k for s, k in zip(shards, shift)]).astype(np.int32)
    symbol = np.concatenate([s.symbol for s in shards])
    of = np.repeat(np.arange(len(shards), dtype=np.int32), sizes)
    key = np.concatenate([s.key for s in shards])
    short = np.concatenate([s.short for s in shards])
    # the interleave by the first eight symbols: sorted runs put together
    order = np.argsort(key, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | short[order][1:]
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    first = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)).astype(np.int32)

    def mixed(at: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` (whole ranges) whose range has suffixes of two shards or more."""
        if not len(at):
            return at
        f = first[at]
        edge = np.ones(len(at), bool)
        edge[1:] = f[1:] != f[:-1]
        starts = np.flatnonzero(edge)
        s = of[order[at]]
        unlike = np.zeros(len(at), bool)
        unlike[1:] = (s[1:] != s[:-1]) & ~edge[1:]
        some = np.logical_or.reduceat(unlike, starts)
        return at[np.repeat(some, np.diff(np.append(starts, len(at))))]

    at = mixed(np.arange(n, dtype=np.int32))
    for _ in range(8, LENGTH):
        if not len(at):
            break
        # ranges one symbol deeper: their suffixes' successors in order, each stepping back to the next place of its range
        whence = np.sort(place[forth[order[at]]])
        x = back[order[whence]]
        by = np.argsort(symbol[x], kind="stable")
        x = x[by]
        old = first[whence][by]
        edge = np.ones(len(at), bool)
        f = first[at]
        edge[1:] = (f[1:] != f[:-1]) | (old[1:] != old[:-1])
        order[at] = x
        place[x] = at
        first[at] = np.maximum.accumulate(np.where(edge, at, 0))
        at = mixed(at)
    f = first[at]
    return order[at], np.flatnonzero(np.diff(f, prepend=np.int32(-1)))


def least_ids(pieces: list[bytes], ids: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes of all pieces, one after the other, the smallest of the ids of the pieces that have it."""
    shards, held, inner = [], [], []
    at = 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and (size == 0 or size + len(pieces[end]) < SHARD):
            size += len(pieces[end]) + 1
            end += 1
        data = np.zeros(size, np.uint8)
        sizes = np.asarray([len(p) + 1 for p in pieces[at:end]])
        ends = np.cumsum(sizes) - 1
        text, whole = np.ones(size, bool), np.zeros(size, np.int8)
        text[ends] = False
        # no byte of UTF-8 is above 0xF4, so symbols from 1 fit in a byte
        data[text] = np.frombuffer(b"".join(pieces[at:end]), np.uint8) + np.uint8(1)
        whole[ends - sizes + 1] = 1
        whole[ends - LENGTH + 1] -= 1
        shards.append(Shard(data))
        held.append(np.repeat(ids[at:end], sizes))
        inner.append(np.cumsum(whole) > 0)  # where a string of LENGTH bytes begins
        at = end
    own = np.concatenate([i[s.order] for s, i in zip(shards, held)])
    # within a shard its own common prefixes say which are alike; across shards the merged intervals do
    new = np.flatnonzero(~np.concatenate([s.repeats for s in shards]))
    by_rank = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
    shared, new = merge(shards)
    if len(new):
        by_rank[shared] = np.repeat(np.minimum.reduceat(own[shared], new), np.diff(np.append(new, len(shared))))
    out, shift = [], 0
    for s, starts in zip(shards, inner):
        n = len(s.order)
        by_place = np.empty(n, np.int64)
        by_place[s.order] = by_rank[shift : shift + n]
        out.append(by_place[starts])
        shift += n
    return np.concatenate(out)


ANSWERS = "block long, told binary"


def _repeats(table: pa.Table) -> pa.Table:
    """Answers to each block for its pieces of some anchors: the smallest id of the piece, and the spans in it that a smaller one has."""
    number: dict[bytes, int] = {}
    asked, anchor, ids, rest = [], [], [], []
    for row in table["asked"]:
        own, sizes, text, least, *more = _unpack(row.as_py(), *ASKED)
        ends = np.cumsum(sizes).tolist()
        mine = [number.setdefault(text[e - n : e], len(number)) for e, n in zip(ends, sizes.tolist())]
        asked.append(np.asarray(mine, np.int64))
        anchor.append(own)
        ids.append(least)
        rest.append(more)
    pieces = list(number)
    every = np.concatenate(asked)
    least = np.full(len(pieces), LAST, np.int64)
    np.minimum.at(least, every, np.concatenate(ids))
    anchors_of = np.empty(len(pieces), np.uint64)
    anchors_of[every] = np.concatenate(anchor)
    size = np.asarray([len(p) for p in pieces], np.int64)
    order = np.argsort(anchors_of, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(anchors_of[order], prepend=~anchors_of[order][:1])), len(order))
    cuts: dict[int, list[tuple[int, int]]] = {}

    def settle(some: np.ndarray) -> None:
        windows = size[some] - LENGTH + 1
        own = np.repeat(least[some], windows)
        less = least_ids([pieces[i] for i in some.tolist()], least[some]) < own
        first = np.cumsum(windows) - windows
        edge = np.zeros(len(less) + 1, bool)
        edge[1:-1] = less[1:] != less[:-1]
        edge[first] = edge[-1] = True
        edge = np.flatnonzero(edge)
        a, b = edge[:-1], edge[1:]
        hit = less[a]
        a, b = a[hit], b[hit]
        piece = np.searchsorted(first, a, "right") - 1
        for i, x, y in zip(some[piece].tolist(), (a - first[piece]).tolist(), (b - first[piece]).tolist()):
            cuts.setdefault(i, []).append((x, y + LENGTH - 1))

    unit: list[np.ndarray] = []
    held = 0
    counts = np.diff(edges)
    bytes_of = np.add.reduceat(size[order], edges[:-1])
    longest = np.maximum.reduceat(size[order], edges[:-1])
    for k in np.flatnonzero((counts > 1) & (longest > LENGTH)).tolist():  # one piece has nothing to compare it with, single strings are alike or not
        if held and held + bytes_of[k] > UNIT:
            settle(np.concatenate(unit))
            unit, held = [], 0
        unit.append(order[edges[k] : edges[k + 1]])
        held += int(bytes_of[k])
    if unit:
        settle(np.concatenate(unit))
    has = np.zeros(len(pieces), bool)
    has[list(cuts)] = True
    out = []
    for mine, (most, n, places) in zip(asked, rest):
        wanted = (most > least[mine]) | has[mine]
        keep = np.repeat(wanted, n)
        its = np.repeat(mine, n)[keep]
        places = places[keep]
        inside = np.flatnonzero(has[its])
        spans = [(p, x, y) for p, i in zip(places[inside].tolist(), its[inside].tolist()) for x, y in cuts[i]]
        spans = np.ascontiguousarray(np.asarray(spans, np.int64).reshape(-1, 3).T)
        out.append(_pack(places, size[its], least[its], *spans) if len(places) else None)
    give_back()
    return pa.table({"block": table["block"], "told": pa.array(out, pa.binary())}).filter(pa.array([x is not None for x in out], pa.bool_()))


OUT = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    ids, texts = _texts(left)
    rows = [_unpack(x.as_py(), *TOLD) for x in right["told"]]
    places, sizes_of, first_id, part, cut_start, cut_end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*rows) if rows else [[]] * 6))
    low = np.int64((1 << PLACE) - 1)
    # a piece that a smaller id has goes whole; in the smallest one's own, what other pieces repeat
    whole = np.asarray(ids, np.int64)[places >> PLACE] > first_id
    place, size = places[whole], sizes_of[whole]
    of = np.concatenate((place >> PLACE, part >> PLACE))
    start = np.concatenate((place & low, (part & low) + cut_start))
    end = np.concatenate(((place & low) + size, (part & low) + cut_end))
    sizes = np.asarray([len(t) + 1 for t in texts], np.int64)  # one apart, so that spans of two texts never touch
    base = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(of):
        s, e = base[of] + start, base[of] + end
        by = np.argsort(s)
        s, e, o = s[by], np.maximum.accumulate(e[by]), of[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] > e[:-1]
        last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
        for i, a, b in zip(o[new].tolist(), s[new].tolist(), e[last].tolist()):
            found[i].append((a - int(base[i]), b - int(base[i])))
    kept = []
    for text, spans in zip(texts, found):
        if spans:
            edges = [0, *[x for span in spans for x in span], len(text)]
            text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        kept.append(text)
    give_back()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int | None = None, hot: int = HOT) -> DataFrame:
    """key, n_bytes, spans (start, end in bytes, maximal, ascending) and kept (the other bytes): a row for each row.

    A null text is empty. Rows with equal keys don't take from one another; a row without a key counts as
    the last, with the key ``LAST``. Texts shorter than ``LENGTH`` stay. Spans follow bytes, so ``kept`` need
    not be UTF-8. Other columns are not looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), data.alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    blocks = max(1, -(-total // (block or max(1, min(BLOCK, total // FEWEST)))))
    # about two million anchors a part, and some MB of pieces a bucket
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 25)
    buckets = max(parts, total >> 22)
    # equal rows get different blocks as well
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "data", F.monotonically_increasing_id()), F.lit(blocks))).repartition(parts, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(parts), "part long, block long, hashes binary, n binary")
    told = asked.groupBy("part").applyInArrow(_answer(hot), "block long, part long, flags binary")
    pieces = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_pieces(parts, buckets), PIECES)
    back = pieces.groupBy("bucket").applyInArrow(_repeats, ANSWERS)
    out = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_cut, OUT)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).cast(kind).alias(key), "n_bytes", "spans", "kept")
