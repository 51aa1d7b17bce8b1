"""Encoding to the pieces of a SentencePiece BPE model with seeded merge-dropout, and decoding.

Each candidate merge of the agenda is skipped where a hash keyed by seed, chunk, document, the chunk's
position in it, place and merged piece falls below the dropout. A chunk is a word with the spaces
before it: no piece of such a model crosses from a word into the next one's spaces, so chunks can be
encoded one by one. Every occurrence of a chunk draws its own skips and takes the agenda itself;
nothing is remembered from one to the next. The chunks of a batch go through the agenda together, as
arrays with a column a chunk: in each round every chunk takes its best remaining merge. Longer chunks
take it one by one from a heap.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import by_size, give_back, small_batches

SPACE = "▁"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Longest chunk that takes a column, columns of an array, and characters of chunks that are worked on at once.
PLACES, COLUMNS, POINTS = 32, 4096, 1 << 18
#: Bytes of texts that are gathered before they are encoded; a longer text comes alone.
GATHERED = 1 << 20
_PLACE_BITS = 5
_NONE = np.int32(2**31 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of ``counts``."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class PairTable:
    """(left, right) numbers below ``n`` to a value: the rows of a sparse table, laid over each other where they don't meet.

    Any lookup is one gather of a row's shift and one of an entry, which tells whose it is.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], n: int):
        by = sorted((a, b, v) for (a, b), v in pairs.items())
        left, right, value = (np.array([x[i] for x in by], np.int64) for i in range(3))
        self.shift = np.zeros(n, np.int64)
        rows, first, sizes = np.unique(left, return_index=True, return_counts=True)
        free = np.ones(4 * len(by) + 2 * n + 4096, bool)
        low = 0
        for k in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)]:
            own = right[first[k] : first[k] + sizes[k]]
            step = max(64, 4096 // len(own))
            low = at = low + int(free[low:].argmax())
            while True:
                slots = at + np.nonzero(free[at : at + step])[0]
                fits = free[slots[:, None] + (own - own[0])[None, :]].all(axis=1)
                if fits.any():
                    break
                at += step
                step = min(2 * step, max(64, 2**18 // len(own)))
            at = int(slots[fits.argmax()])
            free[at + own - own[0]] = False
            self.shift[rows[k]] = at - own[0] + n
        alone = np.nonzero(sizes == 1)[0]  # rows of one entry go into the gaps
        self.shift[rows[alone]] = np.nonzero(free)[0][: len(alone)] - right[first[alone]] + n
        self.entries = np.full(int(self.shift.max(initial=0)) + n + 1, -1, np.int64)
        self.entries[self.shift[left] + right] = left << 32 | value

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where there is none."""
        found = self.entries[self.shift[left] + right]
        return np.where(found >> 32 == left, found & 0xFFFFFFFF, -1).astype(np.int32)


class DropoutEncoder:
    """One model, seed and dropout. ``dropout`` 0 gives the model's own segmentation.

    Inside, a piece goes by its rank among the model's merges; two further numbers stand for a
    character without a piece and for nothing at all.
    """

    def __init__(self, model: str, dropout: float, seed: int):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        text_of: list[bytes] = []
        ids: dict[str, int] = {}
        scores = np.zeros(n)
        for i in range(n):
            piece, scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                text_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                text_of.append(b"")
            else:
                ids[piece] = i
                text_of.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece of this model holds a space after other characters")
        self.piece_bytes = np.frombuffer(b"".join(text_of), np.uint8)
        self.piece_length = np.array(list(map(len, text_of)), np.int32)
        self.piece_at = np.cumsum(self.piece_length, dtype=np.int64) - self.piece_length
        self.id_at = np.argsort(-scores, kind="stable")
        self.rank = np.argsort(self.id_at, kind="stable")
        self.bare, self.gone = n, n + 1
        rank = self.rank.tolist()
        self.merges = {(rank[ids[p[:i]]], rank[ids[p[i:]]]): rank[k] for p, k in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids}
        self.pairs = PairTable(self.merges, n + 2)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, k in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = k
        # a literal U+2581 would decode to a space, so it is spelled in bytes; a space takes its piece
        self.char_ids[ord(" ")], self.char_ids[ord(SPACE)] = self.char_ids[ord(SPACE)], -1
        self.char_ranks = np.where(self.char_ids < 0, self.bare, self.rank[self.char_ids]).astype(np.int32)
        self.skip_below = np.uint64(min(max(dropout, 0.0), 1.0) * (2**64 - 2**12))
        self.drops, self.seed = dropout > 0, seed
        self.piece_key = self.id_at.astype(np.uint64) * _M[2]
        self.place_key = np.arange(PLACES + 1, dtype=np.uint64) * _M[0]

    def merged(self, left: int, right: int) -> int:
        """The id of the piece that two pieces make, -1 where there is none."""
        found = self.merges.get((int(self.rank[left]), int(self.rank[right])), -1)
        return found if found < 0 else int(self.id_at[found])

    def _keys(self, points: np.ndarray, lengths: np.ndarray, first: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """The key of each chunk: a hash of seed, characters and draw."""
        place = (np.arange(1, len(points) + 1) - np.repeat(first, lengths)).astype(np.uint64)
        spread = _mix(points + place * _M[0] + np.uint64(self.seed * int(_M[2]) % 2**64))
        return _mix(np.add.reduceat(spread, first) + draws * _M[1])

    def _order(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order of merging two symbols, the first of which starts at ``place``: by rank, then from the left; _NONE where they don't."""
        found = self.pairs.get(left, right)
        ok = found >= 0
        if self.drops:
            ok &= _mix(key + self.place_key[place] + self.piece_key[found]) >= self.skip_below
        return np.where(ok, found << _PLACE_BITS | place, _NONE)

    def _columns(self, sym: np.ndarray, key: np.ndarray, places: int) -> np.ndarray:
        """The agenda of many chunks at once. ``sym``: a column of ranks a chunk, a row a place, nothing (``gone``) below its end."""
        n = sym.shape[1]
        # one row more: what lies beyond either end of a chunk
        sym = np.concatenate([sym, np.full((1, n), self.gone, np.int32)]).reshape(-1)
        rows = np.arange(places + 1, dtype=np.int32)
        after = np.repeat(np.minimum(rows + 1, places), n)
        before = np.repeat(np.where(rows == 0, places, rows - 1).astype(np.int32), n)
        order = np.full((places + 1) * n, _NONE, np.int32)
        order[: places * n] = self._order(sym[: places * n], sym[n:], np.repeat(rows[:-1], n), np.tile(key, places) if self.drops else key)
        table = order.reshape(places + 1, n)
        while True:
            best = table.min(axis=0)
            col = np.nonzero(best != _NONE)[0]
            if not len(col):
                return sym.reshape(places + 1, n)[:places]
            best = best[col]
            place, piece = best & (PLACES - 1), best >> _PLACE_BITS
            here = place * n + col
            taken = after[here] * n + col
            nxt, prv = after[taken], before[here]
            right, left = nxt * n + col, prv * n + col
            sym[here], sym[taken] = piece, self.gone
            order[taken] = _NONE
            after[here], before[right] = nxt, place
            own = key[col] if self.drops else key
            order[here] = self._order(piece, sym[right], place, own)
            order[left] = self._order(sym[left], piece, prv, own)

    def _alone(self, sym: list[int], key: int) -> list[int]:
        """The agenda of one chunk from a heap: ranks by place, ``gone`` where a symbol went into another."""
        n, merges, mask, m = len(sym), self.merges, 2**64 - 1, [int(x) for x in _M]
        below, piece_key = int(self.skip_below), self.piece_key.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def add(at: int, right: int) -> None:
            found = merges.get((sym[at], sym[right]))
            if found is None:
                return
            if self.drops:
                x = (key + at * m[0] + piece_key[found]) & mask
                x = (x ^ (x >> 30)) * m[1] & mask
                x = (x ^ (x >> 27)) * m[2] & mask
                if x ^ (x >> 31) < below:
                    return
            heapq.heappush(heap, (found, at, right))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            piece, at, right = heapq.heappop(heap)
            if sym[at] == self.gone or after[at] != right or merges.get((sym[at], sym[right])) != piece:
                continue  # one of the two has changed since
            sym[at], sym[right] = piece, self.gone
            nxt = after[at] = after[right]
            if nxt < n:
                before[nxt] = at
                add(at, nxt)
            if before[at] >= 0:
                add(before[at], at)
        return sym

    def segment(self, points: np.ndarray, lengths: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all chunks, one after the other, and how many each has. ``points``: their code points."""
        first = np.cumsum(lengths) - lengths
        keys = self._keys(points, lengths, first, draws) if self.drops else np.zeros(len(lengths), np.uint64)
        sym = self.char_ranks[points]
        by = np.argsort(np.minimum(lengths, PLACES + 1).astype(np.uint16), kind="stable")
        longer = len(by) - int(np.count_nonzero(lengths > PLACES))
        for at in range(0, longer, COLUMNS):
            block = by[at : min(at + COLUMNS, longer)]
            own, start = lengths[block], first[block]
            places = int(own[-1])
            if places == 1:
                continue
            row = np.arange(places)[:, None]
            inside = row < own
            where = np.where(inside, start + row, 0)
            done = self._columns(np.where(inside, sym[where], np.int32(self.gone)), keys[block], places)
            sym[where[inside]] = done[inside]
        for i in by[longer:].tolist():
            sym[first[i] : first[i] + lengths[i]] = self._alone(sym[first[i] : first[i] + lengths[i]].tolist(), int(keys[i]))
        left = sym != self.gone
        counts = np.add.reduceat(left, first, dtype=np.int64)
        ids = np.append(self.id_at, -1)[sym[left]].astype(np.int32)
        bare = np.nonzero(ids < 0)[0]
        if len(bare):  # spelled in bytes
            spelled = [self.byte_ids[np.frombuffer(chr(c).encode(), np.uint8)] for c in points[left][bare].tolist()]
            many = np.ones(len(ids), np.int64)
            many[bare] = list(map(len, spelled))
            counts = np.add.reduceat(many, np.cumsum(counts) - counts)
            ids = np.repeat(ids, many)
            ids[ids < 0] = np.concatenate(spelled)
        return ids, counts

    def agenda(self, chunks: list[tuple[str, int]]) -> list[bytes]:
        """Piece ids (little-endian, 32 bits) of each chunk and draw."""
        points = np.frombuffer("".join(c for c, _ in chunks).encode("utf-32-le"), np.uint32)
        ids, counts = self.segment(points, np.array([len(c) for c, _ in chunks], np.int64), np.array([v for _, v in chunks], np.uint64))
        ends = np.cumsum(counts)
        return [ids[b - n : b].astype("<i4").tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def encode_all(self, texts: list[str], names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and how many each has; ``names`` (hashes of the documents' ids) and positions key the draws."""
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not lengths.sum():
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le"), np.uint32)
        space, line = points == 32, points == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        some = np.nonzero(lengths)[0]
        begins[(np.cumsum(lengths) - lengths)[some]] = True
        first = np.nonzero(begins)[0]
        # chunks of each text
        ends = np.cumsum(lengths)
        chunks = np.diff(np.searchsorted(first, ends), prepend=0)
        draws = _mix(_within(chunks).astype(np.uint64) * _M[0] + np.repeat(np.array(names, np.uint64), chunks))
        edges = np.append(first, len(points))
        ids, counts, at = [], [], 0
        while at < len(first):  # by as many chunks as lie in POINTS characters
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + POINTS, "right")) - 1)
            got, n = self.segment(points[edges[at] : edges[end]], np.diff(edges[at : end + 1]), draws[at:end])
            ids.append(got)
            counts.append(n)
            at = end
        each = np.zeros(len(texts), np.int64)
        each[some] = np.add.reduceat(np.concatenate(counts), (np.cumsum(chunks) - chunks)[some])
        return np.concatenate(ids), each

    def encode(self, texts: list[str], names: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        ids, each = self.encode_all(texts, names)
        return np.split(ids, np.cumsum(each)[:-1]) if len(each) else []

    def decode_all(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces, one after the other."""
        lengths = self.piece_length[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        return self.piece_bytes[np.repeat(self.piece_at[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``encode`` got: pieces joined, the space put before it taken away."""
        return self.decode_all(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]

    def lossless(self, texts: list[str], ids: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to its very bytes."""
        want = [f" {t}".encode() if t else b"" for t in texts]
        sizes = np.fromiter(map(len, want), np.int64, len(want))
        of = np.repeat(np.arange(len(want)), each)
        got = np.bincount(of, self.piece_length[ids], len(want)).astype(np.int64)
        data = self.decode_all(ids)
        if (got == sizes).all() and data.tobytes() == b"".join(want):
            return np.ones(len(want), bool)
        ends = np.cumsum(got)
        return np.array([data[b - n : b].tobytes() == w for b, n, w in zip(ends.tolist(), got.tolist(), want, strict=True)])


@lru_cache(maxsize=2)
def encoder(model: str, dropout: float, seed: int) -> DropoutEncoder:
    return DropoutEncoder(model, dropout, seed)


def encode_documents(docs: DataFrame, model: str, *, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32, lossless for every row of ``docs`` (doc_id, text).

    ``lossless``: the ids decode to the very text. A null text counts as empty, which has no ids;
    repeated rows are encoded alike; an empty table gives no rows; other columns are ignored. A
    literal U+2581 is spelled in bytes, so that it decodes to itself. A chunk of more than ``PLACES``
    characters takes time in proportion to n log n.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model, dropout, seed)
        for batch in batches:
            for part in by_size(batch, 1, GATHERED):
                names = [xxhash.xxh3_64_intdigest(str(d), seed=seed) for d in part.column(0).to_pylist()]
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, each = own.encode_all(texts, names)
                same = own.lossless(texts, ids, each)
                ends = np.concatenate([[0], np.cumsum(each)])
                data = memoryview(ids.astype("<i4")).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(each), pa.array(crcs, pa.int64()), pa.array(same)], ["doc_id", "ids", "n_ids", "ids_crc32", "lossless"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, ids array<int>, n_ids long, ids_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with ids (null ids: null text)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(task, f"doc_id {kind}, text string")
