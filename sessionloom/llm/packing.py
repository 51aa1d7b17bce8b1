"""Packing of documents into fixed windows by best-fit decreasing.

``pack_documents`` tokenises, cuts and packs in one pass over the input's own partitions, so no row
is shuffled. Each task packs the tails that it holds in groups of at most ``group_tails``; what a
task keeps in memory is bounded by that number, not by the table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import give_back, small_batches

#: Longest run of characters without white space that the fast encoder gets; longer runs cost it
#: time in their square, so such documents go to the library's own encoder.
LONG_RUN = 2000


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file, as ``tokenizers`` gives them without special tokens added."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        from public_tokenizers import PATTERN

        self._fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._long = regex.compile(rf"\S{{{LONG_RUN}}}")
        self._slow = None

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self._long.search(text):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
            ids = self._slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode(text, allowed_special="all")
        return np.array(ids, "<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..window counts how many are open."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.open[capacity].append(bin_)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity that is ``need`` or more, removed from the tree."""
        count, i = self.count, need + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not count[i]:
                    i += 1
        capacity = i - self.size
        bin_ = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, bin_


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's filled length. Ties keep input order."""
    n = len(lengths)
    bins, offsets, filled = np.empty(n, np.int64), np.empty(n, np.int64), []
    tree = CapacityTree(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            bin_, capacity = len(filled), window
            filled.append(0)
        else:
            capacity, bin_ = found
        bins[i], offsets[i] = bin_, window - capacity
        filled[bin_] += need
        if capacity > need:
            tree.add(capacity - need, bin_)
    return bins, offsets, np.array(filled, np.int64)


def pack_documents(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
    window: int = 1024, end_id: int = 0, group_tails: int = 65536, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Documents longer than ``window`` are cut into full windows first, each a sequence of its own;
    the tails are packed best-fit decreasing. A null text counts as empty (only ``end_id``); repeated
    rows are packed as often as they occur; an empty table gives no rows. Other columns are ignored.
    ``padded_length`` is what a sequence takes: ``window``, or its own length where that is a power of
    two. ``keep_ids`` adds the token ids of each piece.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long" + ", ids array<int>" * keep_ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        first = TaskContext.get().partitionId() << 36
        used = 0
        tails: list[tuple] = []

        def rows(names: list, columns: np.ndarray, ids: list) -> pa.RecordBatch:
            total = columns[6]
            power = (total & (total - 1)) == 0
            arrays = [names if isinstance(names, pa.Array) else pa.array(names), *map(pa.array, columns), pa.array(np.where(power, total, window))]
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length"]
            if keep_ids:
                lengths = np.array([0, *map(len, ids)])
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype("i4")), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype("i4"))))
                labels.append("ids")
            return pa.RecordBatch.from_arrays(arrays, labels)

        def packed() -> pa.RecordBatch:
            nonlocal used
            names, starts, lengths, crcs, totals, ids = map(list, zip(*tails, strict=True))
            length = np.array(lengths, np.int64)
            bins, offsets, filled = best_fit_decreasing(length, window)
            columns = np.array([starts, length, crcs, totals, first + used + bins, offsets, filled[bins]], np.int64)
            used += len(filled)
            tails.clear()
            return rows(names, columns, ids)

        for batch in batches:
            names, full, at, ids_of = batch.column(0), [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(text or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for start in range(0, n - window + 1, window):
                    piece = ids[start : start + window]
                    full.append((start, window, zlib.crc32(piece.tobytes()), n, first + used, 0, window))
                    used += 1
                    at.append(row)
                    if keep_ids:
                        ids_of.append(piece)
                if start := n % window:
                    piece = ids[n - start :]
                    tails.append((names[row].as_py(), n - start, start, zlib.crc32(piece.tobytes()), n, piece if keep_ids else None))
            if full:
                yield rows(names.take(pa.array(at)), np.array(full, np.int64).T, ids_of)
            if len(tails) >= group_tails:
                yield packed()
        if tails:
            yield packed()
        give_back()

    return source.mapInArrow(task, schema)
