"""Approximate neighbours by residual product codes: a few bytes a vector, exact distances for few.

Vectors are put into k-means cells; what is left of a vector beside its cell's centre is cut into
subspaces, and each part is named by the nearest of the subspace's codewords. A query makes a table of
its distances to all codewords of a cell once, and adds up one entry a subspace for each row. The best
``rerank`` rows of a query by these sums are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.vectors import LANE_ROWS, l2, top


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """k centres of the rows of ``x`` (fewer, if it has fewer distinct rows)."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres * centres).sum(1)
    return np.concatenate([np.argmin(size - 2 * part @ centres.T, 1) for part in np.array_split(x, max(1, len(x) * len(centres) >> 22))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


class ProductCodes:
    """Codes of the rows of ``base`` (id, v), all of one length.

    Cells and codewords are fitted on at most about ``sample_rows`` rows, each subspace in a task of its own;
    every row is coded. Fitting is repeatable: rows are drawn and ordered by their id.
    """

    def __init__(self, base: DataFrame, *, cells: int = 16, subspaces: int = 16, codewords: int = 256, sample_rows: int = 20_000, seed: int = 1, rounds: int = 8):
        self.rows = base.select("id", F.col("v").cast("array<double>").alias("v")).filter("v is not null")
        self.n = self.rows.count()
        drawn = self.rows if self.n <= sample_rows else self.rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(self.n)) < sample_rows)
        one = F.lit(0).alias("part")

        def centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(rows.sort_values("id")["v"].to_numpy())
            return pd.DataFrame({"centre": list(_kmeans(x, cells, np.random.default_rng(seed), rounds))})

        found = drawn.select("id", "v", one).groupBy("part").applyInPandas(centres, "centre array<double>").collect()  # as many as cells
        self.centres = np.asarray([r["centre"] for r in found]) if found else np.zeros((0, 1))
        width = self.centres.shape[1]
        self.edges = np.linspace(0, width, min(subspaces, width) + 1).round().astype(int)
        self.books = self._books(drawn, codewords, seed, rounds) if found else []
        self.coded = self._coded()

    def _books(self, drawn: DataFrame, codewords: int, seed: int, rounds: int) -> list[np.ndarray]:
        own, edges = self.centres, self.edges

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                left = x - own[_nearest(x, own)] if len(x) else x
                for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(x), pa.int32()), pa.array(list(left[:, a:b]), pa.list_(pa.float64()))], ["id", "part", "r"])

        def book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(rows.sort_values("id")["r"].to_numpy())
            words = _kmeans(x, codewords, np.random.default_rng(seed + int(key[0])), rounds)
            return pd.DataFrame({"part": int(key[0]), "word": range(len(words)), "v": list(words)})

        kind = drawn.schema["id"].dataType.simpleString()
        parts = drawn.mapInArrow(cut, f"id {kind}, part int, r array<double>")
        found = parts.groupBy("part").applyInPandas(book, "part int, word int, v array<double>").collect()  # subspaces times codewords at most
        return [np.asarray([r["v"] for r in sorted((r for r in found if r["part"] == p), key=lambda r: r["word"])]) for p in range(len(edges) - 1)]

    def _coded(self) -> DataFrame:
        """id, cell, code (a byte a subspace), lane: rows of a cell are dealt to lanes, more where there are more rows."""
        own, edges, books = self.centres, self.edges, self.books

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                if not len(x):
                    continue
                cell = _nearest(x, own)
                left = x - own[cell]
                code = np.stack([_nearest(left[:, a:b], book) for (a, b), book in zip(zip(edges[:-1], edges[1:]), books)], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "cell", "code"])

        kind = self.rows.schema["id"].dataType.simpleString()
        lanes = max(1, -(-self.n // LANE_ROWS))
        return self.rows.mapInArrow(encode, f"id {kind}, cell int, code binary").withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, rerank: int = 80) -> DataFrame:
        """query_id, rank, id, distance: the k nearest by L2 among the ``rerank`` best by codes, ties to the smaller id.

        ``queries``: query_id, v. Each looks into its ``probes`` nearest cells (all, if not given).
        """
        if not self.n:
            return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("distance")).limit(0)
        near = self._candidates(queries, probes, rerank)
        met = near.join(self.rows, "id").join(queries.select("query_id", F.col("v").alias("qv")), "query_id")
        exact = met.select("query_id", "id", F.round(l2("qv", "v"), 6).alias("distance"))
        return top(exact, k, F.asc("distance"), F.asc("id")).select("query_id", "rank", "id", "distance")

    def _candidates(self, queries: DataFrame, probes: int | None, rerank: int) -> DataFrame:
        own, edges, books = self.centres, self.edges, self.books
        probes = min(probes or len(own), len(own))
        q, i = (queries.schema["query_id"].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString())

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                if not len(x):
                    continue
                d = (own * own).sum(1) - 2 * x @ own.T
                cells = np.argsort(d, 1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(x)), probes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells.ravel(), pa.int32())], ["query_id", "v", "cell"])

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            names, ids, sums = [], [], []
            if len(left) and len(right):
                codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(left), -1)
                x = _matrix(right["v"]) - own[left["cell"][0].as_py()]
                rank = left["id"].combine_chunks()
                for row in range(len(x)):
                    total = np.zeros(len(codes))
                    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        gap = books[part] - x[row, a:b]
                        total += (gap * gap).sum(1)[codes[:, part]]
                    best = np.argpartition(total, rerank - 1)[:rerank] if len(total) > rerank else np.arange(len(total))
                    names += [row] * len(best)
                    ids.append(best)
                    sums.append(total[best])
                at = pa.array(np.concatenate(ids))
                return pa.table({"query_id": right["query_id"].take(pa.array(names)), "id": rank.take(at), "approx": np.concatenate(sums)})
            return pa.table({"query_id": right["query_id"].slice(0, 0), "id": left["id"].slice(0, 0), "approx": pa.array([], pa.float64())})

        asked = queries.select("query_id", F.col("v").cast("array<double>").alias("v")).filter("v is not null").mapInArrow(send, f"query_id {q}, v array<double>, cell int")
        lanes = F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-self.n // LANE_ROWS)) - 1)))
        sent = asked.withColumn("lane", lanes)
        found = self.coded.groupBy("cell", "lane").cogroup(sent.groupBy("cell", "lane")).applyInArrow(scan, f"query_id {q}, id {i}, approx double")
        return top(found, rerank, F.asc("approx"), F.asc("id")).select("query_id", "id")
