"""Exact top-k by inner product through histograms of scores.

All scores are integers. Each round counts, for every query, the scores that fall in the bins of an
interval known to hold its k-th best; the interval shrinks to one bin each time until its width is
one. Then all rows at or above that score are kept and ties go to the smaller id. Vectors move in
blocks: candidate blocks lie in lanes, whose number grows with the blocks, and each query block is
sent to every lane once a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import stored

#: Scores up to this size are exact in double precision.
EXACT = 2.0**53
#: Bits by which each round narrows the bins.
STEP = 9
#: Blocks of candidates in a lane at most, and lanes at least where there are as many blocks.
LANE_BLOCKS, LANES = 8, 24
BLOCK = {"dim": "int", "block": "long", "ids": "binary", "vectors": "binary", "n": "int"}


def _blocks(vectors: DataFrame, rows_per_block: int, tasks: int) -> DataFrame:
    """Rows gathered to blocks of one dimension each: ids as int64 and components as float64."""

    def task(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=True):
                for at in range(0, len(part), rows_per_block):
                    piece = part.iloc[at : at + rows_per_block]
                    ids = piece["vec_id"].to_numpy(np.int64)
                    block = int(ids.min()) if len(ids) else 0
                    yield pd.DataFrame([(int(dim), block, ids.tobytes(), np.stack(piece["v"].to_numpy()).astype(np.float64).tobytes(), len(ids))], columns=list(BLOCK))

    return vectors.repartition(tasks, F.xxhash64("vec_id")).mapInPandas(task, ", ".join(map(" ".join, BLOCK.items())))


def _scores(q_vectors: bytes, n_q: int, c_vectors: bytes, n_c: int) -> np.ndarray:
    q, c = np.frombuffer(q_vectors).reshape(n_q, -1), np.frombuffer(c_vectors).reshape(n_c, -1)
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    return (whole(q) @ whole(c).T).astype(np.int64)  # raises where a score needs more than 64 bits


def _histogram(q_ids, q_vectors, n_q, c_ids, c_vectors, n_c, low, high, shift):
    """Per query the counts of scores by bin, for scores in [low, high)."""
    qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
    scores = _scores(q_vectors, n_q, c_vectors, n_c)
    keep = qi[:, None] != ci[None, :]
    if low is not None:
        keep &= (scores >= np.frombuffer(low, np.int64)[:, None]) & (scores < np.frombuffer(high, np.int64)[:, None])
    row, col = np.nonzero(keep)
    bins = scores[row, col] >> shift
    order = np.lexsort((bins, row))
    row, bins = row[order], bins[order]
    first = np.nonzero(np.append(True, (np.diff(row) != 0) | (np.diff(bins) != 0)))[0] if len(row) else np.empty(0, np.int64)
    return qi[row[first]], bins[first], np.diff(np.append(first, len(row)))


def _at_or_above(q_ids, q_vectors, n_q, c_ids, c_vectors, n_c, low, k):
    """Per query the block's rows that score ``low`` or more; only its own k best can be in the result."""
    qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
    scores = _scores(q_vectors, n_q, c_vectors, n_c)
    keep = (scores >= np.frombuffer(low, np.int64)[:, None]) & (qi[:, None] != ci[None, :])
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in np.nonzero(keep.any(axis=1))[0].tolist():
        at = np.nonzero(keep[r])[0]
        at = at[np.lexsort((ci[at], -scores[r, at]))[:k]]
        rows.append(np.full(len(at), r))
        cols.append(at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    return qi[row], ci[col], scores[row, col]


def _each(pairs: DataFrame, work, names: list[str]) -> DataFrame:
    """Three columns of whole numbers from each row of ``pairs``: a query block, a candidate block and bounds."""
    def task(batches):
        for batch in batches:
            for row in range(len(batch)):
                found = work(*(c[row].as_py() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return pairs.mapInArrow(task, ", ".join(f"{n} long" for n in names))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``floor(scale * x)`` of every component; rows that are null or hold null or non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    return (
        vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull())
        .filter(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
        .select(F.col(id_col).alias("vec_id"), F.size(vector_col).alias("dim"), F.transform(x, lambda c: F.rint(F.floor(c * F.lit(float(scale))).cast("double"))).alias("v"))
    )


def top_k(vectors: DataFrame, is_query, k: int = 10, *, rows_per_block: int = 1024, queries_per_block: int = 256, lanes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query.

    ``vectors``: vec_id, dim, v (whole numbers as doubles). ``is_query``: a condition on vec_id. Rows
    of another dimension than the query's score nothing. Fewer than k candidates: all of them. Of
    repeated ids each row is a candidate, the least vector is the query, and no row meets its own id.
    Empty tables give no rows. Components are whole numbers within 64 bits (``quantised`` saturates
    beyond); a score beyond 64 bits raises. ``lanes``: the number of keys that pairs of blocks are
    dealt by; by default one for ``LANE_BLOCKS`` blocks of candidates, or for each while they are few.
    """
    vectors = stored(vectors)
    n = vectors.count()
    blocks = n // rows_per_block + 1
    tasks = min(4096, blocks)  # partitions, which hold as many blocks as there are
    candidates = stored(_blocks(vectors, rows_per_block, tasks))
    n_queries = vectors.filter(is_query).count()
    asked = vectors.filter(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    queries = stored(_blocks(asked, queries_per_block, max(1, n_queries // queries_per_block + 1)))
    lanes = lanes or max(min(LANES, blocks), -(-blocks // LANE_BLOCKS))
    c = candidates.select("dim", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), F.col("n").alias("c_n"))
    most = vectors.agg(F.max(F.col("dim") * F.pow(F.array_max(F.transform("v", F.abs)), F.lit(2.0)))).first()[0] or 1.0
    bits = min(62, int(np.log2(max(most, 1.0))) + 1)
    both = ["ids", "vectors", "n", "c_ids", "c_vectors", "c_n"]
    low = high = above = None
    for shift in range((bits - 1) // STEP * STEP, -1, -STEP):
        q = queries if low is None else _beside(_beside(queries, low, ["dim", "block"]), high, ["dim", "block"])
        q = q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("block")
        bounds = [F.lit(None).cast("binary").alias(b) if low is None else F.col(b) for b in ("low", "high")]
        counts = (
            _each(_beside(q, c, ["dim", "lane"]).select(*both, *bounds, F.lit(shift)), _histogram, ["query_id", "bin", "n"])
            .groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        )
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("reached", F.sum("n").over(down))
        if above is not None:
            counts = _beside(counts, above, ["query_id"])
            counts = counts.withColumn("reached", F.col("reached") + F.col("above"))
        # the bin in which the count reaches k; a query with fewer rows than k takes its lowest bin
        chosen = counts.groupBy("query_id").agg(
            F.max(F.when(F.col("reached") >= k, F.col("bin"))).alias("hit"), F.min("bin").alias("least"),
            F.max(F.struct(F.when(F.col("reached") >= k, F.col("bin")).alias("b"), F.col("n").alias("n"), F.col("reached").alias("reached"))).alias("at"),
            F.max("reached").alias("all"), F.min_by("n", "bin").alias("least_n"),
        )
        chosen = chosen.select(
            "query_id", F.coalesce("hit", "least").alias("bin"),
            F.when(F.col("hit").isNotNull(), F.col("at.reached") - F.col("at.n")).otherwise(F.col("all") - F.col("least_n")).alias("above"),
        )
        chosen = stored(chosen.select("query_id", "above", F.shiftleft("bin", shift).alias("low"), F.shiftleft(F.col("bin") + 1, shift).alias("high")))
        above = chosen.select("query_id", "above")
        low, high = (_bounds(queries, chosen, name) for name in ("low", "high"))
    q = _beside(queries, low, ["dim", "block"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("block")
    found = _each(_beside(q, c, ["dim", "lane"]).select(*both, "low", F.lit(k)), _at_or_above, ["query_id", "vec_id", "score"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join by shuffles: the size of blocks on disk, by which Spark broadcasts them, knows nothing of how often a lane repeats them."""
    return left.join(right.hint("merge"), on)


def _bounds(queries: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """``chosen``'s bound of each query of a block, in the block's order; a query without one gets an empty interval."""

    ids = F.udf(lambda data: np.frombuffer(data, np.int64).tolist(), "array<long>", useArrow=False)
    packed = F.udf(lambda pairs: np.array([v for _, v in sorted(pairs)], np.int64).tobytes(), "binary", useArrow=False)
    none = 2**62
    each = queries.select("dim", "block", F.posexplode(ids("ids")).alias("at", "query_id")).join(chosen.hint("merge"), "query_id", "left")
    return each.groupBy("dim", "block").agg(packed(F.collect_list(F.struct("at", F.coalesce(name, F.lit(none)).alias("v")))).alias(name))
