"""Rank fusion, collapsing of related hits, frame scores, evidence and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text

RRF_K = 5


def rrf(lists: DataFrame, *, k: float = RRF_K) -> DataFrame:
    """query_id, id, score, lanes, rank: sum of 1 / (k + rank) over the lists that hold an id; ties by id.

    ``lists``: query_id, lane, id, rank (from 1).
    """
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", "rank")))).alias("lanes"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def collapse_related(hits: DataFrame, closure: DataFrame) -> DataFrame:
    """Best first, the hits that no kept better hit is an ancestor or descendant of.

    ``hits``: query_id, id, rank; ``closure``: ancestor, descendant. A hit stays if all its better
    relatives have gone, and goes if one of them has stayed; each round settles some of every query.
    """
    both = closure.select(F.col("ancestor").alias("id"), F.col("descendant").alias("other")).union(closure.select(F.col("descendant").alias("id"), F.col("ancestor").alias("other"))).filter("id <> other").distinct()
    better = hits.join(both, "id").join(hits.select("query_id", F.col("id").alias("other"), F.col("rank").alias("other_rank")), ["query_id", "other"]).filter("other_rank < rank").select("query_id", "id", "other").checkpoint()
    state = hits.withColumn("kept", F.lit(None).cast("boolean"))
    while True:
        known = state.select("query_id", F.col("id").alias("other"), F.col("kept").alias("other_kept"))
        told = better.join(known, ["query_id", "other"]).groupBy("query_id", "id").agg(F.coalesce(F.max("other_kept"), F.lit(False)).alias("dropped"), F.max(F.col("other_kept").isNull()).alias("open"))
        state = state.join(told, ["query_id", "id"], "left").select(*hits.columns, F.coalesce("kept", F.when(F.coalesce("dropped", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))).alias("kept")).checkpoint()
        if state.filter("kept is null").isEmpty():
            return state.filter("kept").drop("kept")


def frame_scores(frames: DataFrame, *, weights: tuple[float, float, float] = (1.0, 0.5, 0.5), k: int = 30) -> DataFrame:
    """query_id, id, score, rank. ``frames``: query_id, id, t, distance, region, segment (null where absent).

    A frame's own score is its distance from the worst to the best; each of the three is divided by
    the query's largest, and they add up by ``weights``.
    """
    w = Window.partitionBy("query_id")
    lo, hi = F.min("distance").over(w), F.max("distance").over(w)
    own = F.when(F.col("distance").isNull(), 0.0).when(hi == lo, 1.0).otherwise((hi - F.col("distance")) / (hi - lo))
    rows = frames.select("*", own.alias("own"), F.coalesce("region", F.lit(0.0)).alias("reg"), F.coalesce("segment", F.lit(0.0)).alias("seg"))
    part = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1e-9))
    scored = rows.withColumn("score", F.round(weights[0] * part("own") + weights[1] * part("reg") + weights[2] * part("seg"), 6))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "t", "id"))).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def region_scores(hits: DataFrame, m: int = 3) -> DataFrame:
    """query_id, frame_id, region: the sum of the m best 1 / rank of a frame's regions, over m."""
    w = Window.partitionBy("query_id", "frame_id").orderBy("rank", "region_id")
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= m).groupBy("query_id", "frame_id").agg((F.sum(1 / F.col("rank")) / m).alias("region"))


def best_segment(links: DataFrame) -> DataFrame:
    """query_id, frame_id, segment_id: the frame's best segment, the shorter on a tie, then the smaller id."""
    return links.groupBy("query_id", "frame_id").agg(F.min_by("segment_id", F.struct(-F.col("score"), "duration", "segment_id")).alias("segment_id"))


def evidence(lists: DataFrame, region_hits: DataFrame | None = None) -> DataFrame:
    """query_id, id, evidence: the lists that held each hit, by rank and then name."""
    rows = lists.select("query_id", "id", "rank", "lane")
    if region_hits is not None:
        n = region_hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
        rows = rows.unionByName(n.select("query_id", "id", "rank", F.concat(F.lit("region_label x"), F.col("n").cast("string")).alias("lane")))
    return rows.groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lane"))), lambda e: F.concat(e["lane"], F.lit("@"), e["rank"].cast("string"))), ", ").alias("evidence"))


def rerank(hits: DataFrame, head: int) -> DataFrame:
    """The first ``head`` hits of each query by how many distinct words they share with it, else as they were.

    ``hits``: query_id, id, rank, query, text.
    """
    shared = F.size(F.array_intersect(text.tokens(F.col("query")), text.tokens(F.col("text"))))
    order = [F.col("rank") > head, F.when(F.col("rank") <= head, -shared).otherwise(0), F.col("rank")]
    return hits.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def tied(hits: DataFrame) -> DataFrame:
    """query_id, tied: whether all of two or more hits have one score."""
    return hits.groupBy("query_id").agg(((F.count("*") >= 2) & (F.min("score") == F.max("score"))).alias("tied"))


def empty_results(queries: DataFrame, hits: DataFrame, spaces: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, diagnosis of queries without frames: another namespace has vectors, or segments have no frames.

    ``queries``: query_id, namespace; ``hits``: query_id, segment_id; ``spaces``: namespace, n;
    ``links``: segment_id, frame_id.
    """
    framed = hits.join(links, "segment_id", "left_semi").select("query_id").distinct()
    matched = hits.select("query_id").distinct().withColumn("matched", F.lit(True))
    here = spaces.select("namespace", F.col("n").alias("own_n"))
    others = spaces.agg(F.sum("n").alias("all_n"))
    rows = queries.join(framed, "query_id", "left_anti").join(matched, "query_id", "left").join(here, "namespace", "left").join(F.broadcast(others), F.lit(True))
    elsewhere = (F.coalesce("own_n", F.lit(0)) == 0) & (F.col("all_n") > 0)
    why: Column = F.when(F.coalesce("matched", F.lit(False)), "no frames linked").when(elsewhere, "other namespace").otherwise("nothing found")
    return rows.select("query_id", why.alias("diagnosis"))
