"""Lexical search: postings and BM25 (k1 = 1.2, b = 0.75) over a table; ``inverted`` has the same over a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text
from sessionloom.operators.inverted import InvertedIndex
from sessionloom.operators.vectors import top


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, token, tf: how often each token occurs in each row."""
    return docs.select(F.col(id_col).alias("id"), F.explode(text.tokens(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, k1: float = 1.2, b: float = 0.75, scope: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, score: the best k rows by BM25. ``docs``: id, text; ``queries``: query_id, text.

    Any punctuation in a query is harmless, and a query without tokens finds nothing. ``scope`` names
    the ids that may answer; statistics stay those of all rows. Only postings of words that some query
    asks for are joined to queries.
    """
    post = postings(docs)
    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token"))
    lengths = docs.select("id", F.size(text.tokens(F.col("text"))).alias("len"))
    total = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = post.join(asked.select("token").distinct(), "token", "left_semi")
    df = wanted.groupBy("token").agg(F.count("*").alias("df"))
    if scope is not None:
        wanted = wanted.join(scope.select("id").distinct(), "id", "left_semi")
    # one row of totals beside the word counts
    idf = df.join(F.broadcast(total), F.lit(True)).select("token", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg_len")
    hits = wanted.join(idf, "token").join(lengths, "id").join(asked, "token")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def label_names(regions: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The given frames' regions with ``name`` (role and label), and id, text of each distinct name."""
    names = regions.join(frames.select("frame_id").distinct(), "frame_id", "left_semi").withColumn("name", F.concat_ws(" ", "role", "label"))
    return names, names.groupBy("name").agg(F.min("id").alias("id")).select("id", F.col("name").alias("text"))


def label_search(regions: DataFrame, queries: DataFrame, frames: DataFrame, k: int, index: InvertedIndex | None = None) -> DataFrame:
    """query_id, region_id, rank: regions of the given frames whose role and label match, by BM25.

    Regions of one role and label share a rank. ``regions``: id, frame_id, role, label. ``index`` has the
    distinct names, if they were stored before.
    """
    names, distinct = label_names(regions, frames)
    hits = bm25(distinct, queries, 2**31 - 1) if index is None else index.search(queries, k, ties=True)
    found = hits.join(distinct.select("id", F.col("text").alias("name")), "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    ranked = found.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "name", "score").join(names.select(F.col("id").alias("region_id"), "frame_id", "name"), "name").select("query_id", "region_id", "frame_id", "rank", "score")
