"""Connected components of a link table, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``links`` (a, b).

    Each round hangs every node's neighbours, and itself, below the smallest of them, first towards
    larger neighbours and then towards smaller ones, until the table is a set of stars. Rounds grow
    with the logarithm of the component's size. A hub's minimum is counted within tasks before the
    shuffle, and the table is written after each round, so a hub costs no long task or lineage.
    Links to oneself, repeated links and nulls are ignored.
    """
    def larger(a: str, b: str):
        return F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")

    edges = stored(links.filter("a is not null and b is not null and a <> b").select(*larger("a", "b")).distinct())
    for _ in range(max_rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # large star: neighbours greater than u go to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), "m").filter("x <> m")
        # small star: u and its lesser neighbours go to the least of them
        small_in = large.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()
        small_in = stored(small_in)
        lowest = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("m")), F.struct(F.col("v").alias("x"), F.col("m").alias("m")))).alias("e")).select("e.x", "e.m").filter("x <> m")
        after = stored(small.select(*larger("x", "m")).distinct())
        # stars stay as they are: same rows before and after
        same = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        was = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        edges = after
        if same == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
