"""A stored inverted index with impact bounds, searched by reading the blocks that can matter only.

Documents of a batch are dealt to slabs of some ``SLAB`` of them, alike in length. A posting block is one
token in one slab: ids, counts and lengths. Its head has the pairs of count and length in it that no other
pair beats in both, from which the largest contribution to BM25 follows, whatever later batches do to the
word's rarity or to the mean length. The tables lie in folders by token bucket and batch:

    postings  token, slab, ids, tfs, lens          heads  token, slab, n, impacts
    documents id, len, slab                        commits  batch, n, total

A batch counts once its row in ``commits`` is there, which is written last; one that was broken off is
written again under the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text
from sessionloom.operators.vectors import top

SLAB, BUCKETS = 32, 16
#: Slabs of a query that are scored first, those of the highest bounds; their k-th score decides what else is read.
FIRST = 4
K1, B = 1.2, 0.75
#: Slabs whose bounds, and whose documents, a task holds; lanes of slabs at least; most queries they meet in a task;
#: most cells of a matrix; most words that are sent to all tasks.
BOUND_SLABS, SCORE_SLABS, LANES, BLOCK_QUERIES, CELLS, SENT_WORDS = 1_024, 64, 24, 2_000, 4_000_000, 100_000


def _place():
    """A slab of a batch in one word."""
    return F.concat_ws(" ", F.col("slab").cast("string"), "batch")


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _impacts():
    """Of a block's (count, length), those that no other one has both more and shorter."""
    pairs = F.array_sort(F.zip_with("tfs", "lens", lambda t, n: F.struct((-t).alias("less"), n.alias("len"))))
    kept = F.aggregate(pairs, F.expr("cast(array() as array<struct<less:int,len:int>>)"), lambda a, x: F.when((F.size(a) == 0) | (x["len"] < F.element_at(a, -1)["len"]), F.concat(a, F.array(x))).otherwise(a))
    return F.transform(kept, lambda x: F.struct((-x["less"]).alias("tf"), x["len"].alias("len")))


class InvertedIndex:
    """The index under ``path``; ``append`` adds documents by batch, ``search`` finds the best by BM25."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def batches(self) -> DataFrame:
        """batch, n, total: the batches that are whole."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], "batch string, n long, total long")
        return self.spark.read.schema("n long, total long, batch string").parquet(f"{self.path}/commits").select("batch", "n", "total")

    def _table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}").withColumn("batch", F.col("batch").cast("string"))
        return df.join(self.batches().select("batch"), "batch", "left_semi")

    def append(self, docs: DataFrame, batch: str) -> None:
        """Adds ``docs`` (id, text) as ``batch``; does nothing if that batch is whole already. Ids are new and unique.

        A null text has no words and counts as a document of length 0.
        """
        if not self.batches().filter(F.col("batch") == batch).isEmpty():
            return
        words = docs.select("id", F.coalesce(text.tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
        # lengths within an eighth or so go together; there are below 300 such classes
        words = words.withColumn("class", F.floor(F.log2(F.size("words") + 1.0) * 6).cast("int")).checkpoint()
        classes = words.groupBy("class").agg(F.ceil(F.count("*") / SLAB).alias("slabs"))
        before = F.sum("slabs").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
        classes = classes.select("class", "slabs", F.coalesce(before, F.lit(0)).alias("before"))
        words = words.join(F.broadcast(classes), "class").withColumn("slab", F.col("before") + F.pmod(F.xxhash64("id"), F.col("slabs")))
        def keep(df: DataFrame, table: str, *folders: str) -> None:
            # a broken batch's own folders are written anew, no others
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.path}/{table}")

        keep(words.select("id", F.size("words").cast("long").alias("len"), "slab", F.lit(batch).alias("batch")), "documents", "batch")
        # a slab's words come together once; both groupings follow from that
        each = words.repartition("slab").select("id", "slab", F.size("words").alias("len"), F.explode("words").alias("token")).groupBy("slab", "token", "id", "len").agg(F.count("*").cast("int").alias("tf"))
        entry = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
        blocks = each.groupBy("token", "slab").agg(entry.alias("e"))
        blocks = blocks.select(_bucket("token").alias("bucket"), "token", "slab", F.lit(batch).alias("batch"), F.col("e.id").alias("ids"), F.col("e.tf").alias("tfs"), F.col("e.len").alias("lens"))
        # a word's blocks lie together, so that readers skip what they don't ask for
        laid = blocks.repartition("bucket").sortWithinPartitions("bucket", "token", "slab")
        kept = laid.select("token", "slab", "ids", "tfs", "lens", "bucket", "batch")
        keep(kept, "postings", "bucket", "batch")
        # heads come from what was written, so that both agree
        made = self.spark.read.schema(kept.schema).parquet(f"{self.path}/postings").filter(F.col("batch").cast("string") == batch)
        heads = made.select("token", "slab", F.size("ids").alias("n"), _impacts().alias("impacts"), "bucket", F.lit(batch).alias("batch"))
        keep(heads, "heads", "bucket", "batch")
        size = self.spark.read.schema("len long, batch string").parquet(f"{self.path}/documents").filter(F.col("batch").cast("string") == batch)
        keep(size.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).withColumn("batch", F.lit(batch)), "commits", "batch")

    def documents(self) -> DataFrame:
        return self._table("documents").select("id", "len")

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        """(token, bucket, idf) of the words that are asked for and known, (query_id, terms) of queries with any, and the mean length."""
        totals = self.batches().agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        count, mean = totals["n"] or 0, (totals["total"] or 0) / max(totals["n"] or 0, 1)
        words = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).withColumn("bucket", _bucket("token"))
        df = self._table("heads").join(words.select("bucket", "token").distinct(), ["bucket", "token"]).groupBy("bucket", "token").agg(F.sum("n").alias("df"))
        rare = df.select("bucket", "token", F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).checkpoint()
        terms = words.join(rare, ["bucket", "token"]).groupBy("query_id").agg(F.collect_list(F.struct("token", "idf")).alias("terms")).checkpoint()
        return rare, terms, mean

    def _lanes(self, slabs: int) -> int:
        n = self.batches().agg(F.sum("n")).first()[0] or 0
        return max(LANES, -(-n // (SLAB * slabs)))

    def _bounds(self, rare: DataFrame, terms: DataFrame, mean: float) -> DataFrame:
        """query_id, batch, slab, bound: the most that a document of a slab can score, of slabs with any word of a query."""
        lanes, blocks = self._lanes(BOUND_SLABS), _blocks(terms)
        heads = self._table("heads").join(_sent(rare), ["bucket", "token"])
        left = heads.select(_deal(lanes, "batch", "slab").alias("_lane"), _every(blocks).alias("_block"), _place().alias("place"), "batch", "slab", "token", F.array_max(F.transform("impacts", lambda i: weight(F.lit(1.0), i["tf"], i["len"], mean))).alias("w"))
        right = terms.select(_every(lanes).alias("_lane"), _deal(blocks, "query_id").alias("_block"), "query_id", "terms")

        def bound(table: pa.Table, some: pa.Table) -> pa.Table:
            words = table["token"].combine_chunks().dictionary_encode()
            at = table["place"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.unique(at, return_index=True)[1]
            q, c, v = _joined(list(_products(some, words, at, table["w"].to_numpy(), len(first))))
            row = pa.array(first[c])
            return pa.table({"query_id": some["query_id"].take(pa.array(q)), "batch": table["batch"].take(row), "slab": table["slab"].take(row), "bound": pa.array(v)})

        kind = terms.schema["query_id"].dataType.simpleString()
        return left.groupBy("_lane", "_block").cogroup(right.groupBy("_lane", "_block")).applyInArrow(bound, f"query_id {kind}, batch string, slab long, bound double")

    def _scores(self, pairs: DataFrame, rare: DataFrame, terms: DataFrame, mean: float, scope: DataFrame | None) -> DataFrame:
        """query_id, id, score of the documents in some pairs of (query_id, batch, slab, least), none far below ``least``."""
        lanes, blocks = self._lanes(SCORE_SLABS), _blocks(terms)
        rows = self._table("postings").join(_sent(rare), ["bucket", "token"]).join(pairs.select("batch", "slab").distinct(), ["batch", "slab"], "left_semi")
        left = rows.select(_deal(lanes, "batch", "slab").alias("_lane"), _every(blocks).alias("_block"), _place().alias("place"), "token", "ids", F.zip_with("tfs", "lens", lambda t, n: weight(F.lit(1.0), t, n, mean)).alias("ws"))
        open_ = pairs.groupBy(_deal(lanes, "batch", "slab").alias("_lane"), "query_id").agg(F.collect_list(_place()).alias("open"), F.coalesce(F.first("least"), F.lit(0.0)).alias("least"))
        right = open_.join(terms, "query_id").select("_lane", _deal(blocks, "query_id").alias("_block"), "query_id", "open", "least", "terms")
        kinds = [terms.schema["query_id"].dataType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()]

        def score(table: pa.Table, some: pa.Table) -> pa.Table:
            lists = table["ids"].combine_chunks()
            long = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = lists.flatten().dictionary_encode()
            words = table["token"].combine_chunks().dictionary_encode()
            words = pa.DictionaryArray.from_arrays(words.indices.take(pa.array(np.repeat(np.arange(len(long)), long))), words.dictionary)
            places = table["place"].combine_chunks().dictionary_encode()
            at, opened = ids.indices.to_numpy(zero_copy_only=False), some["open"].combine_chunks()
            home = np.zeros(len(ids.dictionary), dtype=np.int64)
            home[at] = np.repeat(places.indices.to_numpy(zero_copy_only=False), long)
            place = pa.compute.index_in(opened.flatten(), value_set=places.dictionary).fill_null(len(places.dictionary)).to_numpy(zero_copy_only=False)
            may = np.zeros((len(some), len(places.dictionary) + 1), dtype=bool)
            may[np.repeat(np.arange(len(some)), opened.value_lengths().to_numpy(zero_copy_only=False)), place] = True
            least, out = some["least"].to_numpy(), []
            for q, c, v in _products(some, words, at, table["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False), len(home)):
                kept = may[q, home[c]] & (v >= least[q] - 1e-5)
                out.append((q[kept], c[kept], v[kept]))
            q, c, v = _joined(out)
            return pa.table({"query_id": some["query_id"].take(pa.array(q)), "id": ids.dictionary.take(pa.array(c)), "score": pa.array(v)})

        each = left.groupBy("_lane", "_block").cogroup(right.groupBy("_lane", "_block")).applyInArrow(score, f"query_id {kinds[0]}, id {kinds[1]}, score double")
        if scope is not None:
            each = each.join(scope.select("id").distinct(), "id", "left_semi")
        return each.withColumn("score", F.round("score", 6))

    def plan(self, queries: DataFrame, k: int, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float]:
        """Pairs of queries and slabs with ``read`` (whether they are read), the scores of the first slabs, and the mean length."""
        rare, terms, mean = self._asked(queries)
        return (*self._planned(rare, terms, mean, k, scope), mean)

    def _planned(self, rare: DataFrame, terms: DataFrame, mean: float, k: int, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        bounds = self._bounds(rare, terms, mean).checkpoint()
        slab = ["query_id", "batch", "slab"]
        first = top(bounds, FIRST, F.desc("bound"), F.asc("batch"), F.asc("slab")).select(*slab, F.lit(True).alias("first")).checkpoint()
        scores = self._scores(first.withColumn("least", F.lit(None).cast("double")), rare, terms, mean, scope).checkpoint()
        # documents below the k-th score found so far can't come in, nor can slabs whose words together stay below it
        least = top(scores, k, F.desc("score"), F.asc("id")).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found")).filter(F.col("found") >= k).select("query_id", "least")
        wanted = bounds.join(first, slab, "left").join(least, "query_id", "left").select(*slab, "least", F.coalesce("first", F.lit(False)).alias("first"), (F.col("first").isNotNull() | F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).alias("read"))
        return wanted, scores

    def search(self, queries: DataFrame, k: int, *, scope: DataFrame | None = None, ties: bool = False) -> DataFrame:
        """query_id, rank, id, score: the best k by BM25, ties to the smaller id (with ``ties``, all of the k-th score, unranked).

        ``queries``: query_id, text. A query without known words finds nothing. ``scope`` has the ids that
        may answer; a word's rarity stays that of all documents.
        """
        if self.batches().filter("total > 0").isEmpty():
            return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
        rare, terms, mean = self._asked(queries)
        pairs, scores = self._planned(rare, terms, mean, k, scope)
        rest = self._scores(pairs.filter("read and not first"), rare, terms, mean, scope)
        every = scores.unionByName(rest)
        if ties:
            # rank() keeps all rows of the k-th score
            return top(every, k, F.desc("score"), rank=F.rank()).select("query_id", "id", "score")
        return top(every, k, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score")


def _deal(n: int, *key: str):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _blocks(terms: DataFrame) -> int:
    return max(1, -(-terms.count() // BLOCK_QUERIES))


def _sent(rare: DataFrame) -> DataFrame:
    """The words that are asked for, sent to all tasks where they are few."""
    return F.broadcast(rare) if rare.count() <= SENT_WORDS else rare


def _joined(pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole, none = np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip((whole, whole, none), *pieces, strict=True))


def _products(some: pa.Table, words: pa.DictionaryArray, column: np.ndarray, share: np.ndarray, n: int, least: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, column, value) of what is above 0, or a query's ``least``, in queries times columns, in pieces: ``words``, ``column`` and ``share`` of each entry."""
    if not len(some) or not len(words):
        return
    lists = some["terms"].combine_chunks()
    term, size = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    code = pa.compute.index_in(term.field("token"), value_set=words.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    known = code >= 0
    asks, code, idf = np.repeat(np.arange(len(size)), size)[known], code[known], term.field("idf").to_numpy(zero_copy_only=False)[known]
    order = np.argsort(column, kind="stable")
    word, column, share = words.indices.to_numpy(zero_copy_only=False)[order], column[order], share[order]
    width = len(words.dictionary)
    step = max(1, CELLS // width)
    for c in range(0, n, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        table = np.zeros((width, min(step, n - c)))
        table[word[lo:hi], column[lo:hi] - c] = share[lo:hi]
        rows = max(1, min(step, CELLS // table.shape[1]))
        for q in range(0, len(size), rows):
            first, last = np.searchsorted(asks, [q, q + rows])
            mine = np.zeros((min(rows, len(size) - q), width))
            mine[asks[first:last] - q, code[first:last]] = idf[first:last]
            value = mine @ table
            i, j = np.nonzero(value > (0 if least is None else least[q : q + rows, None]))
            yield i + q, j + c, value[i, j]


def weight(idf, tf, length, mean: float):
    """BM25's share of one word; it grows with the count and falls with the length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean or 1.0))))
