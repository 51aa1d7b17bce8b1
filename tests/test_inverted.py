"""The stored index against BM25 over the table, by batch and with a batch that was broken off."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import inverted, lexical
from sessionloom.sources.tables import ensure_checkpoint_dir, shared_dir


@pytest.fixture(autouse=True)
def _checkpoints(spark):
    ensure_checkpoint_dir(spark)


@pytest.fixture
def index(spark, request):
    return inverted.InvertedIndex(spark, f"{shared_dir(spark)}/index-{request.node.name}-{random.randrange(1 << 40)}")


def texts(spark, n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words[: r.choice([10, 60, 300])]) for _ in range(r.choice([1, 5, 30, 90])))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "w1 W1 w1, w250!")]
    return spark.createDataFrame(rows, "id long, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w3 w250"), (2, "w299, w1; w7 w7"), (3, "unknown"), (4, ""), (5, None), (6, "w4"), (7, "w280 w281 w282")], "query_id int, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())


def test_search_is_bm25_and_reads_less(spark, index):
    docs = texts(spark, 900)
    index.append(docs, "one")
    for k in (1, 5, 40):
        assert rows(index.search(asked(spark), k)) == rows(lexical.bm25(docs.na.fill(""), asked(spark), k))
    blocks, _, _ = index.plan(asked(spark), 5)
    found = blocks.groupBy("query_id").agg(F.count("*").alias("all"), F.sum(F.col("read").cast("int")).alias("read")).collect()
    assert sum(r["read"] for r in found) < 0.8 * sum(r["all"] for r in found)


def test_queries_meet_slabs_once_in_blocks_of_any_size(spark, index, monkeypatch):
    docs = texts(spark, 150)
    index.append(docs, "one")
    pairs, _, _ = index.plan(asked(spark), 4)
    assert pairs.count() == pairs.select("query_id", "batch", "slab").distinct().count()  # not a row a word
    for name, value in (("BLOCK_QUERIES", 2), ("CELLS", 7), ("SCORE_SLABS", 1), ("LANES", 2), ("SENT_WORDS", 0)):
        monkeypatch.setattr(inverted, name, value)
    assert rows(index.search(asked(spark), 4)) == rows(lexical.bm25(docs.na.fill(""), asked(spark), 4))


def test_batches_add_up(spark, index):
    docs = texts(spark, 300)
    for i in range(3):
        index.append(docs.filter(F.col("id") % 3 == i), f"b{i}")
        index.append(docs.filter(F.col("id") % 3 == i), f"b{i}")  # a batch comes once
    assert index.batches().count() == 3 and index.documents().count() == docs.count()
    assert rows(index.search(asked(spark), 7)) == rows(lexical.bm25(docs.na.fill(""), asked(spark), 7))


def test_a_batch_that_was_broken_off_does_not_count(spark, index, monkeypatch):
    docs = texts(spark, 120)
    index.append(docs.filter("id < 60"), "a")
    before = rows(index.search(asked(spark), 5))
    real = inverted._impacts
    monkeypatch.setattr(inverted, "_impacts", lambda: 1 / 0)  # after the postings, before the heads
    with pytest.raises(ZeroDivisionError):
        index.append(docs.filter("id >= 60"), "b")
    assert rows(index.search(asked(spark), 5)) == before
    monkeypatch.setattr(inverted, "_impacts", real)
    index.append(docs.filter("id >= 60"), "b")
    assert rows(index.search(asked(spark), 5)) == rows(lexical.bm25(docs.na.fill(""), asked(spark), 5))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_scope_and_ties(spark, index):
    docs = texts(spark, 200)
    index.append(docs, "one")
    scope = docs.filter("id % 4 = 1")
    assert rows(index.search(asked(spark), 6, scope=scope)) == rows(lexical.bm25(docs.na.fill(""), asked(spark), 6, scope=scope))
    twins = spark.createDataFrame([(i, "same words") for i in range(50)], "id long, text string")
    other = inverted.InvertedIndex(spark, index.path + "-twins")
    other.append(twins, "x")
    query = spark.createDataFrame([(1, "same")], "query_id int, text string")
    assert other.search(query, 3, ties=True).count() == 50 and [r.id for r in other.search(query, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_an_empty_index_finds_nothing(spark, index):
    assert index.batches().isEmpty()
    index.append(texts(spark, 0).limit(0), "none")
    assert index.search(asked(spark), 3).isEmpty()
    assert inverted.InvertedIndex(spark, index.path + "-none").batches().isEmpty()
