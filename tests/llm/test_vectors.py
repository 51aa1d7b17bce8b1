import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import common, covertree, graph, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, x, "clash", 1) for i, e, x in rows], SCHEMA)


def odd(rng, n=60, dim=6):
    base = rng.normal(size=(5, dim))
    rows = [(i, [float(np.float32(x)) for x in base[i % 5] + rng.normal(size=dim) * (0.05 if i % 3 else 0.6)], int(i % 2)) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [1.0] * (dim - 1) + [None], 0), (n + 3, [float("nan")] * dim, 1), (n + 4, [float("inf")] + [1.0] * (dim - 1), 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1], rows[0][2]), (n + 7, [2 * x for x in rows[0][1]], rows[0][2]), (n + 8, rows[0][1][:-1], rows[0][2])]
    return rows


def good(e):
    return e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)


@pytest.mark.parametrize("leaf_rows", [4, 16, 2048])
def test_near_duplicates_match_all_pairs(spark, leaf_rows):
    rows = odd(np.random.default_rng(leaf_rows))
    got = {r.vec_id: r for r in covertree.near_duplicates(table(spark, rows), leaf_rows=leaf_rows, fan=3).collect()}
    ok = [(i, np.array(e, float), x) for i, e, x in rows if good(e) and any(e) and x is not None]
    links = {i: set() for i, _, _ in rows}
    for i, a, x in ok:
        for j, b, y in ok:
            if i != j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)
    assert len(got) == len(rows)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i), i


def test_rows_without_an_id_and_scratch_tables(spark):
    rows = [(None, [1.0, 0.0], 0), (None, [1.0, 0.0], None), (3, [1.0, 0.0], 0), (4, [1.0, 0.001], 0), (5, None, 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in covertree.near_duplicates(table(spark, rows)).collect())
    assert got == [("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "5", True), ("None", 0, "None", True), ("None", 0, "None", True)]
    kept = common.stored(spark.range(3))
    assert kept.count() == 3
    common.clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_near_duplicates_of_nothing(spark):
    assert covertree.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("k", [3, 500])
def test_top_k_matches_all_scores(spark, k):
    rows = odd(np.random.default_rng(3), 120)
    rows += [(200 + i, rows[7][1], 0) for i in range(9)]  # ties
    got = [tuple(r) for r in topk.top_k(topk.quantised(table(spark, rows)), F.col("vec_id") % 10 == 0, k, rows_per_block=16, queries_per_block=4, lanes=3).orderBy("query_id", "rank").collect()]
    v = {i: [math.floor(1024 * float(x)) for x in e] for i, e, _ in rows if good(e)}
    want = []
    for q in sorted(v):
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:k]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(topk.quantised(table(spark, [])), F.col("vec_id") % 10 == 0, 3).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_top_k_of_wide_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 768)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0, "", 1) for i, x in enumerate(v)], SCHEMA)
    got = {}
    for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 100 == 0, 3, rows_per_block=128, queries_per_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(1024 * v.astype(float)).astype(np.int64)
    for q in range(0, 600, 100):
        scores = whole @ whole[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[i], i))[:3]
        assert got[q] == [(i, int(scores[i])) for i in best]


def test_blocks_are_never_broadcast(spark):
    """query blocks, once a lane, were broadcast through the driver where their file is small."""
    rows = [(i, [float((i * 7 + j * j * i) % 13) - 6 for j in range(3)]) for i in range(90)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = topk.top_k(vectors, F.col("vec_id") % 10 == 0, 4, rows_per_block=16, queries_per_block=4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 36
