"""Stores that change in place: read back, done twice, broken off; and provider hooks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import providers, rebuild, traces
from sessionloom.sources import tables
from sessionloom.sources.store import TableStore


@pytest.fixture(autouse=True)
def _checkpoints(spark):
    tables.ensure_checkpoint_dir(spark)


def path(spark, name):
    return f"{tables.shared_dir(spark)}/{name}-{random.randrange(1 << 40)}"


def rows(df):
    return sorted(map(tuple, df.collect()))


def labels(spark, its):
    return spark.createDataFrame(its, "id int, v int, at int")


def test_upserts_are_read_back_and_done_twice(spark):
    store = TableStore(spark, path(spark, "up"), {"t": ["id"]}, buckets=4)
    assert store.read("t") is None
    store.upsert("t", labels(spark, [(i, i, 0) for i in range(20)]), ["id"])
    new = labels(spark, [(3, 30, 1), (3, 31, 2), (99, 1, 1)])
    want = sorted([(i, i, 0) for i in range(20) if i != 3] + [(3, 31, 2), (99, 1, 1)])
    for _ in range(2):
        store.upsert("t", new, ["id"], "at")
        assert rows(store.read("t")) == want
    with pytest.raises(ValueError):
        store.upsert("t", new, ["v"])


def test_buckets_without_new_keys_are_not_written(spark):
    store = TableStore(spark, path(spark, "few"), {"t": ["id"]}, buckets=8)
    store.replace({"t": labels(spark, [(i, 0, 0) for i in range(100)])})
    before = store._state()["t"]
    store.upsert("t", labels(spark, [(7, 1, 1)]), ["id"])
    after = store._state()["t"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("t").count() == 100


def test_a_run_that_dies_leaves_the_old_rows_in_every_table(spark, monkeypatch):
    store = TableStore(spark, path(spark, "die"), {"a": ["session_id"], "b": ["session_id"]}, buckets=4)
    data = spark.range(60).select((F.col("id") % 6).alias("session_id"), "id")
    store.replace({"a": data, "b": data})
    gone = spark.createDataFrame([(2,), (5,)], "session_id long")
    real, calls = TableStore._write, []

    def dies(self, name, df, version):
        calls.append(name)
        real(self, name, df, version)
        if len(calls) == 2:
            raise RuntimeError("stopped")

    monkeypatch.setattr(TableStore, "_write", dies)
    with pytest.raises(RuntimeError):
        store.delete(["a", "b"], gone)
    assert store.read("a").count() == store.read("b").count() == 60  # new rows of both lie there, but don't count
    monkeypatch.setattr(TableStore, "_write", real)
    for _ in range(2):
        store.delete(["a", "b"], gone)
        assert rows(store.read("a")) == rows(store.read("b")) == rows(data.filter("session_id not in (2, 5)"))
    store.purge(["a", "b"], {"b"}, spark.createDataFrame([(1,)], "session_id long"))
    assert store.read("a").count() == 40 and store.read("b").count() == 30
    store.delete(["a"], data)
    assert store.read("a") is None or store.read("a").isEmpty()


def events(spark, seed, n=240, sessions=5):
    r = random.Random(seed)
    its = [(f"s{r.randrange(sessions)}", i, float(r.randrange(0, 60_000)), r.choice(["focus_change", "url_change", "key_down", "mouse_down", "mouse_up", "scroll", "bookmark"])) for i in range(n)]
    its = [(*x, f"app{x[1] % 3}" if x[3] == "focus_change" else None, f"https://www.h{x[1] % 2}.example/d" if x[3] == "url_change" else None, float(x[1] % 90), float(x[1] % 70), "k" if x[3] == "key_down" else None) for x in its]
    return spark.createDataFrame(its, "session_id string, event_id long, t double, kind string, app string, url string, x double, y double, char string")


def test_a_graph_kept_by_batch_is_the_graph_built_at_once(spark, monkeypatch):
    ev = events(spark, 1)
    whole = rebuild.lift(ev, ["app2"])
    store = rebuild.GraphStore(spark, path(spark, "graph"))
    early, late = ev.filter("t < 30000"), ev.filter("session_id in ('s0', 's3')")
    store.apply(rebuild.lift(early, ["app2"]), early.select("session_id"), 0)
    before = rows(store.edges())
    real = rebuild.GraphStore._put

    def dies(self, df, table, batch):
        if table == "commits":
            raise RuntimeError("stopped")
        real(self, df, table, batch)

    monkeypatch.setattr(rebuild.GraphStore, "_put", dies)
    with pytest.raises(RuntimeError):
        store.apply(rebuild.lift(late, ["app2"]), late.select("session_id"), 1)
    assert store.version() == 0 and rows(store.edges()) == before
    monkeypatch.setattr(rebuild.GraphStore, "_put", real)
    store.apply(rebuild.lift(late, ["app2"]), late.select("session_id"), 1)
    store.apply(rebuild.lift(ev.filter("session_id = 's1'"), ["app2"]), ev.filter("session_id = 's1'").select("session_id"), 1)  # that number is done
    rest = ev.filter("session_id not in ('s0', 's3')")
    store.apply(rebuild.lift(rest, ["app2"]), rest.select("session_id"), 2)
    assert rows(store.edges()) == rows(rebuild.merged_edges(whole.steps))
    assert rows(store.nodes()) == rows(rebuild.merged_nodes(whole.visits))


def test_a_session_lifted_by_hand(spark):
    its = [("a", 1, 0.0, "focus_change", "Mail", None, 0.0, 0.0, None), ("a", 2, 100.0, "mouse_down", None, None, 10.0, 10.0, None), ("a", 3, 150.0, "mouse_up", None, None, 10.0, 11.0, None),
           ("a", 4, 200.0, "key_down", None, None, 0.0, 0.0, "h"), ("a", 5, 300.0, "key_down", None, None, 0.0, 0.0, "i"), ("a", 6, 400.0, "focus_change", "Web", None, 0.0, 0.0, None),
           ("a", 7, 450.0, "url_change", None, "https://x.example/docs", 0.0, 0.0, None), ("b", 8, 0.0, "focus_change", "Own", None, 0.0, 0.0, None), ("b", 9, 5.0, "scroll", None, None, 0.0, 0.0, None)]
    ev = spark.createDataFrame(its, "session_id string, event_id long, t double, kind string, app string, url string, x double, y double, char string")
    elements = spark.createDataFrame([("k1", 0, None, "AXWindow", "", "", 0, False), ("k1", 1, 0, "AXButton", "Send", "", 1, False), ("k1", 2, 0, "AXTextField", "To", "to", 1, True)], "snapshot_id string, idx int, parent int, role string, label string, identifier string, depth int, focused boolean")
    shots = spark.createDataFrame([("a", 0.0, 1, "k1")], "session_id string, t double, event_id long, snapshot_id string")
    hit = spark.createDataFrame([(2, "AXWindow[0]>AXButton[0]", "Send", "ax_exists(label=Send,role=Button)")], "event_id long, path string, label string, target string")
    got = rebuild.lift(ev, ["own"], snapshots=shots, elements=elements, anchors=hit)
    steps = got.steps.orderBy("n").collect()
    assert [(r.n, r.signature, r.n_actions) for r in steps] == [(0, "click:ax:AXWindow[0]>AXButton[0]:Send:left:1|type", 2), (1, "", 0)]
    assert [r.label for r in got.visits.orderBy("n").collect()][0] == "Mail — to" and got.visits.count() == 3
    assert rows(got.samples) == [("a", "ax:AXWindow[0]>AXButton[0]:Send", "hi")]
    assert {r.session_id: (r.kept, r.dropped, r.skipped) for r in got.report.collect()} == {"a": (7, 0, False), "b": (0, 2, True)}
    # what was clicked, and focus where text was typed, belong to the first state; other elements don't
    keys = "\x01".join(sorted(["app(app=Mail)", "ax_exists(label=Send,role=Button)", "ax_focused(identifier=to,role=TextField)"]))
    assert got.visits.filter("n = 0").select("state").first()[0] == spark.range(1).select(F.sha2(F.lit(keys), 256)).first()[0]


def _lengths():
    made = {"calls": 0}

    def call(texts, role):
        made["calls"] += 1
        assert len(texts) <= 4
        return [[len(t), 1.0 if role == "query" else 0.0, made["calls"]] for t in texts]

    return call


def test_text_providers_are_batched_and_checked(spark):
    p = providers.Provider("test", "len", 3, _lengths, batch=4)
    df = spark.createDataFrame([(i, "x" * i) for i in range(11)] + [(50, None)], "id int, text string").coalesce(1)
    got = {r.id: r for r in providers.embed(df, p, "digest", role="query").collect()}
    assert len(got) == 11 and got[5].v[:2] == [5.0, 1.0] and got[5].namespace == "digest:test:len:3"
    assert max(r.v[2] for r in got.values()) == 3.0  # made once for the task, called for each batch
    stored = spark.createDataFrame([("digest:test:len:3",), ("other:x:y:9",)], "namespace string")
    providers.check_namespaces(stored, p, "digest")
    with pytest.raises(ValueError, match="is stored"):
        providers.check_namespaces(stored, providers.Provider("test", "len2", 3, _lengths), "digest")
    with pytest.raises(ValueError, match="colon"):
        p.namespace("a:b")
    with pytest.raises(ValueError, match="no role"):
        providers.embed(df, p, "digest", role="title")
    with pytest.raises(Exception, match="gave"):
        providers.embed(df, providers.Provider("test", "len", 4, _lengths, batch=4), "digest").collect()
    assert providers.embed(df.limit(0), p, "digest").isEmpty()


def test_rerank_and_visual_providers(spark):
    hits = spark.createDataFrame([(1, 1, "q", "aaa"), (1, 2, "q", "a"), (1, 3, "q", None), (1, 4, "q", "bbb")], "query_id int, id int, query string, text string")
    scorer = providers.Provider("test", "rr", 0, lambda: lambda pairs: [len(t) for _, t in pairs], batch=2)
    assert [r.id for r in providers.rerank(hits, scorer).orderBy("rank").collect()] == [1, 4, 2, 3]
    eye = providers.Provider("test", "eye", 2, lambda: lambda images, role: [[float(b[0]), float(b[1])] for b in images])
    images = lambda its: spark.createDataFrame([(i, bytearray(b)) for i, b in its], "id int, image binary")
    got = providers.visual_match(images([(1, b"\x01\x00"), (2, b"\x05\x05")]), images([(7, b"\x09\x00"), (8, b"\x00\x09"), (9, b"\x09\x01")]), eye, least=0.9, margin=0.001).collect()
    assert {r.query_id: (r.match, r.verdict) for r in got} == {1: (7, "match"), 2: (None, "none")}


def test_what_a_predicate_says(spark):
    cases = {"app(app=Mail)": "Mail", "url(prefix=a.example/x)": "a.example/x", "ax_focused(identifier=to,role=TextField)": "to", "ax_exists(label=a, b (c),role=Button)": "a, b (c)"}
    df = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: r.v for r in df.select("k", traces.predicate_value(F.col("k")).alias("v")).collect()} == cases


def test_vectors_stay_finite(spark):
    bad = providers.Provider("test", "nan", 1, lambda: lambda texts, role: [[np.nan]] * len(texts))
    with pytest.raises(Exception, match="not finite"):
        providers.embed(spark.createDataFrame([(1, "x")], "id int, text string"), bad, "digest").collect()
