"""Queries over upkeep of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sessionloom.operators import providers
from sessionloom.plans.registry import query
from sessionloom.sources import fixtures as fx
from sessionloom.sources import tables
from sessionloom.sources.store import TableStore


def _store(spark, **by):
    """A new store in the shared folder; results read it."""
    return TableStore(spark, f"{tables.shared_dir(spark)}/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}", by, buckets=8)


@query("s4_namespaces", "SELECT vec_id, 'digest:fixture:emb:' || len(embedding) AS namespace, 'digest' AS view, len(embedding)::INTEGER AS dims FROM embeddings")
def namespaces(spark, d):
    rows = fx.table(spark, d, "embeddings").withColumn("namespace", tables.namespace(F.lit("digest"), F.lit("fixture"), F.lit("emb"), F.size("embedding")))
    parts = tables.namespace_parts(F.col("namespace"))
    return rows.select("vec_id", "namespace", parts["view"].alias("view"), parts["dims"].alias("dims"))


@query("s5_upsert", "SELECT doc_id, quality, 0 AS version FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1 - quality, 2 FROM labels WHERE doc_id % 3 = 0")
def upsert(spark, d):
    old = fx.table(spark, d, "labels").select("doc_id", "quality", F.lit(0).alias("version"))
    third = old.filter("doc_id % 3 = 0")
    new = third.select("doc_id", "quality", F.lit(1).alias("version")).unionByName(third.select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(2).alias("version")))
    store = _store(spark, labels=["doc_id"])
    store.replace({"labels": old})
    for _ in range(2):  # the second time changes nothing
        store.upsert("labels", new, ["doc_id"], "version")
    return store.read("labels")


@query("s6_reconcile", "SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT 2 * doc_id FROM labels) UNION ALL SELECT 2 * doc_id, 'orphan' FROM labels WHERE 2 * doc_id NOT IN (SELECT doc_id FROM documents)")
def reconcile(spark, d):
    """Labels under twice their number: some name no document, some documents have none."""
    return tables.reconcile(fx.table(spark, d, "documents").select("doc_id"), fx.table(spark, d, "labels").select((2 * F.col("doc_id")).alias("doc_id")), "doc_id")


@query("s7_reembed_missing", "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS n_tokens FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reembed(spark, d):
    docs = fx.table(spark, d, "documents")
    missing = tables.reconcile(docs.select("doc_id"), fx.table(spark, d, "labels").select("doc_id"), "doc_id").filter("problem = 'missing'")
    store = _store(spark, vectors=["namespace", "doc_id"])
    made = providers.embed(docs.join(missing, "doc_id", "left_semi"), COUNTER, "digest", id_col="doc_id").withColumnRenamed("id", "doc_id")
    store.upsert("vectors", made, ["namespace", "doc_id"])
    providers.check_namespaces(store.read("vectors"), COUNTER, "digest")
    return store.read("vectors").select("doc_id", F.col("v")[0].cast("long").alias("n_tokens"))


def _count_words():
    import re

    return lambda texts, role: [[float(len(re.findall("[a-z0-9]+", t.lower()))), 1.0] for t in texts]


#: Stands for a model: the number of words and a constant.
COUNTER = providers.Provider("fixture", "words", 2, _count_words)


@query("s8_cascade_delete", f"WITH {fx.EV} SELECT 'events' AS name, count(*) AS n FROM ev WHERE session_id % 10 <> 3 UNION ALL SELECT 'frames', count(*) FROM ev WHERE session_id % 10 <> 3 AND event_id % 5 = 0")
def cascade(spark, d):
    ev = fx.events(spark, d)
    store = _store(spark, events=["session_id"], frames=["session_id"])
    store.replace({"events": ev, "frames": fx.frames(ev)})
    for _ in range(2):
        store.delete(["events", "frames"], ev.filter("session_id % 10 = 3").select("session_id").distinct())
    left = {name: store.read(name) for name in store.by}
    return left["events"].agg(F.lit("events").alias("name"), F.count("*").alias("n")).unionByName(left["frames"].agg(F.lit("frames").alias("name"), F.count("*").alias("n")))


@query("s9_purge_derived", f"WITH {fx.EV} SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'segments', count(*) FROM ev WHERE session_id % 10 <> 3 AND kind = 'bookmark'")
def purge(spark, d):
    ev = fx.events(spark, d)
    gone = ev.filter("session_id % 10 = 3").select("session_id")
    store = _store(spark, events=["session_id"], segments=["session_id"])
    store.replace({"events": ev, "segments": ev.filter("kind = 'bookmark'")})
    for _ in range(2):
        store.purge(["events", "segments"], {"segments"}, gone)
    twice = {name: store.read(name) for name in store.by}
    return twice["events"].agg(F.lit("events").alias("name"), F.count("*").alias("n")).unionByName(twice["segments"].agg(F.lit("segments").alias("name"), F.count("*").alias("n")))


_CAT = "s AS (SELECT user_id AS session_id, epoch_us(min(ts)) AS started_at, epoch_us(max(ts)) AS ended_at FROM events GROUP BY user_id)"


@query("s10_catalogue", f"WITH {fx.EV}, {_CAT} SELECT session_id, started_at, ended_at, count(ev.event_id) AS n_events, count(ev.event_id) FILTER (WHERE event_id % 5 = 0) AS n_frames, count(ev.event_id) FILTER (WHERE kind = 'bookmark') AS n_segments, ended_at - started_at AS duration FROM s LEFT JOIN ev USING (session_id) GROUP BY ALL")
def catalogue(spark, d):
    ev = fx.events(spark, d)
    raw = fx.table(spark, d, "events")
    sessions = raw.groupBy(F.col("user_id").alias("session_id")).agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("started_at"), F.unix_micros(F.max("ts").cast("timestamp")).alias("ended_at"))
    return tables.catalogue(sessions, {"events": ev, "frames": fx.frames(ev), "segments": ev.filter("kind = 'bookmark'")})


@query("s11_catalogue_with_purpose", f"WITH {fx.EV}, {_CAT}, p AS (SELECT session_id, max_by(app, (us, event_id)) AS purpose FROM ev WHERE app IS NOT NULL GROUP BY session_id), b AS (SELECT session_id, sum(k)::BIGINT AS bytes FROM ev GROUP BY session_id) SELECT session_id, started_at, ended_at, bytes, purpose, greatest(0, ended_at - started_at) AS duration FROM s LEFT JOIN p USING (session_id) LEFT JOIN b USING (session_id)")
def purposes(spark, d):
    ev = fx.events(spark, d)
    raw = fx.table(spark, d, "events")
    sessions = raw.groupBy(F.col("user_id").alias("session_id")).agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("started_at"), F.unix_micros(F.max("ts").cast("timestamp")).alias("ended_at"))
    purpose = ev.filter("app is not null").groupBy("session_id").agg(F.max_by("app", F.struct("t", "event_id")).alias("purpose"))
    return tables.catalogue(sessions, {}, ev.select("session_id", F.col("k").cast("long").alias("bytes")), purpose)
