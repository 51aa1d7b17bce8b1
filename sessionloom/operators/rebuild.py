"""The state graph from events: one job over all sessions, and a store that keeps it up by batch.

The job: stretches of excluded apps go (F8); boundaries cut what is left (G1); each is a node that asserts
the app and place then in force and its snapshot's elements (J4, J9, M1); what happens between two
boundaries is an edge's actions (G6, G10, M3, M5), with the text typed into each slot (M7) and a signature
(M8); a node is what its identity predicates say (M6), nodes and edges that are the same are counted once
with what they were seen in (M9), and each state has a label (M13).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import segments, slices, temporal, traces
from sessionloom.sources.tables import ensure_checkpoint_dir

GAPS = ("dwell_gap", "burst_gap")


@dataclass
class Lifted:
    """What sessions add to the graph. visits: session_id, n, t, state, label. steps: session_id, n, from_state, to_state,
    signature, n_actions. samples: slot, text. report: session_id, kept, dropped, apps, n_edges, skipped."""

    visits: DataFrame
    steps: DataFrame
    samples: DataFrame
    report: DataFrame


def _actions(kept: DataFrame, anchors: DataFrame | None, typed_gap_ms: float, display: str) -> tuple[DataFrame, DataFrame]:
    """(session_id, t, ord, kind, anchor_key, ...) of what was done, and (session_id, slot, text) of what was typed."""
    known = kept.join(anchors.select("event_id", "path", "label", "target"), "event_id", "left") if anchors is not None else kept.withColumns({c: F.lit(None).cast("string") for c in ("path", "label", "target")})
    at = lambda x, y: traces.anchor_key(F.col("path"), F.col("label"), F.lit(display), x, y)
    columns = set(kept.columns)
    extra = {"button": F.col("button").cast("string") if "button" in columns else F.lit("left"), "dx": F.col("dx") if "dx" in columns else F.lit(0), "dy": F.col("dy") if "dy" in columns else F.lit(0), "chord": F.col("chord").cast("string") if "chord" in columns else F.lit(None).cast("string"), "char": F.col("char") if "char" in columns else F.lit(None).cast("string")}
    rows = known.withColumns(extra)
    shape = lambda df, kind, key, to=None, keys=None: df.select("session_id", "t", F.col("event_id").alias("ord"), kind.alias("kind"), key.alias("anchor_key"), (F.lit(None).cast("string") if to is None else to).alias("to_key"), "button", F.lit(1).alias("count"), "dx", "dy", (F.lit(None).cast("array<string>") if keys is None else keys).alias("keys"), F.lit(None).cast("string").alias("until"), "target")
    met = segments.clicks(kept).select("event_id", "gesture", "up_x", "up_y")
    to = F.when(F.col("gesture") == "drag", traces.anchor_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(display), F.col("up_x"), F.col("up_y")))
    down = shape(rows.join(met, "event_id"), F.col("gesture"), at(F.col("x"), F.col("y")), to)
    scroll = shape(rows.filter("kind = 'scroll'"), F.lit("scroll"), at(F.col("x"), F.col("y")))
    chord = shape(rows.filter("kind = 'key_down' and length(chord) > 0"), F.lit("chord"), F.lit(None).cast("string"), keys=F.split("chord", r"\+"))
    keys = rows.withColumns({"chord": F.length("chord") > 0, "backspace": F.lit(False) if "backspace" not in columns else F.col("backspace")})
    runs = segments.typed_runs(keys, gap_ms=typed_gap_ms).select("session_id", F.col("t_start").alias("t"), F.col("run_no").cast("long").alias("event_id"), "text")
    # text goes to where the pointer last was pressed
    runs = temporal.asof(runs, down.select("session_id", "t", F.col("ord").alias("event_id"), "anchor_key", "target"), ["anchor_key", "target"])
    typed = shape(runs.withColumns({"button": F.lit("left"), "dx": F.lit(0), "dy": F.lit(0)}), F.lit("type"), F.col("anchor_key"))
    samples = runs.select("session_id", F.coalesce("anchor_key", F.lit("none")).alias("slot"), "text")
    return down.unionByName(scroll).unionByName(chord).unionByName(typed), samples


def lift(
    ev: DataFrame, apps: list[str], *, dwell_ms: float = segments.DWELL_MS, burst_ms: float = segments.BURST_MS, typed_gap_ms: float = segments.DWELL_MS, display: str = "D0",
    snapshots: DataFrame | None = None, elements: DataFrame | None = None, anchors: DataFrame | None = None, slice: float | None = None,
) -> Lifted:
    """Lifts every session of ``ev`` (session_id, event_id, t, kind, app, url, x, y; char, chord, button, dx, dy if there are any).

    ``apps`` are left out with all that happened while they had focus; a session of which nothing stays
    is skipped. ``snapshots``: session_id, t, event_id, snapshot_id, with ``elements`` of each (as M1 takes
    them); ``anchors``: event_id, path, label and target, the predicate key of the element that was hit.
    """
    ensure_checkpoint_dir(ev.sparkSession)
    marked = temporal.exclude_focused(ev, apps, slice=slice)
    kept = marked.filter("not excluded").drop("excluded", "unattributable").checkpoint()  # five steps read it
    spans = kept.groupBy("session_id").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    bounds = segments.boundaries(kept, spans, dwell_ms=dwell_ms, burst_ms=burst_ms, slice=slice)
    cuts = slices.numbered(bounds, "n", [], session="session_id", t="t", slice=slice).withColumn("n", F.col("n") - 1).checkpoint()
    node = F.concat_ws(":", F.col("session_id").cast("string"), F.col("n").cast("string"))

    # what each node asserts
    context = temporal.focus_context(kept, slice=slice).select("session_id", "t", "event_id", F.col("focus_app").alias("app"), F.col("focus_url").alias("url"))
    seen = temporal.asof(cuts, context, ["app", "url"], slice=slice).withColumn("snapshot_id", node)
    around = seen.select("snapshot_id", "app", "url", F.lit(None).cast("array<struct<id:string,w:int,h:int>>").alias("displays"), F.lit(None).cast("array<string>").alias("files"))
    if snapshots is None:
        observed = traces.context_predicates(around).select("snapshot_id", "kind", "key")
    else:
        shown = temporal.asof(cuts.withColumn("node_id", node), snapshots.withColumnRenamed("snapshot_id", "shot"), ["shot"], slice=slice).select("node_id", F.col("shot").alias("snapshot_id"))
        own = elements.join(shown, "snapshot_id").drop("snapshot_id").withColumnRenamed("node_id", "snapshot_id")
        observed = traces.predicates(own, around).select("snapshot_id", "kind", "key")
    observed = observed.withColumnRenamed("snapshot_id", "node_id").checkpoint()

    # what was done between two nodes
    edges = slices.carried(cuts, {"t_end": F.struct("t", "reason")}, [], session="session_id", t="t", slice=slice, own=False, ahead=True)
    edges = edges.filter("t_end is not null").select("session_id", "n", F.col("t").alias("t_start"), F.col("t_end.t").alias("t_end"), F.col("t_end.reason").alias("reason"))
    last = edges.join(spans.select("session_id", F.col("t_end").alias("_last")), "session_id").checkpoint()
    actions, samples = _actions(kept, anchors, typed_gap_ms, display)
    inside = temporal.interval_join(actions, last.select("session_id", "n", "t_start", "t_end", "_last"), closed_at="_last").drop("t_start", "t_end", "_last")
    name = lambda shift=0: F.concat_ws(":", F.col("session_id").cast("string"), (F.col("n") + shift).cast("string"))
    waiting = last.filter(F.col("reason").isin(*GAPS))
    state = lambda shift: waiting.select("session_id", "n", name(shift).alias("node_id")).join(observed, "node_id").select("session_id", "n", "kind", "key")
    waits = traces.waits(state(0), state(1), waiting.select("session_id", "n", (F.col("t_end") - F.col("t_start")).alias("gap_ms")))
    done = inside.unionByName(waits.join(last.select("session_id", "n", "t_end"), ["session_id", "n"]).select("session_id", "n", F.col("t_end").alias("t"), F.lit(1 << 62).alias("ord"), F.lit("wait").alias("kind"), F.col("wait").alias("until")), allowMissingColumns=True).withColumn("edge_id", name()).checkpoint()
    each = done.withColumn("ord", F.struct("t", "ord", F.coalesce("kind", F.lit("")).alias("k")))
    signed = traces.edge_signature(each).join(done.groupBy("edge_id").agg(F.count("*").alias("n_actions")), "edge_id")

    # what a node is
    aimed = done.filter("target is not null").select(F.col("edge_id").alias("node_id"), F.col("target").alias("key")).distinct()
    typing = done.filter("kind = 'type'").select(F.col("edge_id").alias("node_id")).distinct()
    awaited = waits.select(name(1).alias("node_id"), F.col("wait").alias("key")).distinct()
    same = traces.identity(observed, aimed, typing, awaited)
    states = traces.merge_nodes(cuts.select("session_id", node.alias("node_id")).join(same, "node_id")).select("node_id", "state")
    labels = traces.node_label(observed.withColumn("value", traces.predicate_value(F.col("key"))))
    visits = cuts.withColumn("node_id", node).join(states, "node_id", "left").join(labels, "node_id", "left")
    visits = visits.select("session_id", "n", "t", F.coalesce("state", F.sha2(F.lit(""), 256)).alias("state"), F.coalesce("label", F.lit("no state")).alias("label")).checkpoint()
    of = lambda side, shift: visits.select("session_id", (F.col("n") - shift).alias("n"), F.col("state").alias(f"{side}_state"))
    steps = last.select("session_id", "n", name().alias("edge_id")).join(of("from", 0), ["session_id", "n"]).join(of("to", 1), ["session_id", "n"]).join(signed, "edge_id", "left")
    steps = steps.select("session_id", "n", "from_state", "to_state", F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("n_actions", F.lit(0)).alias("n_actions"))
    counted = temporal.exclusion_report(marked).join(last.groupBy("session_id").agg(F.count("*").alias("n_edges")), "session_id", "left")
    report = counted.select("session_id", "kept", "dropped", "apps", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), (F.col("kept") == 0).alias("skipped"))
    return Lifted(visits, steps, samples, report)


def merged_nodes(visits: DataFrame) -> DataFrame:
    """state, label (the least that was seen), visits, sessions."""
    return visits.groupBy("state").agg(F.min("label").alias("label"), F.count("*").alias("visits"), F.countDistinct("session_id").alias("sessions"))


def merged_edges(steps: DataFrame) -> DataFrame:
    """from_state, to_state, signature, observations, sessions."""
    return steps.groupBy("from_state", "to_state", "signature").agg(F.count("*").alias("observations"), F.countDistinct("session_id").alias("sessions"))


class GraphStore:
    """The merged graph under ``path``, kept up by batch: a session that comes again is taken back first.

    Each batch writes under its own number: what its sessions add (``visits``, ``steps``), the sessions it
    touched, and the graph's counts after it; a row in ``commits`` comes last. A batch that was broken off
    is not seen and is written anew; one that is whole is not done twice.
    """

    NODE, EDGE = ["state", "label"], ["from_state", "to_state", "signature"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """Number of the last whole batch, -1 before the first."""
        if not self._exists("commits"):
            return -1
        return self.spark.read.schema("batch long").parquet(f"{self.path}/commits").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first()["b"]

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{table}")

    def _counts(self, kind: str, at: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}_counts").filter(F.col("batch") == at).drop("batch")

    def _old(self, kind: str, touched: DataFrame, at: int) -> DataFrame:
        """What sessions added when they were last lifted."""
        latest = self.spark.read.parquet(f"{self.path}/touched").filter(F.col("batch") <= at).join(touched, "session_id", "left_semi").groupBy("session_id").agg(F.max("batch").alias("batch"))
        return self.spark.read.parquet(f"{self.path}/{kind}").join(latest, ["session_id", "batch"], "left_semi").drop("batch")

    def apply(self, lifted: Lifted, sessions: DataFrame, batch: int) -> None:
        """Replaces what ``sessions`` (session_id) add to the graph by ``lifted``; other sessions' stays."""
        at = self.version()
        if batch <= at:
            return
        touched = sessions.select("session_id").distinct()
        self._put(touched, "touched", batch)
        for kind, keys, rows in (("visits", self.NODE, lifted.visits), ("steps", self.EDGE, lifted.steps)):
            # a session counts each key once among the sessions, and as often as it has it
            new = rows.groupBy("session_id", *keys).agg(F.count("*").alias("times"))
            self._put(new, kind, batch)
            change = self.spark.read.parquet(f"{self.path}/{kind}").filter(F.col("batch") == batch).select(*keys, F.col("times"), F.lit(1).cast("long").alias("sessions"))
            if at >= 0:
                back = self._old(kind, touched, at).select(*keys, (-F.col("times")).alias("times"), F.lit(-1).cast("long").alias("sessions"))
                change = change.unionByName(back).unionByName(self._counts(kind, at))
            self._put(change.groupBy(*keys).agg(F.sum("times").alias("times"), F.sum("sessions").alias("sessions")).filter("times > 0"), f"{kind}_counts", batch)
        self._put(self.spark.range(1).select(F.lit(batch).cast("long").alias("number")), "commits", batch)

    def nodes(self) -> DataFrame:
        """state, label, visits, sessions."""
        return self._counts("visits", self.version()).groupBy("state").agg(F.min("label").alias("label"), F.sum("times").alias("visits"), F.sum("sessions").alias("sessions"))

    def edges(self) -> DataFrame:
        """from_state, to_state, signature, observations, sessions."""
        return self._counts("steps", self.version()).select(*self.EDGE, F.col("times").alias("observations"), "sessions")
