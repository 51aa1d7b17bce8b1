"""The state graph: predicates, lifting of sessions, merging, locating, ranks."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import text
from sessionloom.sources.tables import ensure_checkpoint_dir

# Element roles that stay from one visit to the next.
STABLE_ROLES = ("Sheet", "Dialog", "Button", "PopUpButton", "CheckBox", "RadioButton", "TextField", "TextArea", "SecureTextField", "ComboBox", "MenuItem", "MenuButton", "Toolbar", "SearchField")
# How far an anchor's rung can be trusted.
CEILINGS = {"identifier": 1.0, "label": 0.8, "visual": 0.5, "point": 0.3}


def predicate_key(kind: Column, args: Column) -> Column:
    """``kind(name=value,...)`` with names in order, for a map of arguments."""
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(kind, F.lit("("), F.array_join(pairs, ","), F.lit(")"))


def element_predicates(elements: DataFrame, most: int = 64) -> DataFrame:
    """snapshot_id, key, ord: elements of stable role that have an identifier or a lasting label, outside tab strips.

    ``elements``: snapshot_id, idx, parent, role, label, identifier, depth. Ordered by depth, role and
    descriptor, without repeats, at most ``most`` a snapshot.
    """
    return _listed(_described(elements), most)


def _described(elements: DataFrame) -> DataFrame:
    """Elements of stable role outside tab strips, with the arguments of their predicate."""
    ensure_checkpoint_dir(elements.sparkSession)
    role = F.regexp_replace("role", "^AX", "")
    rows = elements.withColumn("role", role).checkpoint()  # read again by each round
    inside = rows.filter("role = 'TabGroup'").select("snapshot_id", "idx")
    front = inside
    while not front.isEmpty():  # one level a round
        front = rows.join(front.withColumnRenamed("idx", "parent"), ["snapshot_id", "parent"]).select("snapshot_id", "idx").checkpoint()
        inside = inside.union(front)
    lasting = (F.length("label") > 0) & ~text.volatile(F.coalesce("label", F.lit("")))
    args = F.when(F.length("identifier") > 0, F.create_map(F.lit("role"), F.col("role"), F.lit("identifier"), F.col("identifier"))).when(lasting, F.create_map(F.lit("role"), F.col("role"), F.lit("label"), F.col("label")))
    return rows.filter(F.col("role").isin(*STABLE_ROLES)).join(inside.distinct(), ["snapshot_id", "idx"], "left_anti").withColumn("args", args).filter("args is not null").checkpoint()  # else each reader holds the plan of all rounds


def _listed(kept: DataFrame, most: int) -> DataFrame:
    named = kept.select("snapshot_id", "depth", "role", F.coalesce(F.when(F.length("identifier") > 0, F.col("identifier")), F.col("label")).alias("descriptor"), predicate_key(F.lit("ax_exists"), F.col("args")).alias("key"))
    first = named.groupBy("snapshot_id", "key").agg(F.min(F.struct("depth", "role", "descriptor")).alias("o"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("o", "key")))
    return ranked.filter(F.col("ord") <= most).select("snapshot_id", "key", "ord")


def predicate_value(key: Column) -> Column:
    """What a predicate's key says of its first argument: ``app(app=Mail)`` says Mail."""
    return F.regexp_extract(key, r"^\w+\(\w+=(.*?)(?:,\w+=.*)?\)$", 1)


def context_predicates(context: DataFrame) -> DataFrame:
    """snapshot_id, part, i, kind, key: app, URL place, displays and files of ``context`` (see ``predicates``)."""
    one = lambda name, value: F.create_map(F.lit(name), value)
    place = text.url_prefix(F.col("url"))
    display = lambda s: F.create_map(*[x for c in ("id", "w", "h") for x in (F.lit(c), s[c].cast("string"))])
    told = lambda kind, args: F.struct(F.lit(kind).alias("kind"), predicate_key(F.lit(kind), args).alias("key"))
    said = F.concat(
        F.array(F.when(F.length("app") > 0, told("app", one("app", F.col("app")))), F.when(F.length(place) > 0, told("url", one("prefix", place)))),
        F.transform(F.coalesce("displays", F.expr("array()")), lambda s: told("display", display(s))),
        F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda p: told("file", one("path", p))),
    )
    return context.select("snapshot_id", F.posexplode(F.filter(said, lambda s: s.isNotNull())).alias("i", "s")).select("snapshot_id", F.lit(0).alias("part"), "i", "s.kind", "s.key")


def predicates(elements: DataFrame, context: DataFrame, most: int = 64) -> DataFrame:
    """snapshot_id, kind, key, ord: all that a snapshot asserts, in order.

    App, URL place, displays and files of ``context`` (snapshot_id, app, url, displays: an array of
    structs of id, w, h, files: an array of paths), then the focused element and the others by
    ``element_predicates``. An element in focus counts if its role is stable, it has a descriptor and
    lies outside tab strips; of several in focus the first is it.
    """
    around = context_predicates(context)
    first = elements.filter("focused").groupBy("snapshot_id").agg(F.min("idx").alias("idx"))
    described = _described(elements)
    focus = described.join(first, ["snapshot_id", "idx"], "left_semi").select("snapshot_id", F.lit(1).alias("part"), F.lit(0).alias("i"), F.lit("ax_focused").alias("kind"), predicate_key(F.lit("ax_focused"), F.col("args")).alias("key"))
    rest = _listed(described, most).select("snapshot_id", F.lit(2).alias("part"), F.col("ord").alias("i"), F.lit("ax_exists").alias("kind"), "key")
    every = around.unionByName(focus).unionByName(rest)
    return every.select("snapshot_id", "kind", "key", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("part", "i")).alias("ord"))


def anchor_key(path: Column, label: Column, display: Column, x: Column, y: Column, step: float = 16.0) -> Column:
    """``ax:path:label`` where there is a path, else the display and the point in steps of 16 px."""
    cell = lambda v: F.floor(v / step + 0.5).cast("string")
    point = F.concat(F.lit("pt:"), display, F.lit(":"), cell(x), F.lit(","), cell(y))
    return F.coalesce(F.concat(F.lit("ax:"), path, F.lit(":"), F.coalesce(label, F.lit(""))), point)


#: Boundaries and actions that a task of ``lift`` sorts, about; a session is not cut.
LIFT_ROWS = 250_000


def lift_parts(df: DataFrame, n: int) -> int:
    """Tasks that sort ``n`` rows by session."""
    return max(-(-n // LIFT_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lift(bounds: DataFrame, actions: DataFrame) -> DataFrame:
    """session_id, n, t_start, t_end, reason, actions: an edge from each boundary to the next, with its actions in order.

    ``bounds``: session_id, t, reason; ``actions``: session_id, t, ord, action. Both are written first and counted,
    so that tasks grow in number and not in size.
    """
    ensure_checkpoint_dir(bounds.sparkSession)
    bounds, actions = bounds.select("session_id", "t", "reason").checkpoint(), actions.select("session_id", "t", "ord", "action").checkpoint()
    parts = lift_parts(bounds, bounds.count() + actions.count())
    bounds, actions = bounds.repartition(parts, "session_id"), actions.repartition(parts, "session_id")
    w = Window.partitionBy("session_id").orderBy("t")
    edges = bounds.select("session_id", F.col("t").alias("t_start"), F.lead("t").over(w).alias("t_end"), F.lead("reason").over(w).alias("reason"), (F.row_number().over(w) - 1).alias("n")).filter("t_end is not null")
    marks = bounds.select("session_id", "t", F.lit(0).alias("side"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("string").alias("action"))
    every = marks.unionByName(actions.select("session_id", "t", F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord"), "action")).repartition(parts, "session_id")
    span = F.sum((F.col("side") == 0).cast("int")).over(Window.partitionBy("session_id").orderBy("t", "side", "ord").rowsBetween(Window.unboundedPreceding, 0)) - 1
    held = every.withColumn("n", span).filter("side = 1").groupBy("session_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "action"))), lambda a: a["action"]).alias("actions"))
    return edges.join(held, ["session_id", "n"], "left").withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))


def waits(before: DataFrame, after: DataFrame, gaps: DataFrame) -> DataFrame:
    """session_id, n, wait, timeout of edges that end in a pause: the best predicate that became true, else a warning.

    ``before`` and ``after``: session_id, n, kind, key of the states at an edge's ends; ``gaps``:
    session_id, n, gap_ms. Order: app, url, focus, others; then any focus of the later state.
    """
    rank = F.when(F.col("kind") == "app", 0).when(F.col("kind") == "url", 1).when(F.col("kind") == "ax_focused", 2).otherwise(3)
    new = after.join(before.select("session_id", "n", "key"), ["session_id", "n", "key"], "left_anti").withColumn("rank", rank)
    old = after.filter("kind = 'ax_focused'").withColumn("rank", F.lit(4))
    best = new.unionByName(old).groupBy("session_id", "n").agg(F.min(F.struct("rank", "key")).alias("b"))
    timeout = F.greatest(F.lit(3000.0), F.round(3 * F.col("gap_ms")))
    return gaps.join(best, ["session_id", "n"], "left").select("session_id", "n", F.coalesce("b.key", F.lit("warning: nothing to wait for")).alias("wait"), timeout.alias("timeout"))


def identity(observed: DataFrame, anchors: DataFrame, typing: DataFrame, awaited: DataFrame) -> DataFrame:
    """node_id, key: the predicates that make a state what it is.

    App, URL, display and file; elements that its outgoing actions aim at (node_id, key); focus where
    one of them types (node_id); and what incoming waits name (node_id, key).
    """
    always = observed.filter(F.col("kind").isin("app", "url", "display", "file")).select("node_id", "key")
    aimed = observed.join(anchors, ["node_id", "key"], "left_semi").select("node_id", "key")
    focus = observed.filter("kind = 'ax_focused'").join(typing, "node_id", "left_semi").select("node_id", "key")
    named = observed.join(awaited, ["node_id", "key"], "left_semi").select("node_id", "key")
    return always.union(aimed).union(focus).union(named).distinct()


def slots(typed: DataFrame) -> DataFrame:
    """slot, samples (distinct, sorted), variable: whether it was seen with more than one text."""
    g = typed.groupBy("slot").agg(F.array_sort(F.collect_set("text")).alias("samples"))
    return g.withColumn("variable", F.size("samples") > 1)


def action_signature() -> Column:
    """One action by its kind and targets; what was typed, and into which slot, does not count.

    Columns: kind, anchor_key, to_key (drags), button, count, dx, dy (scrolls), keys (chords), until (waits).
    """
    text_of = lambda *parts: F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    kind, sign = F.col("kind"), lambda c: F.signum(F.col(c)).cast("int").cast("string")
    return (
        F.when(kind == "click", text_of("kind", "anchor_key", "button", "count"))
        .when(kind == "drag", text_of("kind", F.concat("anchor_key", F.lit("->"), "to_key"), "button"))
        .when(kind == "hover", text_of("kind", "anchor_key"))
        .when(kind == "scroll", text_of("kind", "anchor_key", F.concat(sign("dx"), F.lit(","), sign("dy"))))
        .when(kind == "chord", text_of("kind", F.array_join("keys", "+")))
        .when(kind == "wait", text_of("kind", "until"))
        .otherwise(kind)
    )


def edge_signature(actions: DataFrame) -> DataFrame:
    """edge_id, signature: the signatures of an edge's actions in order."""
    rows = actions.select("edge_id", "ord", action_signature().alias("s"))
    return rows.groupBy("edge_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda a: a["s"]), "|").alias("signature"))


def merge_nodes(predicates: DataFrame) -> DataFrame:
    """session_id, node_id, state: nodes with the same predicates are one state, whatever their order."""
    keys = predicates.groupBy("session_id", "node_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return keys.select("session_id", "node_id", F.sha2(F.array_join("keys", "\u0001"), 256).alias("state"), F.size("keys").alias("n_predicates"))


def merge_edges(edges: DataFrame, states: DataFrame) -> DataFrame:
    """from_state, to_state, signature, observations, sessions. ``edges``: session_id, from_node, to_node, signature."""
    of = lambda side: states.select("session_id", F.col("node_id").alias(f"{side}_node"), F.col("state").alias(f"{side}_state"))
    joined = edges.join(of("from"), ["session_id", "from_node"]).join(of("to"), ["session_id", "to_node"])
    return joined.groupBy("from_state", "to_state", "signature").agg(F.count("*").alias("observations"), F.countDistinct("session_id").alias("sessions"))


def near_match(scores: DataFrame, *, least: float = 0.92, margin: float = 0.03) -> DataFrame:
    """query_id, match, verdict: the best candidate if it is good and clearly ahead; else ambiguous or none."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    two = scores.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy("query_id").agg(F.min_by("id", "_n").alias("id"), F.max("score").alias("best"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("best") - F.col("second") >= margin)
    verdict = F.when(F.col("best") < least, "none").when(clear, "match").otherwise("ambiguous")
    return two.select("query_id", F.when(verdict == "match", F.col("id")).alias("match"), verdict.alias("verdict"))


def node_label(predicates: DataFrame) -> DataFrame:
    """node_id, label: app, and a sheet, a URL place or a focused label behind a dash."""
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("value")))
    g = predicates.groupBy("node_id").agg(of("app").alias("app"), of("sheet").alias("sheet"), of("url").alias("url"), of("ax_focused").alias("focus"))
    return g.select("node_id", F.coalesce(F.nullif(F.concat_ws(" — ", "app", F.coalesce("sheet", "url", "focus")), F.lit("")), F.concat(F.col("node_id").cast("string"), F.lit(" — no state"))).alias("label"))


def ranks(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, rank by breadth-first search from the entries and the nodes that nothing leads to; the rest have none.

    ``edges``: from_node, to_node; ``entries``: node.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select("from_node", "to_node").distinct()
    starts = pairs.select(F.col("from_node").alias("node")).distinct().join(pairs.filter("from_node <> to_node").select(F.col("to_node").alias("node")).distinct(), "node", "left_anti")
    front = entries.select("node").union(starts).distinct().withColumn("rank", F.lit(0)).checkpoint()
    out = front
    for rank in itertools.count(1):  # each round reaches nodes that no round before has, or is the last
        front = front.join(pairs, F.col("node") == F.col("from_node")).select(F.col("to_node").alias("node")).distinct().join(out.select("node"), "node", "left_anti").withColumn("rank", F.lit(rank)).checkpoint()
        if front.isEmpty():
            break
        out = out.unionByName(front).checkpoint()
    return out


def back_edges(edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """from_node, to_node, back: whether an edge leads to a rank that is not higher."""
    r = lambda side: ranked.select(F.col("node").alias(f"{side}_node"), F.col("rank").alias(f"{side}_rank"))
    return edges.join(r("from"), "from_node", "left").join(r("to"), "to_node", "left").select("from_node", "to_node", F.coalesce(F.col("to_rank") <= F.col("from_rank"), F.lit(False)).alias("back"))


def provenance(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """edge_id, session_id, started_at, offset_sec of the sources whose session still exists."""
    return sources.join(sessions.select("session_id", "started_at", "origin_ms"), "session_id").select("edge_id", "session_id", "started_at", F.greatest((F.col("t_start") - F.col("origin_ms")) / 1000, F.lit(0.0)).alias("offset_sec"))


def verify(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """node_id, satisfied, n_violations, assertable, achievable: expected predicates (node_id, key, reach) not observed (key)."""
    missing = expected.join(observed.select("key").distinct(), "key", "left_anti").groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("reach") == "assertable").alias("assertable"), F.count_if(F.col("reach") == "achievable").alias("achievable"))
    return expected.select("node_id").distinct().join(missing, "node_id", "left").select("node_id", F.col("n").isNull().alias("satisfied"), *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("n", "n_violations"), ("assertable", "assertable"), ("achievable", "achievable"))])


#: Most predicates of a snapshot whose subsets are looked up one by one.
SUBSETS_UP_TO = 10


def locate(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """snapshot_id, node_id, verdict: of the states that are wholly observed the one with most predicates; a tie is ambiguous.

    ``nodes``: node_id, key; ``observed``: snapshot_id, key. States with the same predicates are one kind,
    and so are snapshots. A snapshot of few predicates asks for each of their subsets by an equal join; for
    one of more, a kind of state is posted under its rarest predicate alone, so one that most states
    share (an app) brings hardly any of them together.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    held = nodes.groupBy("node_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    kinds = held.groupBy("keys").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).checkpoint()  # read three times
    seen = observed.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("key")).alias("seen")).checkpoint()  # read thrice
    views = seen.select("seen").distinct()
    none = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("seen", none, lambda found, key: F.concat(found, F.transform(found, lambda f: F.concat(f, F.array(key)))))
    few = views.filter(F.size("seen") <= SUBSETS_UP_TO).select("seen", F.explode(subsets).alias("keys")).join(kinds, "keys").select("seen", F.size("keys").alias("size"), "n", "node_id")
    each = kinds.select("keys", "n", "node_id", F.explode("keys").alias("key"))
    frequency = each.groupBy("key").agg(F.sum("n").alias("uses"))
    posted = each.join(frequency, "key").groupBy("keys", "n", "node_id").agg(F.min(F.struct("uses", "key")).alias("rare")).select("keys", "n", "node_id", F.col("rare.key").alias("key"))
    many = views.filter(F.size("seen") > SUBSETS_UP_TO).withColumn("key", F.explode("seen")).join(posted, "key").filter(F.size(F.array_except("keys", "seen")) == 0).select("seen", F.size("keys").alias("size"), "n", "node_id")
    top = few.unionByName(many).groupBy("seen", "size").agg(F.sum("n").alias("n"), F.min("node_id").alias("node_id"))
    best = top.groupBy("seen").agg(F.max_by(F.struct("n", "node_id"), "size").alias("b"))
    every = seen.join(best, "seen", "left").select("snapshot_id", F.col("b.n").alias("n"), F.col("b.node_id").alias("node_id"))
    return every.select("snapshot_id", F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), F.when(F.col("n").isNull(), "nowhere").when(F.col("n") == 1, "located").otherwise("ambiguous").alias("verdict"))


def lookup(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """want_id, idx, rung: the first element with the identifier, else the path, else label and role.

    ``wanted``: want_id, snapshot_id, identifier, path, role, label; ``elements``: snapshot_id, idx and the same.
    """
    def rung(keys: list[str], name: str) -> DataFrame:
        full = wanted.filter(" and ".join(f"length({k}) > 0" for k in keys))
        return full.select("want_id", "snapshot_id", *keys).join(elements.select("snapshot_id", "idx", *keys), ["snapshot_id", *keys]).groupBy("want_id").agg(F.min("idx").alias(name))

    out = wanted.select("want_id")
    for keys, name in ((["identifier"], "a"), (["path"], "b"), (["role", "label"], "c")):
        out = out.join(rung(keys, name), "want_id", "left")
    return out.select("want_id", F.coalesce("a", "b", "c").alias("idx"), F.when(F.col("a").isNotNull(), "identifier").when(F.col("b").isNotNull(), "path").when(F.col("c").isNotNull(), "label").alias("rung"))


def resolve(candidates: DataFrame, least: float = 0.25) -> DataFrame:
    """want_id, rung, idx, confidence: the rung most trusted whose box agrees with the recorded one.

    ``candidates``: want_id, rung, idx, depth (for paths), area, recorded_area, centre_distance,
    recorded_diagonal; a null recorded area means that no box was recorded.
    """
    ceiling = F.create_map(*[F.lit(v) for pair in CEILINGS.items() for v in pair])
    trust = F.when(F.col("rung") == "path", F.least(F.lit(1.0), F.greatest(F.lit(0.55), 0.95 - 0.035 * (F.col("depth") - 1)))).otherwise(ceiling[F.col("rung")])
    # a box without area or diagonal agrees with nothing
    shared = F.when(F.least("area", "recorded_area") > 0, F.least("area", "recorded_area") / F.greatest("area", "recorded_area"))
    close = F.when(F.col("recorded_diagonal") > 0, F.greatest(F.lit(0.0), 1 - F.col("centre_distance") / F.col("recorded_diagonal")))
    agree = F.when(F.col("recorded_area").isNull(), 1.0).otherwise(F.coalesce(shared * close, F.lit(0.0)))
    rows = candidates.withColumns({"ceiling": trust, "confidence": F.round(trust * agree, 6)}).filter(F.col("confidence") >= least)
    w = Window.partitionBy("want_id").orderBy(F.desc("ceiling"), F.desc("confidence"), "idx")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("want_id", "rung", "idx", "confidence")
