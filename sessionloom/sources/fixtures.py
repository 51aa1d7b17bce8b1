"""Projections of the driver's tables onto the library's schemas (FIXTURES.md, part B).

Times are milliseconds since a session's first event, as doubles; ``us`` keeps them as whole
microseconds. The gaps of this table are hours, so the thresholds used with it are too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DWELL_MS, BURST_MS = 24 * 3_600_000.0, 8 * 3_600_000.0
#: Sessions are folded by slices of thirty days.
SLICE_MS = 30 * 24 * 3_600_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, session_id, us, t, kind, app, url, x, y, k of every event; a session is a user."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value", k.alias("k"))
    rows = rows.join(rows.groupBy("session_id").agg(F.min("at").alias("first_at")), "session_id")
    us = F.col("at") - F.col("first_at")
    kind = (
        F.when(F.col("event_type") == "view", "focus_change")
        .when(F.col("event_type") == "signup", "bookmark")
        .when(F.col("event_type") == "click", F.when(F.col("k") % 2 == 0, "mouse_down").otherwise("mouse_move"))
        .when(F.col("event_type") == "error", F.when(F.col("k") % 4 == 0, "url_change").otherwise("key_down"))
        .otherwise(F.when(F.col("k") % 5 == 0, "mouse_up").otherwise("scroll"))
    )
    return rows.select(
        "event_id", "session_id", us.alias("us"), (us / F.lit(1000.0)).alias("t"), kind.alias("kind"),
        F.when(kind == "focus_change", F.concat(F.lit("app"), (F.col("k") % 8).cast("string"))).alias("app"),
        F.when(kind == "url_change", F.concat(F.lit("https://www.site"), (F.col("k") % 5).cast("string"), F.lit(".example/docs/"), F.col("k").cast("string"), F.lit("/a"))).alias("url"),
        (F.floor(F.col("value") * 37) % 1920).cast("double").alias("x"), ((F.col("k") * 11) % 1080).cast("double").alias("y"), "k",
    )


#: The same for DuckDB: a common table ``ev``.
EV = """ev AS (
  SELECT *, us / 1000.0::DOUBLE AS t,
    CASE WHEN kind = 'focus_change' THEN 'app' || (k % 8) END AS app,
    CASE WHEN kind = 'url_change' THEN 'https://www.site' || (k % 5) || '.example/docs/' || k || '/a' END AS url,
    (floor(value * 37)::BIGINT % 1920)::DOUBLE AS x, ((k * 11) % 1080)::DOUBLE AS y
  FROM (
    SELECT event_id, user_id AS session_id, value, k, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us,
      CASE event_type WHEN 'view' THEN 'focus_change' WHEN 'signup' THEN 'bookmark'
        WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'mouse_down' ELSE 'mouse_move' END
        WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 'url_change' ELSE 'key_down' END
        ELSE CASE WHEN k % 5 = 0 THEN 'mouse_up' ELSE 'scroll' END END AS kind
    FROM (SELECT *, regexp_extract(props, '[0-9]+')::INTEGER AS k FROM events)))"""

#: Boundaries and action segments of ``ev`` in DuckDB, with the fixture's thresholds.
SEG = """ends AS (SELECT session_id, max(us) AS end_us FROM ev GROUP BY session_id),
cand AS (
  SELECT session_id, 0::BIGINT AS us, 'session_start' AS reason, 101 AS p FROM ends
  UNION ALL SELECT session_id, end_us, 'session_end', 100 FROM ends
  UNION ALL SELECT session_id, us, kind, CASE kind WHEN 'bookmark' THEN 30 ELSE 20 END FROM ev WHERE kind IN ('bookmark', 'focus_change')
  UNION ALL SELECT session_id, us, 'dwell_gap', 10 FROM (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b FROM ev) WHERE us - b > 86400000000
  UNION ALL SELECT session_id, us, 'burst_gap', 5 FROM (SELECT *, lag(us) OVER (PARTITION BY session_id ORDER BY us, event_id) AS b FROM ev WHERE kind IN ('mouse_down', 'key_down', 'scroll')) WHERE us - b > 28800000000
), bnd AS (SELECT session_id, us, arg_max(reason, p) AS reason FROM cand GROUP BY session_id, us),
seg AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY us) AS seg_no, us AS start_us, end_us, reason
  FROM (SELECT *, lead(us) OVER (PARTITION BY session_id ORDER BY us) AS end_us FROM bnd WHERE reason IN ('session_start', 'session_end', 'focus_change', 'bookmark', 'scene_change'))
  WHERE end_us IS NOT NULL)"""


def frames(ev: DataFrame) -> DataFrame:
    """Every event whose id divides by five, as a keyframe."""
    return ev.filter(F.col("event_id") % 5 == 0).select(F.col("event_id").alias("frame_id"), "session_id", "us", "t")
