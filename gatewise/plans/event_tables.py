"""Observations, frames and control rows made from the ``events`` table, in Spark and in SQL.

Every event is one frame with one object and one tick; its columns become a box by fixed
arithmetic. Events lie hours apart, so windows are hours and rates are per hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LINE_VERSIONS, SECOND, CounterConfig, Line
from ..operators.ingest import with_prev_tick

LINE1, LINE2 = Line(0.0, 0.40, 1.0, 0.50), Line(0.0, 0.60, 1.0, 0.70)
CONFIG = CounterConfig(window_us=21_600 * SECOND, ttl_us=86_400 * SECOND, fps_window_us=21_600 * SECOND, fps_unit_us=3_600 * SECOND)
WEEK = 7 * 86_400 * SECOND
START = 1_704_067_200 * SECOND  # 2024-01-01

#: (valid_from, both lines or none): off for a week, the usual lines, steeper ones, off, the usual again.
VERSIONS = [
    (START + WEEK, (LINE1, LINE2)),
    (START + 2 * WEEK, (Line(0.0, 0.30, 1.0, 0.60), Line(0.0, 0.55, 1.0, 0.85))),
    (START + 3 * WEEK, None),
    (START + 4 * WEEK, (LINE1, LINE2)),
]
RESETS = [START + 5 * 86_400 * SECOND, START + 9 * 86_400 * SECOND]


def micros(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    number = lambda c: c.cast("double")
    return events.select(
        micros("ts").alias("t"),
        F.col("event_id").alias("frame_seq"),
        F.lit(0).alias("obj_seq"),
        (F.col("user_id") % 6).cast("int").alias("source_id"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("class_id"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("track_id"),
        number(F.round(F.col("value") * 100).cast("long") * 37 % 1200).alias("left"),
        number(k * 7 % 600).alias("top"),
        number(40 + F.col("event_id") % 41).alias("width"),
        number(80 + F.col("event_id") % 41).alias("height"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, source_id, frame_seq) of every frame."""
    return observations(spark, sf_dir).select("t", "source_id", "frame_seq")


def ticked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_prev_tick(observations(spark, sf_dir), frames(spark, sf_dir))


def line_versions(spark: SparkSession) -> DataFrame:
    parts = lambda line: (line.x1, line.y1, line.x2, line.y2)
    return spark.createDataFrame([(t, *((parts(b[0]), parts(b[1])) if b else (None, None))) for t, b in VERSIONS], LINE_VERSIONS)


def resets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in RESETS], "t long")


# ---- the same in DuckDB

OBS = """
obs AS (
  SELECT epoch_us(ts) AS t, event_id AS frame_seq, 0 AS obj_seq, CAST(user_id % 6 AS INTEGER) AS source_id,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS class_id, CASE WHEN event_type <> 'error' THEN user_id END AS track_id,
         CAST((CAST(round(value * 100) AS BIGINT) * 37) % 1200 AS DOUBLE) AS "left",
         CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) * 7) % 600 AS DOUBLE) AS top,
         CAST(40 + event_id % 41 AS DOUBLE) AS width, CAST(80 + event_id % 41 AS DOUBLE) AS height
  FROM events
)"""

TICKED = OBS + """, ticked AS (
  SELECT *, max(t) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_tick FROM obs
)"""


def _side(line: str, x: str, y: str) -> str:
    return f"({line}x2 - {line}x1) * ({y} - {line}y1) - ({line}y2 - {line}y1) * ({x} - {line}x1)"


def _crosses(line: str) -> str:
    a, b = _side(line, "ppx", "ppy"), _side(line, "px", "py")
    return f"CASE WHEN ppx IS NOT NULL THEN ({a} = 0 OR {b} = 0 OR ({a} < 0) <> ({b} < 0)) END"


def _constants(name: str, line: Line) -> str:
    return ", ".join(f"CAST('{getattr(line, k)!r}' AS DOUBLE) AS {name}{k}" for k in ("x1", "y1", "x2", "y2"))


def steps_sql(base: str = "ticked", lines: bool = True) -> str:
    """CTEs from ticked observations to ``matched``; ``lines`` adds the constant ones."""
    with_lines = f", {_constants('a', LINE1)}, {_constants('b', LINE2)}" if lines else ""
    key = "PARTITION BY source_id, track_id ORDER BY t, frame_seq, obj_seq"
    return f""", kept AS (
  SELECT *, ("left" + width / CAST(2 AS DOUBLE)) / CAST(1280 AS DOUBLE) AS px, (top + height) / CAST(720 AS DOUBLE) AS py{with_lines}
  FROM {base} WHERE class_id = 0 AND track_id IS NOT NULL
), seen AS (
  SELECT *, lag(t) OVER w AS prev_seen, lag(px) OVER w AS lx, lag(py) OVER w AS ly FROM kept WINDOW w AS ({key})
), fresh AS (
  SELECT *, prev_seen IS NULL OR coalesce(prev_seen < t AND prev_tick - prev_seen > {CONFIG.ttl_us}, false) AS fresh FROM seen
), steps AS (
  SELECT * EXCLUDE (lx, ly), CASE WHEN NOT fresh THEN lx END AS ppx, CASE WHEN NOT fresh THEN ly END AS ppy,
         CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER ({key}) AS BIGINT) AS incarnation FROM fresh
), crossed AS (
  SELECT *, {_crosses('a')} AS c1, {_crosses('b')} AS c2 FROM steps
), z AS (
  SELECT *, CASE WHEN coalesce(c1, false) THEN 1 WHEN coalesce(c2, false) THEN 2 END AS z FROM crossed
), links AS (
  SELECT *, lag(z) OVER w AS prev_z, lag(t) OVER w AS prev_t FROM z WHERE z IS NOT NULL
  WINDOW w AS (PARTITION BY source_id, track_id, incarnation ORDER BY t, frame_seq, obj_seq)
), linked AS (
  SELECT *, coalesce(prev_z <> z AND t - prev_t <= {CONFIG.window_us}, false) AS link FROM links
), runs AS (
  SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, track_id, incarnation ORDER BY t, frame_seq, obj_seq ROWS UNBOUNDED PRECEDING) AS run FROM linked
), matched AS (
  SELECT *, link AND row_number() OVER (PARTITION BY source_id, track_id, incarnation, run ORDER BY t, frame_seq, obj_seq) % 2 = 0 AS match FROM runs
), happened AS (
  SELECT t, frame_seq, obj_seq, source_id, track_id, CASE WHEN z = 2 THEN 'entry' ELSE 'exit' END AS kind FROM matched WHERE match
)"""


COUNTS = """SELECT count(*) FILTER (WHERE kind = 'entry') AS entries, count(*) FILTER (WHERE kind = 'exit') AS exits,
  greatest(0, count(*) FILTER (WHERE kind = 'entry') - count(*) FILTER (WHERE kind = 'exit')) AS footfall"""

VERSIONS_SQL = ", ".join(
    f"({t}, " + (", ".join(f"CAST('{getattr(line, k)!r}' AS DOUBLE)" for line in b for k in ("x1", "y1", "x2", "y2")) if b else ", ".join(["NULL"] * 8)) + ")" for t, b in VERSIONS
)

WITH_VERSIONS = TICKED + f""", versions AS (
  SELECT *, lead(f) OVER (ORDER BY f) AS u FROM (VALUES {VERSIONS_SQL}) v(f, ax1, ay1, ax2, ay2, bx1, by1, bx2, by2)
), gated AS (
  SELECT o.*, v.* EXCLUDE (f, u) FROM obs o JOIN versions v ON o.t >= v.f AND (v.u IS NULL OR o.t < v.u) WHERE v.ax1 IS NOT NULL
), gated_ticked AS (
  SELECT *, max(t) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_tick FROM gated
)"""
