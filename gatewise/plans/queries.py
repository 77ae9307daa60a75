"""Every registered query of the engine as (Spark plan, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CounterConfig
from ..functions import geometry as g
from ..operators import assoc, control, ingest, lifecycle, metrics, motion, reid, tracker, tracks, transitions
from ..shared import shared_folder
from ..sources import control_tables, detections, jpeg, settings
from . import event_tables as ev

Query = Callable[[SparkSession, str], DataFrame]
_spark: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _spark[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


ID = "t, frame_seq, source_id, track_id"
KEYS = ["t", "frame_seq", "source_id", "track_id"]


def _steps(spark: SparkSession, d: str) -> DataFrame:
    kept = ingest.tracked(ingest.persons(ev.observations(spark, d)))
    return tracks.with_previous_point(tracks.with_incarnation(tracks.with_foot_point(kept, ev.CONFIG), ev.CONFIG, ev.frames(spark, d)))


def _crossed(spark: SparkSession, d: str) -> DataFrame:
    return transitions.with_crossing(_steps(spark, d), ev.LINE1, ev.LINE2)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return transitions.crossing_events(ev.observations(spark, d), ev.LINE1, ev.LINE2, ev.CONFIG, ev.frames(spark, d))


def _with(select: str) -> str:
    return f"WITH {ev.TICKED}{ev.steps_sql()} {select}"


# ---- projections and filters


@query("footpoint", _with(f"SELECT {ID}, px, py FROM kept"))
def footpoint(spark, d):
    kept = ingest.tracked(ingest.persons(ev.observations(spark, d)))
    return tracks.with_foot_point(kept, ev.CONFIG).select(*KEYS, "px", "py")


@query("side_values", _with(f"SELECT {ID}, {ev._side('a', 'px', 'py')} AS side1, {ev._side('b', 'px', 'py')} AS side2 FROM kept"))
def side_values(spark, d):
    x, y = F.col("px"), F.col("py")
    return footpoint(spark, d).select(*KEYS, g.side(ev.LINE1, x, y).alias("side1"), g.side(ev.LINE2, x, y).alias("side2"))


@query("class_filter", f"WITH {ev.OBS} SELECT {ID}, class_id FROM obs WHERE class_id = 0")
def class_filter(spark, d):
    return ingest.persons(ev.observations(spark, d)).select(*KEYS, "class_id")


@query("untracked_filter", f"WITH {ev.OBS} SELECT {ID} FROM obs WHERE track_id IS NOT NULL")
def untracked_filter(spark, d):
    return ingest.tracked(ev.observations(spark, d)).select(*KEYS)


@query("confidence_filter", f"WITH {ev.OBS} SELECT t, frame_seq, (frame_seq * 7919 % 1000) / CAST(1000 AS DOUBLE) AS confidence FROM obs WHERE (frame_seq * 7919 % 1000) / CAST(1000 AS DOUBLE) >= CAST('0.45' AS DOUBLE)")
def confidence_filter(spark, d):
    scored = ev.observations(spark, d).withColumn("confidence", (F.col("frame_seq") * 7919 % 1000) / F.lit(1000.0))
    return ingest.confident(scored).select("t", "frame_seq", "confidence")


@query(
    "detections_topk",
    f"""WITH {ev.OBS}, f AS (SELECT source_id, CAST(floor(t / 3600000000) AS BIGINT) AS frame, frame_seq AS obj_seq, (frame_seq * 7919 % 1000) / CAST(1000 AS DOUBLE) AS confidence FROM obs),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id, frame ORDER BY confidence DESC, obj_seq) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 3""",
)
def detections_topk(spark, d):
    frame = F.floor(F.col("t") / 3_600_000_000)
    scored = ev.observations(spark, d).select("source_id", frame.alias("frame"), F.col("frame_seq").alias("obj_seq"), ((F.col("frame_seq") * 7919 % 1000) / F.lit(1000.0)).alias("confidence"))
    return ingest.top_detections(scored, ["source_id", "frame"], 3)


@query(
    "flatten_batches",
    f"""WITH {ev.OBS}, b AS (SELECT *, CAST(floor(t / 86400000000) AS BIGINT) AS day FROM obs),
    f AS (SELECT *, dense_rank() OVER (PARTITION BY day ORDER BY source_id) - 1 AS f, row_number() OVER (PARTITION BY day, source_id ORDER BY frame_seq) - 1 AS o FROM b)
    SELECT day AS t, f AS frame_seq, CAST(o AS INTEGER) AS obj_seq, source_id, class_id, track_id, "left", top, width, height FROM f""",
)
def flatten_batches(spark, d):
    """Nests the events of a day as a batch of a frame for each source, unsigned ids and all, and flattens it again."""
    obs = ev.observations(spark, d).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    raw = F.coalesce(F.col("track_id").cast("decimal(20,0)"), F.lit(ingest.UNTRACKED).cast("decimal(20,0)")).alias("object_id")
    one = F.struct("frame_seq", "class_id", raw, F.struct("left", "top", "width", "height").alias("rect"))
    frames = obs.groupBy("day", "source_id").agg(F.sort_array(F.collect_list(one)).alias("objects"))
    return ingest.flatten_batches(frames.groupBy(F.col("day").alias("t")).agg(F.sort_array(F.collect_list(F.struct("source_id", "objects"))).alias("frames")))


@query(
    "letterbox_scaled",
    f"WITH {ev.OBS} SELECT t, frame_seq, \"left\" * CAST(0.5 AS DOUBLE) AS x, top * CAST(0.5 AS DOUBLE) + CAST(140 AS DOUBLE) AS y, width * CAST(0.5 AS DOUBLE) AS w, height * CAST(0.5 AS DOUBLE) AS h FROM obs",
)
def letterbox_scaled(spark, d):
    box = g.letterbox(F.col("left"), F.col("top"), F.col("width"), F.col("height"), (1280, 720), (640, 640))
    return ev.observations(spark, d).select("t", "frame_seq", box["left"].alias("x"), box["top"].alias("y"), box["width"].alias("w"), box["height"].alias("h"))


@query("letterbox_boxes", f"WITH {ev.OBS} SELECT t, frame_seq, \"left\" * CAST(1 AS DOUBLE) + CAST(0 AS DOUBLE) AS x, top * CAST(1 AS DOUBLE) + CAST(8 AS DOUBLE) AS y, width * CAST(1 AS DOUBLE) AS w, height * CAST(1 AS DOUBLE) AS h FROM obs")
def letterbox_boxes(spark, d):
    box = g.letterbox(F.col("left"), F.col("top"), F.col("width"), F.col("height"), (1280, 720), (1280, 736))
    return ev.observations(spark, d).select("t", "frame_seq", box["left"].alias("x"), box["top"].alias("y"), box["width"].alias("w"), box["height"].alias("h"))


@query("click_clamp", f"WITH {ev.OBS} SELECT frame_seq, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (\"left\" - CAST(100 AS DOUBLE)) / CAST(640 AS DOUBLE))) AS share FROM obs")
def click_clamp(spark, d):
    return ev.observations(spark, d).select("frame_seq", g.click_to_point(F.col("left"), F.lit(100.0), F.lit(640.0)).alias("share"))


@query("canvas_pixels", _with(f"SELECT {ID}, px * CAST(640 AS DOUBLE) AS x, py * CAST(360 AS DOUBLE) AS y FROM kept"))
def canvas_pixels(spark, d):
    return footpoint(spark, d).select(*KEYS, g.point_to_pixel(F.col("px"), F.lit(640.0)).alias("x"), g.point_to_pixel(F.col("py"), F.lit(360.0)).alias("y"))


# ---- windows


@query("tick_timeline", f"WITH {ev.TICKED} SELECT DISTINCT t, prev_tick FROM ticked")
def tick_timeline(spark, d):
    """The distinct times of all frames, each with the one before it."""
    return ingest.tick_timeline(ev.observations(spark, d))


@query("first_sighting", _with(f"SELECT {ID} FROM steps WHERE fresh"))
def first_sighting(spark, d):
    return _steps(spark, d).where("fresh").select(*KEYS)


@query("prev_point", _with(f"SELECT {ID}, ppx, ppy FROM steps"))
def prev_point(spark, d):
    return _steps(spark, d).select(*KEYS, "ppx", "ppy")


@query("incarnations", _with(f"SELECT {ID}, prev_seen, incarnation FROM steps"))
def incarnations(spark, d):
    return _steps(spark, d).select(*KEYS, "prev_seen", "incarnation")


@query("crosses_line1", _with(f"SELECT {ID}, c1 FROM crossed"))
def crosses_line1(spark, d):
    return _crossed(spark, d).select(*KEYS, "c1")


@query("crosses_line2", _with(f"SELECT {ID}, c2 FROM crossed"))
def crosses_line2(spark, d):
    return _crossed(spark, d).select(*KEYS, "c2")


@query("crossed_line", _with(f"SELECT {ID}, z FROM z"))
def crossed_line(spark, d):
    return _crossed(spark, d).select(*KEYS, "z")


@query("prev_crossing", _with(f"SELECT {ID}, z, prev_z, prev_t FROM links"))
def prev_crossing(spark, d):
    return transitions.with_links(_crossed(spark, d), ev.CONFIG).select(*KEYS, "z", "prev_z", "prev_t")


@query("linkable", _with(f"SELECT {ID}, link FROM linked"))
def linkable(spark, d):
    return transitions.with_links(_crossed(spark, d), ev.CONFIG).select(*KEYS, "link")


@query("expired_rearm", _with(f"SELECT {ID}, z FROM linked WHERE prev_z <> z AND NOT link"))
def expired_rearm(spark, d):
    """Crossings of the other line that came too late and so start over."""
    return transitions.with_links(_crossed(spark, d), ev.CONFIG).where("prev_z <> z and not link").select(*KEYS, "z")


@query("matches", _with(f"SELECT {ID}, z, match FROM matched"))
def matches(spark, d):
    return transitions.with_matches(transitions.with_links(_crossed(spark, d), ev.CONFIG)).select(*KEYS, "z", "match")


@query("crossing_events", _with(f"SELECT {ID}, kind FROM happened"))
def crossing_events(spark, d):
    return _events(spark, d).select(*KEYS, "kind")


# ---- aggregates, control, state


@query("entries_exits_footfall", _with(f"{ev.COUNTS} FROM happened"))
def entries_exits_footfall(spark, d):
    return metrics.totals(_events(spark, d))


@query("totals_by_source", _with(f"{ev.COUNTS}, source_id FROM happened GROUP BY source_id"))
def totals_by_source(spark, d):
    return metrics.totals(_events(spark, d), "source_id")


@query(
    "totals_by_hour",
    _with("""SELECT bucket, entries, exits, CAST(sum(entries) OVER (ORDER BY bucket) AS BIGINT) AS entries_so_far, CAST(sum(exits) OVER (ORDER BY bucket) AS BIGINT) AS exits_so_far FROM (
    SELECT CAST(floor(t / 3600000000) * 3600000000 AS BIGINT) AS bucket, count(*) FILTER (WHERE kind = 'entry') AS entries, count(*) FILTER (WHERE kind = 'exit') AS exits FROM happened GROUP BY 1)"""),
)
def totals_by_hour(spark, d):
    return metrics.running_totals(_events(spark, d), 3_600_000_000)


@query("lines_gate", f"WITH {ev.WITH_VERSIONS} SELECT {ID}, ax1, ay1, ax2, ay2 FROM gated")
def lines_gate(spark, d):
    gated = control.with_lines(ev.observations(spark, d), ev.line_versions(spark))
    return gated.select(*KEYS, *[F.col(f"line1.{c}").alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")])


@query("lines_versioned_counts", f"WITH {ev.WITH_VERSIONS}{ev.steps_sql('gated_ticked', lines=False)} {ev.COUNTS} FROM happened")
def lines_versioned_counts(spark, d):
    versions = ev.line_versions(spark)
    gated, ticks = control.with_lines(ev.observations(spark, d), versions), control.with_lines(ev.frames(spark, d).select("t").distinct(), versions)
    return metrics.totals(transitions.crossing_events(gated, "line1", "line2", ev.CONFIG, ticks))


@query("counts_since_reset", _with(f"{ev.COUNTS} FROM happened WHERE t > {max(ev.RESETS)}"))
def counts_since_reset(spark, d):
    return metrics.totals(control.since_last_reset(_events(spark, d), ev.resets(spark)))


#: What is posted as lines: good ones, one line missing, a point missing, no JSON, no object.
_POSTED = """CASE event_id % 5 WHEN 0 THEN '{"width":1280,"height":720,"line1":[[0.1,0.' || kk || '],[0.9,0.5]],"line2":[[0,0.6],[1,0.' || kk || ']]}'
  WHEN 1 THEN '{"line1":null,"line2":[[0,0.6],[1,0.7]]}' WHEN 2 THEN '{"line1":[[0.1,0.' || kk || ']],"line2":[[0,0.6],[1,0.7]]}' WHEN 3 THEN 'not json' ELSE '[1,2]' END"""


def _posted(spark: SparkSession, d: str) -> DataFrame:
    """(t, n, a, b): every event posts lines as text, often malformed ones, and these are read."""
    kk = F.lpad(F.get_json_object("props", "$.k"), 2, "0")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", ev.micros("ts").alias("t"), kk.alias("kk"))
    a, b = control.parse_lines(F.expr(_POSTED))
    return rows.select("t", F.col("event_id").alias("n"), a.alias("line1"), b.alias("line2"))


_KK = "(SELECT event_id, epoch_us(ts) AS t, lpad(json_extract_string(props, '$.k'), 2, '0') AS kk FROM events)"


@query(
    "lines_json_parse",
    f"SELECT event_id AS n, event_id % 5 = 0 AS active, CASE WHEN event_id % 5 = 0 THEN CAST('0.' || kk AS DOUBLE) END AS a_y1, CASE WHEN event_id % 5 = 0 THEN CAST('0.' || kk AS DOUBLE) END AS b_y2 FROM {_KK}",
)
def lines_json_parse(spark, d):
    return _posted(spark, d).select("n", F.col("line1").isNotNull().alias("active"), F.col("line1.y1").alias("a_y1"), F.col("line2.y2").alias("b_y2"))


_NEWEST = f"(SELECT t, CAST('0.' || kk AS DOUBLE) AS y FROM {_KK} WHERE event_id % 5 = 0 ORDER BY t DESC LIMIT 1)"


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The well-formed lines that were posted last."""
    whole = _posted(spark, d).where("line1 is not null").withColumn("row", F.struct(F.col("t").alias("valid_from"), "line1", "line2"))
    return control.latest(whole, "t", "row").select("row.*")


@query("lines_latest", f"SELECT t AS valid_from, CAST('0.1' AS DOUBLE) AS ax1, y AS by2 FROM {_NEWEST}")
def lines_latest(spark, d):
    return _newest(spark, d).select("valid_from", F.col("line1.x1").alias("ax1"), F.col("line2.y2").alias("by2"))


@query(
    "lines_sink",
    f"""SELECT t AS valid_from, event_id % 5 = 0 AS active, CASE WHEN event_id % 5 = 0 THEN CAST('0.' || kk AS DOUBLE) END AS a_y1 FROM {_KK}
    UNION ALL SELECT -CAST(4611686018427387904 AS BIGINT), false, NULL""",
)
def lines_sink(spark, d):
    """Every post of lines appended to the control table, and the table as it is read back; before the first there are no lines."""
    path = shared_folder(spark, "lines")
    kk = F.lpad(F.get_json_object("props", "$.k"), 2, "0")
    posts = spark.read.parquet(f"{d}/events.parquet").select("event_id", ev.micros("ts").alias("t"), kk.alias("kk"))
    control_tables.append_versions(posts.select("t", F.expr(_POSTED).alias("raw")), path)
    return control_tables.read_lines(spark, path).select("valid_from", F.col("line1").isNotNull().alias("active"), F.col("line1.y1").alias("a_y1"))


_RESET = "event_type = 'signup' AND json_extract_string(props, '$.k') = '7'"


@query("reset_sink", _with(f"{ev.COUNTS} FROM happened WHERE t > coalesce((SELECT max(epoch_us(ts)) FROM events WHERE {_RESET}), -1)"))
def reset_sink(spark, d):
    """Resets posted by some events, appended to their table and read back: what was counted after the last one."""
    path = shared_folder(spark, "resets")
    rows = spark.read.parquet(f"{d}/events.parquet").where((F.col("event_type") == "signup") & (F.get_json_object("props", "$.k") == "7"))
    control_tables.append_resets(rows.select(ev.micros("ts").alias("t")), path)
    return metrics.totals(control.since_last_reset(_events(spark, d), control_tables.read_resets(spark, path)))


_RATES = f"""rates AS (
  SELECT source_id, t, CAST(row_number() OVER (PARTITION BY source_id ORDER BY t, frame_seq) AS BIGINT) AS i FROM obs
), walk AS (
  SELECT source_id, i AS from_i, t AS start, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS closed_at, CAST(0 AS BIGINT) AS base FROM rates WHERE i = 1
  UNION ALL
  SELECT s.source_id, s.i, s.t, s.i, s.t, s.base FROM (
    SELECT w.source_id, n.i, n.t, w.base, row_number() OVER (PARTITION BY w.source_id ORDER BY n.i) AS k
    FROM walk w JOIN rates n ON n.source_id = w.source_id AND n.i > w.from_i AND n.t - w.start >= {ev.CONFIG.fps_window_us}
  ) s WHERE k = 1
), closed AS (
  SELECT source_id, closed_at, from_i - coalesce(lag(from_i) OVER (PARTITION BY source_id ORDER BY from_i), 0)
           + CASE WHEN lag(i) OVER (PARTITION BY source_id ORDER BY from_i) IS NULL THEN 0 ELSE 0 END AS frames,
         closed_at - lag(start) OVER (PARTITION BY source_id ORDER BY from_i) AS elapsed_us, from_i, i FROM walk
), windows AS (
  SELECT c.source_id, closed_at, CASE WHEN row_number() OVER (PARTITION BY c.source_id ORDER BY from_i) = 1 THEN from_i ELSE frames END AS frames, elapsed_us
  FROM closed c WHERE i IS NOT NULL
)"""


#: Frames per hour, rounded as decimal output rounds the binary value.
_FPS = f"CAST(printf('%.2f', frames / (elapsed_us / CAST({ev.CONFIG.fps_unit_us} AS DOUBLE))) AS DOUBLE)"


@query("fps_windows", f"WITH RECURSIVE {ev.OBS}, {_RATES} SELECT source_id, closed_at, frames, elapsed_us, {_FPS} AS fps FROM windows")
def fps_windows(spark, d):
    return metrics.fps_windows(ev.frames(spark, d), ev.CONFIG)


_LAST = f"{_RATES}, last AS (SELECT source_id, arg_max({_FPS}, closed_at) AS fps FROM windows GROUP BY source_id)"


@query("fps_by_source", f"WITH RECURSIVE {ev.OBS}, {_LAST} SELECT source_id, fps FROM last")
def fps_by_source(spark, d):
    return metrics.fps_by_source(metrics.fps_windows(ev.frames(spark, d), ev.CONFIG))


@query("fps_total", f"WITH RECURSIVE {ev.OBS}, {_LAST} SELECT CAST(printf('%.2f', sum(fps ORDER BY source_id)) AS DOUBLE) AS fps FROM last")
def fps_total(spark, d):
    return metrics.fps_total(fps_by_source(spark, d))


@query("fps_map", f"WITH RECURSIVE {ev.OBS}, {_LAST} SELECT string_agg(source_id || '=' || CAST(fps * 100 AS BIGINT), ',' ORDER BY source_id) AS rates FROM last")
def fps_map(spark, d):
    entries = F.transform(F.array_sort(F.map_entries("fps_by_source")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("long").cast("string")))
    return metrics.fps_map(fps_by_source(spark, d)).select(F.array_join(entries, ",").alias("rates"))


_STATE = f"""{_LAST}, counts AS ({ev.COUNTS} FROM happened), rate AS (
  SELECT CAST(printf('%.2f', coalesce(sum(fps ORDER BY source_id), 0)) AS DOUBLE) AS fps,
         coalesce(string_agg('"' || source_id || '":' || CAST(fps AS VARCHAR), ',' ORDER BY CAST(source_id AS VARCHAR)), '') AS each FROM last
), clock AS (
  SELECT max(t) // 1000000 || '.' || lpad(CAST(max(t) % 1000000 AS VARCHAR), 6, '0') AS stamp FROM obs
)"""
_STATE_JSON = """'{"entries":' || entries || ',"exits":' || exits || ',"footfall":' || footfall || ',"fps":' || CAST(fps AS VARCHAR)
  || ',"fps_by_source":{' || each || '},"updated_at":' || stamp"""


def _with_state(select: str) -> str:
    return f"WITH RECURSIVE {ev.TICKED}{ev.steps_sql()}, {_STATE} {select} FROM counts, rate, clock"


def _state(spark: SparkSession, d: str) -> DataFrame:
    return metrics.state_snapshot(_events(spark, d), fps_by_source(spark, d), ev.frames(spark, d))


@query("state_snapshot", _with_state("SELECT entries, exits, footfall, fps, '{' || each || '}' AS fps_by_source, CAST(stamp AS DECIMAL(18, 6)) AS updated_at"))
def state_snapshot(spark, d):
    return _state(spark, d).withColumn("fps_by_source", F.to_json("fps_by_source"))


@query("state_snapshot_json", _with_state(f"SELECT {_STATE_JSON} || '}}' AS json"))
def state_snapshot_json(spark, d):
    return metrics.as_json(_state(spark, d))


def _lines_text(version: tuple) -> str:
    import json

    each = [None if version[1] is None else [[x.x1, x.y1], [x.x2, x.y2]] for x in version[1] or (None, None)]
    return json.dumps({"width": 1280, "height": 720, "line1": each[0], "line2": each[1]}, separators=(",", ":"))


@query("api_lines", f"""SELECT '{{"width":1280,"height":720,"line1":[[0.1,' || CAST(y AS VARCHAR) || '],[0.9,0.5]],"line2":[[0.0,0.6],[1.0,' || CAST(y AS VARCHAR) || ']]}}' AS json FROM {_NEWEST}""")
def api_lines(spark, d):
    """The lines in force, as they are served."""
    return control_tables.lines_json(_newest(spark, d)).select("json")


@query("api_state", _with_state(f"SELECT {_STATE_JSON} || ',\"lines\":' || '{_lines_text(ev.VERSIONS[-1])}' || '}}' AS json"))
def api_state(spark, d):
    """The state with the lines in force nested into it."""
    row = ev.line_versions(spark).withColumn("row", F.struct("valid_from", "line1", "line2"))
    lines = control_tables.lines_rows(control.latest(row, "valid_from", "row").select("row.*")).select("lines").scalar()
    return metrics.as_json(_state(spark, d).withColumn("lines", lines))


@query("latest_by_source", f"WITH {ev.OBS} SELECT source_id, max(t) AS t, arg_max(frame_seq, t) AS frame_seq FROM obs GROUP BY source_id")
def latest_by_source(spark, d):
    obs = ev.observations(spark, d)
    return control.latest_by(obs, "source_id", ["t", "frame_seq"], ["t", "frame_seq"])


@query("ui_format", _with_state("SELECT CAST(entries AS VARCHAR) AS entries_text, CAST(exits AS VARCHAR) AS exits_text, CASE WHEN fps * 4 = floor(fps * 4) AND fps * 2 <> floor(fps * 2) THEN printf('%.1f', floor(fps * 10 + 0.5) / 10) ELSE printf('%.1f', fps) END AS rate_text"))
def ui_format(spark, d):
    """What the page shows: counts, and the rate with one decimal."""
    text = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return _state(spark, d).select(text("entries").alias("entries_text"), text("exits").alias("exits_text"), g.fixed_tenths(F.coalesce("fps", F.lit(0.0))).alias("rate_text"))


# ---- registry and settings

_CAMS = "(VALUES " + ", ".join(f"({i}, '{c[0]}', '{c[1]}', {c[2]}, {c[3]}, {c[4]})" for i, c in enumerate(settings.CAMERAS)) + ") c(p, id, name, nvr, channel, subtype)"
#: Every event asks for two cameras in a list with a blank entry; two of the ids do not exist.
_WANTED_SQL = """(SELECT event_id AS request, pos, id FROM (
  SELECT event_id, 0 AS pos, 'ground_0' || (user_id % 8 + 1) AS id FROM events UNION ALL SELECT event_id, 2, 'ground_0' || (event_id % 8 + 1) FROM events)) r"""


def _requested(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.concat(F.lit(" ground_0"), F.col("user_id") % 8 + 1, F.lit(", ,ground_0"), F.col("event_id") % 8 + 1, F.lit("\t"))
    lists = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request"), wanted.alias("wanted"))
    return settings.request_rows(lists, "request")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    return settings.select_cameras(_requested(spark, d), settings.cameras(spark))


@query("camera_registry", f"SELECT p AS pos, id, name, nvr, channel, subtype, count(*) AS frames FROM {_CAMS} JOIN events ON user_id % 6 = p GROUP BY ALL")
def camera_registry(spark, d):
    """The registered cameras with the frames each of them sent."""
    sent = ev.frames(spark, d).groupBy(F.col("source_id").alias("pos")).agg(F.count("*").alias("frames"))
    return settings.cameras(spark).join(sent, "pos")


@query("cameras_requested", f"SELECT request, pos, r.id, name, nvr, channel, subtype FROM {_WANTED_SQL} JOIN {_CAMS} ON r.id = c.id")
def cameras_requested(spark, d):
    return _selected(spark, d)


@query("cameras_missing_anti", f"SELECT request, pos, id FROM {_WANTED_SQL} WHERE id NOT IN (SELECT id FROM {_CAMS})")
def cameras_missing_anti(spark, d):
    return settings.missing_cameras(_requested(spark, d), settings.cameras(spark)).select("request", "pos", "id")


@query("subtype_override", f"SELECT request, pos, r.id, 0 AS subtype FROM {_WANTED_SQL} JOIN {_CAMS} ON r.id = c.id")
def subtype_override(spark, d):
    return settings.override_subtype(_selected(spark, d), " 0 ").select("request", "pos", "id", "subtype")


_DUMMY = {"CAMERA_USERNAME": "user name+1", "CAMERA_PASSWORD": "p@ss/w*rd~é", "NVR_225_HOST": "host.invalid", "NVR_225_PORT": "554"}


@query("rtsp_url", f"SELECT request, pos, 'rtsp://user%20name%2B1:p%40ss%2Fw%2Ard~%C3%A9@host.invalid:554/cam/realmonitor?channel=' || channel || '&subtype=' || subtype AS url FROM {_WANTED_SQL} JOIN {_CAMS} ON r.id = c.id")
def rtsp_url(spark, d):
    return settings.stream_urls(_selected(spark, d), _DUMMY).select("request", "pos", "url")


@query("offline_url", f"SELECT request, pos, printf('file:///videos/cam_%02d.mp4', row_number() OVER (PARTITION BY request ORDER BY pos) - 1) AS url FROM {_WANTED_SQL} JOIN {_CAMS} ON r.id = c.id")
def offline_url(spark, d):
    return settings.offline_urls(_selected(spark, d), "/videos", "request").select("request", "pos", "url")


#: Every customer is a line of an environment file: a comment, a plain value, a quoted one, a line without a value, a blank one.
_ENV = """CASE c_custkey % 5 WHEN 0 THEN '# ' || c_name WHEN 1 THEN 'K' || c_custkey || '=' || c_name WHEN 2 THEN ' K' || c_custkey || ' = "' || c_mktsegment || ' = 2" '
  WHEN 3 THEN 'no separator ' || c_name ELSE '' END"""
_ENV_SQL = "(SELECT 'K' || c_custkey AS key, CASE c_custkey % 5 WHEN 1 THEN c_name ELSE c_mktsegment || ' = 2' END AS value FROM customer WHERE c_custkey % 5 IN (1, 2)) f"


@query("env_scan", f"SELECT key, value FROM {_ENV_SQL}")
def env_scan(spark, d):
    return settings.parse_env(spark.read.parquet(f"{d}/customer.parquet").select(F.expr(_ENV).alias("value")))


@query("env_overlay", f"SELECT f.key, coalesce(s_name, value) AS value FROM {_ENV_SQL} LEFT JOIN supplier ON f.key = 'K' || s_suppkey * 3")
def env_overlay(spark, d):
    """Suppliers are the process environment: some of its keys are in the file, and only these count."""
    process = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("K"), F.col("s_suppkey") * 3).alias("key"), F.col("s_name").alias("value"))
    return settings.overlay_env(env_scan(spark, d), process)


_LABELS_SQL = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(settings.LABELS)) + ") l(class_id, label)"


@query("label_join", f"WITH {ev.OBS} SELECT label, count(*) AS n FROM obs JOIN {_LABELS_SQL} USING (class_id) GROUP BY label")
def label_join(spark, d):
    return ev.observations(spark, d).join(settings.labels(spark), "class_id").groupBy("label").agg(F.count("*").alias("n"))


@query("tiler_layout", f"""WITH {ev.OBS}, f AS (SELECT CAST(floor(t / 3600000000) AS BIGINT) AS hour, CAST(count(DISTINCT source_id) AS INTEGER) AS n FROM obs GROUP BY 1)
    SELECT hour, n, CASE WHEN n <= 2 THEN 1 ELSE 2 END AS rows, CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS columns, 1280 * CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS total_width, 720 * CASE WHEN n <= 2 THEN 1 ELSE 2 END AS total_height FROM f""")
def tiler_layout(spark, d):
    """How the cameras that sent something in an hour are tiled."""
    seen = ev.frames(spark, d).groupBy(F.floor(F.col("t") / 3_600_000_000).alias("hour")).agg(F.count_distinct("source_id").cast("int").alias("n"))
    return seen.select("hour", "n", *[c.cast("int").alias(k) for k, c in g.tiler(F.col("n"), F.lit(1280), F.lit(720)).items()])


_CONFIDENCE = "(frame_seq * 7919 % 1000) / CAST(1000 AS DOUBLE)"


@query(
    "detector_settings",
    f"""WITH {ev.OBS}, r AS (SELECT source_id, row_number() OVER (PARTITION BY source_id, floor(t / 86400000000) ORDER BY {_CONFIDENCE} DESC, frame_seq) AS k FROM obs WHERE class_id = 0 AND {_CONFIDENCE} >= CAST('0.45' AS DOUBLE))
    SELECT source_id, count(*) AS kept FROM r WHERE k <= 3 GROUP BY source_id""",
)
def detector_settings(spark, d):
    """What settings read from a file keep of the events: classes, confidence, the best of a day."""
    s = settings.DetectorSettings.read("[property]\nbatch-size = 6\nfilter-out-class-ids = " + ";".join(map(str, range(1, 80))) + "\n[class-attrs-all]\npre-cluster-threshold = 0.45\ntopk = 3\n")
    rows = ev.observations(spark, d).select("source_id", F.floor(F.col("t") / 86_400_000_000).alias("day"), "class_id", F.col("frame_seq").alias("obj_seq"), ((F.col("frame_seq") * 7919 % 1000) / F.lit(1000.0)).alias("confidence"))
    kept = ingest.confident(rows.where(~F.col("class_id").isin(*s.excluded)), s.threshold)
    return ingest.top_detections(kept, ["source_id", "day"], s.top_k).groupBy("source_id").agg(F.count("*").alias("kept"))


@query("tracker_settings", f"WITH {ev.OBS} SELECT source_id, count(*) AS kept FROM obs WHERE {_CONFIDENCE} >= CAST('0.1894' AS DOUBLE) GROUP BY source_id")
def tracker_settings(spark, d):
    """What the tracker's own least confidence, read from its file, keeps of the events."""
    text = "%YAML:1.0\n####\nBaseConfig:\n  minDetectorConfidence: 0.1894    # least\nTargetManagement:\n  maxTargetsPerStream: 150    # limit\nReID:\n  inferDims: [3, 256, 128]    # shape\n"
    least = settings.tracker_parameters(spark, text).where("parameter = 'minDetectorConfidence'").select(F.col("value").cast("double").alias("least")).scalar()
    rows = ev.observations(spark, d).select("source_id", ((F.col("frame_seq") * 7919 % 1000) / F.lit(1000.0)).alias("confidence"))
    return rows.where(F.col("confidence") >= least).groupBy("source_id").agg(F.count("*").alias("kept"))


# ---- association (approximate)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return ev.observations(spark, d).select("source_id", F.floor(F.col("t") / 21_600_000_000).alias("frame"), F.col("frame_seq").alias("obj_seq"), F.lit(0).alias("class_id"), "left", "top", "width", "height")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Boxes of one six-hour frame against those of the next, as targets and detections, with the keys of a frame."""
    boxes = _boxes(spark, d)
    return boxes.withColumn("frame", F.col("frame") + 1), boxes, ["source_id", "frame"]


_BOXES = """b AS (SELECT source_id, CAST(floor(t / 21600000000) AS BIGINT) AS frame, frame_seq AS o, "left" AS l, top AS u, width AS w, height AS h FROM obs)"""
_PAIRS = f"""{_BOXES}, j AS (
  SELECT d.source_id, d.frame, a.o AS target, d.o AS detection, a.w * a.h AS sa, d.w * d.h AS sd,
    greatest(CAST(0 AS DOUBLE), least(a.l + a.w, d.l + d.w) - greatest(a.l, d.l)) * greatest(CAST(0 AS DOUBLE), least(a.u + a.h, d.u + d.h) - greatest(a.u, d.u)) AS i
  FROM b a JOIN b d ON a.source_id = d.source_id AND a.frame + 1 = d.frame
), s AS (
  SELECT source_id, frame, 0 AS class_id, target, detection, i / (sa + sd - i) AS iou, least(sa, sd) / greatest(sa, sd) AS size_similarity FROM j
), pairs AS (
  SELECT *, CAST('0.6003' AS DOUBLE) * size_similarity + CAST('0.4033' AS DOUBLE) * iou AS score FROM s
  WHERE iou >= CAST('0.0548' AS DOUBLE) AND size_similarity >= CAST('0.3552' AS DOUBLE) AND CAST('0.6003' AS DOUBLE) * size_similarity + CAST('0.4033' AS DOUBLE) * iou >= CAST('0.0222' AS DOUBLE)
)"""


#: Two numbers of each box that stand for its appearance.
_FEATURE_SQL = '[CAST("left" % 100 + 1 AS DOUBLE), CAST(top % 90 - 40 AS DOUBLE)]'


@query("iou_pairs", f"WITH {ev.OBS}, {_PAIRS} SELECT * FROM pairs")
def iou_pairs(spark, d):
    return assoc.pairs_in_frame(*_sides(spark, d))


@query(
    "greedy_match",
    f"""WITH {ev.OBS}, {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, frame, target ORDER BY score DESC, detection) AS x,
    row_number() OVER (PARTITION BY source_id, frame, detection ORDER BY score DESC, target) AS y FROM pairs) SELECT * EXCLUDE (x, y) FROM r WHERE x = 1 AND y = 1""",
)
def greedy_match(spark, d):
    return assoc.mutual_best_in_frame(*_sides(spark, d))


@query(
    "greedy_all",
    f"""WITH RECURSIVE {ev.OBS}, {_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY score DESC, target, detection) AS k FROM pairs),
    walk AS (
      SELECT DISTINCT source_id, frame, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS ds, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS detection FROM o
      UNION ALL
      SELECT w.source_id, w.frame, o.k, CASE WHEN list_contains(ts, o.target) OR list_contains(ds, o.detection) THEN ts ELSE list_append(ts, o.target) END,
             CASE WHEN list_contains(ts, o.target) OR list_contains(ds, o.detection) THEN ds ELSE list_append(ds, o.detection) END,
             CASE WHEN NOT (list_contains(ts, o.target) OR list_contains(ds, o.detection)) THEN o.target END, CASE WHEN NOT (list_contains(ts, o.target) OR list_contains(ds, o.detection)) THEN o.detection END
      FROM walk w JOIN o ON o.source_id = w.source_id AND o.frame = w.frame AND o.k = w.k + 1
    ) SELECT source_id, frame, target, detection FROM walk WHERE target IS NOT NULL""",
)
def greedy_all(spark, d):
    return assoc.greedy_in_frame(*_sides(spark, d)).select("source_id", "frame", "target", "detection")


def _walk(pairs: str, found: str) -> str:
    """CTE ``found``: greedy matching of the CTE ``pairs``, one pair after another."""
    used = "list_contains(ts, o.target) OR list_contains(ds, o.detection)"
    return f"""o_{found} AS (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY score DESC, target, detection) AS k FROM {pairs}),
    w_{found} AS (
      SELECT DISTINCT source_id, frame, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS ds, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS detection FROM o_{found}
      UNION ALL
      SELECT w.source_id, w.frame, o.k, CASE WHEN {used} THEN ts ELSE list_append(ts, o.target) END, CASE WHEN {used} THEN ds ELSE list_append(ds, o.detection) END,
             CASE WHEN NOT ({used}) THEN o.target END, CASE WHEN NOT ({used}) THEN o.detection END
      FROM w_{found} w JOIN o_{found} o ON o.source_id = w.source_id AND o.frame = w.frame AND o.k = w.k + 1
    ), {found} AS (SELECT source_id, frame, target, detection FROM w_{found} WHERE target IS NOT NULL)"""


@query(
    "cascade_match",
    f"""WITH RECURSIVE {ev.OBS}, {_BOXES}, j AS (
      SELECT d.source_id, d.frame, a.o AS target, d.o AS detection, a.o % 3 AS st, (d.o * 7919 % 1000) / CAST(1000 AS DOUBLE) AS conf, a.w * a.h AS sa, d.w * d.h AS sd,
        greatest(CAST(0 AS DOUBLE), least(a.l + a.w, d.l + d.w) - greatest(a.l, d.l)) * greatest(CAST(0 AS DOUBLE), least(a.u + a.h, d.u + d.h) - greatest(a.u, d.u)) AS i
      FROM b a JOIN b d ON a.source_id = d.source_id AND a.frame + 1 = d.frame
    ), s AS (SELECT *, i / (sa + sd - i) AS iou, least(sa, sd) / greatest(sa, sd) AS z FROM j WHERE i > 0),
    p1 AS (SELECT source_id, frame, target, detection, CAST('0.6003' AS DOUBLE) * z + CAST('0.4033' AS DOUBLE) * iou AS score FROM s WHERE st < 2 AND conf >= CAST('0.3' AS DOUBLE) AND iou >= CAST('0.0548' AS DOUBLE) AND z >= CAST('0.3552' AS DOUBLE)),
    {_walk('p1', 'm1')},
    p2 AS (SELECT source_id, frame, target, detection, iou AS score FROM s ANTI JOIN m1 USING (source_id, frame, target) WHERE st = 0 AND conf < CAST('0.3' AS DOUBLE) AND iou >= CAST('0.2852' AS DOUBLE)),
    {_walk('p2', 'm2')},
    p3 AS (SELECT source_id, frame, target, detection, iou AS score FROM s ANTI JOIN m1 USING (source_id, frame, detection) WHERE st = 2 AND conf >= CAST('0.3' AS DOUBLE) AND iou >= CAST('0.0548' AS DOUBLE)),
    {_walk('p3', 'm3')}
    SELECT *, 1 AS stage FROM m1 UNION ALL SELECT *, 2 FROM m2 UNION ALL SELECT *, 3 FROM m3""",
)
def cascade_match(spark, d):
    """Boxes of one six-hour frame as targets, in sight, in the shadow or on probation, against the detections of the next."""
    boxes = _boxes(spark, d)
    status = F.element_at(F.array(*[F.lit(x) for x in (assoc.ACTIVE, assoc.SHADOW, assoc.TENTATIVE)]), (F.col("obj_seq") % 3 + 1).cast("int"))
    targets = boxes.withColumn("frame", F.col("frame") + 1).withColumn("status", status)
    found = boxes.withColumn("confidence", (F.col("obj_seq") * 7919 % 1000) / F.lit(1000.0))
    return assoc.cascade(targets, found, ["source_id", "frame"], tentative_confidence=0.3).select("source_id", "frame", "target", "detection", "stage")


@query("optimal_match")
def optimal_match(spark, d):
    """The same frames as in ``greedy_all``, matched for the largest sum of scores."""
    return assoc.optimal_in_frame(*_sides(spark, d)).select("source_id", "frame", "target", "detection")


_TRACKING = tracker.TrackerConfig(tentative_confidence=0.3, life=lifecycle.LifecycleConfig(probation=3, early_termination=2, shadow=8))


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Events as detections of six-hour frames, the best 300 of each; all of a frame have its end as their time."""
    frame = F.floor(F.col("t") / 21_600_000_000)
    rows = ev.observations(spark, d).select(
        ((frame + 1) * 21_600_000_000).alias("t"), frame.alias("frame"), F.col("frame_seq").alias("obj_seq"), "source_id", "class_id",
        ((F.col("frame_seq") * 7919 % 1000) / F.lit(1000.0)).alias("confidence"), "left", "top", "width", "height",
    )
    return ingest.top_detections(rows, ["source_id", "frame"], 300).drop("rank")


@query("tracked_detections")
def tracked_detections(spark, d):
    """Detections without ids get those of the tracker, frame by frame."""
    return tracker.track_table(_detections(spark, d), lambda: tracker.CascadeTracker(_TRACKING))


@query("online_tracks")
def online_tracks(spark, d):
    """The same from a stream that is stopped and started in between; the tracker's targets are the query's state."""
    from ..streaming import replay

    return replay.replay_tracks(_detections(spark, d), lambda: tracker.CascadeTracker(_TRACKING))


@query(
    "visual_pairs",
    f"""WITH {ev.OBS}, m AS (SELECT *, {_FEATURE_SQL} AS f FROM obs), b AS (SELECT source_id, CAST(floor(t / 21600000000) AS BIGINT) AS frame, frame_seq AS o, "left" AS l, top AS u, width AS w, height AS h, f FROM m),
    j AS (SELECT d.source_id, d.frame, a.o AS target, d.o AS detection, a.w * a.h AS sa, d.w * d.h AS sd, a.f AS fa, d.f AS fd,
      greatest(CAST(0 AS DOUBLE), least(a.l + a.w, d.l + d.w) - greatest(a.l, d.l)) * greatest(CAST(0 AS DOUBLE), least(a.u + a.h, d.u + d.h) - greatest(a.u, d.u)) AS i
      FROM b a JOIN b d ON a.source_id = d.source_id AND a.frame + 1 = d.frame),
    s AS (SELECT *, i / (sa + sd - i) AS iou, least(sa, sd) / greatest(sa, sd) AS z, (fa[1] * fd[1] + fa[2] * fd[2]) / (sqrt(fa[1] * fa[1] + fa[2] * fa[2]) * sqrt(fd[1] * fd[1] + fd[2] * fd[2])) AS visual FROM j),
    p AS (SELECT *, CAST('0.6003' AS DOUBLE) * z + CAST('0.4033' AS DOUBLE) * iou + CAST('0.3951' AS DOUBLE) * visual AS score FROM s WHERE iou >= CAST('0.0548' AS DOUBLE) AND z >= CAST('0.3552' AS DOUBLE))
    SELECT source_id, frame, target, detection, round(visual, 9) AS visual, round(score, 9) AS score FROM p WHERE visual >= CAST('0.4' AS DOUBLE) AND score >= CAST('0.0222' AS DOUBLE)""",
)
def visual_pairs(spark, d):
    boxes = _boxes(spark, d).withColumn("feature", F.array((F.col("left") % 100 + 1).cast("double"), (F.col("top") % 90 - 40).cast("double")))
    pairs = assoc.pairs_in_frame(boxes.withColumn("frame", F.col("frame") + 1), boxes, ["source_id", "frame"], "feature")
    return pairs.select("source_id", "frame", "target", "detection", F.round("visual", 9).alias("visual"), F.round("score", 9).alias("score"))


@query(
    "targets_topk",
    f"WITH {ev.OBS}, r AS (SELECT source_id, CAST(floor(t / 86400000000) AS BIGINT) AS frame, frame_seq AS obj_seq, CAST(row_number() OVER (PARTITION BY source_id, floor(t / 86400000000) ORDER BY width * height DESC, frame_seq) AS INTEGER) AS rank FROM obs) SELECT * FROM r WHERE rank <= 150",
)
def targets_topk(spark, d):
    """The targets of each stream and frame (here a day), up to the limit."""
    scored = ev.observations(spark, d).select("source_id", F.floor(F.col("t") / 86_400_000_000).alias("frame"), F.col("frame_seq").alias("obj_seq"), (F.col("width") * F.col("height")).alias("confidence"))
    return ingest.top_detections(scored, ["source_id", "frame"], 150).drop("confidence")


@query(
    "tracklet_reid",
    """WITH e AS (SELECT vec_id AS track, label AS g, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(vec_id % 7 - 3 AS DOUBLE) AS vx, CAST(vec_id % 5 - 2 AS DOUBLE) AS vy, CAST(100 + vec_id % 300 AS DOUBLE) AS z FROM embeddings),
    p AS (SELECT b.g AS label, b.track AS new, a.track AS old, sqrt(a.vx * a.vx + a.vy * a.vy) AS sa, sqrt(b.vx * b.vx + b.vy * b.vy) AS sb, a.vx * b.vy - a.vy * b.vx AS across, a.vx * b.vx + a.vy * b.vy AS along, a.z AS za, b.z AS zb,
      list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS similarity
      FROM e a JOIN e b ON a.g = b.g AND b.track > a.track AND b.track - a.track <= 90),
    q AS (SELECT *, CASE WHEN sa > 0 AND sb > 0 THEN degrees(abs(atan2(across, along))) ELSE 0 END AS angle, CASE WHEN greatest(sa, sb) > 0 THEN least(sa, sb) / greatest(sa, sb) ELSE 1 END AS speed, least(za, zb) / greatest(za, zb) AS size FROM p),
    r AS (SELECT *, ((1 - angle / 180) + speed + size) / 3 AS tracklet FROM q WHERE angle <= 67 AND speed >= 0.0574 AND size >= 0.1013 AND similarity >= 0.0771),
    o AS (SELECT *, CAST('0.7981' AS DOUBLE) * tracklet + CAST('0.3848' AS DOUBLE) * similarity AS overall FROM r WHERE tracklet >= 0.294),
    k AS (SELECT *, row_number() OVER (PARTITION BY label, new ORDER BY overall DESC, old) AS n FROM o WHERE overall >= 0.6622)
    SELECT label, new, old, round(tracklet, 6) AS tracklet, round(similarity, 6) AS similarity, round(overall, 6) AS overall FROM k WHERE n = 1""",
)
def tracklet_reid(spark, d):
    v = F.col("vec_id")
    moving = spark.read.parquet(f"{d}/embeddings.parquet").select(
        "label", v.alias("track"), v.alias("frame"), (v % 7 - 3).cast("double").alias("vx"), (v % 5 - 2).cast("double").alias("vy"), (100 + v % 300).cast("double").alias("size"), "embedding"
    )
    found = assoc.reassociate_tracklets(moving, moving, "label")
    return found.select("label", "new", "old", *[F.round(c, 6).alias(c) for c in ("tracklet", "similarity", "overall")])


def _hours(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of tracks with the hour as the frame."""
    seen = ingest.tracked(ev.observations(spark, d)).withColumn("frame", F.floor(F.col("t") / 3_600_000_000))
    return seen.select("source_id", "track_id", "frame", "left", "top", "width", "height")


def _estimates(rows: str, found: str, config: motion.MotionConfig) -> str:
    """CTE ``found``: the filter over the rows (source_id, track_id, frame, cx, cy, w, h, k) of the CTE ``rows``, one after another."""
    c = {k: f"CAST('{getattr(config, k)!r}' AS DOUBLE)" for k in ("location", "size", "velocity", "measurement")}
    return f"""{found} AS (
      SELECT source_id, track_id, k, frame, cx AS x, cy AS y, w AS width, h AS height, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, {c['measurement']} AS p, CAST(0 AS DOUBLE) AS q, {c['velocity']} AS r, {c['measurement']} AS s
      FROM {rows} WHERE k = 1
      UNION ALL
      SELECT source_id, track_id, k, frame, ax + gain * (cx - ax), ay + gain * (cy - ay), width + fit * (w - width), height + fit * (h - height), vx + pull * (cx - ax), vy + pull * (cy - ay),
             (1 - gain) * p, (1 - gain) * q, r - pull * q, (1 - fit) * s
      FROM (
        SELECT *, p / (p + {c['measurement']}) AS gain, q / (p + {c['measurement']}) AS pull, s / (s + {c['measurement']}) AS fit FROM (
          SELECT b.source_id, b.track_id, b.k, b.frame, b.cx, b.cy, b.w, b.h, e.width, e.height, e.vx, e.vy, e.x + n * e.vx AS ax, e.y + n * e.vy AS ay,
            e.p + 2 * (n * e.q + n * (n - 1) / 2 * e.r + n * (n - 1) * (n - 2) / 6 * {c['velocity']}) + n * e.r + n * (n - 1) / 2 * {c['velocity']} + n * {c['location']} AS p,
            e.q + n * e.r + n * (n - 1) / 2 * {c['velocity']} AS q, e.r + n * {c['velocity']} AS r, e.s + n * {c['size']} AS s
          FROM {found} e JOIN {rows} b ON b.source_id = e.source_id AND b.track_id = e.track_id AND b.k = e.k + 1, LATERAL (SELECT CAST(b.frame - e.frame AS DOUBLE) AS n)
        )
      )
    )"""


_BOX_ORDER = 'frame, "left", top, width, height'
_HOURS = f"""hours AS (SELECT source_id, track_id, CAST(floor(t / 3600000000) AS BIGINT) AS frame, "left", top, width, height FROM obs WHERE track_id IS NOT NULL),
    seen AS (SELECT source_id, track_id, frame, "left" + width / 2 AS cx, top + height / 2 AS cy, width AS w, height AS h, row_number() OVER (PARTITION BY source_id, track_id ORDER BY {_BOX_ORDER}) AS k FROM hours)"""
_STATES = ("x", "y", "width", "height", "vx", "vy")


@query("state_estimates", f"WITH RECURSIVE {ev.OBS}, {_HOURS}, {_estimates('seen', 'e', motion.MotionConfig())} SELECT source_id, track_id, frame, {', '.join(f'round({c}, 5) AS {c}' for c in _STATES)} FROM e")
def state_estimates(spark, d):
    return motion.estimate(_hours(spark, d)).select("source_id", "track_id", "frame", *[F.round(c, 5).alias(c) for c in _STATES])


@query(
    "projected_trajectories",
    f"""WITH RECURSIVE {ev.OBS}, {_HOURS}, {_estimates('seen', 'e', motion.MotionConfig())}, l AS (SELECT *, max(k) OVER (PARTITION BY source_id, track_id) AS n FROM e), s AS (SELECT * FROM l WHERE k = n AND n >= 4)
    SELECT source_id, track_id, frame + i AS frame, round(x + vx * i, 4) AS x, round(y + vy * i, 4) AS y FROM s, range(1, 34) t(i)""",
)
def projected_trajectories(spark, d):
    ahead = motion.project(motion.estimate(_hours(spark, d)), motion.MotionConfig(least_length=4))
    return ahead.select("source_id", "track_id", "frame", *[F.round(c, 4).alias(c) for c in ("x", "y")])


_PATHS = reid.PathConfig(region_scale=3.0)
_SCALED = motion.MotionConfig(**{k: getattr(motion.MotionConfig(), k) * 0.01 for k in ("location", "size", "velocity")}, measurement=motion.MotionConfig().measurement * 100.0)


@query(
    "path_reid",
    f"""WITH RECURSIVE {ev.TICKED}{ev.steps_sql()}, hours AS (SELECT source_id, track_id * 1000 + incarnation AS track_id, CAST(floor(t / 3600000000) AS BIGINT) AS frame, "left", top, width, height FROM steps),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, track_id ORDER BY frame DESC, "left" DESC, top DESC, width DESC, height DESC) AS newest, count(*) OVER (PARTITION BY source_id, track_id) AS n FROM hours),
    sighted AS (SELECT source_id, track_id, frame, "left" + width / 2 AS cx, top + height / 2 AS cy, width AS w, height AS h, row_number() OVER (PARTITION BY source_id, track_id ORDER BY {_BOX_ORDER}) AS k FROM ranked WHERE newest <= 20 AND n >= 2),
    {_estimates("sighted", "e", _SCALED)},
    s AS (SELECT * FROM e QUALIFY k = max(k) OVER (PARTITION BY source_id, track_id)),
    paths AS (SELECT source_id, track_id AS old, frame AS last, frame + i AS frame, x + vx * i AS x, y + vy * i AS y, width * 4 AS w, height * 4 AS h FROM s, range(1, 34) t(i)),
    pts AS (SELECT source_id, track_id AS new, frame, "left" + width / 2 AS px, top + height / 2 AS py, min(frame) OVER (PARTITION BY source_id, track_id) AS first FROM hours),
    met AS (SELECT p.source_id, new, old, last, greatest(abs(px - x) / w, abs(py - y) / h) AS off FROM paths p JOIN pts q ON p.source_id = q.source_id AND p.frame = q.frame WHERE first > last AND first - last <= 90),
    pairs AS (SELECT source_id, new, old, any_value(last) AS last, count(*) AS aligned, sum(1 - off) AS near FROM met WHERE off <= 1 GROUP BY source_id, new, old),
    scored AS (SELECT p.source_id, p.new, old, any_value(aligned) AS aligned, any_value(near) / count(*) AS path FROM pairs p JOIN pts q ON p.source_id = q.source_id AND p.new = q.new AND q.frame <= p.last + 33 GROUP BY ALL)
    SELECT source_id, new, old, aligned, round(path, 6) AS path FROM scored""",
)
def path_reid(spark, d):
    """Tracks cut where they were forgotten: which of the later pieces follow the projected path of an earlier one."""
    pieces = _steps(spark, d).select("source_id", (F.col("track_id") * 1000 + F.col("incarnation")).alias("track_id"), F.floor(F.col("t") / 3_600_000_000).alias("frame"), "left", "top", "width", "height")
    paths = reid.projected_paths(pieces, motion.MotionConfig(least_length=2), _PATHS)
    return reid.path_similarity(paths, pieces, _PATHS).withColumn("path", F.round("path", 6))


@query(
    "gallery_reid",
    """WITH s AS (SELECT (vec_id // 8) % 3 AS source_id, vec_id // 8 AS track, vec_id AS frame, (vec_id * 37 % 100) / CAST(100 AS DOUBLE) AS vis, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    t AS (SELECT source_id, track, min(frame) AS first, max(frame) AS last FROM s GROUP BY ALL),
    g AS (SELECT source_id, track, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u, row_number() OVER (PARTITION BY source_id, track ORDER BY frame DESC) AS k FROM s WHERE vis >= CAST('0.6' AS DOUBLE) AND frame % 2 = 0),
    p AS (SELECT a.source_id, a.track AS old, b.track AS new FROM t a JOIN t b ON a.source_id = b.source_id AND b.first > a.last AND b.first - a.last <= 90),
    m AS (SELECT p.source_id, p.new, p.old, max(list_inner_product(x.u, y.u)) AS similarity FROM p JOIN g x ON x.source_id = p.source_id AND x.track = p.old AND x.k <= 100 JOIN g y ON y.source_id = p.source_id AND y.track = p.new AND y.k <= 100 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id, new ORDER BY similarity DESC, old) AS n FROM m WHERE similarity >= CAST('0.0771' AS DOUBLE))
    SELECT source_id, new, old, round(similarity, 6) AS similarity FROM r WHERE n = 1""",
)
def gallery_reid(spark, d):
    """Eight vectors in a row are one track's; tracks of one of three sources are found again by their galleries."""
    v = F.col("vec_id")
    track = F.floor(v / 8)
    seen = spark.read.parquet(f"{d}/embeddings.parquet").select((track % 3).alias("source_id"), track.alias("track"), v.alias("frame"), ((v * 37 % 100) / F.lit(100.0)).alias("visibility"), "embedding")
    return reid.reassociate_galleries(seen, "source_id").withColumn("similarity", F.round("similarity", 6))


@query(
    "parsed_detections",
    f"""WITH {ev.OBS}, x AS (SELECT t, source_id, "left", top, width, height, frame_seq FROM obs)
    SELECT t, source_id, 0 AS obj_seq, 0 AS class_id, (frame_seq % 10) / CAST(10 AS DOUBLE) AS confidence, "left", top, width, height FROM x WHERE (frame_seq % 10) / CAST(10 AS DOUBLE) >= CAST('0.45' AS DOUBLE)""",
)
def parsed_detections(spark, d):
    """Every event as detector output of two rows: its box, and one of a class that is left out."""
    x1, y1 = F.col("left"), F.col("top")
    box = [x1, y1, x1 + F.col("width"), y1 + F.col("height"), (F.col("frame_seq") % 10) / F.lit(10.0)]
    output = F.array(*[c.cast("double") for c in [*box, F.lit(0), *box, F.lit(7)]])
    return detections.parse(ev.observations(spark, d).select("t", "source_id", output.alias("output")))


@query(
    "cosine_reid",
    """WITH e AS (SELECT vec_id AS track, label AS g, vec_id AS frame, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    p AS (SELECT b.g AS label, b.track AS new, a.track AS old, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) AS similarity
      FROM e a JOIN e b ON a.g = b.g AND b.frame > a.frame AND b.frame - a.frame <= 90),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, new ORDER BY similarity DESC, old) AS k FROM p WHERE similarity >= CAST('0.0771' AS DOUBLE))
    SELECT label, new, old, round(similarity, 6) AS similarity FROM r WHERE k = 1""",
)
def cosine_reid(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("vec_id").alias("track"), F.col("vec_id").alias("frame"), "embedding")
    found = assoc.reassociate(vectors, vectors, "label")  # an older track has an earlier frame
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "target_lifecycle",
    f"""WITH {ev.OBS}, f AS (SELECT DISTINCT source_id, track_id, CAST(floor(t / 3600000000) AS BIGINT) AS frame FROM obs WHERE track_id IS NOT NULL),
    g AS (SELECT *, frame - lag(frame) OVER w - 1 AS gap FROM f WINDOW w AS (PARTITION BY source_id, track_id ORDER BY frame)),
    r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, track_id ORDER BY frame) AS run FROM g),
    runs AS (SELECT source_id, track_id, run, min(frame) AS a, max(frame) - min(frame) + 1 AS span, arg_min(gap, frame) AS gap FROM r GROUP BY ALL),
    c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, track_id ORDER BY run) AS chain FROM runs),
    k AS (SELECT *, coalesce(bool_or(span >= 12) OVER (PARTITION BY source_id, track_id, chain ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS carried FROM c),
    n AS (SELECT *, sum(CASE WHEN carried THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, track_id ORDER BY run) AS target FROM k)
    SELECT r.source_id, r.track_id, r.frame, CAST(target AS BIGINT) AS target, carried OR r.frame - n.a + 1 >= 12 AS active FROM r JOIN n USING (source_id, track_id, run)""",
)
def target_lifecycle(spark, d):
    hours = ingest.tracked(ev.observations(spark, d)).select("source_id", "track_id", F.floor(F.col("t") / 3_600_000_000).alias("frame")).distinct()
    return lifecycle.with_targets(hours, lifecycle.LifecycleConfig())


# ---- byte streams and streams


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """A byte stream a source, in order of time and number: each event becomes a tiny frame, cut in two at a place that moves."""
    body = F.concat(F.lit("x"), F.col("frame_seq").cast("string")).cast("binary")
    whole = F.concat(F.lit(b"\xff\xd8"), body, F.lit(b"\xff\xd9"))
    cut = (F.col("frame_seq") % 4 + 1).cast("int")
    rows = ev.observations(spark, d).select("source_id", "t", "frame_seq", whole.alias("w"), cut.alias("c"))
    halves = F.array(F.struct(F.lit(0).alias("h"), F.expr("substring(w, 1, c)").alias("chunk")), F.struct(F.lit(1).alias("h"), F.expr("substring(w, c + 1, 1000)").alias("chunk")))
    return rows.select(F.col("source_id").alias("stream"), "t", "frame_seq", F.explode(halves).alias("p")).select("stream", F.struct("t", "frame_seq", "p.h").alias("seq"), "p.chunk")


_JPEG = f"WITH {ev.OBS}, j AS (SELECT CAST(source_id AS BIGINT) AS stream, row_number() OVER (PARTITION BY source_id ORDER BY t, frame_seq) - 1 AS seq, 'x' || frame_seq AS body FROM obs)"


@query("mjpeg_frames", f"{_JPEG} SELECT * FROM j")
def mjpeg_frames(spark, d):
    frames = jpeg.jpeg_frames(_chunks(spark, d))
    return frames.select("stream", "seq", F.expr("cast(substring(jpeg, 3, octet_length(jpeg) - 4) as string)").alias("body"))


@query("mjpeg_parts", f"{_JPEG} SELECT stream, seq, 51 + length(CAST(length(body) + 4 AS VARCHAR)) + 4 + length(body) + 4 + 2 AS part_bytes FROM j")
def mjpeg_parts(spark, d):
    return jpeg.multipart(jpeg.jpeg_frames(_chunks(spark, d))).select("stream", "seq", F.octet_length("part").cast("long").alias("part_bytes"))


@query(
    "mjpeg_repeats",
    f"""WITH {ev.OBS}, u AS (SELECT DISTINCT ON (source_id, t) source_id, t, frame_seq FROM obs ORDER BY source_id, t, frame_seq), f AS (SELECT CAST(source_id AS BIGINT) AS stream, t, frame_seq, coalesce(lead(t) OVER (PARTITION BY source_id ORDER BY t), {ev.START + 5 * ev.WEEK}) - 1 AS upto FROM u),
    g AS (SELECT stream, frame_seq, unnest(range(CAST(ceil(t / 21600000000) AS BIGINT) * 21600000000, upto + 1, 21600000000)) AS tick FROM f) SELECT stream, tick, 'x' || frame_seq AS body FROM g""",
)
def mjpeg_repeats(spark, d):
    """What a viewer gets every six hours: the latest frame again and again."""
    frames = ev.frames(spark, d).groupBy(F.col("source_id").cast("long").alias("stream"), "t").agg(F.concat(F.lit("x"), F.min("frame_seq")).alias("jpeg"))
    return jpeg.repeated(frames, 21_600_000_000, ev.START + 5 * ev.WEEK).withColumnRenamed("jpeg", "body")


@query("snapshot", f"{_JPEG} SELECT stream, arg_max(body, seq) AS body, true AS available FROM j GROUP BY stream")
def snapshot(spark, d):
    """The latest frame of every stream."""
    one = jpeg.snapshots(jpeg.jpeg_frames(_chunks(spark, d)))
    return one.select("stream", F.expr("cast(substring(jpeg, 3, octet_length(jpeg) - 4) as string)").alias("body"), "available")


@query("stream_counts", _with(f"{ev.COUNTS} FROM happened"))
def stream_counts(spark, d):
    """The events table replayed as a stream of several files, counted from the stream's output."""
    from ..streaming import replay

    return metrics.totals(replay.replay_events(ev.ticked(spark, d), ev.LINE1, ev.LINE2, ev.CONFIG))


_LIVE_SQL = f"WITH RECURSIVE {ev.WITH_VERSIONS}{ev.steps_sql('gated_ticked', lines=False)}, {_LAST}, c AS ({ev.COUNTS} FROM happened WHERE t > {max(ev.RESETS)}) SELECT c.*, r.fps FROM c, (SELECT CAST(printf('%.2f', sum(fps ORDER BY source_id)) AS DOUBLE) AS fps FROM last) r"


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a batch of one frame."""
    box = F.struct("left", "top", "width", "height").alias("rect")
    raw = F.coalesce(F.col("track_id").cast("decimal(20,0)"), F.lit(ingest.UNTRACKED).cast("decimal(20,0)")).alias("object_id")
    objects = F.array(F.struct("class_id", raw, box)).alias("objects")
    return ev.observations(spark, d).select("t", F.array(F.struct("source_id", objects)).alias("frames"))


@query("live_counts", _LIVE_SQL)
def live_counts(spark, d):
    """Events as files of batches through the live queries, stopped and started in between: lines, ticks, resets and rates all found on the way."""
    from ..streaming import replay

    return replay.live_state(_batches(spark, d), ev.line_versions(spark), ev.resets(spark), ev.CONFIG)


@query("live_source_counts", _LIVE_SQL)
def live_source_counts(spark, d):
    """The same from segments that each camera appends to its own folder, read by the streaming source with offsets."""
    from ..streaming import replay

    return replay.source_state(_batches(spark, d), ev.line_versions(spark), ev.resets(spark), ev.CONFIG)


def queries() -> dict[str, Query]:
    return dict(_spark)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["CounterConfig", "entries_exits_footfall", "oracle_sql", "queries"]
