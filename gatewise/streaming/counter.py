"""Crossing events from a stream of observations, with the batch semantics.

The tracks of a source are dealt to buckets, each a state group with a list of rows that
wait for the watermark, those that came together as columns in one value, a list of its tracks, and event-time timers: what is asked of the
state store grows with buckets, not with tracks. Arriving rows are appended to the list; a timer takes those
that the watermark has passed in order, folds them track by track, and removes tracks whose
lifetime is over. Rows that come behind the watermark leave at once, marked as late, so
every row is either used or reported.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CounterConfig, Line
from ..operators.ingest import persons, tracked
from ..operators.tracks import with_foot_point

EVENT = "t long, frame_seq long, obj_seq int, source_id int, track_id long, kind string"
#: ``kind`` of a row that came behind the watermark.
LATE = "late"
TRACK = "track_id long, x double, y double, line int, at long, seen long"
#: Columns of rows that came together, as one value of the state.
WAITING = "rows binary"
#: Source and track of rows that only say how late it is.
HEARTBEAT = -1
#: State groups of a source.
BUCKETS = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that the state API needs; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class TrackFold:
    """The state of one track and what an observation does to it."""

    def __init__(self, line1: Line | None, line2: Line | None, config: CounterConfig):
        self.lines, self.config = (line1, line2), config

    @staticmethod
    def _crossed(lines: tuple, before: tuple[float, float], after: tuple[float, float]) -> int | None:
        for number, line in enumerate(lines, 1):
            a, b = ((line.x2 - line.x1) * (y - line.y1) - (line.y2 - line.y1) * (x - line.x1) for x, y in (before, after))
            if a == 0 or b == 0 or (a < 0) != (b < 0):
                return number
        return None

    def step(self, track: dict | None, t: int, prev_tick: int | None, point: tuple[float, float], lines: tuple | None = None) -> tuple[dict, str | None]:
        """The track after the observation, and "entry" or "exit" if it completes one."""
        if track and track["seen"] < t and prev_tick is not None and prev_tick - track["seen"] > self.config.ttl_us:
            track = None
        if track is None:
            return {"point": point, "line": None, "at": t, "seen": t}, None
        kind, number = None, self._crossed(lines or self.lines, track["point"], point)
        line, at = track["line"], track["at"]
        if number is not None:
            if line is not None and line != number and t - at <= self.config.window_us:
                kind, line = ("entry" if number == 2 else "exit"), None
            else:
                line, at = number, t
        return {"point": point, "line": line, "at": at, "seen": t}, kind


_ENDS = [f"line{n}.{c}" for n in (1, 2) for c in ("x1", "y1", "x2", "y2")]
#: What is known of a waiting row; behind it the ends of its lines, if it brings its own.
_KNOWN = ["track_id", "t", "frame_seq", "obj_seq", "prev_tick", "px", "py"]
#: Stands for no tick before.
_NEVER = -(1 << 63)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of waiting rows; lines that all rows share are kept once."""
    return pickle.dumps([*columns[: len(_KNOWN)], *[x[:1] if (x == x[0]).all() else x for x in columns[len(_KNOWN) :]]], protocol=5)


def _unpacked(rows: bytes) -> list[np.ndarray]:
    columns = pickle.loads(bytes(rows))
    return [x if len(x) == len(columns[0]) else np.repeat(x, len(columns[0])) for x in columns]


class TrackCounter(StatefulProcessor):
    """Folds the rows of the tracks in one bucket, each track's in order of time, as the watermark passes them."""

    def __init__(self, line1: Line | None, line2: Line | None, config: CounterConfig):
        self.fold, self.ttl = TrackFold(line1, line2, config), config.ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks, self.waiting = handle.getListState("tracks", TRACK), handle.getListState("waiting", WAITING)

    def _wake(self, at: int, watermark: int) -> None:
        """Keep the earliest timer ahead of the watermark; those behind it fire in this batch or have just done so."""
        ahead = [x for x in self.handle.listTimers() if x > watermark]
        if not ahead or at < min(ahead):
            for old in ahead:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    @staticmethod
    def _events(key: tuple, t, frame, obj, track, kind) -> pd.DataFrame:
        numbers = {"t": (t, np.int64), "frame_seq": (frame, np.int64), "obj_seq": (obj, np.int32), "source_id": (key[0], np.int32), "track_id": (track, np.int64)}
        return pd.DataFrame({c: np.broadcast_to(np.asarray(x, kind_), len(t)) for c, (x, kind_) in numbers.items()} | {"kind": kind})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for held in rows:
            held = held[[c for c in held.columns if c not in ("source_id", "bucket")]]
            late = held.t.to_numpy() < watermark * 1000
            if late.any():
                yield self._events(key, *[held[c].to_numpy()[late] for c in ("t", "frame_seq", "obj_seq", "track_id")], LATE)
            if not late.all():
                columns = [held[c].to_numpy()[~late] for c in held.columns]
                self.waiting.appendValue((_packed(columns),))
                soonest = int(columns[1].min())
                first = soonest if first is None else min(first, soonest)
        if first is not None:
            self._wake(max(first // 1000 + 1, watermark + 1), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = [_unpacked(rows) for (rows,) in self.waiting.get()] if self.waiting.exists() else []
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        passed = columns[1] < watermark * 1000 if columns else np.zeros(0, bool)
        due, rest = [x[passed] for x in columns], [x[~passed] for x in columns]
        some, later = bool(passed.any()), not passed.all()
        tracks, found = {}, []
        for one, x, y, line, at, seen in self.tracks.get() if self.tracks.exists() else ():
            tracks[one] = {"point": (x, y), "line": line, "at": at, "seen": seen}
        if some:
            order = np.lexsort(due[3::-1])  # by track, time, frame and object
            known = [x[order].tolist() for x in due[: len(_KNOWN)]]
            own = [x[order].tolist() for x in due[len(_KNOWN) :]]
            both: dict = {None: None}
            for one, t, frame, obj, tick, x, y, ends in zip(*known, zip(*own, strict=True) if own else repeat(None, len(order)), strict=True):
                if ends not in both:
                    both[ends] = (Line(*ends[:4]), Line(*ends[4:]))
                tracks[one], kind = self.fold.step(tracks.get(one), t, None if tick == _NEVER else tick, (x, y), both[ends])
                if kind:
                    found.append((t, frame, obj, one, kind))
            if found:
                yield self._events(key, *zip(*found, strict=True))
            if later:
                self.waiting.put([(_packed(rest),)])
            else:
                self.waiting.clear()
        expected = set(rest[0].tolist()) if later else set()
        left = {one: track for one, track in tracks.items() if one in expected or track["seen"] + 2 * self.ttl >= watermark * 1000}
        if left and (some or len(left) < len(tracks)):
            self.tracks.put([(one, *track["point"], track["line"], track["at"], track["seen"]) for one, track in left.items()])
        elif tracks and not left:
            self.tracks.clear()
        times = [int(rest[1].min())] if later else []
        times += [track["seen"] + 2 * self.ttl for one, track in left.items() if one not in expected]
        if times:
            self._wake(max(min(times) // 1000 + 1, watermark + 1), watermark)


def crossing_stream(observations: DataFrame, line1: Line | None, line2: Line | None, config: CounterConfig, delay: str = "0 seconds") -> DataFrame:
    """Append-mode events from streaming observations with ``prev_tick`` and ``at`` (the time as a timestamp).

    With lines of None the rows bring their own, as structs ``line1`` and ``line2``. A row
    behind the watermark comes out with the kind ``late`` instead of being counted. The last
    rows of a stream come out only when later rows, of any track or of none (``HEARTBEAT`` as source and track), move the watermark past
    them. Start the query inside ``state_store``.
    """
    points = with_foot_point(tracked(persons(observations)), config).withWatermark("at", delay)
    ends = [F.col(c).cast("double").alias(c.replace(".", "_")) for c in _ENDS] if line1 is None else []
    box = [F.coalesce(c, F.raise_error(F.lit("an observation has no box")).cast("double")).alias(c) for c in ("px", "py")]
    tick = F.coalesce(F.col("prev_tick").cast("long"), F.lit(_NEVER)).alias("prev_tick")
    # Without ``at`` the rows behind the watermark are not dropped before the processor sees them.
    bucket = F.pmod(F.hash("track_id"), F.lit(BUCKETS))
    # Heartbeats move the watermark and go no further, or one group would get every tick; the condition on ``at`` keeps the filter above the watermark.
    seen = points.where((F.col("source_id") != HEARTBEAT) | (F.col("track_id") != HEARTBEAT) | (F.col("at") < F.lit("0001-01-01").cast("timestamp")))
    slim = seen.select("source_id", bucket.alias("bucket"), "track_id", "t", "frame_seq", "obj_seq", tick, *box, *ends)
    return slim.groupBy("source_id", "bucket").transformWithStateInPandas(TrackCounter(line1, line2, config), EVENT, "append", "eventtime")


def checkpointed_tracks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(source_id, track_id, x, y, line, at, seen): the tracks that a counter's checkpoint holds, as a table."""
    held = spark.read.format("statestore").option("stateVarName", "tracks").load(checkpoint)
    return held.select("key.source_id", "list_element.*")


def tracks_from_events(ticked: DataFrame, line1: Line, line2: Line, config: CounterConfig, upto: int) -> DataFrame:
    """The same tracks worked out of the table of observations, all rows before the time ``upto`` (microseconds) folded.

    What waits for another crossing is the last one of a track's last incarnation, unless a match used it up.
    """
    from ..operators.tracks import with_incarnation, with_previous_point
    from ..operators.transitions import with_crossing, with_links, with_matches

    kept = tracked(persons(ticked.where(F.col("t") < upto)))
    steps = with_crossing(with_previous_point(with_incarnation(with_foot_point(kept, config), config)), line1, line2)
    key = ["source_id", "track_id"]
    order = F.struct("t", "frame_seq", "obj_seq")
    last = steps.groupBy(*key).agg(F.max_by(F.struct("incarnation", "px", "py", "t"), order).alias("now"))
    born = steps.groupBy(*key, "incarnation").agg(F.min("t").alias("born"))
    crossed = with_matches(with_links(steps, config)).groupBy(*key, "incarnation").agg(F.max_by(F.struct(F.when(~F.col("match"), F.col("z")).alias("line"), "t"), order).alias("crossing"))
    # A match leaves the time of the crossing it used up, the one before it.
    held = with_matches(with_links(steps, config)).groupBy(*key, "incarnation").agg(F.max(F.when(~F.col("match"), F.col("t"))).alias("armed"))
    rows = last.withColumn("incarnation", F.col("now.incarnation")).join(born, [*key, "incarnation"]).join(crossed, [*key, "incarnation"], "left").join(held, [*key, "incarnation"], "left")
    rows = rows.where(F.col("now.t") + 2 * config.ttl_us >= upto)
    return rows.select(*key, F.col("now.px").alias("x"), F.col("now.py").alias("y"), F.col("crossing.line").cast("int").alias("line"), F.coalesce("armed", "born").alias("at"), F.col("now.t").alias("seen"))


# ---- the state file

FIRST_STATE = {"entries": 0, "exits": 0, "footfall": 0, "fps": 0.0, "fps_by_source": {}, "updated_at": 0, "epoch": -1, "reset_at": None}


def read_state(spark: SparkSession, path: str) -> dict:
    """The state file with defaults for what it lacks; all defaults if it is missing or broken."""
    fs = spark._jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    state = dict(FIRST_STATE)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        try:
            held = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
            state |= {k: held[k] for k in FIRST_STATE if k in held}
            state |= {k: int(state[k]) for k in ("entries", "exits", "footfall")} | {"fps": float(state["fps"])}
        except (ValueError, TypeError):
            return dict(FIRST_STATE)
    return state


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and move it there in one step: readers see the old file or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, temporary = fs.Path(path), fs.Path(path + ".tmp")
    out = target.getFileSystem(conf).create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    context.rename(context.makeQualified(temporary), context.makeQualified(target), how)


def write_state(batch: DataFrame, epoch: int, path: str, resets: DataFrame | None = None, rates: DataFrame | None = None, updated_at: float | None = None) -> None:
    """A ``foreachBatch`` sink that keeps one small JSON state file, replaced in one step.

    ``batch`` holds new crossing events, ``rates`` (source_id, fps) the latest rates.
    Counts are those after the last of ``resets`` (t); tracks live on. A batch that is
    replayed changes nothing.
    """
    from ..operators.metrics import fps_total, totals

    state = read_state(batch.sparkSession, path)
    if state["epoch"] >= epoch:
        return
    reset_at = resets.agg(F.max("t")).first()[0] if resets is not None else None
    if reset_at is not None and (state["reset_at"] is None or reset_at > state["reset_at"]):
        state |= {"entries": 0, "exits": 0, "reset_at": reset_at}
    batch = batch.where(F.col("kind") != LATE)
    new = totals(batch if state["reset_at"] is None else batch.where(F.col("t") > state["reset_at"])).first()
    state |= {k: state[k] + new[k] for k in ("entries", "exits")}
    if rates is not None:
        known = rates.where("fps is not null")
        state |= {"fps": fps_total(known).first()[0], "fps_by_source": {str(r.source_id): r.fps for r in known.orderBy("source_id").collect()}}  # a row for each source
    if updated_at is not None:
        state["updated_at"] = updated_at
    state |= {"footfall": max(0, state["entries"] - state["exits"]), "epoch": epoch}
    replace_file(batch.sparkSession, path, json.dumps(state, separators=(",", ":")))


def ship() -> None:
    """Send the fold's code with the tasks, so executors need no copy of this package."""
    import sys

    from .. import config

    for name in (__name__, config.__name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


ship()
