"""The tracker as a stateful query: detections without ids in, ids out.

Every source is a state group. Its targets are a map in the state, one entry each, so a
micro-batch reads and writes targets as rows; detections wait in a list until the watermark
passes their frame. Any tracker can be plugged in that keeps a tuple for each target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracker import TRACKED, CascadeTracker, Detection, Tracker, typed
from .counter import LATE

_WAITING = "t long, frame long, obj_seq long, class_id int, confidence double, left double, top double, width double, height double, feature array<double>"


class TrackSource(StatefulProcessor):
    """Runs the tracker of one source over its frames as the watermark passes them."""

    def __init__(self, tracker: Callable[[], Tracker]):
        self.tracker = tracker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.targets = handle.getMapState("targets", "id long", self.tracker().STATE)
        self.next_id, self.waiting = handle.getValueState("next_id", "id long"), handle.getListState("waiting", _WAITING)

    def _wake(self, at: int, watermark: int) -> None:
        """Keep the earliest timer ahead of the watermark; those behind it fire in this batch or have just done so."""
        ahead = [x for x in self.handle.listTimers() if x > watermark]
        if not ahead or at < min(ahead):
            for old in ahead:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = []
        for r in rows:
            if r.t < watermark * 1000:
                yield Row(source_id=key[0], frame=r.frame, obj_seq=r.obj_seq, track_id=None, status=LATE)
            else:
                new.append((r.t, r.frame, r.obj_seq, r.class_id, r.confidence, r.left, r.top, r.width, r.height, r.feature))
        if new:
            self.waiting.appendList(new)
            self._wake(max(min(x[0] for x in new) // 1000 + 1, watermark + 1), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = [x for x in held if x[0] < watermark * 1000], [x for x in held if x[0] >= watermark * 1000]
        if due:
            before = {k[0]: tuple(v) for k, v in self.targets.iterator()}
            one = self.tracker()
            one.load(before, self.next_id.get()[0] if self.next_id.exists() else 1)
            frames: dict[int, list[Detection]] = {}
            for _, frame, *box in due:
                frames.setdefault(frame, []).append(Detection(*box))
            for frame in sorted(frames):
                for obj, track, status in one.step(frame, frames[frame]):
                    yield Row(source_id=key[0], frame=frame, obj_seq=obj, track_id=track, status=status)
            after, next_id = one.dump()
            for k in before.keys() - after.keys():
                self.targets.removeKey((k,))
            for k, x in after.items():
                if before.get(k) != x:
                    self.targets.updateValue((k,), x)
            self.next_id.update((next_id,))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self._wake(max(min(x[0] for x in rest) // 1000 + 1, watermark + 1), watermark)


def tracked_stream(detections: DataFrame, tracker: Callable[[], Tracker] = CascadeTracker, delay: str = "0 seconds") -> DataFrame:
    """Append-mode (source_id, frame, obj_seq, track_id, status) of streaming detections.

    ``detections`` has the columns of ``operators.tracker.DETECTION`` (``feature`` is
    optional) and ``at``, the time as a timestamp. All rows of a frame have one time, and
    frames of a source ascend with it. Rows behind the watermark come out as late, without an
    id. Start the query inside ``counter.state_store``.
    """
    marked = detections.withWatermark("at", delay)
    return typed(marked).dropna(subset=["t", "source_id", "frame", "left", "top", "width", "height"]).groupBy("source_id").transformWithState(TrackSource(tracker), TRACKED, "append", "eventtime")


def checkpointed_targets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(source_id, id, columns of the tracker's state): the targets that a checkpoint of the query holds, as a table."""
    held = spark.read.format("statestore").option("stateVarName", "targets").load(checkpoint)
    return held.select(F.col("key.source_id"), F.col("user_map_key.id"), "user_map_value.*")


def _ship() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
