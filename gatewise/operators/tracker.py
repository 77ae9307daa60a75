"""A tracker of boxes: ids for detections, frame by frame (an approximation of a closed tracker).

What happens in a frame depends on the targets the frame before left, so the frames of a
source are a fold. A tracker is that fold's step and the table of its targets;
``streaming.tracking`` keeps the table in the state of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assoc
from .assoc import ACTIVE, SHADOW, TENTATIVE
from .lifecycle import LifecycleConfig
from .motion import Estimator, MotionConfig

IGNORED, SUPPRESSED = "ignored", "suppressed"
DETECTION = "t long, frame long, obj_seq long, source_id int, class_id int, confidence double, left double, top double, width double, height double, feature array<double>"
TRACKED = "source_id int, frame long, obj_seq long, track_id long, status string"


class Detection(NamedTuple):
    obj_seq: int
    class_id: int
    confidence: float
    left: float
    top: float
    width: float
    height: float
    feature: list[float] | None = None


class Tracker(Protocol):
    """What a tracker must offer. ``STATE`` is the schema of the tuple it keeps for each target."""

    STATE: str

    def load(self, targets: dict[int, tuple], next_id: int) -> None: ...

    def dump(self) -> tuple[dict[int, tuple], int]: ...

    def step(self, frame: int, detections: list[Detection]) -> Iterator[tuple[int, int | None, str]]:
        """(obj_seq, track id or None, status) for every detection of the frame."""
        ...


@dataclass(frozen=True)
class TrackerConfig:
    """Fixed values of the tracker settings are the defaults."""

    least_confidence: float = 0.1894
    tentative_confidence: float = assoc.TENTATIVE_CONFIDENCE
    shadow_confidence: float = 0.1513
    new_target_overlap: float = 0.3
    max_targets: int = 150
    life: LifecycleConfig = field(default_factory=LifecycleConfig)
    motion: MotionConfig = field(default_factory=MotionConfig)
    optimal: bool = False


class Target:
    """One target: its motion, when it was born, last seen, last seen well, and whether its probation is over."""

    __slots__ = ("active", "born", "class_id", "feature", "motion", "seen", "sure", "well")

    def __init__(self, class_id: int, born: int, motion: Estimator, feature):
        self.class_id, self.born, self.seen, self.sure, self.active, self.well, self.motion, self.feature = class_id, born, born, born, False, True, motion, feature


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(iou, size similarity) of every box of ``a`` (left, top, width, height) with every one of ``b``."""
    a, b = a.reshape(-1, 1, 4), b.reshape(1, -1, 4)
    shared = np.maximum(0.0, np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.maximum(a[..., :2], b[..., :2])).prod(-1)
    size_a, size_b = a[..., 2] * a[..., 3], b[..., 2] * b[..., 3]
    union, larger = size_a + size_b - shared, np.maximum(size_a, size_b)
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0), np.where(larger > 0, np.minimum(size_a, size_b) / np.where(larger > 0, larger, 1), 0.0)


class CascadeTracker:
    """Targets that live through probation, sight and shadow, matched to detections in three stages.

    Detections below ``least_confidence`` are ignored. The stages are those of
    ``assoc.cascade``. A target on probation ends after more than ``early_termination``
    frames without a match, another one after more than ``shadow`` frames without a sure one;
    a match below ``shadow_confidence`` moves a target but leaves it in the shadow. What is
    left of the sure detections founds targets, unless it overlaps one by more than
    ``new_target_overlap`` or the stream is full. Features, where both sides have them, add
    appearance to the first stage; a target keeps that of its last sure match.
    """

    STATE = "class_id int, born long, seen long, sure long, active boolean, well boolean, motion array<double>, feature array<double>"

    def __init__(self, config: TrackerConfig = TrackerConfig()):  # noqa: B008
        self.config, self.targets, self.next_id = config, {}, 1

    def load(self, targets: dict[int, tuple], next_id: int) -> None:
        self.targets, self.next_id = {}, next_id
        for k, (class_id, born, seen, sure, active, well, motion, feature) in sorted(targets.items()):
            one = Target(class_id, born, Estimator.going_on(self.config.motion, seen, tuple(motion)), feature)
            one.seen, one.sure, one.active, one.well = seen, sure, active, well
            self.targets[k] = one

    def dump(self) -> tuple[dict[int, tuple], int]:
        rows = {k: (x.class_id, x.born, x.seen, x.sure, x.active, x.well, [float(v) for v in x.motion.held()], x.feature) for k, x in self.targets.items()}
        return rows, self.next_id

    def _match(self, ids: list[int], found: list[Detection], frame: int, whole: bool, least: float) -> list[tuple[int, Detection]]:
        """Pairs of target and detection, by the whole score or by overlap of ``least`` or more."""
        if not ids or not found:
            return []
        boxes = np.array([self.targets[k].motion.ahead(frame) for k in ids])
        iou, size = overlaps(boxes, np.array([(d.left, d.top, d.width, d.height) for d in found], np.float64))
        same = np.equal.outer([self.targets[k].class_id for k in ids], [d.class_id for d in found])
        if whole:
            score = assoc.WEIGHT_SIZE * size + assoc.WEIGHT_IOU * iou
            able = same & (iou >= assoc.MIN_IOU) & (size >= assoc.MIN_SIZE)
            seen = np.logical_and.outer([bool(self.targets[k].feature) for k in ids], [bool(d.feature) for d in found])
            for i, j in np.argwhere(able & seen):
                a, b = self.targets[ids[i]].feature, found[j].feature
                if len(a) == len(b):
                    visual = float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0))
                    score[i, j] += assoc.WEIGHT_VISUAL * visual
                    able[i, j] = visual >= assoc.MIN_VISUAL
            able &= score >= assoc.MIN_SCORE
        else:
            score, able = iou, same & (iou >= least) & (iou > 0)
        i, j = np.nonzero(able)
        if not len(i):
            return []
        if self.config.optimal:
            keep = assoc.optimal_mask(i, j, score[i, j])
        else:
            order = np.lexsort((j, i, -score[i, j]))
            i, j = i[order], j[order]
            keep = np.array(assoc.greedy_mask(i.tolist(), j.tolist()))
        return [(ids[a], found[b]) for a, b in zip(i[keep], j[keep], strict=True)]

    def step(self, frame: int, detections: list[Detection]) -> Iterator[tuple[int, int | None, str]]:
        c = self.config
        limit = lambda x: c.life.shadow if x.active else c.life.early_termination
        self.targets = {k: x for k, x in self.targets.items() if frame - (x.sure if x.active else x.seen) - 1 <= limit(x)}
        detections = sorted(detections)
        heard = [d for d in detections if d.confidence >= c.least_confidence]
        sure, unsure = [d for d in heard if d.confidence >= c.tentative_confidence], [d for d in heard if d.confidence < c.tentative_confidence]
        in_sight = lambda x: x.well and frame - x.seen <= 1
        pairs = self._match([k for k, x in self.targets.items() if x.active], sure, frame, True, 0.0)
        met = {k for k, _ in pairs}
        pairs += self._match([k for k, x in self.targets.items() if x.active and in_sight(x) and k not in met], unsure, frame, False, assoc.MIN_TENTATIVE_IOU)
        taken = {d.obj_seq for _, d in pairs}
        pairs += self._match([k for k, x in self.targets.items() if not x.active], [d for d in sure if d.obj_seq not in taken], frame, False, assoc.MIN_IOU)
        own = {}
        for k, d in pairs:
            x = self.targets[k]
            x.motion.feed(frame, d.left + d.width / 2, d.top + d.height / 2, d.width, d.height)
            x.seen, x.well = frame, d.confidence >= c.shadow_confidence
            if x.well:
                x.sure, x.feature = frame, d.feature or x.feature
            x.active = x.active or frame - x.born + 1 >= c.life.probation
            own[d.obj_seq] = (k, TENTATIVE if not x.active else ACTIVE if x.well else SHADOW)
        boxes = [x.motion.ahead(frame) for x in self.targets.values()]
        for d in sure:
            if d.obj_seq in own:
                continue
            box = (d.left, d.top, d.width, d.height)
            if len(self.targets) >= c.max_targets or boxes and overlaps(np.array(boxes), np.array([box], np.float64))[0].max() > c.new_target_overlap:
                own[d.obj_seq] = (None, SUPPRESSED)
                continue
            motion = Estimator(c.motion)
            motion.feed(frame, d.left + d.width / 2, d.top + d.height / 2, d.width, d.height)
            one = Target(d.class_id, frame, motion, d.feature)
            one.active = c.life.probation <= 1
            own[d.obj_seq] = (self.next_id, ACTIVE if one.active else TENTATIVE)
            self.targets[self.next_id] = one
            self.next_id += 1
            boxes.append(box)
        for d in detections:
            yield (d.obj_seq, *own.get(d.obj_seq, (None, IGNORED)))


def track_table(detections: DataFrame, tracker: Callable[[], Tracker] = CascadeTracker) -> DataFrame:
    """(source_id, frame, obj_seq, track_id, status) of a table of detections (columns of ``DETECTION``, ``t`` and ``feature`` optional).

    The frames of a source stream through one task in order, and no more than one is held.
    Rows without source, frame or box are left out; an object number is unique in its frame.
    """
    names = [c.split()[0] for c in TRACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, frame, held, one = None, None, [], None

        def done() -> list[tuple]:
            return [(source, frame, *x) for x in one.step(frame, held)] if held else []

        for batch in batches:
            out = []
            for s, f, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, f) != (source, frame):
                    out += done()
                    held = []
                    if s != source:
                        one = tracker()
                    source, frame = s, f
                held.append(Detection(*rest))
            yield _rows(out, names)
        yield _rows(done() if one else [], names)

    kept = typed(detections).where("source_id is not null and frame is not null").dropna(subset=["left", "top", "width", "height"])
    wanted = kept.select("source_id", "frame", "obj_seq", "class_id", "confidence", "left", "top", "width", "height", "feature")
    return wanted.repartition("source_id").sortWithinPartitions("source_id", "frame", "obj_seq").mapInArrow(run, TRACKED)


def typed(detections: DataFrame) -> DataFrame:
    return detections.select(*[(F.col(n) if n in detections.columns else F.lit(None)).cast(kind).alias(n) for n, kind in (c.split(" ", 1) for c in DETECTION.split(", "))])


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _ship() -> None:
    import sys

    from . import lifecycle

    for name in (__name__, lifecycle.__name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


_ship()
