"""Boxes out of raw detector output, by a parser that is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import top_detections
from .settings import DetectorSettings

DETECTION = "t long, source_id int, obj_seq int, class_id int, confidence double, left double, top double, width double, height double"
#: Takes the output of one frame, gives rows (class, confidence, left, top, width, height).
Parser = Callable[[np.ndarray], np.ndarray]


def corners(output: np.ndarray) -> np.ndarray:
    """The parser of rows (x1, y1, x2, y2, confidence, class)."""
    x = output.reshape(-1, 6)
    return np.stack([x[:, 5], x[:, 4], x[:, 0], x[:, 1], x[:, 2] - x[:, 0], x[:, 3] - x[:, 1]], 1)


def parse(outputs: DataFrame, parser: Parser = corners, settings: DetectorSettings | None = None) -> DataFrame:
    """Detections of (t, source_id, output array<float>): parsed, of kept classes, confident enough, the best of each frame.

    Null outputs are frames without detections; rows with a number that is not finite go.
    """
    settings = settings or DetectorSettings()
    names = [c.split()[0] for c in DETECTION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parser(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)) if v.is_valid else np.zeros((0, 6)) for v in batch.column(2)]
            n = [len(x) for x in found]
            rows = np.concatenate(found) if found else np.zeros((0, 6))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            place = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0)
            finite = np.isfinite(rows).all(1)
            kinds = [pa.array(place.astype(np.int32)), pa.array(np.where(finite, rows[:, 0], -1).astype(np.int32)), *(pa.array(rows[:, i]) for i in range(1, 6))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *kinds], names=names).filter(pa.array(finite))

    flat = outputs.select(F.col("t").cast("long").alias("t"), F.col("source_id").cast("int").alias("source_id"), "output").mapInArrow(run, DETECTION)
    kept = flat.where(~F.col("class_id").isin(*settings.excluded) & (F.col("confidence") >= settings.threshold))
    return top_detections(kept, ["t", "source_id"], settings.top_k).drop("rank")


def _ship() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
