"""Parameters of the counting engine and the fixed schemas at its edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SECOND = 1_000_000


@dataclass(frozen=True)
class Line:
    """A line through two normalised points; it counts as infinite."""

    x1: float
    y1: float
    x2: float
    y2: float


@dataclass(frozen=True)
class CounterConfig:
    """Frame size in pixels; transition window, track lifetime, rate window and the time a rate counts for in microseconds."""

    width: float = 1280.0
    height: float = 720.0
    window_us: int = 30 * SECOND
    ttl_us: int = 120 * SECOND
    fps_window_us: int = SECOND
    fps_unit_us: int = SECOND


LINE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])

OBSERVATION = T.StructType(
    [
        T.StructField("t", T.LongType(), False),  # microseconds since the epoch, one value for a whole batch
        T.StructField("frame_seq", T.LongType(), False),
        T.StructField("obj_seq", T.IntegerType(), False),
        T.StructField("source_id", T.IntegerType(), False),
        T.StructField("class_id", T.IntegerType(), False),
        T.StructField("track_id", T.LongType()),
        T.StructField("left", T.DoubleType(), False),
        T.StructField("top", T.DoubleType(), False),
        T.StructField("width", T.DoubleType(), False),
        T.StructField("height", T.DoubleType(), False),
    ]
)

LINE_VERSIONS = T.StructType([T.StructField("valid_from", T.LongType(), False), T.StructField("line1", LINE), T.StructField("line2", LINE)])

#: The JSON edge of line definitions.
LINES_JSON = "width int, height int, line1 array<array<double>>, line2 array<array<double>>"
