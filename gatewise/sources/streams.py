"""Metadata of live sources as streams: files of nested batches, one schema, many sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import flatten_batches

BATCH = (
    "t bigint, prev_tick bigint, frames array<struct<source_id: int, objects: array<struct<"
    "class_id: int, object_id: decimal(20,0), rect: struct<left: double, top: double, width: double, height: double>>>>>"
)


def batch_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files under ``path`` as batches; the rate limit takes the place of dropped frames."""
    return spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path)


def batch_table(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a table, for replay."""
    return spark.read.schema(BATCH).json(path)


def observations(batches: DataFrame) -> DataFrame:
    """Flattened objects with their tick and ``at``, the time as a timestamp; works on both forms."""
    ticks = batches.select(F.struct("t", "prev_tick").alias("t"), "frames")
    flat = flatten_batches(ticks)
    rest = [c for c in flat.columns if c != "t"]
    return flat.select(F.col("t.t").alias("t"), *rest, F.col("t.prev_tick").alias("prev_tick"), F.timestamp_micros("t.t").alias("at"))


def frames(batches: DataFrame) -> DataFrame:
    """(t, frame_seq, source_id) of every frame, also those without objects: what rates and ticks need."""
    return batches.select("t", F.posexplode("frames").alias("frame_seq", "frame")).select("t", F.col("frame_seq").cast("long").alias("frame_seq"), F.col("frame.source_id").alias("source_id"))
