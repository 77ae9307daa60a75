"""From nested batches to observations: flattening, ids, filters, the tick timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000, 3_600_000_000
#: Both spellings of the id that marks an object without a track.
UNTRACKED = "18446744073709551615"


def flatten_batches(batches: DataFrame) -> DataFrame:
    """(t, frames: array<struct<source_id, objects>>) to one row an object, in iteration order.

    Frames without objects vanish here; keep a table of frames for rates and ticks.
    """
    frames = batches.select("t", F.posexplode("frames").alias("frame_seq", "frame"))
    objects = frames.select("t", F.col("frame_seq").cast("long"), F.col("frame.source_id").alias("source_id"), F.posexplode("frame.objects").alias("obj_seq", "o"))
    rect = [F.col(f"o.rect.{c}").cast("double").alias(c) for c in ("left", "top", "width", "height")]
    return objects.select("t", "frame_seq", "obj_seq", "source_id", F.col("o.class_id").alias("class_id"), track_id(F.col("o.object_id")).alias("track_id"), *rect)


def track_id(raw: Column) -> Column:
    """Unsigned ids as signed ones; the untracked mark, as 2^64-1 or -1, becomes null."""
    text = raw.cast("string")
    wide = text.cast("decimal(20,0)")
    signed = F.when(wide > F.lit("9223372036854775807").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)
    return F.when(text.isin(UNTRACKED, "-1"), F.lit(None)).otherwise(signed.cast("long"))


def persons(observations: DataFrame, class_id: int = 0) -> DataFrame:
    """One class only. It must come before any look at earlier rows."""
    return observations.where(F.col("class_id") == class_id)


def tracked(observations: DataFrame) -> DataFrame:
    return observations.where(F.col("track_id").isNotNull())


def confident(detections: DataFrame, least: float = 0.45) -> DataFrame:
    return detections.where(F.col("confidence") >= F.lit(least))


def top_detections(detections: DataFrame, keys: list[str], k: int = 300) -> DataFrame:
    """The ``k`` most confident rows of each frame; ties go to the earlier object."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "obj_seq"))
    return detections.withColumn("rank", rank).where(F.col("rank") <= k)


def tick_timeline(frames: DataFrame, bucket_us: int = HOUR) -> DataFrame:
    """(t, prev_tick) of the distinct times of ``frames``; the first has no earlier one.

    Time is cut into buckets, so no task orders all ticks; the last tick of the bucket
    before comes from a table with one row a bucket.
    """
    ticks = frames.select("t").distinct().withColumn("_bucket", F.floor(F.col("t") / bucket_us))
    ends = ticks.groupBy("_bucket").agg(F.max("t").alias("_last"))
    carried = ends.select("_bucket", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")).alias("_carried"))
    own = ticks.withColumn("_own", F.lag("t").over(Window.partitionBy("_bucket").orderBy("t")))
    return own.join(carried, "_bucket").select("t", F.coalesce("_own", "_carried").alias("prev_tick"))


def with_prev_tick(rows: DataFrame, frames: DataFrame | None = None, bucket_us: int = HOUR) -> DataFrame:
    """Add ``prev_tick``, the latest tick before ``t``, to rows with the time of a tick.

    Every frame of a batch with lines in force ticks, whether it shows an object or not:
    give them as ``frames`` (``t`` is read). Without them the rows' own times are the ticks.
    The rows are not ordered; they meet the timeline, one row a tick, by their time.
    """
    return rows.join(tick_timeline(rows if frames is None else frames, bucket_us), "t")
