"""Replay of a batch table through the streaming counter."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CounterConfig, Line
from ..operators.tracker import TRACKED, Tracker, typed
from ..shared import shared_folder
from ..sources.live_source import append_lines, append_segment, camera_stream
from .counter import EVENT, HEARTBEAT, LATE, crossing_stream, read_state, state_store

#: More files than a slice can have: its files are in no order of time, so it is taken whole.
WHOLE = (1 << 31) - 1


def replay_events(ticked: DataFrame, line1: Line, line2: Line, config: CounterConfig, files: int = 4) -> DataFrame:
    """Crossing events of ``ticked`` observations, written in time order as slices and read as a stream.

    The files of a slice are in no order of time, so the query takes a slice whole, however
    many files it has, and stops and starts again before the next. A heartbeat after the last row moves the watermark past the end, so nothing stays behind.
    """
    spark = ticked.sparkSession
    root = shared_folder(spark, "replay")
    names = ["t", "frame_seq", "obj_seq", "source_id", "class_id", "track_id", "left", "top", "width", "height", "prev_tick"]
    rows = ticked.select(*names)
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    if first is None:
        return spark.createDataFrame([], EVENT)
    step = (last - first) // files + 1
    beat = {"t": last + 4 * config.ttl_us, "track_id": HEARTBEAT, "source_id": HEARTBEAT}
    one = spark.range(1).select(*[F.lit(beat.get(c, 0)).cast(rows.schema[c].dataType).alias(c) for c in names])
    for k in range(files + 1):
        part = rows.where((F.col("t") >= first + k * step) & (F.col("t") < first + (k + 1) * step)) if k < files else one
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        events = crossing_stream(stream.withColumn("at", F.timestamp_micros("t")), line1, line2, config, delay="1 hour")
        with state_store(spark):
            done = events.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out").where(F.col("kind") != LATE)


def replay_tracks(detections: DataFrame, make: Callable[[], Tracker], slices: int = 2) -> DataFrame:
    """What ``tracked_stream`` gives for a table of detections, written slice by slice; the query stops and starts again in between."""
    from .tracking import tracked_stream

    spark = detections.sparkSession
    root = shared_folder(spark, "replay")
    rows = typed(detections)
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    if first is None:
        return spark.createDataFrame([], TRACKED)
    step = (last - first) // slices + 1
    beat = {"t": last + 3_600_000_000, "source_id": -1}
    one = spark.range(1).select(*[F.lit(beat.get(f.name, None if f.name == "feature" else 0)).cast(f.dataType).alias(f.name) for f in rows.schema])
    for k in range(slices + 1):
        part = rows.where((F.col("t") >= first + k * step) & (F.col("t") < first + (k + 1) * step)) if k < slices else one
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in").withColumn("at", F.timestamp_micros("t"))
        tracked = tracked_stream(stream, make)
        with state_store(spark):
            query = tracked.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(tracked.schema).parquet(f"{root}/out").where("source_id >= 0")


def write_segments(batches: DataFrame, path: str, number: int) -> None:
    """``batches`` (t, frames) as segments of the cameras whose frames they hold, in order of time.

    Cameras are cut by time among tasks. A task writes what it holds of a camera, an Arrow batch at a time,
    so neither it nor a segment grows with the camera. Segments of a later ``number`` come later.
    """
    frame = batches.select("t", F.explode("frames").alias("frame"))
    line = F.to_json(F.struct("t", F.array("frame").alias("frames")))
    rows = frame.select(F.col("frame.source_id").alias("source_id"), "t", line.alias("line")).repartitionByRange("source_id", "t").sortWithinPartitions("source_id", "t")

    def put(parts):
        task, chunk = TaskContext.get().partitionId(), 0
        for part in parts:
            cameras = part["source_id"].to_pylist()
            for camera in dict.fromkeys(cameras):
                first, n = cameras.index(camera), cameras.count(camera)
                append_lines(path, f"camera-{camera}", number * 10**9 + task * 10**4 + chunk, part["line"].slice(first, n).to_pylist())
            chunk += 1
            yield pa.record_batch([pa.array([len(cameras)], pa.int64())], ["n"])

    rows.mapInArrow(put, "n long").count()


def source_state(batches: DataFrame, versions: DataFrame, resets: DataFrame, config: CounterConfig, slices: int = 2) -> DataFrame:
    """As ``live_state``, but the batches come from the cameras' own segments."""
    from .live import start_counter, start_ticker

    spark = batches.sparkSession
    root = shared_folder(spark, "replay")
    first, last = batches.agg(F.min("t"), F.max("t")).first()
    step = ((last or 0) - (first or 0)) // slices + 1
    for k in range(slices + 1):
        if first is not None and k < slices:
            write_segments(batches.where((F.col("t") >= first + k * step) & (F.col("t") < first + (k + 1) * step)), f"{root}/in", k)
        else:
            append_segment(f"{root}/in", "clock", k, [{"t": (last or 0) + 4 * config.ttl_us, "frames": []}])
        start_ticker(camera_stream(spark, f"{root}/in"), f"{root}/live", lambda: versions, config, availableNow=True).awaitTermination()
        start_counter(spark, f"{root}/live", f"{root}/state.json", lambda: resets, config, availableNow=True).awaitTermination()
    state = read_state(spark, f"{root}/state.json")
    return spark.createDataFrame([(state["entries"], state["exits"], state["footfall"], state["fps"])], "entries long, exits long, footfall long, fps double")


def live_state(batches: DataFrame, versions: DataFrame, resets: DataFrame, config: CounterConfig, slices: int = 2) -> DataFrame:
    """One row, the state file after ``batches`` (t, frames) went through both live queries slice by slice.

    The queries stop and start again between the slices. A last batch without objects,
    long after the others, moves time past the end.
    """
    from ..sources.streams import batch_stream
    from .live import start_counter, start_ticker

    spark = batches.sparkSession
    root = shared_folder(spark, "replay")
    first, last = batches.agg(F.min("t"), F.max("t")).first()
    step = ((last or 0) - (first or 0)) // slices + 1
    for k in range(slices + 1):
        if first is not None and k < slices:
            part = batches.where((F.col("t") >= first + k * step) & (F.col("t") < first + (k + 1) * step))
        else:
            part = batches.limit(0) if first is None else spark.range(1).select(F.lit(last + 4 * config.ttl_us).alias("t"), F.expr("array()").cast(batches.schema["frames"].dataType).alias("frames"))
        part.write.mode("append").json(f"{root}/in")
        start_ticker(batch_stream(spark, f"{root}/in", WHOLE), f"{root}/live", lambda: versions, config, availableNow=True).awaitTermination()
        start_counter(spark, f"{root}/live", f"{root}/state.json", lambda: resets, config, availableNow=True).awaitTermination()
    state = read_state(spark, f"{root}/state.json")
    return spark.createDataFrame([(state["entries"], state["exits"], state["footfall"], state["fps"])], "entries long, exits long, footfall long, fps double")
