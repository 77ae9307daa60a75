"""Live counting from batches of frames: ticks, lines, resets, rates and the state file.

Two chained queries. The first takes the raw batches, looks up the lines in force, puts the
tick before each one beside it, carries the rate windows on, and appends observations as
files. The second folds the tracks of these observations and keeps the state file. Control
tables are read again in every micro-batch, so its trigger is how often they are refreshed.
What the first carries from batch to batch lies in a folder for each of its epochs. It is
written beside and moved there in one step, so it is there whole or not at all, a repeated
epoch changes nothing, and a restarted query goes on where the last one stopped. Carried
folders leave after ``KEPT`` epochs, observations once they are counted, so what a
micro-batch has to list does not grow with the age of the queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import LINE, OBSERVATION, CounterConfig
from ..operators.control import with_lines
from ..operators.ingest import flatten_batches, tick_timeline
from ..operators.metrics import OPEN_RATES, carry_rates
from ..sources.streams import frames
from .counter import HEARTBEAT, LATE, crossing_stream, state_store, write_state

SEEN = T.StructType(
    [*OBSERVATION.fields, T.StructField("line1", LINE), T.StructField("line2", LINE), T.StructField("prev_tick", T.LongType())]
)
CLOCK = "last_tick long, last_frame long"


#: Epochs of carried folders that stay, for a repeated epoch and for the other query.
KEPT = 10
#: How often state is written, unless a trigger is given.
THROTTLE = {"processingTime": "500 milliseconds"}


def _system(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _done(spark: SparkSession, path: str) -> bool:
    system, where = _system(spark, path)
    return system.exists(where)


def _once(df: DataFrame, root: str, name: str, epoch: int) -> None:
    """Write ``df`` as an epoch's folder unless an earlier attempt did: beside it first, then moved there in one step."""
    spark, path = df.sparkSession, f"{root}/{name}/{epoch:09d}"
    if _done(spark, path):
        return
    beside = f"{root}/unfinished/{name}-{epoch:09d}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    system, where = _system(spark, path)
    system.mkdirs(where.getParent())
    if not system.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), where):
        raise OSError(f"{beside} could not be moved to {path}")


def _children(spark: SparkSession, path: str) -> list[str]:
    system, where = _system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def _drop(spark: SparkSession, path: str) -> None:
    system, where = _system(spark, path)
    system.delete(where, True)


def _tidy(spark: SparkSession, root: str, epoch: int) -> None:
    """Remove what no later epoch reads: carried folders beyond ``KEPT``, and emptied folders of observations."""
    for name in ("clock", "rates"):
        _drop(spark, f"{root}/{name}/{epoch - KEPT:09d}")
    for old in _children(spark, f"{root}/observations"):
        if old.isdigit() and int(old) < epoch and not any(x.endswith(".parquet") for x in _children(spark, f"{root}/observations/{old}")):
            _drop(spark, f"{root}/observations/{old}")


def _carried(spark: SparkSession, root: str, name: str, epoch: int, schema: str) -> DataFrame:
    """What the epoch before wrote, nothing before the first."""
    path = f"{root}/{name}/{epoch - 1:09d}"
    if epoch > 0 and not _done(spark, path):
        raise FileNotFoundError(f"{path} of the epoch before is missing")
    return spark.read.schema(schema).parquet(path) if epoch > 0 else spark.createDataFrame([], schema)


def start_ticker(batches: DataFrame, root: str, versions: Callable[[], DataFrame], config: CounterConfig, **trigger) -> StreamingQuery:
    """Run the first query over streaming ``batches`` (t, frames); ``versions()`` gives the line versions at that moment.

    A batch ticks if lines are in force, whether its frames show objects or not. Batches
    come in order of time. Every tick also leaves a heartbeat row, so that time goes on
    downstream while nobody is seen.
    """
    spark = batches.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read once for all that is made of it
        held = _carried(spark, root, "clock", epoch, CLOCK).first()
        last_tick, last_frame = (held.last_tick, held.last_frame) if held else (None, None)
        every, lines = frames(batch), versions()
        ticks = with_lines(batch.select("t").distinct(), lines)
        timeline = tick_timeline(ticks).withColumn("prev_tick", F.coalesce("prev_tick", F.lit(last_tick).cast("long")))
        timeline = ticks.join(timeline, "t")
        seen = flatten_batches(batch).join(timeline, "t")
        zero = F.lit(0.0)
        beat = {"frame_seq": F.lit(0).cast("long"), "obj_seq": F.lit(0), "source_id": F.lit(HEARTBEAT), "class_id": F.lit(0), "track_id": F.lit(HEARTBEAT).cast("long")}
        beats = timeline.withColumns(beat | dict.fromkeys(("left", "top", "width", "height"), zero))
        names = SEEN.fieldNames()
        _once(seen.select(*names).unionByName(beats.select(*names)), root, "observations", epoch)
        _once(carry_rates(_carried(spark, root, "rates", epoch, OPEN_RATES), every, config), root, "rates", epoch)
        now = batch.agg(F.max("t").alias("t")).select(F.greatest(F.lit(last_frame).cast("long"), "t").alias("last_frame"))
        tick = ticks.agg(F.greatest(F.lit(last_tick).cast("long"), F.max("t")).alias("last_tick"))
        _once(tick.crossJoin(now).select("last_tick", "last_frame").coalesce(1), root, "clock", epoch)  # one row and one row
        batch.unpersist()
        _tidy(spark, root, epoch)

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoints/ticker").trigger(**trigger).start()


def latest(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """What the last finished epoch wrote; at most about ``KEPT`` folders are listed."""
    done = [x for x in _children(spark, f"{root}/{name}") if x.isdigit()]
    return spark.read.schema(schema).parquet(f"{root}/{name}/{done[-1]}") if done else spark.createDataFrame([], schema)


def start_counter(
    spark: SparkSession, root: str, state_path: str, resets: Callable[[], DataFrame], config: CounterConfig, delay: str = "0 seconds", counted: str = "delete", **trigger
) -> StreamingQuery:
    """Run the second query: events of the tracks, appended under ``root``, and the state file at ``state_path``.

    Without a trigger the state is written every half second at most. ``counted`` says what
    becomes of observations that have been read: "delete" them, or keep them ("off").
    """
    system, where = _system(spark, f"{root}/observations")
    system.mkdirs(where)
    seen = spark.readStream.schema(SEEN).option("recursiveFileLookup", "true").option("cleanSource", counted).parquet(f"{root}/observations")
    events = crossing_stream(seen.withColumn("at", F.timestamp_micros("t")), None, None, config, delay)

    def step(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        _once(batch, root, "events", epoch)
        clock = latest(spark, root, "clock", CLOCK).first()
        at = clock.last_frame / 1e6 if clock and clock.last_frame is not None else None
        write_state(batch, epoch, state_path, resets(), latest(spark, root, "rates", OPEN_RATES), at)
        batch.unpersist()

    with state_store(spark):
        return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoints/counter").trigger(**(trigger or THROTTLE)).start()


def happened(spark: SparkSession, root: str) -> DataFrame:
    """All events that the counter under ``root`` has written, late rows among them."""
    from .counter import EVENT

    return spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/events")


def late_rows(spark: SparkSession, root: str) -> int:
    """How many rows of tracks came behind the watermark, ever: they are part of the events."""
    return happened(spark, root).where(F.col("kind") == LATE).count()
