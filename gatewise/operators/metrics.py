"""Counts, occupancy, frame rates and the state snapshot."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CounterConfig
from ..shared import written
from .ingest import HOUR


def totals(events: DataFrame, *keys: str) -> DataFrame:
    """``entries``, ``exits``, ``footfall`` (never below 0), over all events or by keys (an extension)."""
    grouped = events.groupBy(*keys) if keys else events
    counted = grouped.agg(F.count_if(F.col("kind") == "entry").alias("entries"), F.count_if(F.col("kind") == "exit").alias("exits"))
    return counted.withColumn("footfall", F.greatest(F.lit(0).cast("long"), F.col("entries") - F.col("exits")))


class RateFold:
    """The open rate window of one source, and what frames do to it."""

    def __init__(self, config: CounterConfig, start: int | None = None, count: int = 0):
        self.width, self.unit, self.start, self.count = config.fps_window_us, config.fps_unit_us, start, count

    def feed(self, t: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(closed_at, frames, elapsed_us, fps) of the windows that the frames at the ascending times ``t`` close."""
        out, i = [], 0
        if self.start is None and len(t):
            self.start = int(t[0])
        while i < len(t):
            at = int(np.searchsorted(t, self.start + self.width, side="left"))
            at = max(at, i)
            if at == len(t):
                self.count += at - i
                break
            self.count += at - i + 1
            elapsed = int(t[at]) - self.start
            out.append((int(t[at]), self.count, elapsed, round(self.count / (elapsed / self.unit), 2)))
            self.start, self.count, i = int(t[at]), 0, at + 1
        return out


RATE = "source_id int, closed_at long, frames long, elapsed_us long, fps double"
_EXITS = "source_id int, a long, b long, last long, before long"


def fps_windows(frames: DataFrame, config: CounterConfig, block_us: int | None = None) -> DataFrame:
    """(source_id, closed_at, frames, elapsed_us, fps) of every closed rate window.

    A window closes at the first frame that lies ``fps_window_us`` or more after its start
    and the next starts there without that frame; the very first frame counts. ``fps`` is
    frames per ``fps_unit_us``, rounded to two places as Python does it.

    Where a window starts depends on the one before, but every time has one successor, the
    time that would close a window started there. Time is cut into blocks of ``block_us``
    (an hour, or 16 windows if that is longer). A task for each block finds where the chain leaves it, from every time by
    which it can come in; those lie within one window of its start, so the chains shrink
    to a small table. There pointer doubling marks the times that the chain from the first frame
    comes by, in as many rounds as the logarithm of the number of blocks. Then each block
    walks its own part. No task holds more of a source than a block.
    """
    width = config.fps_window_us
    block = max(block_us or max(HOUR, 16 * width), width)
    number = F.floor(F.col("t") / block)
    times = frames.where("source_id is not null and t is not null").groupBy(F.col("source_id").cast("int").alias("source_id"), "t").agg(F.count("*").alias("n")).withColumn("block", number)
    times = written(times, "rate-times")  # a row for each time, read by both passes
    is_head = F.col("t") < F.col("block") * block + width
    blocks = times.groupBy("source_id", "block").agg(F.min("t").alias("first"), F.min(F.when(~is_head, F.col("t"))).alias("behind"), F.sum("n").alias("n"))
    w = Window.partitionBy("source_id").orderBy("block")  # a row for each block
    follows = F.lead("block").over(w) == F.col("block") + 1
    beyond = F.when(follows, F.coalesce(F.lead("behind").over(w), F.lead("first", 2).over(w))).otherwise(F.lead("first").over(w))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    root = F.min("first").over(Window.partitionBy("source_id"))
    blocks = written(blocks.select("source_id", "block", "first", "behind", beyond.alias("beyond"), before.alias("before"), root.alias("root")), "rate-blocks")

    heads = times.where(is_head).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    around = times.withColumn("own", F.lit(True)).unionByName(heads).join(blocks, ["source_id", "block"])

    def leave(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        t, own, n = (rows[c].to_numpy() for c in ("t", "own", "n"))
        mine, count = t[own], n[own]
        ahead = np.searchsorted(t, mine + width)
        far = rows["beyond"][0].as_py()
        passed = int(rows["before"][0].as_py()) + np.cumsum(count) - count
        exits, last = [None] * len(mine), [0] * len(mine)
        for i in range(len(mine) - 1, -1, -1):
            j = int(ahead[i])
            if j < len(mine):
                exits[i], last[i] = exits[j], last[j]
            else:
                exits[i], last[i] = int(t[j]) if j < len(t) else far, i
        start = int(rows["block"][0].as_py()) * block
        ways_in = np.flatnonzero((mine < start + width) | (mine == (rows["behind"][0].as_py() or -1)))
        ends = np.array(last, np.int64)[ways_in]
        return pa.table(
            {
                "source_id": pa.array(np.full(len(ways_in), rows["source_id"][0].as_py(), np.int32)), "a": pa.array(mine[ways_in]),
                "b": pa.array([exits[i] for i in ways_in], pa.int64()), "last": pa.array(mine[ends]), "before": pa.array(passed[ends]),
            }
        )

    links = written(around.groupBy("source_id", "block").applyInArrow(leave, _EXITS), "rate-links")
    rounds = (blocks.groupBy("source_id").count().agg(F.max("count")).first()[0] or 0).bit_length()  # a chain comes by each block once at most
    met, jumps = blocks.select("source_id", F.col("root").alias("a")).distinct(), links.where("b is not null").select("source_id", "a", "b")
    for k in range(rounds):
        met = met.join(jumps, ["source_id", "a"], "left").select("source_id", F.explode(F.array_compact(F.array("a", "b"))).alias("a"))
        if k + 1 < rounds:
            second = jumps.select("source_id", F.col("a").alias("b"), F.col("b").alias("c"))
            jumps = written(jumps.join(second, ["source_id", "b"]).select("source_id", "a", F.col("c").alias("b")), "rate-jumps")
    met = met.distinct()
    entries = met.join(links, ["source_id", "a"]).where("b is not null").select("source_id", F.col("b").alias("entry"), "last", F.col("before").alias("last_before"))
    first = blocks.select("source_id", F.col("root").alias("entry")).distinct().withColumns({c: F.lit(None).cast("long") for c in ("last", "last_before")})
    entries = entries.unionByName(first).withColumn("block", F.floor(F.col("entry") / block))

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        t, n = rows["t"].to_numpy(), rows["n"].to_numpy()
        entry, last, last_before, source, start, root = (rows[c][0].as_py() for c in ("entry", "last", "last_before", "source_id", "before", "root"))
        passed = start + np.cumsum(n) - n
        i, out = int(np.searchsorted(t, entry)), []
        if last is not None:
            out.append((entry, int(passed[i]) - last_before + (last == root), entry - last))
        while (j := int(np.searchsorted(t, t[i] + width))) < len(t):
            out.append((int(t[j]), int(passed[j] - passed[i]) + (int(t[i]) == root), int(t[j] - t[i])))
            i = j
        closed, frames_, elapsed = zip(*out, strict=True) if out else ((), (), ())
        fps = [round(k / (e / config.fps_unit_us), 2) for k, e in zip(frames_, elapsed, strict=True)]
        return pa.table([pa.array([source] * len(out), pa.int32()), *(pa.array(x, pa.int64()) for x in (closed, frames_, elapsed)), pa.array(fps, pa.float64())], names=[c.split()[0] for c in RATE.split(", ")])

    mine = times.join(entries, ["source_id", "block"]).join(blocks.select("source_id", "block", "before", "root"), ["source_id", "block"])
    return mine.groupBy("source_id", "block").applyInArrow(walk, RATE)


OPEN_RATES = "source_id int, start long, count long, fps double"


def carry_rates(open_rates: DataFrame, frames: DataFrame, config: CounterConfig) -> DataFrame:
    """(source_id, start, count, fps): the open window of each source and its latest rate, after more frames.

    ``open_rates`` is the result before them, so a stream folds its rates from one
    micro-batch to the next. Frames of a time are counted first, and every source may have a task of its own.
    """

    def fold(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        source = int((held if len(held) else new).source_id.iloc[0])
        start, count, fps = (held.iloc[0][c] for c in ("start", "count", "fps")) if len(held) else (None, 0, None)
        one = RateFold(config, None if start is None else int(start), int(count))
        new = new.sort_values("t")
        closed = one.feed(np.repeat(new.t.to_numpy(np.int64), new.n.to_numpy(np.int64)))
        return pd.DataFrame([(source, one.start, one.count, closed[-1][3] if closed else fps)], columns=["source_id", "start", "count", "fps"])

    times = frames.groupBy("source_id", "t").agg(F.count("*").alias("n"))
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said here, as tasks are made fewer by their bytes otherwise
    return open_rates.repartition(parts, "source_id").groupBy("source_id").cogroup(times.repartition(parts, "source_id").groupBy("source_id")).applyInPandas(fold, OPEN_RATES)


def fps_by_source(windows: DataFrame) -> DataFrame:
    """The rate of the last closed window of each source; a silent source keeps its rate."""
    return windows.groupBy("source_id").agg(F.max_by("fps", "closed_at").alias("fps"))


def fps_total(by_source: DataFrame) -> DataFrame:
    return by_source.agg(F.coalesce(F.bround(F.sum("fps"), 2), F.lit(0.0)).alias("fps"))


def fps_map(by_source: DataFrame) -> DataFrame:
    """One row with a map from source, as a string, to rate."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("source_id").cast("string").alias("key"), F.col("fps").alias("value"))))
    return by_source.agg(F.map_from_entries(entries).alias("fps_by_source"))


def state_snapshot(events: DataFrame, by_source: DataFrame, frames: DataFrame) -> DataFrame:
    """The single state row: counts, rates and the time of the last frame in seconds."""
    fps = fps_total(by_source).scalar()
    rates = fps_map(by_source).scalar()
    at = frames.agg((F.max("t").cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")).scalar()
    return totals(events).select("entries", "exits", "footfall", fps.alias("fps"), rates.alias("fps_by_source"), at.alias("updated_at"))


def as_json(row: DataFrame) -> DataFrame:
    """Rows as JSON text, nulls spelled out."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def running_totals(events: DataFrame, bucket_us: int) -> DataFrame:
    """Counts of each time bucket and their running sums (an extension)."""
    per = totals(events.withColumn("bucket", F.floor(F.col("t") / bucket_us) * bucket_us), "bucket").drop("footfall")
    w = Window.partitionBy(F.lit(0)).orderBy("bucket")  # a row for each bucket
    return per.withColumn("entries_so_far", F.sum("entries").over(w)).withColumn("exits_so_far", F.sum("exits").over(w))


def _ship() -> None:
    """Send the folds with the tasks, so executors need no copy of this package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
