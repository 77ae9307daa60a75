"""Life of tracked targets over frames: probation, early termination, shadow age (approximate)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LifecycleConfig:
    """In frames. Fixed values of the tracker settings are the defaults."""

    probation: int = 12
    early_termination: int = 5
    shadow: int = 90


def with_targets(sightings: DataFrame, config: LifecycleConfig, keys: tuple[str, ...] = ("source_id", "track_id"), frame: str = "frame") -> DataFrame:
    """Add ``target`` (1, 2, .. per key) and ``active`` to distinct (keys, frame) sightings.

    A target starts on probation, where missing more than ``early_termination`` frames ends
    it; it is active once its run of sightings spans ``probation`` frames. An active target
    survives up to ``shadow`` missing frames. Runs are cut at gaps of probation length;
    whether a run goes on from an active one is a running maximum inside the chain of runs
    whose gaps are short enough, so no row is folded one by one.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    gap = F.col(frame) - F.lag(frame).over(w) - 1
    cut = sightings.withColumn("_gap", gap).withColumn("_cut", F.coalesce(F.col("_gap") > config.early_termination, F.lit(True)))
    runs = cut.withColumn("_run", F.sum(F.col("_cut").cast("long")).over(w))
    in_run = Window.partitionBy(*keys, "_run")
    spans = runs.withColumn("_first", F.min(frame).over(in_run)).withColumn("_span", F.max(frame).over(in_run) - F.col("_first") + 1)
    lead_gap = F.max(F.when(F.col("_cut"), F.coalesce("_gap", F.lit(2**31)))).over(in_run)
    chained = spans.withColumn("_break", F.col("_cut") & (lead_gap > config.shadow)).withColumn("_chain", F.sum(F.col("_break").cast("long")).over(w))
    confirmed = F.col("_span") >= config.probation
    earlier = Window.partitionBy(*keys, "_chain").orderBy("_run").rangeBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.max(confirmed).over(earlier), F.lit(False))
    known = chained.withColumn("_carried", carried)
    fresh = F.col("_cut") & ~F.col("_carried")
    active = F.col("_carried") | (F.col(frame) - F.col("_first") + 1 >= config.probation)
    numbered = known.withColumn("active", active).withColumn("target", F.sum(fresh.cast("long")).over(w))
    return numbered.drop("_gap", "_cut", "_run", "_first", "_span", "_break", "_chain", "_carried")
