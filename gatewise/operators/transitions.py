"""Crossings of two lines and the transitions they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CounterConfig, Line
from ..functions.geometry import crossed_line, crosses, side
from .ingest import persons, tracked
from .tracks import KEY, ORDER, with_foot_point, with_incarnation, with_previous_point


def with_crossing(steps: DataFrame, line1: Line | str, line2: Line | str) -> DataFrame:
    """Add ``c1``, ``c2`` (null without a previous point) and ``z``, the line that counts as crossed."""
    at = {}
    for i, line in ((1, line1), (2, line2)):
        touched = crosses(side(line, F.col("ppx"), F.col("ppy")), side(line, F.col("px"), F.col("py")))
        at[f"c{i}"] = F.when(F.col("ppx").isNotNull(), touched)  # a first sighting on a line is no crossing
    return steps.withColumns(at).withColumn("z", crossed_line(F.coalesce("c1", F.lit(False)), F.coalesce("c2", F.lit(False))))


def with_links(steps: DataFrame, config: CounterConfig) -> DataFrame:
    """Crossings only, each with the one before it and whether the two may form a transition."""
    w = Window.partitionBy(*KEY, "incarnation").orderBy(*ORDER)
    crossings = steps.where(F.col("z").isNotNull())
    crossings = crossings.withColumn("prev_z", F.lag("z").over(w)).withColumn("prev_t", F.lag("t").over(w))
    link = (F.col("prev_z") != F.col("z")) & (F.col("t") - F.col("prev_t") <= F.lit(config.window_us))
    return crossings.withColumn("link", F.coalesce(link, F.lit(False)))


def with_matches(links: DataFrame) -> DataFrame:
    """Add ``match``: a match uses up the crossing before it.

    The remembered crossing is always the one just before, so a crossing matches if it links
    and the one before it did not match. In a run opened by a crossing that does not link,
    these are the even ones.
    """
    w = Window.partitionBy(*KEY, "incarnation").orderBy(*ORDER)
    runs = links.withColumn("run", F.sum(F.when(F.col("link"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*KEY, "incarnation", "run").orderBy(*ORDER))
    return runs.withColumn("match", F.col("link") & (place % 2 == 0))


def crossing_events(observations: DataFrame, line1: Line | str, line2: Line | str, config: CounterConfig, ticks: DataFrame | None = None) -> DataFrame:
    """(t, frame_seq, obj_seq, source_id, track_id, kind) from observations with ``prev_tick``, or with the times of all frames as ``ticks``."""
    steps = with_previous_point(with_incarnation(with_foot_point(tracked(persons(observations)), config), config, ticks))
    matched = with_matches(with_links(with_crossing(steps, line1, line2), config)).where("match")
    kind = F.when(F.col("z") == 2, F.lit("entry")).otherwise(F.lit("exit"))
    return matched.select(*ORDER, *KEY, kind.alias("kind"))
