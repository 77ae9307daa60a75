"""Track life: previous observation, lifetime rule, incarnations.

Every window here is partitioned by (source_id, track_id) or by more, so the whole chain
down to crossing events needs one exchange of the observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CounterConfig
from ..functions.geometry import foot_x, foot_y
from .ingest import tick_timeline

ORDER = ("t", "frame_seq", "obj_seq")
KEY = ("source_id", "track_id")


def with_foot_point(observations: DataFrame, config: CounterConfig) -> DataFrame:
    """Add the normalised bottom centre of each box; it is not clamped."""
    return observations.withColumn("px", foot_x(F.col("left"), F.col("width"), config)).withColumn("py", foot_y(F.col("top"), F.col("height"), config))


def with_incarnation(observations: DataFrame, config: CounterConfig, ticks: DataFrame | None = None) -> DataFrame:
    """Add ``prev_seen``, ``fresh`` and ``incarnation``.

    Tracks are pruned after each tick, so a track is forgotten only if some tick between its
    last sighting and now came more than the lifetime after that sighting; the latest such
    tick decides. Rows that bring it along have it in ``prev_tick``. With ``ticks`` (t), the times of
    all frames, only the few rows after a gap longer than the lifetime are shuffled by their time to look it
    up; what they find comes back as one row a track, so the observations stay where they are.
    """
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    seen = observations.withColumn("prev_seen", F.lag("t").over(w))
    if ticks is None:
        pruned = (F.col("prev_seen") < F.col("t")) & (F.col("prev_tick") - F.col("prev_seen") > F.lit(config.ttl_us))
    else:
        late = F.col("t") - F.col("prev_seen") > F.lit(config.ttl_us)
        gap = F.struct(*ORDER, "prev_seen")
        gaps = seen.where(late).select(*KEY, "t", "prev_seen", gap.alias("_gap")).join(tick_timeline(ticks), "t")
        forgotten = gaps.where(F.col("prev_tick") - F.col("prev_seen") > F.lit(config.ttl_us)).groupBy(*KEY).agg(F.collect_set("_gap").alias("_forgotten"))  # at most one a lifetime
        seen = seen.join(forgotten, list(KEY), "left")
        pruned = late & F.array_contains("_forgotten", gap)
    fresh = F.col("prev_seen").isNull() | F.coalesce(pruned, F.lit(False))
    return seen.withColumn("fresh", fresh).drop("_forgotten").withColumn("incarnation", F.sum(F.col("fresh").cast("long")).over(w))


def with_previous_point(tracks: DataFrame) -> DataFrame:
    """Add ``ppx``, ``ppy``: the foot point before, null at the first sighting of an incarnation."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    return tracks.withColumn("ppx", F.when(~F.col("fresh"), F.lag("px").over(w))).withColumn("ppy", F.when(~F.col("fresh"), F.lag("py").over(w)))
