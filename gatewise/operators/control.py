"""Control tables in time: line versions, resets, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LINES_JSON
from .ingest import DAY


def parse_lines(raw: Column) -> tuple[Column, Column]:
    """Both lines of the JSON edge as structs; null unless both are there and well formed."""
    value = F.from_json(raw, LINES_JSON, {"mode": "PERMISSIVE"})

    def line(name: str) -> Column:
        p = value[name]
        point = lambda i, j: F.get(F.get(p, F.lit(i)), F.lit(j))
        return F.struct(point(0, 0).alias("x1"), point(0, 1).alias("y1"), point(1, 0).alias("x2"), point(1, 1).alias("y2"))

    def whole(name: str) -> Column:
        p = value[name]
        return F.coalesce((F.size(p) == 2) & F.forall(p, lambda q: (F.size(q) == 2) & F.forall(q, lambda v: v.isNotNull())), F.lit(False))

    both = whole("line1") & whole("line2")
    return F.when(both, line("line1")), F.when(both, line("line2"))


def with_lines(observations: DataFrame, versions: DataFrame, bucket_us: int = DAY) -> DataFrame:
    """Add the lines in force (``line1``, ``line2``) and drop rows without both.

    As-of join on time buckets: each version that ended is cut into the buckets it covers,
    and rows look for theirs by an equi-join on the bucket with the bounds as a residual condition. The version
    still in force has no end; it is one row, and rows from its start on take it. The
    observations are read once.
    """
    ends = Window.partitionBy(F.lit(0)).orderBy("valid_from")  # a handful of versions
    spans = versions.withColumn("valid_to", F.lead("valid_from").over(ends)).where("line1 is not null and line2 is not null")
    first, last = F.floor(F.col("valid_from") / bucket_us), F.floor((F.col("valid_to") - 1) / bucket_us)
    closed = spans.where("valid_to is not null").select(F.explode(F.sequence(first, last)).alias("_bucket"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), F.struct("line1", "line2").alias("_ended"))
    open_ = spans.where("valid_to is null").select(F.struct("valid_from", "line1", "line2").alias("_open"))  # the last version, if it is on: one row without an end
    rows = observations.withColumn("_bucket", F.floor(F.col("t") / bucket_us)).withColumn("_open", open_.scalar())
    inside = (rows["_bucket"] == closed["_bucket"]) & (rows["t"] >= closed["_from"]) & (rows["t"] < closed["_to"])
    met = rows.join(closed, inside, "left").drop("_bucket", "_from", "_to")
    lines = F.coalesce("_ended", F.when(F.col("t") >= F.col("_open.valid_from"), F.struct("_open.line1", "_open.line2")))
    return met.withColumn("_lines", lines).where("_lines is not null").withColumns({"line1": F.col("_lines.line1"), "line2": F.col("_lines.line2")}).drop("_ended", "_open", "_lines")


def since_last_reset(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Events after the last reset; all of them if there was none."""
    last = resets.agg(F.coalesce(F.max("t"), F.lit(-(2**63)))).scalar()
    return events.where(F.col("t") > last)


def latest(rows: DataFrame, order: str, value: str) -> DataFrame:
    """One row: the value of the largest ``order``."""
    return rows.agg(F.max_by(value, order).alias(value))


def latest_by(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_best.{v}").alias(v) for v in values])
