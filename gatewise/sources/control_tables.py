"""Versioned control tables: every change of lines and every reset is an appended row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LINE_VERSIONS
from ..operators.control import parse_lines

FRAME = (1280, 720)


def append_lines(spark: SparkSession, path: str, raw: str, at_us: int) -> None:
    """Put new lines (the JSON edge) in force from ``at_us``; anything malformed switches counting off."""
    append_versions(spark.range(1).select(F.lit(at_us).cast("long").alias("t"), F.lit(raw).alias("raw")).coalesce(1), path)


def append_versions(posted: DataFrame, path: str) -> None:
    """Append a version for every row of ``posted`` (t, raw), in force from its time on."""
    a, b = parse_lines(F.col("raw"))
    posted.select(F.col("t").alias("valid_from"), a.alias("line1"), b.alias("line2")).write.mode("append").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All versions; none at all is one version without lines from the beginning."""
    rows = spark.read.schema(LINE_VERSIONS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LINE_VERSIONS)
    start = spark.createDataFrame([(-(2**62), None, None)], LINE_VERSIONS)
    return rows.unionByName(start)


def lines_rows(version: DataFrame) -> DataFrame:
    """(valid_from, lines): versions in the shape of the JSON edge, with the frame size stamped in."""

    def points(c):
        return F.when(F.col(c).isNotNull(), F.array(F.array(f"{c}.x1", f"{c}.y1"), F.array(f"{c}.x2", f"{c}.y2")))

    body = F.struct(F.lit(FRAME[0]).alias("width"), F.lit(FRAME[1]).alias("height"), points("line1").alias("line1"), points("line2").alias("line2"))
    return version.select("valid_from", body.alias("lines"))


def lines_json(version: DataFrame) -> DataFrame:
    return lines_rows(version).select("valid_from", F.to_json("lines", {"ignoreNullFields": "false"}).alias("json"))


def append_reset(spark: SparkSession, path: str, at_us: int) -> None:
    """Counts start again after ``at_us``; tracks live on."""
    append_resets(spark.range(1).select(F.lit(at_us).cast("long").alias("t")).coalesce(1), path)


def append_resets(times: DataFrame, path: str) -> None:
    """Append a reset for every row of ``times`` (t)."""
    times.select(F.col("t").cast("long").alias("t")).write.mode("append").parquet(path)


def read_resets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t long").parquet(path) if _exists(spark, path) else spark.createDataFrame([], "t long")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
