"""Tables written to a folder that driver and executors share, where lineage ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below ``spark.checkpoint.dir``, without that setting below the warehouse; it goes when the interpreter ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/") + f"/gatewise/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that was written once: losing an executor costs nothing behind this point."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
