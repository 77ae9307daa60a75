"""What the text operators share: scratch tables, Arrow mapping, hashing of bytes."""

from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` inside the tasks that call them."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``, else the context's, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch").rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before the interpreter does
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    Lost executors cost no recomputation behind this point. The files go when ``release``
    or ``release_since`` says so, at last when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/gatewise/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def release(*stashed: DataFrame) -> None:
    """Delete tables of ``stash`` that nothing still to run reads."""
    for df in stashed:
        path = getattr(df, "_stash_path", None)
        if path and (df.sparkSession, path) in _written:
            drop_path(df.sparkSession, path)
            _written.remove((df.sparkSession, path))


def scratch_mark() -> int:
    """A point to hand to ``release_since``."""
    return len(_written)


def release_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables of ``stash`` written since ``mark`` but those of ``keep``: for a result that is written by then."""
    kept = {getattr(df, "_stash_path", None) for df in keep}
    for spark, path in _written[mark:]:
        if path not in kept:
            drop_path(spark, path)
            _written.remove((spark, path))


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of ``frames`` has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(schema: T.StructType, new: list[T.StructField]) -> T.StructType:
    """``schema`` with ``new`` at its end; an input column of the same name gives way."""
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new)


def map_texts(
    df: DataFrame,
    text_col: str,
    schema: T.StructType,
    make: Callable[[], Callable[[list, pa.RecordBatch], dict]],
) -> DataFrame:
    """Map Arrow batches of ``df`` to ``schema``.

    ``make()`` runs once a task and returns ``step(texts, batch)``, which gives the new
    columns by name; other columns of ``schema`` pass through from the batch.
    """
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if step is None:
                step = make()
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            new = step(texts, batch)
            yield pa.RecordBatch.from_arrays(
                [new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names=names
            )

    return df.mapInArrow(run, schema)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the public SplitMix64 one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def held_out(doc_id):
    """True where crc32 of the id's decimal text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
