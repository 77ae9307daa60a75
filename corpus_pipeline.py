"""The corpus pipeline: operators of ``gatewise.llm`` run one after another over documents.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm import decontaminate, lang_id, line_dedup, near_dedup, packing
from gatewise.llm.common import release, release_since, scratch_mark, stash, unused


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no language (null, or without a letter) go."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    return lang_id.identify(spark, whole).where(F.col("lang_pred") != "und").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go from every text; rows stay, ``n_chars`` follows the text."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    done = line_dedup.drop_common_lines(spark, docs.select(rest, "text"), min_docs=10)
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return done.select(*[now.get(c, F.col("row")[c].alias(c)) for c in docs.columns])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one of the smallest id (five words, 0.8).

    A null id counts as larger than any other. Of several rows of that id in a group one stays.
    """
    row = unused("row", docs)
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_dedup.near_duplicates(spark, rows, id_col=row, size=5, percent=80).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))).alias("first")
    kept = rows.select(row, "doc_id").join(groups, row).groupBy("group").agg(first).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = decontaminate.contamination(spark, whole, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return found.where("not contaminated").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, placed in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("language ID", language_filter),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the language models, so there is none for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each reads what the one before it wrote, and what it wrote on its way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark, before = scratch_mark(), docs
        docs = stash(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release_since(mark, docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
