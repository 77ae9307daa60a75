"""Exact inner-product search by branch and bound over a vertical layout.

Queries and candidates are cut into blocks; each pair of blocks is one task. There the
candidates lie dimension by dimension, strongest dimensions first. Scores grow block by
block of dimensions, and a candidate goes as soon as its score so far plus the product of
the remaining norms cannot reach the query's k-th best; the rest are compacted. Every query
brings a bound along to all its tasks: its k-th best score among a few candidates that were looked at before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, stash

by_value(__name__)

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16_384
#: Dimensions added between two rounds of pruning, and candidates scanned together.
STEP, SCAN = 16, 2048
#: Candidates that give queries their first bound: about so many drawn by a hash, and the longest ones.
DRAWN, LONGEST = 1024, 512


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, norm, vec): floor(scale * x) of every component as bytes, of int32 where all fit, else of int64; unusable vectors go.

    A component that no 64 bits hold after scaling is an error.
    """

    def run(batches):
        for batch in batches:
            ids, dims, norms, out = [], [], [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                ids.append(vec_id)
                dims.append(len(x))
                whole = np.floor(scale * x)
                if np.abs(whole).max(initial=0) >= 2**63:
                    raise ValueError("a component that no 64 bits hold after scaling")
                norms.append(float(np.square(whole).sum()))
                out.append(whole.astype(np.int32 if np.abs(whole).max(initial=0) < 2**31 else np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(out, pa.binary())], names=["vec_id", "dim", "norm", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).mapInArrow(run, "vec_id long, dim int, norm double, vec binary")


def matrix(vecs, dim: int) -> np.ndarray:
    """Vectors of ``quantised`` as rows of int64."""
    if all(len(x) == 4 * dim for x in vecs):
        return np.frombuffer(b"".join(vecs), np.int32).reshape(len(vecs), dim).astype(np.int64)
    return np.stack([np.frombuffer(x, np.int32 if len(x) == 4 * dim else np.int64).astype(np.int64) for x in vecs])


class Best:
    """The k best (score, id, row) of one query: larger scores first, then smaller ids. Scores below ``floor`` need not be added."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor, self.score, self.ids, self.rows = k, floor, *(np.zeros(0, np.int64) for _ in range(3))

    @property
    def least(self) -> float:
        return max(self.floor, float(self.score[-1])) if len(self.score) == self.k else self.floor

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score, ids, rows = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -score))[: self.k]
        self.score, self.ids, self.rows = score[order], ids[order], rows[order]


def search(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floors: np.ndarray) -> list[Best]:
    """The ``k`` best candidates of each query among ``vectors`` but its own row, of those whose score reaches its floor."""
    dim = vectors.shape[1]
    top = max(1, int(np.abs(queries).max(initial=0)), int(np.abs(vectors).max(initial=0)))
    kind = np.float64 if top * top * max(dim, 1) < 2**52 else np.int64  # doubles hold such sums exactly
    strong = np.argsort(-np.square(vectors.astype(np.float64)).sum(0), kind="stable")
    queries, columns = queries[:, strong].astype(kind), np.ascontiguousarray(vectors[:, strong].T.astype(kind))
    starts = list(range(0, dim, STEP))
    after = [np.sqrt(np.square(columns[s + STEP :].astype(np.float64)).sum(0)) for s in starts]
    q_after = [np.sqrt(np.square(queries[:, s + STEP :].astype(np.float64)).sum(1)) for s in starts]
    best = [Best(k, f) for f in floors]
    for lo in range(0, len(ids), SCAN):
        part = slice(lo, min(lo + SCAN, len(ids)))
        for q_lo in range(0, len(query_rows), 256):
            first = queries[q_lo : q_lo + 256, :STEP] @ columns[:STEP, part] if dim else np.zeros((len(query_rows[q_lo : q_lo + 256]), part.stop - lo), kind)
            for i, score in enumerate(first, q_lo):
                mine, own = best[i], np.flatnonzero(rows[part] != query_rows[i])
                score = score[own]
                for b, s in enumerate(starts):
                    if b:
                        score = score + queries[i, s : s + STEP] @ columns[s : s + STEP, lo + own]
                    hope = score + q_after[b][i] * after[b][lo + own] + 0.5 + 1e-9 * np.abs(score)
                    alive = hope >= mine.least
                    if not alive.all():
                        own, score = own[alive], score[alive]
                    if not len(own):
                        break
                if len(own):
                    mine.add(score.astype(np.int64), ids[lo + own], rows[lo + own])
    return best


def first_bounds(queries: DataFrame, some: list, k: int) -> DataFrame:
    """``queries`` with ``floor``, their k-th best score among the rows ``some`` (row, dim, vec); null with fewer than ``k`` of their length."""
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(r.dim, []).append(r)
    held = queries.sparkSession.sparkContext.broadcast({d: (matrix([bytes(r.vec) for r in x], d), np.array([r.row for r in x])) for d, x in by_dim.items()})

    def run(batches):
        for batch in batches:
            floors = []
            rows, dims, vecs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "dim", "vec"))
            for row, dim, vec in zip(rows, dims, vecs, strict=True):
                vectors, others = held.value.get(dim, (None, np.zeros(0)))
                score = vectors[others != row] @ matrix([vec], dim)[0] if len(others) else others
                floors.append(int(np.partition(score, -k)[-k]) if len(score) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], names=[*batch.schema.names, "floor"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("floor", T.LongType())]))


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query.

    Queries are the rows for which the Column ``is_query`` (over ``vec_id``) holds. All
    other rows are candidates, of the same length only; fewer than ``k`` give fewer
    results, ties go to the smaller id. Vectors that are null or hold null or non-finite
    components, and null ids, take no part. Repeated rows count each, as queries and as
    candidates, of each other too. Exact while sums stay below 2^63; an empty table gives an
    empty one, and any other columns are not read.
    """
    base = stash(quantised(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")  # read four times
    sizes = base.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()  # a row for each length
    total = sum(r.n for r in sizes)
    wanted = ["row", "dim", "vec"]
    some = base.where(F.pmod(F.xxhash64("row"), F.lit(max(total, 1))) < DRAWN).select(*wanted).collect()
    some += base.orderBy(F.desc("norm"), "row").limit(LONGEST).select(*wanted).collect()
    asked = first_bounds(base.where(is_query).select("dim", "vec_id", "row", "vec"), list({r.row: r for r in some}.values()), k)
    blocks = spark.createDataFrame([(r.dim, max(1, -(-r.q // QUERY_BLOCK)), max(1, -(-r.n // CANDIDATE_BLOCK))) for r in sizes], "dim int, nq int, nc int")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(row), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = asked.join(F.broadcast(blocks), "dim").withColumn("qb", own("nq")).withColumn("cb", each("nc"))
    right = base.join(F.broadcast(blocks), "dim").withColumn("cb", own("nc")).withColumn("qb", each("nq"))
    found_type = "query_id long, asked long, vec_id long, held long, score long"

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in (x.split()[0] for x in found_type.split(", "))})
        c = c.sort_by([("c_vec_id", "ascending"), ("c_row", "ascending")])
        dim = q["dim"][0].as_py()
        ids, rows = q["vec_id"].to_numpy(), q["row"].to_numpy()
        floors = np.array([-np.inf if x is None else np.nextafter(float(x), -np.inf) for x in q["floor"].to_pylist()])  # never above the score itself
        found = search(matrix(q["vec"].to_pylist(), dim), rows, matrix(c["c_vec"].to_pylist(), dim), c["c_vec_id"].to_numpy(), c["c_row"].to_numpy(), k, floors)
        n = [len(b.ids) for b in found]
        columns = (np.repeat(ids, n), np.repeat(rows, n), *(np.concatenate([getattr(b, x) for b in found]) for x in ("ids", "rows", "score")))
        return pa.table(list(map(pa.array, columns)), names=[x.split()[0] for x in found_type.split(", ")])

    left = left.select("dim", "qb", "cb", "vec_id", "row", "vec", "floor")
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in ("dim", "qb", "cb", "vec_id", "row", "vec")])
    keys = ["dim", "qb", "cb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*[f"c_{c}" for c in keys])).applyInArrow(run, found_type)
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "held"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(spark, vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
