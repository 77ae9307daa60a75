"""Vector compression to short codes by integer codebooks.

Vectors are cut into equal parts, and every part position has a codebook of integer entries,
fitted by rounds of assignment and floored means. The nearest entry is found by
partial-distance search: dimensions are added in descending order of the codebook's
variance, and an entry is dropped as soon as its distance so far strictly exceeds the best
complete distance of the vector. Only sums for each entry leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, stash
from .graphs import join_hot

by_value(__name__)

#: Integer components must be smaller than this, so that squared distances and their sums are exact in 64 bits.
LIMIT = 1 << 24
#: Vectors that one search handles at once.
BLOCK = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row of ``x``, ties to the smaller one, and the squared distance."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    n, k = len(x), len(book)
    first = np.square(x[:, :1] - book[None, :, 0]) if x.shape[1] else np.zeros((n, k), np.int64)
    best = np.square(x - book[np.argmin(first, axis=1)]).sum(axis=1)  # complete distance of the entry that is ahead
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for d in range(1, x.shape[1]):
        so_far = so_far + np.square(x[row, d] - book[entry, d])
        alive = so_far <= best[row]
        row, entry, so_far = row[alive], entry[alive], so_far[alive]
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # the entry ahead is alive in every row
    least = np.minimum.reduceat(so_far, starts) if n else so_far
    tied = so_far == least[row]
    row, entry = row[tied], entry[tied]
    return entry[np.flatnonzero(np.diff(row, prepend=-1))], least


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int, dim: int) -> DataFrame:
    """(vec_id, label, vec): floor(scale * x) of every component as int32; rows whose vector is null or holds null or non-finite components go."""

    def run(batches):
        for batch in batches:
            keep, out = [], []
            for i, v in enumerate(batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                if len(x) != dim:
                    raise ValueError(f"vectors of {dim} and of {len(x)} components have no codebook together")
                whole = np.floor(scale * x)
                if np.abs(whole).max(initial=0) >= LIMIT:
                    raise ValueError(f"a component of {LIMIT} or more after scaling: squared distances would not fit 64 bits")
                keep.append(i)
                out.append(whole.astype(np.int32).tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    given = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vec"))
    types = dict(given.dtypes)
    return given.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, vec binary")


def _rows(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)


def entry_sums(base: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many parts are assigned to each entry and their sums by component; a row for each entry and task."""
    parts, k, width = books.shape

    def run(batches):
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = _rows(batch.column(0), parts * width)
            for lo in range(0, len(x), BLOCK):
                for p in range(parts):
                    own = x[lo : lo + BLOCK, p * width : (p + 1) * width]
                    entry, _ = nearest(own, books[p])
                    n[p] += np.bincount(entry, minlength=k)
                    np.add.at(sums[p], entry, own)
        used = np.argwhere(n > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(n[n > 0]), pa.array(list(sums[n > 0]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    each = base.select("vec").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    summed = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *summed).select("part", "entry", "n", F.array(*[f"s{j}" for j in range(width)]).alias("sums"))


def fit_codebooks(base: DataFrame, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks (part, entry, component) of the ``integer_vectors`` ``base``: ``rounds`` rounds from the vectors of the smallest ids.

    Ids that repeat are ordered by their vectors' bytes, null ids come last; with fewer
    vectors than ``entries`` the codebooks are as small.
    """
    first = base.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    width = dim // parts
    books = np.stack([np.frombuffer(r.vec, np.int32).astype(np.int64).reshape(parts, width) for r in first], axis=1)
    for _ in range(rounds):
        books = books.copy()
        for r in entry_sums(base, books).collect():  # one row for each entry
            books[r.part, r.entry] = [s // r.n for s in r.sums]
    return books


def encode(base: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's nearest entry, and the squared distances summed over the parts."""
    parts, k, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(k)])

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(2), parts * width)
            error, code = np.zeros(len(x), np.int64), np.zeros((len(x), parts), np.int64)
            for lo in range(0, len(x), BLOCK):
                for p in range(parts):
                    code[lo : lo + BLOCK, p], far = nearest(x[lo : lo + BLOCK, p * width : (p + 1) * width], books[p])
                    error[lo : lo + BLOCK] += far
            text = ["".join(c) for c in digits[code]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    types = dict(base.dtypes)
    return base.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", scale: int = 4096) -> DataFrame:
    """``codes`` with ``vector``, the entries its codes name over ``scale``; an input column of that name gives way, a null code gives null."""
    parts = len(books)
    table = "array(" + ", ".join("array(" + ", ".join("array(" + ", ".join(f"{int(c) / scale!r}D" for c in entry) + ")" for entry in book) + ")" for book in books) + ")"
    name = "`" + code_col.replace("`", "``") + "`"
    index = f"cast(conv(substring({name}, 2 * p + 1, 2), 16, 10) as int)"
    vector = f"if({name} is null, null, flatten(transform(sequence(0, {parts - 1}), p -> get(get({table}, p), {index}))))"
    return codes.drop("vector").withColumn("vector", F.expr(vector))


def compress(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6,
) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error, label_error), codebooks) of all usable rows of ``vectors``.

    A component x counts as floor(scale * x). Rows whose vector is null or holds null or
    non-finite components go. ``label_error`` is the error summed over rows of equal label,
    null labels together. Repeated rows and ids count each; of equally near entries the
    first one is taken. An empty table, or one without usable vectors, gives an empty result
    and no codebooks. Vectors of different lengths, of a length that ``parts`` does not
    divide, or with components of ``LIMIT`` or more after scaling are an error. ``vectors``
    may hold any other columns.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold indexes up to 255")
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    some = vectors.where(usable).select(F.size(vector_col).alias("dim")).first()
    label_type = dict(vectors.dtypes)[label_col] if label_col else "int"
    if some is None:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)[id_col]}, label {label_type}, code string, error long, label_error long"), None
    if not some.dim or some.dim % parts:
        raise ValueError(f"{some.dim} components are no {parts} equal parts")
    base = stash(integer_vectors(vectors, id_col, vector_col, label_col, scale, some.dim), "codes-vectors")  # read in every round
    books = fit_codebooks(base, some.dim, parts, entries, rounds)
    coded = stash(encode(base, books).withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    totals = coded.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_hot(coded, totals, "_label", "vec_id").select("vec_id", "label", "code", "error", "label_error"), books


def books_digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    done, books = compress(spark, vectors)
    return done.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pt AS MATERIALIZED (
  SELECT r, vec_id, p, e[p * {width} + 1 : p * {width} + {width}] AS x FROM v, range({parts}) t(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM pt QUALIFY k < {entries}
)"""
    ]
    near = """a{i} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, k := k)) AS b FROM (
    SELECT r, pt.p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM pt JOIN c{i} USING (p)
  ) GROUP BY r, p
)"""
    mean = """m{j} AS (
  SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT pt.p, b.k AS k, j, sum(x[j + 1]) AS s, count(*) AS n FROM pt JOIN a{i} USING (r, p), range({width}) t(j) GROUP BY ALL
  ) GROUP BY p, k
), c{j} AS MATERIALIZED (
  SELECT p, k, coalesce(m{j}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{j} USING (p, k)
)"""
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1, width=width)]
    steps.append(near.format(i=rounds))
    return "WITH " + ",\n".join(steps) + f""", e AS (
  SELECT v.r, v.vec_id, v.label, string_agg(printf('%02x', b.k), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM v JOIN a{rounds} USING (r) GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM e"""


ORACLE = _oracle()
