"""Quality scores: kernel ridge regression on document statistics, calibrated.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a
text. Every partition sums its normal equations, Spark sums the partitions, and the ridge
weights follow from the total. Scores of each fold under the weights of the other folds
calibrate them by isotonic regression.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, held_out, map_texts, stash, with_fields

by_value(__name__)

FEATURES = 256
RIDGE = 1e-3
#: Standard deviations of the statistics over which the kernel falls off.
WIDTH = 4.0
FOLDS = 3
#: Cells of the score histogram on which the calibration is fitted.
CELLS = 1000
SEED = 11

_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 . ! ? , 7 , ; : , 8 quotes and brackets, 9 symbols, 10 non-ASCII
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\x0b\x0c", 4), ("\n", 5), (".?", 6), (",;:", 7), ("'\"()[]{}-", 8), ("!#$%&*+/<=>@\\^_`|~", 9)):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 10
_SENTENCE = re.compile(r"[.!?]+[\s]")
_WIDE = re.compile(r"[^\W\d_]")

STATISTICS = [
    "log_chars", "log_words", "upper", "digit", "blank", "stop", "comma", "bracket", "symbol", "wide", "word_length", "word_spread", "distinct_words", "top_word",
    "distinct_pairs", "same_next", "wordless", "upper_words", "ends_symbol", "log_lines", "distinct_lines", "top_line", "line_words", "line_stops", "sentence_words", "short_words",
]


def statistics(text: str | None) -> list[float]:
    """Fixed statistics of the whole text, in the order of ``STATISTICS``; all zero for an empty one."""
    text = text or ""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=11) / len(raw)
    words = text.split()
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    n = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    rows: dict[str, int] = {}
    for x in lines:
        rows[x] = rows.get(x, 0) + 1
    length = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    pairs = set(zip(words, words[1:], strict=False))
    wordless = upper = symbol = 0
    for w, k in seen.items():
        last = w[-1]
        symbol += k * (last in "!#$%&*+/<=>@\\^_`|~")
        if w.isupper() and len(w) > 1:
            upper += k
        elif not _WIDE.search(w):
            wordless += k
    return [
        np.log1p(len(text)), np.log1p(len(words)), *(kinds[i] for i in (2, 3, 4, 6, 7, 8, 9, 10)), float(length.mean()), float(length.std()),
        len(seen) / n, max(seen.values(), default=0) / n, len(pairs) / n, sum(map(str.__eq__, words, words[1:])) / n, wordless / n, upper / n, symbol / n,
        np.log1p(len(lines)), len(rows) / max(1, len(lines)), max(rows.values(), default=0) / max(1, len(lines)), n / max(1, len(lines)),
        sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), n / (1 + len(_SENTENCE.findall(text))), float((length <= 3).mean()),
    ]


class Fourier:
    """cos(W x + b) features of standardised statistics, with a constant at the end."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        out = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([out, np.ones((len(x), 1))], 1)


def statistics_table(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_x``, the statistics of each row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def make():
        return lambda texts, batch: {"_x": pa.array([[float(v) for v in statistics(t)] for t in texts], pa.list_(pa.float64()))}

    return map_texts(docs.select(text_col, *[c for c in keep if c != text_col]), text_col, schema, make)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], dict[int, float]]:
    """Per fold: sum of z z', of z y and of y, from (fold, y, _x). Partitions sum first; the totals are as large as the features."""
    d = len(features.b) + 1
    held = rows.sparkSession.sparkContext.broadcast(features)  # of fixed size

    def run(batches):
        total = {}
        for batch in batches:
            fold, y = np.asarray(batch.column(0)), np.asarray(batch.column(1), dtype=float)
            z = held.value(_matrix(batch.column(2)))
            for f in np.unique(fold):
                own = z[fold == f]
                both = np.concatenate([own, y[fold == f, None]], 1)
                total[int(f)] = total.get(int(f), 0) + own.T @ both
        for f, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, f, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], names=["fold", "i", "v"]
            )

    parts = rows.select("fold", "y", "_x").mapInArrow(run, "fold int, i int, v array<double>")

    def add(pdf):
        out = pdf.iloc[:1].copy()
        out["v"] = [np.sum(np.stack(pdf.v.to_list()), 0)]
        return out

    # A row of the matrix from each partition: first within salts, so no task gets all partitions.
    some = parts.withColumn("salt", F.spark_partition_id() % 64).groupBy("fold", "i", "salt").applyInPandas(add, "fold int, i int, v array<double>, salt int")
    grams, rights = {}, {}
    for fold, i, v in some.select("fold", "i", "v").groupBy("fold", "i").applyInPandas(add, "fold int, i int, v array<double>").collect():
        grams.setdefault(fold, np.zeros((d, d)))[i] = v[:d]
        rights.setdefault(fold, np.zeros(d))[i] = v[d]
    return grams, rights, {f: g[-1, -1] for f, g in grams.items()}


def ridge(gram: np.ndarray, right: np.ndarray, n: float, strength: float) -> np.ndarray:
    return np.linalg.solve(gram + strength * max(n, 1) * np.eye(len(gram)), right)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of the cells by pooling adjacent violators."""
    level: list[list[float]] = []
    for n, k in zip(total, positive, strict=True):
        level.append([k, n, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            k2, n2, w2 = level.pop()
            level[-1] = [level[-1][0] + k2, level[-1][1] + n2, level[-1][2] + w2]
    return np.concatenate([np.full(w, k / n) for k, n, w in level]) if level else np.zeros(0)


class Model:
    """Score of statistics: ridge output, through the calibration curve."""

    def __init__(self, features: Fourier | None, weights: np.ndarray, knots: np.ndarray, rates: np.ndarray, base: float):
        self.features, self.weights, self.knots, self.rates, self.base = features, weights, knots, rates, base

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), self.base)
        raw = self.features(x) @ self.weights
        if not len(self.knots):
            return np.clip(raw, 0, 1)
        # A small slope keeps the order of scores inside flat parts of the curve.
        return np.clip(0.99 * np.interp(raw, self.knots, self.rates) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def fit(table: DataFrame, features: int = FEATURES, strength: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """Fit on all rows of (fold, y, _x); without both labels the score is constant."""
    size = len(STATISTICS)
    cells = F.posexplode("_x").alias("i", "v")
    moments = dict.fromkeys(range(size), (0.0, 1.0))
    for i, m, s in table.select(cells).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).collect():  # a row for each statistic
        moments[i] = (m, s)
    rff = Fourier(np.array([moments[i][0] for i in range(size)]), np.array([moments[i][1] for i in range(size)]), features, width, seed)
    grams, rights, sizes = normal_equations(table, rff)
    n, total = sum(sizes.values()), sum((r[-1] for r in rights.values()), 0.0)
    if not n or not 0 < total < n:
        return Model(None, np.zeros(0), np.zeros(0), np.zeros(0), total / n if n else 0.5)
    whole = ridge(sum(grams.values()), sum(rights.values()), n, strength)
    if len(grams) < 2:
        return Model(rff, whole, np.zeros(0), np.zeros(0), total / n)
    others = {f: ridge(sum(g for k, g in grams.items() if k != f), sum(r for k, r in rights.items() if k != f), n - sizes[f], strength) for f in grams}
    held = table.sparkSession.sparkContext.broadcast((rff, others))

    def cell(batches):
        rff_, weights = held.value
        for batch in batches:
            fold, z = np.asarray(batch.column(0)), rff_(_matrix(batch.column(2)))
            raw = np.einsum("ij,ij->i", z, np.stack([weights[int(f)] for f in fold])) if len(fold) else np.zeros(0)
            at = np.clip(np.round((raw + 0.5) * CELLS / 2), 0, CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["cell", "y"])

    counted = table.select("fold", "y", "_x").mapInArrow(cell, "cell int, y double").groupBy("cell").agg(F.count("*"), F.sum("y")).collect()  # at most CELLS + 1 rows
    at, k, y = (np.array(c, float) for c in zip(*sorted(counted), strict=True))
    return Model(rff, whole, at * 2 / CELLS - 0.5, isotonic(k, y), total / n)


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Learns from the labels (``id_col``, ``label_col`` 0 or 1) of rows whose crc32(id) mod 4
    is not 2; the text alone is scored. Null labels and ids are not learned from, several
    labels of one id count as their mean, repeated rows are learned from and scored each.
    Null and empty texts are scored by their all-zero statistics. Without labels of both
    kinds the score is their mean, or 0.5 if there are none. An empty table gives an empty
    one. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = stash(statistics_table(base, "text", ["doc_id"]), "quality")
    out = held_out(F.col("doc_id"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    fold = (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int")
    learned = stash(table.where(~out).join(known, "doc_id").select(fold.alias("fold"), "y", "_x"), "quality-learned")
    held = spark.sparkContext.broadcast(fit(learned))  # of fixed size
    new = [T.StructField("score", T.DoubleType())]
    schema = with_fields(T.StructType([table.schema["doc_id"]]), new)

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value(_matrix(batch.column(1))) if batch.num_rows else [], pa.float64())], names=["doc_id", "score"])

    scored = table.select("doc_id", "_x").mapInArrow(apply, schema)
    return scored.select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)
