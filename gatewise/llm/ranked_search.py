"""Ranked lexical search over a clustered index.

Recursive graph bisection orders the documents: a set of documents is halved again and
again so that both halves need few bits for the gaps of their terms' postings. The bisection
is fitted on a bounded sample; every document then goes down the tree by the gains of its
own terms. A cluster (leaf) is one shard of an inverted index, a large one several. For
every term a shard knows the largest score it can give, which bounds what a query can find
there. Queries visit shards in order of these bounds, a few first and then more at a time, and
stop when no bound of the rest reaches the k-th best score so far, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, release, stash, unused

by_value(__name__)

#: Documents of one shard, about.
SHARD = 8192
#: The bisection is fitted on about this many documents; leaves keep at least ``FEWEST`` of them, and nodes * terms stay below ``CELLS``.
SAMPLE, FEWEST, CELLS = 8192, 64, 1 << 22
#: Rounds of swaps a bisection makes at most.
SWAPS = 12
#: Distinct terms of the queries that are answered together; more queries are taken in blocks.
TERMS = 50_000
#: Shards that a query visits in its first wave, and how many times more in the next ones.
FIRST, MORE = 2, 8
#: Of bytes: what separates terms becomes a blank, A-Z are lower-cased, the rest (also all of non-ASCII characters) stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CUT = 1 << 21


def count_terms(text: str | None) -> Counter:
    """How often each term (UTF-8) stands in ``text``: maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    raw, counts, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), Counter(), 0
    while at < len(raw):
        end = min(len(raw), at + _CUT)
        while end < len(raw) and raw[end] != 32:  # never inside a term
            end += 1
        counts.update(raw[at:end].split())
        at = end
    return counts


def impact(tf, m):
    """What an occurrence count ``tf`` gives before the term's weight, in a document of length measure ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# ---- recursive graph bisection


def _gap_bits(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits for the gaps of postings, for terms of ``degree`` documents among ``size``."""
    return degree * np.log2(size / (degree + 1.0))


def bisect(doc: np.ndarray, term: np.ndarray, docs: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(left half of ``docs`` as a mask, gain of each term for going left) of the edges (place in ``docs``, term)."""
    n = len(docs)
    left = np.arange(n) < n // 2
    size = np.array([max(1, n // 2), max(1, n - n // 2)])
    for _ in range(SWAPS):
        degree = [np.bincount(term[left[doc]], minlength=n_terms), np.bincount(term[~left[doc]], minlength=n_terms)]
        bits = _gap_bits(degree[0], size[0]) + _gap_bits(degree[1], size[1])
        to_right = bits - _gap_bits(np.maximum(degree[0] - 1, 0), size[0]) - _gap_bits(degree[1] + 1, size[1])
        to_left = bits - _gap_bits(degree[0] + 1, size[0]) - _gap_bits(np.maximum(degree[1] - 1, 0), size[1])
        gain = np.bincount(doc, weights=np.where(left[doc], to_right[term], to_left[term]), minlength=n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        swap = gain[a[:pairs]] + gain[b[:pairs]] > 1e-9
        if not swap.any():
            break
        left[a[:pairs][swap]], left[b[:pairs][swap]] = False, True
    degree = [np.bincount(term[left[doc]], minlength=n_terms), np.bincount(term[~left[doc]], minlength=n_terms)]
    grown = [_gap_bits(d + 1, s) - _gap_bits(d, s) for d, s in zip(degree, size, strict=True)]
    return left, np.where(degree[0] + degree[1] > 0, grown[1] - grown[0], 0.0)


def fit_bisection(lists: list[np.ndarray], n_terms: int, depth: int) -> np.ndarray:
    """Gains (node, term) of the ``2 ** depth - 1`` inner nodes, in heap order, for documents given as arrays of distinct terms."""
    gains = np.zeros((2**depth - 1, n_terms), np.float32)
    size = np.array([len(x) for x in lists], np.int64)
    doc, term = np.repeat(np.arange(len(lists)), size), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    todo = [(0, np.arange(len(lists)), doc, term)] if depth else []
    while todo:
        node, docs, doc, term = todo.pop()
        left, gains[node] = bisect(doc, term, docs, n_terms)
        number = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
        for side, mask in ((1, left), (2, ~left)):
            child = 2 * node + side
            if child < len(gains):
                own = mask[doc]
                todo.append((child, docs[mask], number[doc[own]], term[own]))
    return gains


def route(sizes: np.ndarray, flat: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The leaf of each document, given the number of its terms and all terms end to end."""
    node, doc = np.zeros(len(sizes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    while len(gains) and node[0:1].size and node[0] < len(gains):  # all are at one level
        go_left = np.bincount(doc, weights=gains[node[doc], flat], minlength=len(sizes)) > 0
        node = 2 * node + np.where(go_left, 1, 2)
    return node - len(gains)


# ---- Spark side


def query_terms(queries: DataFrame, text_col: str, row: str) -> DataFrame:
    """(row, term, qtf): a row for each distinct term (UTF-8) of each query."""

    def run(batches):
        for batch in batches:
            rows, names, n = [], [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, k in count_terms(text).items():
                    rows.append(r)
                    names.append(t)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["row", "term", "qtf"])

    return queries.select(F.col(row).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, term binary, qtf long")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all values end to end) of a column of arrays."""
    return np.diff(np.asarray(column.offsets)).astype(np.int64), np.asarray(column.flatten())


def forward_table(docs: DataFrame, text_col: str, id_col: str, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of each row, and those that ``number`` has with their counts. Rows without terms go."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    )
    held = docs.sparkSession.sparkContext.broadcast(number)  # at most about ``TERMS``

    def run(batches):
        known = held.value
        for batch in batches:
            keep, sizes, own, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                counts = count_terms(text.as_py())
                if counts:
                    keep.append(i)
                    sizes.append(sum(counts.values()))
                    found = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                    own.append([t for t, _ in found])
                    tfs.append([k for _, k in found])
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def document_frequencies(forward: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(_lists(batch.column(0))[1], minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most about ``TERMS`` rows
        out[r.term] = r.df
    return out


def bisection(forward: DataFrame, total: int, n_terms: int) -> np.ndarray:
    """Gains of a bisection into leaves of about ``SHARD`` documents, fitted in one task on about ``SAMPLE`` of them."""
    sampled = min(total, SAMPLE)
    leaves = min(total / SHARD, sampled / FEWEST, CELLS / max(n_terms, 1))
    depth = max(0, math.ceil(math.log2(leaves))) if leaves > 1 else 0
    if not depth:
        return np.zeros((0, n_terms), np.float32)

    def fit(batches):
        lists = [x for batch in batches for x in np.split(*(lambda s, f: (f, np.cumsum(s)[:-1]))(*_lists(batch.column(0)))) if len(x)]
        gains = fit_bisection(lists, n_terms, depth)
        node, term = np.nonzero(gains)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(term), pa.array(gains[node, term])], names=["node", "term", "gain"])

    sample = forward.where(F.pmod(F.xxhash64("row"), F.lit(total)) < sampled).select("terms").coalesce(1)
    gains = np.zeros((2**depth - 1, n_terms), np.float32)
    for r in sample.mapInArrow(fit, "node long, term long, gain float").toLocalIterator():  # at most ``CELLS``
        gains[r.node, r.term] = r.gain
    return gains


def inverted_index(forward: DataFrame, gains: np.ndarray, docs: int, words: int) -> DataFrame:
    """(leaf, part, term, top, places, impacts, ids): of every shard the postings of each term and the largest impact; term -1 holds the ids.

    Documents of a shard are numbered by id (nulls last); places are these numbers.
    """
    held = forward.sparkSession.sparkContext.broadcast(gains)

    def place(batches):
        for batch in batches:
            leaf = route(*_lists(batch.column(batch.schema.get_field_index("terms"))), held.value)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    schema = T.StructType([T.StructField("leaf", T.LongType()), *forward.schema.fields])
    placed = stash(forward.mapInArrow(place, schema), "search-placed")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("parts"))  # a row for each leaf
    sharded = placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.expr("cast(pmod(xxhash64(row), parts) as int)")).drop("parts", "row")

    def invert(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("n", "ascending")]).combine_chunks()
        size, term = _lists(shard["terms"].chunk(0))
        tf, term = _lists(shard["tfs"].chunk(0))[1], term.astype(np.int64)
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        m = 100 - 25 + np.array([25 * n * docs // words for n in shard["n"].to_pylist()], np.int64)
        score = impact(tf, m[doc])
        by = np.lexsort((doc, term))
        term, doc, score = term[by], doc[by], score[by].astype(np.int32)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts, len(term))[1:]
        n = len(starts) + 1
        ids = shard["doc_id"].chunk(0)
        return pa.table(
            {
                "leaf": pa.repeat(shard["leaf"][0], n), "part": pa.repeat(shard["part"][0], n),
                "term": pa.array(np.append(term[starts], -1), pa.int32()),
                "top": pa.array(np.append(np.maximum.reduceat(score, starts) if len(starts) else score, 0), pa.int32()),
                "places": pa.array([doc[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] + [None], pa.binary()),
                "impacts": pa.array([score[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] + [None], pa.binary()),
                "ids": pa.ListArray.from_arrays(pa.array([*([None] * (n - 1)), 0, len(ids)], pa.int32()), ids),
            }
        )

    fields = T.StructType([T.StructField(c, t) for c, t in (("leaf", T.LongType()), ("part", T.IntegerType()), ("term", T.IntegerType()), ("top", T.IntegerType()), ("places", T.BinaryType()), ("impacts", T.BinaryType()))])
    fields = fields.add("ids", T.ArrayType(forward.schema["doc_id"].dataType))
    return stash(sharded.groupBy("leaf", "part").applyInArrow(invert, fields), "search-index")


def visit(index: DataFrame, visits: DataFrame, weights: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(row, score, doc_id): the ``k`` best documents of a shard for each query that visits it, with scores of its ``least`` or more.

    ``visits`` has (leaf, part, asked) with the queries and their least scores; ``weights`` the terms and weights of each query.
    """
    held = index.sparkSession.sparkContext.broadcast(weights)

    def run(shard: pa.Table) -> pa.Table:
        term = shard["term"].to_pylist()
        at = term.index(-1)
        ids = shard["ids"][at].values
        postings = {t: (np.frombuffer(p, np.int32), np.frombuffer(s, np.int32)) for t, p, s in zip(term, shard["places"].to_pylist(), shard["impacts"].to_pylist(), strict=True) if t >= 0}
        rows, scores, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q in shard["asked"][at].as_py():
            total = np.zeros(len(ids), np.int64)
            for t, w in zip(*(x.tolist() for x in held.value[q["row"]]), strict=True):
                if t in postings:
                    places, score = postings[t]
                    total[places] += w * score.astype(np.int64)
            able = np.flatnonzero(total >= max(1, q["least"]))
            if len(able) > k:
                able = able[total[able] >= np.partition(total[able], -k)[-k]]
            able = able[np.lexsort((able, -total[able]))][:k]
            rows.append(np.full(len(able), q["row"], np.int64))
            scores.append(total[able])
            found.append(able)
        return pa.table({"row": np.concatenate(rows), "score": np.concatenate(scores), "doc_id": ids.take(pa.array(np.concatenate(found)))})

    fields = T.StructType([T.StructField("row", T.LongType()), T.StructField("score", T.LongType()), T.StructField("doc_id", index.schema["ids"].dataType.elementType)])
    visited = index.join(visits, ["leaf", "part"]).withColumn("asked", F.when(F.col("term") == -1, F.col("asked")))  # once a shard, not with each term
    return visited.groupBy("leaf", "part").applyInArrow(run, fields)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _answer(spark: SparkSession, docs: DataFrame, asked: DataFrame, text_col: str, id_col: str, k: int) -> DataFrame:
    """(row, rank, doc_id, score) for a block of queries (row, term, qtf)."""
    pairs = asked.collect()  # at most about ``TERMS``, or one query's
    number = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in pairs}))}
    forward = stash(forward_table(docs, text_col, id_col, number).withColumn("row", F.monotonically_increasing_id()), "search-forward")
    n_docs, n_words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(forward, len(number)) if n_docs else np.zeros(len(number), np.int64)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
    weights: dict[int, list[tuple[int, int]]] = {}
    for r in pairs:
        t = number[bytes(r.term)]
        if df[t]:
            weights.setdefault(r.row, []).append((t, r.qtf * weight[t]))
    held = {r: tuple(np.array(x, np.int64).T) for r, x in weights.items()}
    index = inverted_index(forward, bisection(forward, n_docs, len(number)), n_docs, max(n_words, 1))

    wanted = spark.createDataFrame([(r, t, w) for r, x in weights.items() for t, w in x], "row long, term int, w long")
    bounds = index.select("leaf", "part", "term", "top").join(F.broadcast(wanted), "term").groupBy("row", "leaf", "part").agg(F.sum(F.col("w") * F.col("top")).alias("bound")).where("bound > 0")
    order = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("bound"), "leaf", "part"))
    bounds = stash(bounds.withColumn("nth", order), "search-bounds")
    last, done, upto = bounds.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0], 0, FIRST
    best = None
    while done < last:
        wave = bounds.where(f"nth > {done} and nth <= {upto}")
        if best is None:
            wave = wave.withColumn("least", F.lit(1).cast("long"))
        else:
            reached = best.where(F.col("rank") == k).select("row", F.col("score").alias("least"))
            open_ = bounds.where(f"nth > {done}").join(reached, "row", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least")
            if open_.limit(1).count() == 0:
                break
            wave = open_.where(f"nth <= {upto}")
        visits = wave.groupBy("leaf", "part").agg(F.collect_list(F.struct("row", "least")).alias("asked"))  # bounded by the block's queries
        found = visit(index, visits, held, k)
        before = best
        best = stash(_best(found if best is None else found.unionByName(best.select("row", "score", "doc_id")), k), "search-best")
        if before is not None:
            release(before)
        done, upto = upto, upto * MORE
    release(forward, index, bounds)
    if best is None:
        return spark.createDataFrame([], T.StructType([T.StructField("row", T.LongType()), T.StructField("score", T.LongType()), docs.schema[id_col], T.StructField("rank", T.IntegerType())])).withColumnRenamed(id_col, "doc_id")
    return best


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, text_col: str = "text", id_col: str = "doc_id", query_id: str = "item_id", query_text: str = "text", k: int = 20) -> DataFrame:
    """(``query_id``, rank, doc_id, score): the ``k`` best rows of ``docs`` for each row of ``queries``, scores above 0 only.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Every row
    with a term counts as a document. With N documents of L terms, n of them in this one, and
    df documents holding a term, its weight is floor(1000 * ln((2N + 2) / (2df + 1))), and a document scores the sum over the
    query's terms, repeats included, of weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25nN div L. Equal scores go by ascending id,
    null ids last, and repeated rows each have a rank. Null and empty texts match nothing;
    repeated queries are answered each. Either table may be empty and hold any other columns.
    """
    row = unused("row", queries)
    asked = stash(queries.select(F.monotonically_increasing_id().alias(row), F.col(query_id).alias("_query"), F.col(query_text).alias("_text")), "search-queries")
    pairs = stash(query_terms(asked, "_text", row), "search-terms")
    blocks = max(1, -(-pairs.count() // TERMS))
    answers = None
    for b in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        found = _answer(spark, docs, mine, text_col, id_col, k)
        answers = found if answers is None else answers.unionByName(found)
    out = answers.join(asked.select(F.col(row).alias("row"), "_query"), "row")
    return out.select(F.col("_query").alias(query_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT r, doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (
    SELECT r, doc_id, unnest(list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM (SELECT row_number() OVER () AS r, * FROM documents)
  ) GROUP BY ALL
), q AS (
  SELECT r AS qr, item_id, t, CAST(count(*) AS BIGINT) AS qtf FROM (
    SELECT r, item_id, unnest(list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM (SELECT row_number() OVER () AS r, * FROM benchmark)
  ) GROUP BY ALL
), n AS (
  SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY r
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM d GROUP BY t), s
), found AS (
  SELECT qr, item_id, d.r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN d USING (t) JOIN n ON n.r = d.r, s GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
