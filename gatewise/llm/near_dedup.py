"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A signature has components of 16 bits and is split into chunks of ``WIDTH``; of two
signatures that differ in fewer than ``chunks * (ERRORS + 1)`` components some chunk differs
in at most ``ERRORS`` (pigeonhole). The allowed errors are enumerated by
leaving components out, so every such pair meets under a common key. Documents with equal
shingle sets are one class and never pair up; classes meet their bucket's smallest member
first, and only buckets where that leaves a member apart are looked at pair by pair. What
meets is gathered into candidate groups, and inside these links are confirmed on the full
shingle sets.
"""

from __future__ import annotations

import heapq
from itertools import combinations
from math import ceil, comb, exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_value, mix64, release, stash
from .graphs import components, join_hot, spread_groups

by_value(__name__)

WIDTH, ERRORS = 5, 1
#: Share of the pairs exactly at the threshold that may meet in no chunk. It sets the number of chunks.
MISSED = 1e-6
#: Share of such pairs whose signatures may be taken as too far apart to compare sets.
REFUSED = 1e-8
#: Chunks up to which signatures are made; thresholds that need more (below 26 per cent) are refused.
MOST_CHUNKS = 800
#: Shingles of a block of a candidate group.
BLOCK = 1 << 20
_CUT = 1 << 21

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)


def design(percent: int) -> tuple[int, int]:
    """Chunks, and the largest signature distance of a candidate pair, for links of ``percent`` or more."""
    same = percent / 100
    meets = sum(comb(WIDTH, e) * same ** (WIDTH - e) * (1 - same) ** e for e in range(ERRORS + 1))
    chunks = 1 if meets >= 1 else ceil(log(MISSED) / log(1 - meets)) if meets > 0 else MOST_CHUNKS + 1
    if not 0 < percent <= 100 or chunks > MOST_CHUNKS:
        raise ValueError(f"no signature of up to {MOST_CHUNKS} chunks finds pairs at {percent} per cent")
    n = chunks * WIDTH
    beyond, accept = 1.0, -1
    while beyond > REFUSED and accept < n and same < 1 or accept < 0:
        accept += 1
        odds = accept * log(1 - same) if accept else 0.0
        beyond -= exp(lgamma(n + 1) - lgamma(accept + 1) - lgamma(n - accept + 1) + odds + (n - accept) * log(same))
    return chunks, accept


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` hash functions; those of a smaller ``n`` are the first of them."""
    return (np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1) for seed in (21, 22))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """64-bit hashes of the words of a byte string, all at once."""

    def __init__(self):
        self.up, self.down = _powers(_B, 1 << 16), _powers(_B_INV, 1 << 16)

    def words(self, raw: bytes) -> np.ndarray:
        parts, start, n = [], 0, len(raw)
        while start < n:
            end = min(n, start + _CUT)
            while end < n and not _IS_SPACE[raw[end]]:  # never inside a word
                end += 1
            parts.append(self._part(np.frombuffer(raw, np.uint8, end - start, start)))
            start = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _part(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            self.up, self.down = _powers(_B, len(raw) * 2), _powers(_B_INV, len(raw) * 2)
        space = _IS_SPACE[raw]
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([[U64(0)], np.cumsum(_BYTE[raw] * self.up[: len(raw)], dtype=np.uint64)])
        return mix64((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; fewer words are one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        out = mix64(out * U64(3) + words[j : j + n] + U64(j))
    return np.unique(out)


def signature_table(docs: DataFrame, text_col: str, id_col: str, size: int, chunks: int) -> DataFrame:
    """(doc_id, cid, n, sig): set hash (16 bytes, null for an empty set), set size and signature of each row."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("cid", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType())]
    )

    def run(batches):
        hasher = _Hasher()
        mult, add = multipliers(chunks * WIDTH)
        for batch in batches:
            cids, sizes, sigs, held, room = [], [], [], [], 0

            def flush():
                if not held:
                    return
                flat, starts = np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
                low = np.empty((len(held), chunks * WIDTH), np.uint64)
                for k in range(chunks * WIDTH):
                    low[:, k] = np.minimum.reduceat(flat * mult[k] + add[k], starts)
                sig = (mix64(low) >> U64(48)).astype(np.uint16)
                h1 = np.add.reduceat(mix64(flat + U64(0x1234567)), starts)
                h2 = np.add.reduceat(mix64(flat ^ U64(0x5DEECE66D1234)), starts)
                cid = np.stack([mix64(h1), mix64(h2)], 1)
                cids.extend(x.tobytes() for x in cid)
                sigs.extend(x.tobytes() for x in sig)
                held.clear()

            where = []
            for text in batch.column(1).to_pylist():
                s = shingles(hasher.words((text or "").encode("utf-8", "surrogatepass")), size)
                sizes.append(len(s))
                where.append(bool(len(s)))
                if len(s):
                    held.append(s)
                    room += len(s)
                if room > 200_000:
                    flush()
                    room = 0
            flush()
            a, b = iter(cids), iter(sigs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([next(a) if x else None for x in where], pa.binary()), pa.array(sizes, pa.int64()), pa.array([next(b) if x else None for x in where], pa.binary())],
                names=["doc_id", "cid", "n", "sig"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def chunk_keys(classes: DataFrame, chunks: int, width: int = WIDTH, errors: int = ERRORS) -> DataFrame:
    """(key, nid): a key for every chunk and every choice of ``errors`` components left out."""
    picks = [[j for j in range(width) if j not in out] for out in combinations(range(width), errors)]

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, width).astype(np.uint64)
            keys = []
            for c in range(chunks):
                for p, pick in enumerate(picks):
                    key = np.full(len(sig), c * len(picks) + p + 1, np.uint64)
                    for j in pick:
                        key = mix64(key * U64(0x10001) + sig[:, c, j] + U64(1))
                    keys.append(key)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), n))], names=["key", "nid"])

    return classes.select("nid", "sig").mapInArrow(run, "key long, nid long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1)


def cluster_signatures(sig: np.ndarray, accept: int) -> np.ndarray:
    """The smallest row number reachable from each row over pairs within ``accept``."""
    root, rest, new = np.full(len(sig), -1), np.arange(len(sig)), []
    while len(rest):
        if not new:
            new = [rest[0]]
            root[rest[0]], top, rest = rest[0], rest[0], rest[1:]
        near = _apart(sig[rest], sig[new.pop()]) <= accept
        root[rest[near]] = top
        new.extend(rest[near])
        rest = rest[~near]
    return root


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of each set, as the smallest position in it, over pairs whose
    intersection is at least ``percent`` per cent of their union.

    Sets are reached from those already in a component, the most central first, and only
    sets not yet reached are compared: no pair is listed.
    """
    k = len(sets)
    size = np.array([len(x) for x in sets])
    _, inv = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(k), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    df = np.bincount(inv)
    order = np.argsort(inv, kind="stable")
    posted, post_at = own[order], np.concatenate([[0], np.cumsum(df)])
    central = np.bincount(own, weights=df[inv], minlength=k) / size
    root, open_ = np.full(k, -1), np.ones(k, bool)
    left, live, live_own = k, inv, own
    for seed in np.argsort(-central, kind="stable"):
        if not open_[seed]:
            continue
        open_[seed], left, group, heap = False, left - 1, [seed], [(-central[seed], seed)]
        while heap and left:
            u = heapq.heappop(heap)[1]
            mine = inv[begin[u] : begin[u + 1]]
            if 2 * df[mine].sum() < len(live):
                at = np.repeat(post_at[mine] - np.concatenate([[0], np.cumsum(df[mine])[:-1]]), df[mine]) + np.arange(df[mine].sum())
                both = np.bincount(posted[at], minlength=k)
            else:
                mark = np.zeros(len(df), bool)
                mark[mine] = True
                both = np.bincount(live_own[mark[live]], minlength=k)
            got = np.flatnonzero(open_ & (100 * both >= percent * (size[u] + size - both)))
            if len(got):
                open_[got], left = False, left - len(got)
                group.extend(got)
                for v in got:
                    heapq.heappush(heap, (-central[v], v))
                if left and size[open_].sum() < len(live) // 2:
                    keep = open_[live_own]
                    live, live_own = live[keep], live_own[keep]
        root[group] = min(group)
    return root


def _candidates(classes: DataFrame, chunks: int, accept: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) edges that join every two classes with near signatures into one group, and the tables they read."""
    keys = chunk_keys(classes, chunks)
    shared = stash(keys.groupBy("key").agg(F.min("nid").alias("leader"), F.count("*").alias("n")).where("n > 1"), "near-keys")
    members = stash(join_hot(keys, shared, "key", "nid").where("nid <> leader"), "near-members")
    sigs = classes.select("nid", "sig")

    def compare(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, chunks * WIDTH) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_apart(a, b) <= accept)], names=["leader", "nid", "near"])

    met = members.select("leader", "nid").distinct().join(sigs.withColumnRenamed("sig", "sig2"), "nid")
    led = members.groupBy("leader").agg(F.count("*").alias("n")).join(sigs.select(F.col("nid").alias("leader"), "sig"), "leader")
    pairs = (
        join_hot(met, led, "leader", "nid").select("leader", "nid", "sig", "sig2")
        .mapInArrow(compare, "leader long, nid long, near boolean")
    )
    pairs = stash(pairs, "near-pairs")
    direct = pairs.where("near").select(F.col("leader").alias("a"), F.col("nid").alias("b"))
    torn = members.where("n > 2").join(pairs.where("not near").select("leader", "nid"), ["leader", "nid"], "left_semi").select("key", "leader").distinct()
    torn = stash(torn, "near-torn")
    inside = members.select("key", "nid").join(torn.select("key"), "key", "left_semi").unionByName(torn.select("key", F.col("leader").alias("nid")))
    weighted = inside.withColumn("w", F.lit(1))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "nid"])
        sig = np.frombuffer(b"".join(pdf.sig), np.uint16).reshape(-1, chunks * WIDTH)
        key, nid = pdf.key.to_numpy(), pdf.nid.to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        a = np.concatenate([nid[lo:hi][cluster_signatures(sig[lo:hi], accept)] for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True)])
        return pd.DataFrame({"a": a, "b": nid})[a != nid]

    rest = spread_groups(weighted, "key", "nid", "w", 20_000).join(sigs, "nid").groupBy("task").applyInPandas(cluster, "a long, b long")
    return direct.unionByName(rest), [shared, members, pairs, torn]


def near_duplicates(spark: SparkSession, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words are runs of anything but [space, \\t..\\r], A-Z lower-cased; a document's set
    holds its distinct shingles of ``size`` words, or all its words as one if there are
    fewer. Rows are linked when 100 * intersection >= ``percent`` * union, and
    ``component_id`` is the smallest id reachable. Rows without words are linked with
    nothing. A null id counts as larger than any other: it names a component only of null
    ids. Repeated ids stay separate rows; equal texts share a component, and an empty table
    gives an empty one. ``docs`` may
    hold any other columns. The signatures miss a pair at the threshold with a
    probability of at most ``MISSED``, and none that differs in fewer components than
    the pigeonhole allows; a ``percent`` too low for that is an error.
    """
    chunks, accept = design(percent)
    table = stash(signature_table(docs, text_col, id_col, size, chunks), "near-sets")
    grouped = table.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.count("*").alias("copies"))
    classes = stash(grouped.withColumn("nid", F.monotonically_increasing_id()), "near-classes")
    candidates, used = _candidates(classes, chunks, accept)
    groups = stash(components(candidates), "near-groups")
    release(*used)
    found = classes.select("nid", "cid", "rep", "n").join(groups.withColumnRenamed("node", "nid"), "nid")
    members = stash(spread_groups(found, "root", "nid", "n", BLOCK), "near-tasks")

    def full_sets(batches):
        hasher = _Hasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cids, sets = [], []
                for text in batch.column(0).slice(lo, 256).to_pylist():
                    s = shingles(hasher.words((text or "").encode("utf-8", "surrogatepass")), size)
                    if len(s):
                        h = [mix64(np.atleast_1d(np.sum(x))) for x in (mix64(s + U64(0x1234567)), mix64(s ^ U64(0x5DEECE66D1234)))]
                        cids.append(h[0].tobytes() + h[1].tobytes())
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(sets, pa.binary())], names=["cid", "shingles"])

    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    texts = source.join(wanted, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    sets = texts.mapInArrow(full_sets, "cid binary, shingles binary")

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["root", "nid"]).sort_values(["root", "nid"])
        root, nid = pdf.root.to_numpy(), pdf.nid.to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        cuts = np.flatnonzero(np.diff(root)) + 1
        a = np.concatenate([nid[lo:hi][link_sets(own[lo:hi], percent)] for lo, hi in zip([0, *cuts], [*cuts, len(root)], strict=True)])
        return pd.DataFrame({"a": a, "b": nid})[a != nid]

    links = members.select("task", "root", "nid", "cid").join(sets, "cid").groupBy("task").applyInPandas(confirm, "a long, b long")
    linked = stash(components(links), "near-links")
    release(groups, members)
    placed = classes.select("nid", "cid", "rep", "copies").join(linked.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    low = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = stash(placed.join(low, "root").select("cid", "component_id", F.col("copies").alias("n")), "near-placed")
    out = join_hot(table.select("doc_id", "cid", F.col("n").alias("n_shingles")), by_class, "cid", "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM sets
), each AS (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs WHERE 100 * k >= 85 * (nx + ny - k)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS r FROM both_ways
  UNION
  SELECT b.y, r.r FROM reach r JOIN both_ways b ON b.x = r.doc_id
), low AS (
  SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(l.r, s.doc_id) AS component_id, s.doc_id = coalesce(l.r, s.doc_id) AS kept
FROM sized s LEFT JOIN low l USING (doc_id)
"""
