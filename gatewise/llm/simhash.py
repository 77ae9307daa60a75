"""Near duplicates by SimHash fingerprints, found with vantage-point trees.

Distinct fingerprints are partitioned by their Hamming distance to vantage points: those
within a radius go to one branch, the others to the other one. A fingerprint lives in one
shard (leaf) and visits every shard that the triangle bounds leave open, which are those
beyond a boundary it lies near. So every pair meets in exactly one shard, and there the same
splitting goes on until comparing all that is left is cheaper. A shard returns spanning
links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_value, mix64, release, stash
from .graphs import components, join_hot

by_value(__name__)

SEED = 42
#: Fingerprints that live in one shard, about.
SHARD = 4000
#: The upper tree is fitted on at most one fingerprint in ``SHARE`` and at most ``SAMPLE`` of them; all are routed through it.
SHARE, SAMPLE = 8, 65_536
#: Sampled fingerprints that a leaf of the upper tree keeps at least.
FEWEST = 16
#: Fingerprints that are compared all with all, and what a split must leave of the work to be made.
LEAF, WORTH = 512, 0.9
#: Bytes of a text that are cut into words at once, hashes summed at once, and links held before they are reduced.
_CUT, _ROOM, _LINKS = 1 << 21, 1 << 18, 1 << 20
_LANES = U64(0x0001000100010001)
_SPACES = frozenset(b" \t\n\x0b\x0c\r")


# ---- fingerprints


def _each(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    cut = map(joined.__getitem__, map(slice, starts.tolist(), ends[size - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(starts))


def shingle_hashes(raw: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all runs of ``size`` words of ``raw``, repeats included; of the whole sequence if it has fewer, of nothing if none."""
    held, some, at = [], False, 0
    while at < len(raw):
        end = min(len(raw), at + _CUT)
        while end < len(raw) and raw[end] not in _SPACES:  # never inside a word
            end += 1
        held += raw[at:end].lower().split()
        at = end
        if len(held) >= size:
            some = True
            yield _each(held, size)
            held = held[len(held) - size + 1 :]
    if held and not some:
        yield _each(held, len(held))


class Majority:
    """Counts set bits of the hashes of many texts."""

    def __init__(self, texts: int):
        self.ones, self.total = np.zeros((texts, 64), np.int64), np.zeros(texts, np.int64)
        self._parts, self._owner, self._room = [], [], 0

    def add(self, text: int, hashes: np.ndarray) -> None:
        self.total[text] += len(hashes)
        for lo in range(0, len(hashes), 65_535):  # as many as a lane of 16 bits can count
            part = hashes[lo : lo + 65_535]
            self._parts.append(part)
            self._owner.append(text)
            self._room += len(part)
            if self._room > _ROOM:
                self._sum()

    def _sum(self) -> None:
        if not self._parts:
            return
        flat, owner = np.concatenate(self._parts), np.array(self._owner)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in self._parts])[:-1]])
        for k in range(16):
            lanes = np.add.reduceat((flat >> U64(k)) & _LANES, starts).view(np.uint16).reshape(-1, 4)
            np.add.at(self.ones, (owner[:, None], np.arange(k, 64, 16)[None, :]), lanes)
        self._parts, self._owner, self._room = [], [], 0

    def fingerprints(self) -> np.ndarray:
        """Of each text the bits set in over half of its hashes."""
        self._sum()
        return np.packbits(2 * self.ones > self.total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_table(docs: DataFrame, text_col: str, id_col: str, size: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            bits = Majority(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                for hashes in shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), size):
                    bits.add(i, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.fingerprints().view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---- vantage-point trees


def distances(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def choose_split(homes: np.ndarray, visitors: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and cut that leave the least work, judged by samples; None if none leaves less than ``WORTH`` of it.

    A split puts homes within ``cut`` of the vantage point inside, the others outside.
    """
    some = [x if len(x) <= 2048 else rng.choice(x, 2048, replace=False) for x in (homes, visitors)]
    h, v, best, found = len(homes), len(visitors), WORTH * len(homes) * (len(visitors) + len(homes) / 2), None
    cuts = np.arange(64)
    for vantage in rng.choice(some[0], min(8, len(some[0])), replace=False):
        below = [np.cumsum(np.bincount(distances(x, vantage), minlength=65)) / max(1, len(x)) for x in some]

        def upto(share, d):
            return np.where(d < 0, 0.0, share[np.clip(d, 0, 64)])

        inside, edge = upto(below[0], cuts), upto(below[0], cuts) - upto(below[0], cuts - radius)
        work = inside * h * (v * upto(below[1], cuts + radius) + inside * h / 2)
        work += (1 - inside) * h * (v * (1 - upto(below[1], cuts - radius)) + edge * h + (1 - inside) * h / 2)
        cut = int(np.argmin(work))
        if work[cut] < best:
            best, found = work[cut], (vantage, cut)
    return found


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, again := root[root]):
            root = again
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def shard_links(homes: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all homes to whatever home or visitor lies within ``radius``, at most one for each fingerprint."""
    every = np.concatenate([homes, visitors])
    rng = np.random.default_rng(len(every))
    links, held = [], 0

    def reduced() -> list[tuple[np.ndarray, np.ndarray]]:
        if not links:
            return []
        root = connected(len(every), *(np.concatenate(x) for x in zip(*links, strict=True)))
        tied = np.flatnonzero(root != np.arange(len(every)))
        return [(tied, root[tied])]

    stack = [(np.arange(len(homes)), np.arange(len(homes), len(every)), 0)]
    while stack:
        h, v, depth = stack.pop()
        split = choose_split(every[h], every[v], radius, rng) if len(h) > LEAF and depth < 64 else None
        if split:
            at, cut = split
            dh, dv = distances(every[h], at), distances(every[v], at)
            stack.append((h[dh <= cut], v[dv <= cut + radius], depth + 1))
            stack.append((h[dh > cut], np.concatenate([v[dv > cut - radius], h[(dh <= cut) & (dh > cut - radius)]]), depth + 1))
            continue
        both = np.concatenate([h, v])
        rows = max(1, 65_536 // max(1, len(both)))
        for lo in range(0, len(h), rows):
            i, j = np.nonzero(np.bitwise_count(every[h[lo : lo + rows], None] ^ every[None, both[lo:]]) <= radius)
            i, j = i[j > i], j[j > i]
            if len(i):
                links.append((h[lo + i], both[lo + j]))
                held += len(i)
            if held > _LINKS:
                links = reduced()
                held = sum(len(x) for x, _ in links)
    links = reduced()
    return (every[links[0][0]], every[links[0][1]]) if links else (every[:0], every[:0])


class Tree:
    """The upper tree: routes fingerprints to the shards where they live and that they visit."""

    def __init__(self, sample: np.ndarray, n: int, radius: int):
        """Fitted on ``sample``, distinct fingerprints of ``n``."""
        self.radius = radius
        self.at, self.cut, self.inside, self.outside, self.shard, self.blocks = [], [], [], [], [], []
        scale, rng, self.shards = n / max(1, len(sample)), np.random.default_rng(1), 0

        def grow(homes: np.ndarray, visitors: np.ndarray, depth: int) -> int:
            node = len(self.at)
            for x, value in ((self.at, U64(0)), (self.cut, 0), (self.inside, -1), (self.outside, -1), (self.shard, -1), (self.blocks, 0)):
                x.append(value)
            split = choose_split(homes, visitors, radius, rng) if len(homes) * scale > SHARD and len(homes) >= 2 * FEWEST and depth < 64 else None
            if split:
                self.at[node], self.cut[node] = split
                dh, dv = distances(homes, split[0]), distances(visitors, split[0])
                self.inside[node] = grow(homes[dh <= split[1]], visitors[dv <= split[1] + radius], depth + 1)
                edge = homes[(dh <= split[1]) & (dh > split[1] - radius)]
                self.outside[node] = grow(homes[dh > split[1]], np.concatenate([visitors[dv > split[1] - radius], edge]), depth + 1)
            else:  # what no vantage point parts is dealt to blocks
                self.shard[node], self.blocks[node] = self.shards, max(1, round(len(homes) * scale / (2 * SHARD)))
                self.shards += self.blocks[node]
            return node

        grow(sample, sample[:0], 0)
        self.at = np.array(self.at, np.uint64)
        self.cut, self.inside, self.outside, self.shard, self.blocks = (np.array(x, np.int64) for x in (self.cut, self.inside, self.outside, self.shard, self.blocks))

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, position in ``fps``, lives there or visits), for every shard that a fingerprint belongs to."""
        who, node, home, out = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool), []
        while len(who):
            leaf = self.inside[node] < 0
            out.append(self._dealt(fps, who[leaf], node[leaf], home[leaf]))
            who, node, home = who[~leaf], node[~leaf], home[~leaf]
            d, cut, r = distances(fps[who], self.at[node]), self.cut[node], self.radius
            to_in = np.where(home, d <= cut, d <= cut + r)
            to_out = d > cut - r  # homes inside near the boundary visit; those outside live there
            who, home, node = (
                np.concatenate([who[to_in], who[to_out]]),
                np.concatenate([home[to_in], home[to_out] & (d > cut)[to_out]]),
                np.concatenate([self.inside[node[to_in]], self.outside[node[to_out]]]),
            )
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), who, home)

    def _dealt(self, fps, who, node, home):
        """The blocks of a shard: a fingerprint lives in one of them and visits those behind it; others visit all."""
        blocks = self.blocks[node]
        own = np.where(home, (mix64(fps[who]) % blocks.astype(np.uint64)).astype(np.int64), 0)
        n = blocks - own
        each = np.repeat(np.arange(len(who)), n)
        place = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        return self.shard[node][each] + own[each] + place, who[each], home[each] & (place == 0)


# ---- Spark side


def near_fingerprints(spark: SparkSession, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Words are runs of anything but [space, \\t..\\r], A-Z lower-cased. A bit of the
    fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of the
    shingles of ``size`` words, repeats included; fewer words are one shingle, and none
    (null or empty text) give fingerprint zero, linked like any other. Fingerprints link
    at ``radius`` or fewer differing bits, all pairs of them, and ``component_id`` is the
    smallest id reachable. A null id counts as larger than any other: it names a component
    only of null ids. Repeated rows and ids stay separate rows; an empty table gives an
    empty one. ``docs`` may hold any other columns.
    """
    table = stash(fingerprint_table(docs, text_col, id_col, size), "simhash")
    classes = stash(table.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-classes")
    total = classes.count()
    wanted = min(SAMPLE, total // SHARE) if total > SHARD else 0
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(max(total, 1))) < wanted).select("fp") if wanted else classes.limit(0).select("fp")
    tree = Tree(np.sort(np.array([r.fp for r in sample.collect()], np.int64)).view(np.uint64), total, radius)

    def route(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            shard, who, home = tree.route(fps)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[who].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")  # a repeated task gives the same links
        fps, home = pdf.fp.to_numpy().view(np.uint64), pdf.home.to_numpy()
        a, b = shard_links(fps[home], fps[~home], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = classes.select("fp").mapInArrow(route, "shard long, fp long, home boolean").groupBy("shard").applyInPandas(link, "a long, b long")
    linked = stash(components(links), "simhash-links")
    placed = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stash(placed, "simhash-placed")
    release(linked, classes)
    low = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    by_class = join_hot(placed.select("fp", "root", F.col("n").alias("copies")), low, "root", "fp").select("fp", "component_id", F.col("copies").alias("n"))
    out = join_hot(table, stash(by_class, "simhash-components"), "fp", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, radius=2)
