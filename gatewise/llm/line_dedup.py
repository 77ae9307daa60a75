"""Drop lines that many documents share.

All distinct line hashes are indexed by a sharded minimal perfect hash, whose shards hold
compact fingerprint and count arrays; documents probe these arrays, no line is joined, and
drop the lines whose count is large enough. While the arrays fit ``BROADCAST_BYTES`` every task
gets them; beyond that the line references (never the lines) are routed to the shards,
each shard split into as many salted copies as its share of references asks for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_value, map_texts, mix64, stash, unused, with_fields

by_value(__name__)

BROADCAST_BYTES = 64 << 20
SHARD_KEYS = 1 << 16
#: Line references that one routed task takes.
ROUTED_REFS = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_BYTES_A_KEY = 10


def line_hashes(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of ``text`` as bytes and the 128-bit digest of each key (b"" for an empty key)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digest = xxhash.xxh3_128_digest
    return lines, [digest(k) if (k := x.strip(_SPACE).lower()) else b"" for x in lines]


def _key_chars(line: bytes) -> int:
    return len(line.strip(_SPACE).decode("utf-8", "replace"))


# ---- minimal perfect hash: levels of bit arrays, a key owns the first level where it is alone


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return mix64(h1 + U64((level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF) ^ (h2 * U64(0xD6E8FEB86659FD93))) % np.asarray(size, U64)


def _print(h2: np.ndarray) -> np.ndarray:
    """The compact fingerprint of a key. Keys of the indexed table never need it: each owns its slot."""
    return (h2 >> U64(32)).astype(np.uint32)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, gamma: float = 2.0) -> dict:
    """Bits, level sizes, fingerprints and counts of a minimal perfect hash over distinct (h1, h2)."""
    sizes, levels, left, owner = [], [], np.arange(len(h1)), []
    while len(left):
        size = max(64, -(-int(gamma * len(left)) // 64) * 64)
        at = _place(h1[left], h2[left], len(sizes), size).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        bits = np.packbits(once, bitorder="little")
        alone = once[at]
        mine = left[alone]
        owner.append(mine[np.argsort(at[alone])])
        levels.append(bits)
        sizes.append(size)
        left = left[~alone]
        if len(sizes) > 200:
            raise ValueError("the keys of a shard are not distinct")
    order = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    return {
        "sizes": np.array(sizes, np.int64).tobytes(),
        "bits": b"".join(x.tobytes() for x in levels),
        "prints": _print(h2[order]).tobytes(),
        "counts": np.minimum(counts[order], 2**31 - 1).astype(np.int32).tobytes(),
    }


class LineIndex:
    """Shards laid end to end; looks up many keys at once."""

    def __init__(self, shards: dict[int, dict], n_shards: int):
        self.n_shards = n_shards
        sizes = {s: np.frombuffer(x["sizes"], np.int64) for s, x in shards.items()}
        depth = max((len(x) for x in sizes.values()), default=0)
        self.size = np.zeros((n_shards, depth), np.int64)
        self.start = np.zeros((n_shards, depth), np.int64)
        self.base = np.zeros(n_shards, np.int64)
        bits, at, keys = [], 0, 0
        prints, counts = [], []
        for s in sorted(shards):
            n = len(sizes[s])
            self.size[s, :n] = sizes[s]
            self.start[s, :n] = at + np.concatenate([[0], np.cumsum(sizes[s])[:-1]])
            at += int(sizes[s].sum())
            bits.append(shards[s]["bits"])
            prints.append(np.frombuffer(shards[s]["prints"], np.uint32))
            counts.append(np.frombuffer(shards[s]["counts"], np.int32))
            keys += len(prints[-1])
        self.words = np.frombuffer(b"".join(bits), np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int32)

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for a key that is not held."""
        out = np.zeros(len(h1), np.int64)
        if not len(self.prints):
            return out
        live, shard = np.arange(len(h1)), (h1 % U64(self.n_shards)).astype(np.int64)
        for level in range(self.size.shape[1]):
            if not len(live):
                break
            size = self.size[shard[live], level]
            live, size = live[size > 0], size[size > 0]
            at = _place(h1[live], h2[live], level, size).astype(np.int64) + self.start[shard[live], level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            got = (self.words[word] >> bit) & U64(1) == 1
            hit, word, bit = live[got], word[got], bit[got]
            slot = self.rank[word] + np.bitwise_count(self.words[word] & ((U64(1) << bit) - U64(1)))
            same = self.prints[slot] == _print(h2[hit])
            out[hit[same]] = self.counts[slot[same]]
            live = live[~got]
        return out


# ---- Spark side


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): the number of documents (rows) that hold each line key, keys of ``min_chars`` or more."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")])

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column(0).to_pylist():
                lines, keys = line_hashes(text)
                if min_chars > 1:
                    keys = [k if _key_chars(x) >= min_chars else b"" for x, k in zip(lines, keys, strict=True)]
                for k in set(keys):
                    seen[k] = seen.get(k, 0) + 1
            seen.pop(b"", None)
            h = np.frombuffer(b"".join(seen), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["h1", "h2", "n"]
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("h1", "h2").agg(F.sum("n").alias("n"))


_SHARD = "shard int, sizes binary, bits binary, prints binary, counts binary"


def shard_table(counted: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays for each shard of the (h1, h2, n) table."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_shard(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf.n.to_numpy())
        return pd.DataFrame([{"shard": int(pdf.shard.iloc[0]), **made}])

    shard = F.expr(f"cast(pmod(pmod(h1, {n_shards}) + if(h1 < 0, {(1 << 64) % n_shards}, 0), {n_shards}) as int)")  # h1 counts as unsigned
    return counted.withColumn("shard", shard).groupBy("shard").applyInPandas(build, _SHARD)


def _kept(docs: DataFrame, text_col: str, fields: list[T.StructField], find) -> DataFrame:
    """Apply ``find(lines, keys of a batch) -> mask of lines to drop``."""

    def make():
        def step(texts, batch):
            lines, sizes, keys = [], [], []
            for text in texts:
                own, hashed = line_hashes(text)
                lines.append(own)
                sizes.append(len(own))
                keys += hashed
            full = np.array([bool(k) for k in keys], bool)
            drop = np.zeros(len(keys), bool)
            h = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            drop[full] = find(h[:, 0], h[:, 1])
            ends, out, dropped = np.cumsum(sizes), [], []
            for own, end, n, text in zip(lines, ends, sizes, texts, strict=True):
                mask = drop[end - n : end]
                k = int(mask.sum())
                dropped.append(k)
                out.append((text or "") if not k else b"\n".join(x for x, d in zip(own, mask, strict=True) if not d).decode("utf-8", "surrogatepass"))
            return {text_col: pa.array(out, pa.string()), fields[0].name: pa.array(sizes, pa.int64()), fields[1].name: pa.array(dropped, pa.int64())}

        return step

    return map_texts(docs, text_col, with_fields(docs.schema, fields), make)


def drop_common_lines(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``docs`` with every line dropped whose key at least ``min_docs`` rows hold.

    A key is the line without [space, \\t..\\r] at both ends, A-Z lower-cased; keys of
    fewer than ``min_chars`` code points are kept. Columns ``n_lines`` and ``n_dropped``
    are added (input columns of these names give way), all others pass unchanged. Null
    and empty texts are one empty line and come back as an empty text. Every row counts
    as a document, repeated ids included; an empty table gives an empty table.
    """
    counted = stash(line_counts(docs, text_col, min_chars), "lines")
    total = counted.count()
    n_shards = max(1, -(-total // SHARD_KEYS))
    shards = shard_table(counted, n_shards)
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    if total * _BYTES_A_KEY > broadcast_bytes:
        return _routed(docs, text_col, fields, shards, n_shards, min_docs)
    held = spark.sparkContext.broadcast({r["shard"]: {k: bytes(r[k]) for k in ("sizes", "bits", "prints", "counts")} for r in shards.collect()})

    class Held:
        index = None

    def find(h1, h2):
        if Held.index is None:
            Held.index = LineIndex(held.value, n_shards)
        return Held.index.count(h1, h2) >= min_docs

    return _kept(docs, text_col, fields, find)


def _routed(docs: DataFrame, text_col: str, fields: list[T.StructField], shards: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """Without a broadcast: references to lines go to the shards, the dropped line numbers come back."""
    row, gone = unused("_row", docs), unused("_gone", docs)
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "lines-docs")
    refs_schema = "row long, line int, h1 long, h2 long, shard int"

    def refer(batches):
        for batch in batches:
            rows, nums, keys = [], [], []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, k in enumerate(line_hashes(text)[1]):
                    if k:
                        rows.append(r)
                        nums.append(i)
                        keys.append(k)
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            shard = (h[:, 0].astype(np.uint64) % U64(n_shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(nums, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(shard)],
                names=["row", "line", "h1", "h2", "shard"],
            )

    refs = stash(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text")).mapInArrow(refer, refs_schema), "lines-refs")
    copies = refs.groupBy("shard").agg(F.ceil(F.count("*") / ROUTED_REFS).cast("int").alias("copies"))
    salted = refs.join(copies, "shard").withColumn("salt", F.expr("cast(pmod(xxhash64(row), copies) as int)")).drop("copies")
    spread = shards.join(copies, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": pd.Series(dtype="int64"), "line": pd.Series(dtype="int32")})
        s = int(right.shard.iloc[0])
        index = LineIndex({s: {k: bytes(right[k].iloc[0]) for k in ("sizes", "bits", "prints", "counts")}}, n_shards)
        hit = index.count(left.h1.to_numpy().view(np.uint64), left.h2.to_numpy().view(np.uint64)) >= min_docs
        return left.loc[hit, ["row", "line"]]

    hits = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, "row long, line int")
    per_doc = hits.groupBy("row").agg(F.collect_list("line").alias(gone)).withColumnRenamed("row", row)  # bounded by the lines of one document
    joined = numbered.join(per_doc, row, "left")

    def make():
        def step(texts, batch):
            out, sizes, less = [], [], []
            for text, lost in zip(texts, batch.column(batch.schema.get_field_index(gone)).to_pylist(), strict=True):
                lines, lost = (text or "").split("\n"), set(lost or ())
                sizes.append(len(lines))
                less.append(len(lost))
                out.append("\n".join(x for i, x in enumerate(lines) if i not in lost))
            return {text_col: pa.array(out, pa.string()), fields[0].name: pa.array(sizes, pa.int64()), fields[1].name: pa.array(less, pa.int64())}

        return step

    return map_texts(joined, text_col, with_fields(docs.schema, fields), make)


# ---- the registered query


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = drop_common_lines(spark, docs, min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
  SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '') AS t
  FROM keyed LEFT JOIN common c USING (k) GROUP BY r, doc_id
)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM kept
"""
