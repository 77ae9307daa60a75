"""Benchmark decontamination by winnowing, in DataFrame and SQL functions only.

Every k-gram of words has a hash, and of every window of ``WINDOW`` words the smallest one
is kept. Neighbouring windows mostly keep the same, so a text has few fingerprints. A window
shared by a document and a benchmark text has the same fingerprint in both, so a join of
the fingerprints of both sides misses no shared span of ``WINDOW`` words or more. Where they
meet, the hit is extended to the windows that kept this fingerprint, compared word for word.
Benchmark texts shorter than a window are windows of their own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stash

WINDOW, GRAM = 10, 5
#: Benchmark fingerprints and windows up to this many, and windows of this many bytes, are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A k-gram's number: 44 bits of its hash, then its place, so that of equal hashes the last one is the smallest.
_PLACES = (1 << 20) - 1


def words(text):
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _every(of: str, n: int, what: str) -> str:
    """SQL: ``what`` of every ``n`` consecutive elements of the array ``of``; there ``{0}`` stands for them and i for the first one's place."""
    parts = ", ".join(["x"] + [f"get({of}, i + {j})" for j in range(1, n)])
    return f"if(size({of}) < {n}, array(), slice(transform({of}, (x, i) -> {what.format(parts)}), 1, greatest(size({of}) - {n - 1}, 0)))"


def _joined(of: str, n: int) -> str:
    """SQL: the ``n`` elements of the array ``of`` from i on, with blanks between."""
    return "concat_ws(' ', " + ", ".join(f"get({of}, i + {j})" for j in range(n)) + ")"


def with_fingerprints(df: DataFrame, window: int = WINDOW, gram: int = GRAM, short: tuple[int, ...] = ()) -> DataFrame:
    """Add ``_prints`` to the words ``_w``: structs (len, fp, at, n), the fingerprint kept by the ``n`` windows from word ``at`` on.

    For the lengths ``short`` every window of that length is a fingerprint of its own.
    """
    df = df.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    df = df.withColumn("_g", F.expr(_every("_h", gram, f"(xxhash64({{0}}) & {~_PLACES}L) | ({_PLACES}L - (i & {_PLACES}))")))
    df = df.withColumn("_m", F.expr(_every("_g", window - gram + 1, "least({0})")) if window > gram else F.col("_g"))
    # a run of windows begins where another k-gram than before is kept
    begins = "filter(transform(_m, (m, j) -> if(j > 0 and get(_m, j - 1) = m, null, struct(shiftright(m, 20) as fp, j))), x -> x is not null)"
    df = df.withColumn("_runs", F.expr(begins))
    prints = [f"transform(_runs, (x, k) -> struct({window} as len, x.fp as fp, x.j as at, coalesce(get(_runs, k + 1).j, size(_m)) - x.j as n))"]
    for n in short:
        own = f"struct({n} as len, xxhash64({_joined('_w', n)}) as fp, i as at, 1 as n)"
        prints.append(f"transform(if(size(_w) < {n}, array(), sequence(0, size(_w) - {n})), i -> {own})")
    return df.withColumn("_prints", F.expr(f"concat({', '.join(prints)})")).drop("_h", "_g", "_m", "_runs")


#: SQL: the words of the windows of the print p. A slice would copy the whole text for each.
_REACH = "transform(sequence(p.at, p.at + p.n + p.len - 2), k -> get(_w, k))"


def benchmark_tables(bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints (len, fp) of all items, and their distinct windows (len, win, set_id, items).

    ``items`` holds the sorted ids of the items that share a window, ``set_id`` stands for them.
    """
    base = stash(bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("_w")).where("size(_w) > 0"), "bench")
    long_, short = base.where(f"size(_w) >= {window}"), base.where(f"size(_w) < {window}")
    prints = with_fingerprints(long_, window, gram).select(F.explode_outer("_prints").alias("p")).where("p is not null").select("p.len", "p.fp")
    prints = prints.unionByName(short.selectExpr("size(_w) as len", "xxhash64(array_join(_w, ' ')) as fp")).distinct()
    each = long_.select("item", F.expr(f"inline(transform(sequence(0, size(_w) - {window}), i -> struct({window} as len, {_joined('_w', window)} as win)))"))
    each = each.unionByName(short.selectExpr("item", "size(_w) as len", "array_join(_w, ' ') as win"))
    windows = each.groupBy("len", "win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stash(prints, "bench-prints"), stash(windows.withColumn("set_id", F.xxhash64("items")), "bench-windows")


def fingerprint_hits(docs: DataFrame, doc_fields: list[str], prints: DataFrame, short: tuple[int, ...], window: int, gram: int, broadcast: bool) -> tuple[DataFrame, DataFrame]:
    """Documents (_row, doc) and hits (_row, len, at, words): the places whose fingerprint the benchmark has too, with the words of their windows.

    ``docs`` has ``_doc``, a struct of columns to carry on, and the words ``_w``. The texts
    are read once if the benchmark's fingerprints are broadcast. Otherwise numbers alone are
    shuffled to meet them, and only then joined to the words; adaptive execution splits what
    meets a fingerprint of very many documents. (Outer generators: for the
    others Spark derives a filter that works out all fingerprints once more, step by step.)
    """
    carried = F.struct(*[F.col("_doc")[c].alias(c) for c in doc_fields], F.size("_w").cast("long").alias("n_words")).alias("doc")
    if broadcast:
        own = with_fingerprints(docs.select(F.monotonically_increasing_id().alias("_row"), carried, "_w"), window, gram, short)
        row = "transform(_prints, p -> struct(p.len as len, p.fp as fp, p.at as at, {0} as words, {1} as doc))"
        nothing = f"cast(null as {docs_type(own, 'doc')})"
        alone = "array(struct(cast(null as int) as len, cast(null as bigint) as fp, cast(null as int) as at, cast(null as array<string>) as words, doc))"
        flat = own.select("_row", F.expr(f"inline_outer(concat({alone}, {row.format(_REACH, nothing)}))"))
        met = flat.join(F.broadcast(prints.withColumn("hit", F.lit(True))), ["len", "fp"], "left").where("doc is not null or hit")
        seen = stash(met.select("_row", "doc", "len", "at", "words"), "bench-seen")
        return seen.where("doc is not null").select("_row", "doc"), seen.where("doc is null").select("_row", "len", "at", "words")
    seen = stash(docs.select(F.monotonically_increasing_id().alias("_row"), carried, "_w"), "bench-seen")
    each = with_fingerprints(seen.select("_row", "_w"), window, gram, short).select("_row", F.expr("inline_outer(_prints)")).where("len is not null")
    met = each.join(prints, ["len", "fp"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("len", "at", "n")).alias("_met"))  # bounded by one document
    back = seen.select("_row", "_w").join(met, "_row")
    hits = back.select("_row", F.expr(f"inline_outer(transform(_met, p -> struct(p.len as len, p.at as at, {_REACH} as words)))"))
    return seen.select("_row", "doc"), hits


def docs_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def contamination(
    spark: SparkSession, docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window of the benchmark
    (``item_id``, ``text``), ``items`` holds the ids of items with such a window, sorted as
    strings. Null texts have no words, items without words no windows; a null item id hits
    but is not listed. Repeated rows and ids stay as they are. Input columns named like an
    output give way, other columns pass unchanged. With an empty benchmark nothing is hit; no documents give no rows.
    """
    prints, windows = benchmark_tables(bench, window, gram)
    short = tuple(sorted(r[0] for r in windows.where(F.col("len") < window).select("len").distinct().collect()))  # less than ``window`` values
    new = ("n_words", "n_hit", "n_items", "items", "contaminated")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    carried = F.struct(*keep) if keep else F.struct(F.lit(0))
    rows, hits = fingerprint_hits(docs.select(carried.alias("_doc"), words(F.col(text_col)).alias("_w")), keep, prints, short, window, gram, prints.count() <= broadcast_rows)

    right = windows.select("len", "win", "set_id")
    n_windows, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("win") + 32), F.lit(0))).first()
    if n_windows <= broadcast_rows and n_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    around = "inline(transform(sequence(0, size(words) - len), i -> struct(at + i as at, array_join(slice(words, i + 1, len), ' ') as win)))"
    hits = hits.select("_row", "len", F.expr(around)).join(right, ["len", "win"]).select("_row", "at", "len", "set_id")
    covered = "aggregate(array_sort(_spans), struct(0 as upto, 0L as n), (a, s) -> struct(greatest(a.upto, s.upto) as upto, a.n + greatest(s.upto - greatest(s.at, a.upto), 0) as n), a -> a.n)"
    per_doc = hits.groupBy("_row").agg(  # bounded by the words of one document
        F.collect_list(F.struct("at", (F.col("at") + F.col("len")).alias("upto"))).alias("_spans"), F.collect_set("set_id").alias("_sets")
    ).select("_row", F.expr(covered).cast("long").alias("n_hit"), "_sets")
    per_doc = stash(per_doc, "bench-hits")
    sets = windows.groupBy("set_id").agg(F.first("items").alias("items"))
    named = per_doc.select("_row", F.explode("_sets").alias("set_id")).join(sets, "set_id")
    named = named.groupBy("_row").agg(F.expr("sort_array(array_distinct(flatten(collect_list(items))))").alias("items"))
    found = per_doc.select("_row", "n_hit").join(named, "_row", "left")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, "_row", "left").select(
        *[F.col("doc")[c].alias(c) for c in [*keep, "n_words"]], n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, keep=["doc_id"])
    sha = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bwin AS (
  SELECT item, least(len(w), 10) AS n, unnest(CASE WHEN len(w) <= 10 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win
  FROM bw WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT n FROM bwin
), dwin AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM dw, lens WHERE len(w) >= n
), hit AS (
  SELECT d.r, d.i, d.n, b.item FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
