"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the histogram of piece lengths (as many rows as the capacity) reaches the driver.
There bin completion works on counts: take the largest length left, enumerate the
undominated fillings of the room beside it one by one, use a filling as often as the counts
allow and then less often, prune by the waste that a better solution could still afford.
Best-fit decreasing gives the first incumbent. Only the number of nodes ends a search early. Pieces then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, stash, with_fields

by_value(__name__)

CAPACITY = 2048
#: Nodes of the branch-and-bound search (see ``bin_completion``); when they are spent the incumbent stands.
NODES = 4000
#: Pieces of one salted group when ranks are dealt.
RANK_GROUP = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenIds:
    """Ids of whole texts as little-endian uint32 bytes, as ``encode(text, add_special_tokens=False)`` gives them.

    ``path`` is a byte-level BPE file of the tokenizers library; its special strings are
    single ids wherever a text holds them. Where the same vocabulary lies beside it as
    ranks, tiktoken gives the same ids several times faster; the tokenizers library takes
    what tiktoken refuses.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.whole, self.fast = path, None, None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(path, encoding="utf-8") as file:
                added = json.load(file).get("added_tokens") or []
            if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
                return
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {x["content"]: x["id"] for x in added}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in table.items() if v not in special.values()}, special_tokens=special)

    def _slow(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def of(self, text: str) -> bytes:
        ids = None
        if self.fast is not None:
            try:
                ids = self.fast.encode(text, allowed_special="all", disallowed_special=())
            except BaseException as e:  # noqa: BLE001
                if type(e).__name__ != "PanicException":  # its native code panics on some very long runs, and the type has no place to import it from
                    raise
        return array("I", self._slow(text) if ids is None else ids).tobytes()


def token_pieces(docs: DataFrame, text_col: str, id_col: str, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut into pieces."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids = TokenIds(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = ids.of(text or "") + end
                    n = len(raw) // 4
                    at = 0
                    while at < n:
                        size = (n % capacity or capacity) if at == 0 else capacity
                        row.append(i)
                        piece.append(-(-at // capacity))
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(memoryview(raw)[4 * at : 4 * (at + size)]))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---- the plan over the histogram: a list of (lengths with multiplicity, copies)

Pattern = tuple[dict[int, int], int]
#: Pieces as (length, times), the longest first.
Filling = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: total length, or pieces too large to share one."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    for k in range(1, capacity // 2 + 1):
        large = int(counts[capacity - k + 1 :].sum())
        middle = counts[capacity // 2 + 1 : capacity - k + 1]
        n_mid = int(middle.sum())
        free = n_mid * capacity - int((middle * lengths[capacity // 2 + 1 : capacity - k + 1]).sum())
        rest = int((counts[k : capacity // 2 + 1] * lengths[k : capacity // 2 + 1]).sum())
        best = max(best, large + n_mid + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing, equal bins kept together with a count."""
    open_: dict[int, list[list]] = {}
    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each, bins, used = capacity // length, -(-n // (capacity // length)), {}
            else:
                each = room // length
                used, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            full = min(bins, n // each)
            left = n - full * each
            if full:
                open_.setdefault((room if room is not None else capacity) - each * length, []).append([{**used, length: each}, full])
            n = left
            if full < bins and n:
                open_.setdefault((room if room is not None else capacity) - min(n, each) * length, []).append([{**used, length: min(n, each)}, 1])
                full, n = full + 1, n - min(n, each)
            if room is not None and full < bins:
                open_.setdefault(room, []).append([used, bins - full])
    return [(used, k) for groups in open_.values() for used, k in groups]


def _sums(lengths: list[int], times: list[int], room: int) -> list[int]:
    """For each i the sums, up to ``room``, of pieces of the first i lengths, as the bits of a number."""
    mask, out = (1 << room + 1) - 1, [1]
    for x, n in zip(lengths, times, strict=True):
        bits, n, step = out[-1], min(n, room // x), 1
        while n:
            step = min(step, n)
            bits |= bits << x * step & mask
            n -= step
            step *= 2
        out.append(bits)
    return out


def _dominated(filling: Filling, spare: int, waste: int) -> bool:
    """Whether one of the ``spare`` lengths (as bits) can take the place of other pieces, or of none, and of waste."""
    one = more = 0  # sums of one piece, and of several
    for x, m in filling:
        for _ in range(m):
            more |= (more | one) << x
            one |= 1 << x
    above, reach = (one | more | 1) << 1, 1  # up to ``waste`` more than a sum
    while reach < waste:
        step = min(reach, waste - reach)
        above |= above << step
        reach += step
    return bool(spare & (above | more if waste else more))


def fillings(counts: np.ndarray, room: int, after: tuple[int, Filling] | None = None, most: int | None = None) -> Iterator[tuple[int, Filling] | None]:
    """Every undominated filling of ``room`` from the lengths left, as (waste, filling).

    They come in order of waste, up to ``most``, and of one waste those of the longest pieces
    first; only those behind ``after`` if it is given. A filling is dominated when a piece
    left over can take the place of some of its pieces that fit into it, or of none, within
    the waste; None stands for each one made and found dominated.
    """
    have = np.flatnonzero(counts[: room + 1])
    lengths = have[have > 0].tolist()
    times = [int(counts[x]) for x in lengths]
    if lengths and lengths[-1] == room:  # one piece that fills the room dominates every other filling
        if after is None:
            yield 0, ((room, 1),)
        return
    whole = _sums(lengths, times, room)[-1]
    every = sum(1 << x for x in lengths)
    small = forced = 0  # pieces no longer than the waste are all inside, or the filling is dominated
    for waste in range(after[0] if after else 0, room + 1 if most is None else min(room, most) + 1):
        while small < len(lengths) and lengths[small] <= waste:
            forced += lengths[small] * times[small]
            small += 1
        if forced > room - waste:
            return
        if not whole >> room - waste & 1:
            continue
        tail = tuple((x, n) for x, n in zip(lengths[:small][::-1], times[:small][::-1], strict=True))
        free, n_free = lengths[small:], times[small:]
        sums = _sums(free, n_free, room)
        bound = tuple(r for r in after[1] if r[0] > waste) if after and waste == after[0] else None

        def walk(top: int, rest: int, head: Filling, bound: Filling | None) -> Iterator[Filling]:
            """Ways to ``rest`` by the first ``top`` lengths, the longest pieces first, behind ``bound``."""
            if not rest:
                if bound is None:
                    yield head
                return
            if bound is not None and not bound:
                return
            for i in range(bisect_right(free, rest, 0, top) - 1, -1, -1):
                if not sums[i + 1] >> rest & 1:
                    return
                x = free[i]
                if bound and x > bound[0][0]:
                    continue
                for m in range(min(n_free[i], rest // x), 0, -1):
                    if bound and x == bound[0][0] and m > bound[0][1]:
                        continue
                    if sums[i] >> rest - m * x & 1:
                        yield from walk(i, rest - m * x, (*head, (x, m)), bound[1:] if bound and (x, m) == bound[0] else None)

        for head in walk(len(free), room - waste - forced, (), bound):
            found = (*head, *tail)
            full = sum(1 << x for x, m in found if m == counts[x])
            yield None if _dominated(found, every ^ full, waste) else (waste, found)


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """A packing by branch and bound from the best-fit incumbent.

    It is optimal unless the search ends by its ``nodes``: each filling made, dominated or
    not, and each number of copies of one is a node. Sequences that hold the largest length
    left are taken in the order of ``fillings``.
    """
    best = best_fit_decreasing(counts, capacity)
    best_n, bound = sum(k for _, k in best), lower_bound(counts, capacity)
    if best_n <= bound:
        return best
    lengths = np.arange(len(counts))
    left, total = counts.astype(np.int64).copy(), int((counts * lengths).sum())
    path: list[tuple[int, tuple[int, Filling], int]] = []
    used = waste = 0
    after: tuple[int, Filling] | None = None

    def with_top(top: int, filling: Filling) -> dict[int, int]:
        use = dict(filling)
        use[top] = use.get(top, 0) + 1
        return use

    def place(top: int, found: tuple[int, Filling], k: int) -> None:
        nonlocal used, waste
        for x, m in with_top(top, found[1]).items():
            left[x] -= m * k
        used += k
        waste += k * found[0]

    while nodes > 0 and best_n > bound:
        spare = (best_n - 1) * capacity - total - waste  # more waste than that no better solution affords
        step = None
        if not left.any():
            if used < best_n:
                best, best_n = [(with_top(top, found[1]), k) for top, found, k in path], used
        elif spare >= 0:
            top = int(np.flatnonzero(left)[-1])
            rest = left.copy()
            rest[top] -= 1
            for found in fillings(rest, capacity - top, after, spare):
                nodes -= 1
                if found or not nodes:
                    break
            else:
                found = None
            if found:
                k = int(min(left[x] // m for x, m in with_top(top, found[1]).items()))
                step = top, found, min(k, spare // found[0]) if found[0] else k
        if step is None:  # back: fewer copies of the last choice, or the next filling
            if not path:
                break
            top, found, k = path.pop()
            place(top, found, -k)
            if k == 1 or found[1] in ((), ((capacity - top, 1),)):  # the only filling: fewer copies lead nowhere
                after = found
                continue
            nodes -= 1
            step = top, found, k - 1
        place(*step)
        path.append(step)
        after = step[1] if left[step[0]] else None
    return best


def _placement(plan: list[Pattern]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each length the slots that take its pieces in turn: (first rank), and (first sequence, times, offset)."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for use, copies in plan:
        at = 0
        for x in sorted(use, reverse=True):
            slots.setdefault(x, []).append((copies * use[x], first, use[x], at))
            at += x * use[x]
        first += copies
    ranks = {x: np.concatenate([[0], np.cumsum([s[0] for s in v])]) for x, v in slots.items()}
    return ranks, {x: np.array([s[1:] for s in v], np.int64) for x, v in slots.items()}


def pack(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone.
    Longer ones than ``capacity`` are cut into pieces of it, the first of which may be
    shorter. Sequences are numbered from 0 and gapless inside. Repeated rows and ids are
    packed as often as they occur; an empty table gives an empty one; other columns of
    ``docs`` take no part.
    """
    pieces = stash(token_pieces(docs, text_col, id_col, capacity, end_id, tokenizer or default_tokenizer()), "pieces")
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows:
        counts[length] = n
    ranks, slots = _placement(bin_completion(counts, capacity))
    salts = max(1, -(-int(counts.sum()) // RANK_GROUP))
    salted = pieces.withColumn("_salt", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {salts})"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside)).join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    schema = with_fields(pieces.schema, [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                slot = np.searchsorted(ranks[x], rank[mine], side="right") - 1
                own = slots[x][slot]
                k = rank[mine] - ranks[x][slot]
                seq[mine] = own[:, 0] + k // own[:, 1]
                off[mine] = own[:, 2] + (k % own[:, 1]) * x
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"]
            )

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=2048, end_id=0)
