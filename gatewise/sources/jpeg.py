"""JPEG frames in a chunked byte stream: framing, the latest frame, multipart encoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

_FRAME = re.compile(rb"\xff\xd8.*?\xff\xd9", re.S)


class FrameCutter:
    """Takes chunks of a byte stream and gives the frames that each of them completes."""

    def __init__(self):
        self.pending = b""

    def feed(self, chunk: bytes) -> list[bytes]:
        data = self.pending + chunk
        frames, used = [], 0
        for found in _FRAME.finditer(data):
            frames.append(found.group())
            used = found.end()
        rest = data[used:]
        opened = rest.find(b"\xff\xd8")
        self.pending = rest[opened:] if opened >= 0 else rest[-1:]  # a marker may be cut in two
        return frames


#: What is known of a stream between two bytes: outside or inside of a frame, and whether the last byte may begin a marker.
OUTSIDE, OUTSIDE_FF, INSIDE, INSIDE_FF = range(4)
_OPEN, _CLOSE = b"\xff\xd8", b"\xff\xd9"


def walk(data: bytes, state: int) -> Iterator[tuple[int, int, bool, bool]]:
    """Pieces of frames in ``data``, entered in ``state``: (start, end, opens here, closes here).

    A start of -1 stands for a first marker byte that came before ``data``.
    """
    if not data:
        return
    begun, at = state in (OUTSIDE_FF, INSIDE_FF), 0
    if state >= INSIDE:
        at = 1 if begun and data[:1] == _CLOSE[1:] else data.find(_CLOSE) + 2
        closes = at != 1 or begun and data[:1] == _CLOSE[1:]
        yield 0, at if closes else len(data), False, closes
        if not closes:
            return
    start = -1 if begun and state < INSIDE and data[:1] == _OPEN[1:] else data.find(_OPEN, at)
    while start >= 0 or at == 0 and begun and data[:1] == _OPEN[1:]:
        found = data.find(_CLOSE, start + 2)
        yield start, found + 2 if found >= 0 else len(data), True, found >= 0
        if found < 0:
            return
        at = found + 2
        start = data.find(_OPEN, at)


def passage(data: bytes, state: int) -> tuple[int, int]:
    """(state after ``data``, frames it closed) if it is entered in ``state``."""
    if not data:
        return state, 0
    inside, closed = state >= INSIDE, 0
    for _, _, _, closes in walk(data, state):
        closed += closes
        inside = not closes
    return (INSIDE if inside else OUTSIDE) + (data[-1:] == b"\xff"), closed


_FRAMES = "stream long, seq long, part int, piece binary, opens boolean, closes boolean"


def jpeg_frames(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """(stream, seq, jpeg) from (stream, seq, chunk): every complete frame of each stream, numbered in order.

    A stream is cut into ranges of its chunks, so many tasks share even a single one. What a range does to
    the four states in which it can be entered is a small function; composing these
    functions from range to range gives the state and the number of frames before each.
    Then every range cuts its own chunks, and frames that reach over its edges are put
    together from their pieces. Null chunks are empty; an unfinished frame is none.
    """
    order = ("stream", "seq")
    rows = chunks.select(F.col("stream").cast("long").alias("stream"), "seq", "chunk")
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    placed = dealt.sortWithinPartitions(*order).select("stream", F.coalesce("chunk", F.lit(b"")).alias("chunk"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = written(placed, "jpeg-ranges")  # the ranges must stay as they are now
    grouped = placed.groupBy("stream", "part")

    def compose(rows: pa.Table) -> pa.Table:
        states, closed = [0, 1, 2, 3], [0, 0, 0, 0]
        for chunk in rows.sort_by("at")["chunk"].to_pylist():
            seen = {s: passage(chunk, s) for s in set(states)}
            closed = [n + seen[s][1] for n, s in zip(closed, states, strict=True)]
            states = [seen[s][0] for s in states]
        return pa.table({"stream": rows["stream"].slice(0, 1), "part": rows["part"].slice(0, 1), "states": pa.array([states], pa.list_(pa.int32())), "closed": pa.array([closed], pa.list_(pa.int64()))})

    def chain(rows: pa.Table) -> pa.Table:
        rows, state, before, out = rows.sort_by("part"), OUTSIDE, 0, []
        for states, closed in zip(rows["states"].to_pylist(), rows["closed"].to_pylist(), strict=True):
            out.append((state, before))
            state, before = states[state], before + closed[state]
        return pa.table({"stream": rows["stream"], "part": rows["part"], "state": pa.array([x for x, _ in out], pa.int32()), "before": pa.array([x for _, x in out], pa.int64())})

    functions = grouped.applyInArrow(compose, "stream long, part int, states array<int>, closed array<long>")
    entered = functions.groupBy("stream").applyInArrow(chain, "stream long, part int, state int, before long")  # a row for each range

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        state, number, held, opened, out = rows["state"][0].as_py(), rows["before"][0].as_py(), [], False, []
        for chunk in rows["chunk"].to_pylist():
            for start, end, opens, closes in walk(chunk, state):
                if opens:
                    held, opened = [b"\xff"] if start < 0 else [], True
                held.append(chunk[max(start, 0) : end])
                if closes:
                    out.append((number, b"".join(held), opened, True))
                    number, held, opened = number + 1, [], False
            state = passage(chunk, state)[0]
        if held:
            out.append((number, b"".join(held), opened, False))
        n = len(out)
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
        seq, piece, opens, closes = (pa.array(x, k) for x, k in zip(columns, kinds, strict=True))
        return pa.table({"stream": pa.repeat(rows["stream"][0], n), "seq": seq, "part": pa.repeat(rows["part"][0], n), "piece": piece, "opens": opens, "closes": closes})

    pieces = written(placed.join(entered, ["stream", "part"]).groupBy("stream", "part").applyInArrow(cut, _FRAMES), "jpeg-pieces")
    whole = pieces.where("opens and closes").select("stream", "seq", F.col("piece").alias("jpeg"))
    parts = pieces.where("not (opens and closes)").groupBy("stream", "seq").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "closes"))).alias("p"))  # one frame
    joined = F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.piece))")
    return whole.unionByName(parts.where(F.exists("p", lambda x: x["closes"])).select("stream", "seq", joined.alias("jpeg")))


def snapshot(frames: DataFrame) -> DataFrame:
    """One row: the latest frame and whether there is one."""
    last = frames.agg(F.max_by("jpeg", "seq").alias("jpeg"))
    return last.select("jpeg", F.col("jpeg").isNotNull().alias("available"))


def snapshots(frames: DataFrame) -> DataFrame:
    """(stream, jpeg, available): the latest frame of each stream."""
    return frames.groupBy("stream").agg(F.max_by("jpeg", "seq").alias("jpeg")).withColumn("available", F.col("jpeg").isNotNull())


def multipart(frames: DataFrame) -> DataFrame:
    """Each frame as a part of a multipart stream."""
    head = F.concat(F.lit("--frame\r\nContent-Type: image/jpeg\r\nContent-Length: "), F.octet_length("jpeg").cast("string"), F.lit("\r\n\r\n"))
    return frames.withColumn("part", F.concat(head.cast("binary"), F.col("jpeg"), F.lit("\r\n").cast("binary")))


def repeated(frames: DataFrame, step_us: int, until_us: int) -> DataFrame:
    """What a viewer gets: at every multiple of ``step_us`` the latest frame of (stream, t, jpeg) so far."""
    from pyspark.sql import Window

    upto = F.coalesce(F.lead("t").over(Window.partitionBy("stream").orderBy("t")), F.lit(until_us)) - 1
    first = F.ceil(F.col("t") / step_us) * step_us
    spans = frames.withColumn("_from", first).withColumn("_to", upto).where("_from <= _to")
    return spans.select("stream", F.explode(F.sequence("_from", "_to", F.lit(step_us).cast("long"))).alias("tick"), "jpeg")


def _ship() -> None:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
