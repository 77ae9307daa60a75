"""A streaming source of frame batches: every camera appends closed segments to a folder of its own.

The source keeps an offset for each camera, the last segment read, so cameras come, go and fall
behind independently. A micro-batch has a partition for each camera with something new, several
if that is more than ``SPAN`` segments, and a task holds ``LINES`` batches at a time. It
is planned from two offsets, so a repeated or restarted micro-batch reads the same segments.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "camera_segments"
#: Segments that one task reads, at most.
SPAN = 8
#: Batches of a segment that are held at a time.
LINES = 4096
SEGMENT = (
    "t bigint, frames array<struct<source_id: int, objects: array<struct<"
    "class_id: int, object_id: string, rect: struct<left: double, top: double, width: double, height: double>>>>>"
)
_RECT = pa.struct([(c, pa.float64()) for c in ("left", "top", "width", "height")])
_OBJECT = pa.struct([("class_id", pa.int32()), ("object_id", pa.string()), ("rect", _RECT)])
_ARROW = pa.schema([("t", pa.int64()), ("frames", pa.list_(pa.struct([("source_id", pa.int32()), ("objects", pa.list_(_OBJECT))])))])


def _located(path: str, *below: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path``, and there the path of what lies ``below`` it, whose names may hold anything."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, root = pafs.FileSystem.from_uri(path)
    return system, "/".join([root, *below])


def segments(path: str) -> dict[str, list[str]]:
    """The closed segments (``*.jsonl``) of each camera in order of their names."""
    system, root = _located(path)
    found: dict[str, list[str]] = {}
    for x in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if x.is_file and x.base_name.endswith(".jsonl"):
            found.setdefault(x.path.rsplit("/", 2)[-2], []).append(x.base_name)
    return {camera: sorted(names) for camera, names in sorted(found.items())}


class Unread(InputPartition):
    """Segments of one camera behind ``after``, up to ``upto``."""

    def __init__(self, camera: str, after: str, upto: str):
        self.camera, self.after, self.upto = camera, after, upto


class SegmentReader(DataSourceStreamReader):
    """Offsets are {camera: name of the last segment}; names of a camera's segments ascend."""

    def __init__(self, path: str, consumed: str):
        self.path, self.consumed = path, consumed

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {camera: names[-1] for camera, names in segments(self.path).items()} or {"": ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        held, out = segments(self.path), []
        for camera, upto in sorted(end.items()):
            after = start.get(camera, "")
            if camera and upto > after:
                names = [name for name in held.get(camera, []) if after < name <= upto]
                ends = [after, *names[SPAN - 1 : -1 : SPAN], upto]
                out += [Unread(camera, *ends[k : k + 2]) for k in range(len(ends) - 1)]
        return out

    def read(self, partition: Unread) -> Iterator[pa.RecordBatch]:
        system, root = _located(self.path, partition.camera)
        names = sorted(x.base_name for x in system.get_file_info(pafs.FileSelector(root)) if x.is_file and x.base_name.endswith(".jsonl"))
        for name in names:
            if partition.after < name <= partition.upto:
                with system.open_input_stream(f"{root}/{name}") as file:
                    lines = (x for x in io.TextIOWrapper(file, "utf-8", newline="\n") if x.strip())
                    while rows := [json.loads(x) for x in islice(lines, LINES)]:
                        for row in rows:
                            for frame in row.get("frames") or []:
                                for one in frame.get("objects") or []:
                                    one["object_id"] = None if one.get("object_id") is None else str(one["object_id"])
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def commit(self, end: dict) -> None:
        """With the option ``consumed`` set to "delete", segments up to ``end`` leave: the query will not ask for them again."""
        if self.consumed != "delete":
            return
        for camera, names in segments(self.path).items():
            for name in names:
                if name <= end.get(camera, ""):
                    system, root = _located(self.path, camera)
                    system.delete_file(f"{root}/{name}")


class CameraSegments(DataSource):
    """Options: ``path``, a folder with a folder for each camera; ``consumed``, "keep" or "delete"."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SEGMENT

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SegmentReader(self.options["path"].rstrip("/"), self.options.get("consumed", "keep"))


def camera_stream(spark: SparkSession, path: str, consumed: str = "keep") -> DataFrame:
    """New segments under ``path`` as streaming batches (t, frames)."""
    spark.dataSource.register(CameraSegments)
    return spark.readStream.format(NAME).option("path", path).option("consumed", consumed).load()


def append_segment(path: str, camera: str, number: int, batches: list[dict]) -> None:
    """What a camera does: write a segment beside, then move it to its name in one step."""
    append_lines(path, camera, number, map(json.dumps, batches))


def append_lines(path: str, camera: str, number: int, lines: Iterable[str]) -> None:
    """``append_segment`` of batches that are JSON already."""
    system, root = _located(path, camera)
    system.create_dir(root)
    with system.open_output_stream(f"{root}/.{number:012d}") as file:
        file.write("".join(x + "\n" for x in lines).encode())
    system.move(f"{root}/.{number:012d}", f"{root}/{number:012d}.jsonl")


def _ship() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
