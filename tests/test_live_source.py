"""The streaming source of camera segments: offsets, restarts, segments that leave."""

import pytest
from pyspark.sql import functions as F

from gatewise.operators.ingest import flatten_batches
from gatewise.sources import live_source
from gatewise.sources.live_source import append_segment, camera_stream, segments


def batch(t, source, *ids):
    return {"t": t, "frames": [{"source_id": source, "objects": [{"class_id": 0, "object_id": i, "rect": {"left": 1, "top": 2.5, "width": 3, "height": 4}} for i in ids]}]}


def run(spark, tmp_path, **more):
    out = camera_stream(spark, f"file:{tmp_path}/in", **more).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("consumed", ["keep", "delete"])
def test_segments_are_read_once_each(spark, tmp_path, consumed):
    path = str(tmp_path / "in")
    run_ = lambda: run(spark, tmp_path, consumed=consumed)
    run_()  # nothing there yet
    append_segment(f"file://{path}", "a", 0, [batch(1, 0, 5, 2**64 - 1), batch(2, 0)])
    append_segment(f"file://{path}", "b", 7, [batch(1, 1, 9)])
    run_()
    run_()  # nothing new
    append_segment(f"file://{path}", "a", 1, [batch(3, 0, 6), {"t": 4, "frames": None}])
    append_segment(f"file://{path}", "late starter", 0, [batch(2, 2)])
    (tmp_path / "in" / "a" / ".000000000009").write_text("not closed yet")
    run_()
    got = spark.read.schema(live_source.SEGMENT).parquet(str(tmp_path / "out"))
    assert sorted((r.t, [f.source_id for f in r.frames or []]) for r in got.collect()) == [(1, [0]), (1, [1]), (2, [0]), (2, [2]), (3, [0]), (4, [])]
    flat = flatten_batches(got).select("t", "source_id", "track_id", "top").orderBy("t", "source_id", F.col("track_id").asc_nulls_last())
    assert [tuple(r) for r in flat.collect()] == [(1, 0, 5, 2.5), (1, 0, None, 2.5), (1, 1, 9, 2.5), (3, 0, 6, 2.5)]
    left = sum(map(len, segments(f"file://{path}").values()))
    assert left == 4 if consumed == "keep" else left < 4


def test_a_partition_for_each_camera_with_something_new():
    reader = live_source.SegmentReader("file:///nowhere", "keep")
    start, end = {"a": "2", "b": "5"}, {"a": "4", "b": "5", "c": "1"}
    assert [(p.camera, p.after, p.upto) for p in reader.partitions(start, end)] == [("a", "2", "4"), ("c", "", "1")]
    assert reader.partitions({}, {"": ""}) == []
    assert segments("file:///nowhere/at/all") == {}
