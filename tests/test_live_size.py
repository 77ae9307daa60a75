"""What a task of the live queries holds does not grow with a camera, and ticks are no state."""

from decimal import Decimal

from pyspark.sql import functions as F

from gatewise.config import OBSERVATION, SECOND, CounterConfig, Line
from gatewise.operators.ingest import with_prev_tick
from gatewise.operators.metrics import OPEN_RATES, carry_rates
from gatewise.sources import live_source
from gatewise.streaming import counter, replay

L1, L2, CONFIG = Line(0, 0.4, 1, 0.4), Line(0, 0.6, 1, 0.6), CounterConfig(width=1.0, height=1.0)
FRAMES = "array<struct<source_id: int, objects: array<struct<class_id: int, object_id: decimal(20,0), rect: struct<left: double, top: double, width: double, height: double>>>>>"


def test_a_camera_writes_many_segments_in_order_of_time(spark, tmp_path):
    batches = spark.createDataFrame([(37 * k % 1000, [(k % 2, [(0, Decimal(k), (1.0, 2.0, 3.0, 4.0))])]) for k in range(1000)], f"t long, frames {FRAMES}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for number in range(2):
            replay.write_segments(batches.withColumn("t", F.col("t") + 1000 * number), f"file:{tmp_path}/in", number)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for camera, names in live_source.segments(f"file:{tmp_path}/in").items():
        texts = [(tmp_path / "in" / camera / name).read_text().splitlines() for name in names]
        assert max(map(len, texts)) <= 50 and len(names) >= 20
        times = [int(x.split(":", 1)[1].split(",", 1)[0]) for text in texts for x in text]
        assert times == sorted(times) and len(times) == 1000
    stream = live_source.camera_stream(spark, f"file:{tmp_path}/in").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(live_source.SEGMENT).parquet(str(tmp_path / "out"))
    assert sorted((r.t, r.frames[0].source_id, r.frames[0].objects[0].object_id) for r in rows.collect()) == sorted((37 * k % 1000 + 1000 * n, k % 2, str(k)) for k in range(1000) for n in range(2))


def test_segments_are_shared_out_and_read_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(live_source, "SPAN", 3, raising=False)
    monkeypatch.setattr(live_source, "LINES", 4, raising=False)
    path = f"file:{tmp_path}/in"
    for k in range(8):
        live_source.append_segment(path, "a", k, [{"t": 10 * k + i, "frames": []} for i in range(10)] + [{"t": 10 * k, "frames": [{"source_id": 1, "objects": [{"object_id": 2**64 - 1, " ": " "}]}]}])
    reader = live_source.SegmentReader(path, "keep")
    names = live_source.segments(path)["a"]
    parts = reader.partitions({"a": names[0]}, {"a": names[-1]})
    assert [(p.after, p.upto) for p in parts] == [(names[0], names[3]), (names[3], names[6]), (names[6], names[7])]
    held = [[b.num_rows for b in reader.read(p)] for p in parts]
    assert held == [[4, 4, 3] * 3, [4, 4, 3] * 3, [4, 4, 3]]


def test_heartbeats_move_the_watermark_and_are_no_state(spark, tmp_path):
    rows = [(t * SECOND, t, 0, 0, 0, 7, 0.5, y, 0.0, 0.0) for t, y in ((1, 0.3), (2, 0.5), (3, 0.7))]
    beats = [(t * SECOND, 0, 0, -1, 0, -1, 0.0, 0.0, 0.0, 0.0) for t in range(10, 60)]
    table = with_prev_tick(spark.createDataFrame(rows + beats, OBSERVATION))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("t"))
    with counter.state_store(spark):
        out = counter.crossing_stream(stream, L1, L2, CONFIG).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.t, r.source_id, r.track_id, r.kind) for r in spark.read.schema(counter.EVENT).parquet(str(tmp_path / "out")).collect()] == [(3 * SECOND, 0, 7, "entry")]
    assert [r.source_id for r in counter.checkpointed_tracks(spark, str(tmp_path / "state")).collect()] == [0]


def test_rates_of_sources_are_carried_by_several_tasks(spark):
    frames = spark.createDataFrame([(s, t) for s in range(12) for t in (0, 1, 1, 2)], "source_id int, t long")
    config = CounterConfig(fps_window_us=2, fps_unit_us=1)
    got = carry_rates(spark.createDataFrame([], OPEN_RATES), frames, config).select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.source_id, r["start"], r["count"], r.fps) for r in got) == [(s, 2, 0, 2.0) for s in range(12)]
    assert len({r.task for r in got}) > 1
