"""Settings, control tables, rates, byte streams, streaming."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.config import LINE_VERSIONS, SECOND, CounterConfig
from gatewise.functions.geometry import percent_encoded
from gatewise.operators import assoc, control, ingest, metrics
from gatewise.plans import event_tables as ev
from gatewise.plans import queries as plans
from gatewise.sources import jpeg, settings

DATA = "/root/testdata/sf0.001"


def test_unsigned_ids(spark):
    rows = spark.createDataFrame([("18446744073709551615",), ("-1",), ("18446744073709551614",), ("7",), (None,)], "v string")
    assert [r[0] for r in rows.select(ingest.track_id(F.col("v"))).collect()] == [None, None, -2, 7, None]


def test_rates_as_a_page_writes_them(spark):
    """Tenths of the binary value; 2.05 lies below its text, 0.25 is a tie."""
    from decimal import ROUND_HALF_UP, Decimal

    from gatewise.functions.geometry import fixed_tenths

    values = [0.0, 0.25, 0.75, 2.05, 1.15, 12.35, 29.95, 0.05, 99.99, *(k / 100 for k in range(1, 4000, 7))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_tenths(F.col("v")).alias("text")).collect()
    assert [r.text for r in got] == [str(Decimal(r.v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for r in got]


def test_cameras(spark):
    registry = settings.cameras(spark, [*settings.CAMERAS, ("ground_01", "again", 1, 2, 3)])
    asked = settings.requested_ids(spark, " ground_01 , ,ground_02,ground_01")
    got = settings.load_cameras(asked, registry).orderBy("pos").collect()
    assert [(r.id, r.name) for r in got] == [("ground_01", "again"), ("ground_02", "ground_02"), ("ground_01", "again")]
    with pytest.raises(ValueError, match="unknown camera IDs: b,a"):
        settings.load_cameras(settings.requested_ids(spark, "b,ground_01,a"), registry)
    assert settings.requested_ids(spark, " , ").count() == 0
    assert settings.camera_rows(None) == [] == settings.camera_rows("# nothing\n")


def test_percent_encoding(spark):
    from urllib.parse import quote

    text = "aZ09 -_.~+*/?&=%é漢'\"()!"
    assert spark.range(1).select(percent_encoded(F.lit(text))).first()[0] == quote(text, safe="")


def test_lines_off_on_and_replaced(spark):
    flat = lambda y: (0.0, y, 1.0, y)
    versions = spark.createDataFrame([(5, flat(0.4), flat(0.6)), (9, None, None), (20, flat(0.1), flat(0.2))], LINE_VERSIONS)
    rows = spark.createDataFrame([(t,) for t in (0, 5, 8, 9, 19, 20, 500)], "t long")
    got = control.with_lines(rows, versions, 7).orderBy("t").select("t", "line1.y1").collect()
    assert [tuple(r) for r in got] == [(5, 0.4), (8, 0.4), (20, 0.1), (500, 0.1)]
    assert control.with_lines(rows, versions.limit(0)).count() == 0
    assert control.with_lines(rows.limit(0), versions).count() == 0


def test_resets(spark):
    events = spark.createDataFrame([(1, "entry"), (5, "entry"), (6, "exit")], "t long, kind string")
    at = lambda *t: spark.createDataFrame([(x,) for x in t], "t long")
    assert tuple(metrics.totals(control.since_last_reset(events, at(2, 5))).first()) == (0, 1, 0)
    assert tuple(metrics.totals(control.since_last_reset(events, at())).first()) == (2, 1, 1)


def test_rate_windows(spark):
    ticks = [0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.2]
    frames = spark.createDataFrame([(3, round(t * SECOND), i) for i, t in enumerate(ticks)] + [(4, 0, 0)], "source_id int, t long, frame_seq long")
    got = metrics.fps_windows(frames, CounterConfig())
    assert sorted(map(tuple, got.collect())) == [(3, SECOND, 5, SECOND, 5.0), (3, 2_200_000, 2, 1_200_000, 1.67)]
    by = metrics.fps_by_source(got)
    assert [tuple(r) for r in by.collect()] == [(3, 1.67)]
    assert metrics.fps_map(by).first()[0] == {"3": 1.67}
    assert metrics.fps_total(by.limit(0)).first()[0] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_rate_windows_by_blocks_equal_fold(spark, seed):
    """Many blocks, gaps of whole blocks, frames of one time, a source with a single frame."""
    r = random.Random(seed)
    config = CounterConfig(fps_window_us=10, fps_unit_us=7)
    rows = [(9, 55, 0)]
    for source in range(4):
        t = r.randint(-40, 40)
        for i in range(r.randint(20, 120)):
            rows.append((source, t, i))
            t += r.choice([0, 0, 1, 3, 9, 10, 11, r.randint(0, 90)])
    frames = spark.createDataFrame(rows, "source_id int, t long, frame_seq long")
    want = []
    for source in {x[0] for x in rows}:
        want += [(source, *x) for x in metrics.RateFold(config).feed(np.sort(np.array([x[1] for x in rows if x[0] == source])))]
    for block in (10, 16, 35, 10_000):
        assert sorted(map(tuple, metrics.fps_windows(frames, config, block_us=block).collect())) == sorted(want), block
    assert metrics.fps_windows(frames.limit(0), config).count() == 0


def test_rate_windows_hold_no_whole_source(spark):
    """Frames are exchanged by source and block, never by source alone."""
    rows = [(0, t * SECOND, t) for t in range(0, 40_000, 7)]
    frames = spark.createDataFrame(rows, "source_id int, t long, frame_seq long")
    plan = metrics.fps_windows(frames, CounterConfig())._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning(source_id" in line]
    assert exchanged
    assert all(", block" in line or ", a#" in line or ", entry" in line for line in exchanged), exchanged


def test_jpeg_cut_anywhere(spark):
    stream = b"junk\xff" + b"\xff\xd8one\xff\xd9" + b"\xff\xd8\xff\xd9" + b"x" + b"\xff\xd8two\xff\xff\xd9" + b"\xff\xd8open"
    want = [b"\xff\xd8one\xff\xd9", b"\xff\xd8\xff\xd9", b"\xff\xd8two\xff\xff\xd9"]
    for size in (1, 2, 3, 7, 1000):
        cutter = jpeg.FrameCutter()
        assert [f for i in range(0, len(stream), size) for f in cutter.feed(stream[i : i + size])] == want
    rows = [(s, i, stream[i : i + 3]) for s in (1, 2) for i in range(0, len(stream), 3)] + [(3, 0, None)]
    got = jpeg.jpeg_frames(spark.createDataFrame(rows, "stream long, seq long, chunk binary"))
    assert [bytes(r.jpeg) for r in got.where("stream = 2").orderBy("seq").collect()] == want
    assert jpeg.snapshot(got.where("stream = 3")).first().available is False


@pytest.mark.parametrize("seed", range(40))
def test_pieces_of_chunks_make_the_same_frames(seed):
    """Any cutting of a byte stream, entered chunk by chunk, gives the frames of the whole."""
    r = random.Random(seed)
    stream = b"".join(r.choice([b"\xff", b"\xd8", b"\xd9", b"\xff\xd8", b"\xff\xd9", b"x"]) for _ in range(r.randint(1, 60)))
    want = jpeg.FrameCutter().feed(stream)
    cuts = sorted({0, len(stream), *(r.randint(0, len(stream)) for _ in range(r.randint(0, 20)))})
    state, number, held, frames = jpeg.OUTSIDE, 0, b"", []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        chunk = stream[lo:hi]
        for start, end, opens, closes in jpeg.walk(chunk, state):
            held = (b"\xff" if start < 0 else b"") if opens else held
            held += chunk[max(start, 0) : end]
            if closes:
                frames.append(held)
        state, closed = jpeg.passage(chunk, state)
        number += closed
    assert frames == want and number == len(want)


def test_one_hot_stream_is_cut_by_many_tasks(spark, monkeypatch):
    r, kept = random.Random(1), {}
    stream = b"".join(b"\xff\xd8" + bytes([r.randint(0, 9)]) * r.choice([0, 3, 900]) + b"\xff\xd9" + b"junk" * r.randint(0, 2) for _ in range(80))
    rows = [(5, i, stream[i : i + 7]) for i in range(0, len(stream), 7)]
    original = jpeg.written
    monkeypatch.setattr(jpeg, "written", lambda df, name: kept.setdefault(name, original(df, name)))
    got = jpeg.jpeg_frames(spark.createDataFrame(rows, "stream long, seq long, chunk binary"), partitions=9)
    assert [(x.seq, bytes(x.jpeg)) for x in got.orderBy("seq").collect()] == list(enumerate(jpeg.FrameCutter().feed(stream)))
    sizes = [x["count"] for x in kept["jpeg-ranges"].groupBy("part").count().collect()]
    assert len(sizes) > 6 and max(sizes) < len(rows) / 4
    assert kept["jpeg-pieces"].where("not (opens and closes)").count() > 6  # frames that reach over an edge


def test_overlap(spark):
    boxes = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 10.0, 10.0), (0, 0, 2, 5.0, 0.0, 10.0, 10.0), (0, 1, 3, 0.0, 0.0, 10.0, 10.0)], "frame int, class_id int, obj_seq int, left double, top double, width double, height double")
    got = {(r.target, r.detection): round(r.iou, 4) for r in assoc.pairs_in_frame(boxes, boxes, ["frame"]).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.3333, (2, 1): 0.3333, (2, 2): 1.0, (3, 3): 1.0}
    best = assoc.mutual_best(assoc.pairs_in_frame(boxes, boxes, ["frame"]), ["frame"]).collect()
    assert {(r.target, r.detection) for r in best} == {(1, 1), (2, 2), (3, 3)}


def test_greedy_goes_on_to_its_end(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 1, 0.7), (0, 2, 2, 0.1), (0, 3, 3, 0.5), (0, 3, 4, 0.5), (1, 1, 1, 0.2)], "frame int, target long, detection long, score double")
    got = {(r.frame, r.target, r.detection) for r in assoc.greedy(pairs, ["frame"]).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 1)}


def test_estimates_against_the_full_filter(spark):
    """The separated filter equals the textbook one with all six states in one matrix."""
    import numpy as np

    from gatewise.operators import motion

    r, c = np.random.default_rng(1), motion.MotionConfig()
    frames = np.cumsum(r.integers(1, 4, 30))
    boxes = r.normal(size=(30, 4)) * 20 + [300, 200, 40, 90]
    rows = [(1, k, int(f), *map(float, b)) for k in (5, 6) for f, b in zip(frames, boxes + k, strict=True)]
    rows += [(1, None, 3, 1.0, 1.0, 1.0, 1.0), (1, 7, 3, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source_id int, track_id long, frame long, left double, top double, width double, height double")
    got = motion.estimate(df).orderBy("track_id", "frame").collect()
    assert len(got) == 60
    move = np.eye(6)
    move[0, 4] = move[1, 5] = 1
    noise, see = np.diag([c.location] * 2 + [c.size] * 2 + [c.velocity] * 2), np.eye(4, 6)
    for k in (5, 6):
        state, cov, last = None, None, None
        for f, (left, top, w, h), x in zip(frames, boxes + k, [x for x in got if x.track_id == k], strict=True):
            z = np.array([left + w / 2, top + h / 2, w, h])
            if state is None:
                state, cov = np.append(z, [0, 0]), np.diag([c.measurement] * 4 + [c.velocity] * 2)
            else:
                for _ in range(f - last):
                    state, cov = move @ state, move @ cov @ move.T + noise
                gain = cov @ see.T @ np.linalg.inv(see @ cov @ see.T + c.measurement * np.eye(4))
                state, cov = state + gain @ (z - see @ state), (np.eye(6) - gain @ see) @ cov
            last = f
            assert np.allclose([x.x, x.y, x.width, x.height, x.vx, x.vy], state)
    ahead = motion.project(motion.estimate(df)).where("track_id = 5").orderBy("frame").collect()
    end = [x for x in got if x.track_id == 5][-1]
    assert [a.frame for a in ahead] == list(range(end.frame + 1, end.frame + 34))
    assert np.isclose(ahead[9].x, end.x + 10 * end.vx)
    assert motion.project(motion.estimate(df.where("frame < 10"))).count() == 0


def test_parsers_of_detector_output(spark):
    import numpy as np

    from gatewise.sources import detections

    rows = [(1, 0, [0.0, 0.0, 4.0, 2.0, 0.9, 0.0, 1.0, 1.0, 2.0, 2.0, 0.4, 0.0, 1.0, 1.0, 2.0, 2.0, 0.9, 5.0]), (2, 0, None), (3, 0, []), (4, 0, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "t long, source_id int, output array<float>")
    assert [(r.t, r.obj_seq, r.left, r.width, r.height) for r in detections.parse(df).collect()] == [(1, 0, 0.0, 4.0, 2.0)]
    own = lambda output: np.array([[0, 1, *output[:4]]]) if len(output) else np.zeros((0, 6))
    assert [(r.t, r.width) for r in detections.parse(df, own).collect()] == [(1, 4.0)]


def test_settings_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("cameras:\n  - id: a\n    name: x\n    nvr: 1\n    channel: 2\n    subtype: 0\n")
    (tmp_path / "l.txt").write_text("person\nbicycle\n")
    (tmp_path / "e").write_text("# c\n\tA = '1'\t\nB=2=3\n")
    (tmp_path / "d.txt").write_text("[property]\nbatch-size = 5\nfilter-out-class-ids = 1;2\n[class-attrs-all]\npre-cluster-threshold = 0.3\ntopk = 7\n")
    (tmp_path / "t.yml").write_text("%YAML:1.0\nA:\n  x: 1    # one\n")
    at = lambda n: str(tmp_path / n)
    assert [tuple(r) for r in settings.read_cameras(spark, at("c.yaml")).collect()] == [(0, "a", "x", 1, 2, 0)]
    assert settings.read_cameras(spark, at("none")).count() == 0 == settings.read_env(spark, at("none")).count()
    assert [tuple(r) for r in settings.read_labels(spark, at("l.txt")).collect()] == [(0, "person"), (1, "bicycle")]
    assert sorted(map(tuple, settings.read_env(spark, at("e")).collect())) == [("A", "1"), ("B", "2=3")]
    assert settings.read_detector(spark, at("d.txt")) == settings.DetectorSettings(0.3, 7, (1, 2), 5)
    assert [tuple(r) for r in settings.read_tracker(spark, at("t.yml")).collect()] == [("A", "x", "1")]


def test_repeated_frames(spark):
    frames = spark.createDataFrame([(1, 0, b"a"), (1, 250, b"b"), (1, 260, b"c"), (2, 90, b"d")], "stream long, t long, jpeg binary")
    got = jpeg.repeated(frames, 100, 400).collect()
    assert sorted((r.stream, r.tick, bytes(r.jpeg)) for r in got) == [(1, 0, b"a"), (1, 100, b"a"), (1, 200, b"a"), (1, 300, b"c"), (2, 100, b"d"), (2, 200, b"d"), (2, 300, b"d")]


def test_control_tables(spark, tmp_path):
    import json

    from gatewise.sources import control_tables as c

    path = str(tmp_path / "lines")
    assert [r.line1 for r in c.read_lines(spark, path).collect()] == [None]
    raw = '{"line1":[[0.1,0.4],[0.9,0.5]],"line2":[[0.0,0.6],[1.0,0.7]]}'
    c.append_lines(spark, path, raw, 10)
    c.append_lines(spark, path, "broken", 20)
    rows = {r.valid_from: json.loads(r.json) for r in c.lines_json(c.read_lines(spark, path)).collect()}
    assert rows[10] == {"width": 1280, "height": 720, **json.loads(raw)}
    assert rows[20] == {"width": 1280, "height": 720, "line1": None, "line2": None}
    seen = control.with_lines(spark.createDataFrame([(5,), (15,), (25,)], "t long"), c.read_lines(spark, path))
    assert [r.t for r in seen.collect()] == [15]
    resets = str(tmp_path / "resets")
    assert c.read_resets(spark, resets).count() == 0
    c.append_reset(spark, resets, 7)
    assert [r.t for r in c.read_resets(spark, resets).collect()] == [7]


@pytest.mark.parametrize("seed", range(3))
def test_lifecycle_equals_fold(spark, seed):
    import random

    from gatewise.operators.lifecycle import LifecycleConfig, with_targets

    r = random.Random(seed)
    config = LifecycleConfig(probation=4, early_termination=1, shadow=6)
    frames = {k: sorted({f for _ in range(r.randint(1, 60)) for f in [r.randint(0, 160)]}) for k in range(8)}
    want = []
    for k, own in frames.items():
        target, start, last, active = 0, None, None, False
        for f in own:
            missed = None if last is None else f - last - 1
            if missed is None or missed > (config.shadow if active else config.early_termination):
                target, start, active = target + 1, f, False
            active = active or f - start + 1 >= config.probation
            want.append((0, k, f, target, active))
            last = f
    rows = spark.createDataFrame([(0, k, f) for k, own in frames.items() for f in own], "source_id int, track_id long, frame long")
    got = with_targets(rows, config).select("source_id", "track_id", "frame", "target", "active").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_files_of_batches_as_stream_and_table(spark, tmp_path):
    import json

    from gatewise.config import Line
    from gatewise.operators.transitions import crossing_events
    from gatewise.sources import streams
    from gatewise.streaming.counter import crossing_stream, state_store

    box = lambda y: {"left": 0.5, "top": y, "width": 0.0, "height": 0.0}
    inside = tmp_path / "in"
    inside.mkdir()
    ys, last = [0.3, 0.5, 0.7, 0.5, 0.3], None
    for i, y in enumerate([*ys, None]):
        t = (i + 1 if y is not None else 10_000) * SECOND  # the first watermark, time 0, drops what is not later
        objects = [{"class_id": 0, "object_id": 7, "rect": box(y)}, {"class_id": 0, "object_id": 2**64 - 1, "rect": box(y)}] if y is not None else [{"class_id": 0, "object_id": 9, "rect": box(0.1)}]
        batch = {"t": t, "prev_tick": last, "frames": [{"source_id": 0, "objects": objects}, {"source_id": 1, "objects": []}]}
        (inside / f"{i}.json").write_text(json.dumps(batch))
        os.utime(inside / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
        last = t
    lines, config = (Line(0, 0.4, 1, 0.4), Line(0, 0.6, 1, 0.6)), CounterConfig(width=1.0, height=1.0)
    table = streams.batch_table(spark, str(inside))
    assert streams.frames(table).count() == 12
    want = sorted(map(tuple, crossing_events(streams.observations(table), *lines, config).collect()))
    assert [w[-1] for w in want] == ["entry", "exit"]
    live = crossing_stream(streams.observations(streams.batch_stream(spark, str(inside), 2)), *lines, config)
    with state_store(spark):
        run = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect())) == want


def test_state_file(spark, tmp_path):
    import json

    from gatewise.streaming.counter import read_state, write_state

    path = str(tmp_path / "state.json")
    held = lambda: json.loads((tmp_path / "state.json").read_text())
    rows = spark.createDataFrame([(1, "entry"), (2, "entry"), (3, "exit")], "t long, kind string")
    rates = spark.createDataFrame([(0, 1.25), (3, 2.5), (4, None)], "source_id int, fps double")
    write_state(rows, 0, path)
    write_state(rows, 0, path)  # a replayed batch changes nothing
    write_state(rows, 1, path, rates=rates, updated_at=7.5)
    assert held() == {"entries": 4, "exits": 2, "footfall": 2, "fps": 3.75, "fps_by_source": {"0": 1.25, "3": 2.5}, "updated_at": 7.5, "epoch": 1, "reset_at": None}
    resets = spark.createDataFrame([(2,)], "t long")
    write_state(rows, 2, path, resets)
    assert {k: held()[k] for k in ("entries", "exits", "footfall", "fps", "reset_at")} == {"entries": 0, "exits": 1, "footfall": 0, "fps": 3.75, "reset_at": 2}
    write_state(rows, 3, path, resets)
    assert held()["exits"] == 2
    (tmp_path / ".state.json.crc").unlink(missing_ok=True)
    (tmp_path / "state.json").write_text("{broken")
    assert read_state(spark, path)["entries"] == 0
    assert read_state(spark, str(tmp_path / "none.json"))["fps_by_source"] == {}


def test_live_counting_with_a_restart(spark, tmp_path):
    """Lines change, nobody is seen for a while, a reset comes in: counted as the reference scenario has it."""
    import json

    from gatewise.config import Line
    from gatewise.sources import control_tables as c
    from gatewise.sources import streams
    from gatewise.streaming import live
    from gatewise.streaming.counter import read_state

    inside, root, state = tmp_path / "in", str(tmp_path / "live"), str(tmp_path / "state.json")
    inside.mkdir()
    config = CounterConfig(width=1.0, height=1.0)
    raw = lambda a, b: json.dumps({"line1": [[0, a], [1, a]], "line2": [[0, b], [1, b]]})
    c.append_lines(spark, str(tmp_path / "lines"), raw(0.4, 0.6), 0)
    c.append_lines(spark, str(tmp_path / "lines"), raw(0.1, 0.2), 500 * SECOND)

    def put(n, t, *people):
        objects = [{"class_id": 0, "object_id": k, "rect": {"left": 0.5, "top": y, "width": 0.0, "height": 0.0}} for k, y in people]
        (inside / f"{n:03d}.json").write_text(json.dumps({"t": round(t * SECOND), "frames": [{"source_id": 0, "objects": objects}]}))

    def run():
        spark_versions = lambda: c.read_lines(spark, str(tmp_path / "lines"))
        live.start_ticker(streams.batch_stream(spark, str(inside)), root, spark_versions, config, availableNow=True).awaitTermination()
        query = live.start_counter(spark, root, state, lambda: c.read_resets(spark, str(tmp_path / "resets")), config, counted="off", availableNow=True)
        query.awaitTermination()
        return query

    for n, (t, y) in enumerate([(1, 0.3), (2, 0.5), (3, 0.7), (4, 0.5)]):
        put(n, t, (7, y), (8, 0.3))
    put(10, 5, (8, 0.5))
    run()
    put(11, 6, (7, 0.3))  # 7 goes out again, after the restart
    put(12, 140)  # nobody: 8 is forgotten
    put(13, 200, (8, 0.7))
    put(14, 501, (9, 0.05))
    put(15, 502, (9, 0.15))
    put(16, 503, (9, 0.3))  # in over the new lines
    put(17, 5000)
    run()
    got = read_state(spark, state)
    assert (got["entries"], got["exits"], got["footfall"]) == (2, 1, 1)
    assert got["updated_at"] == 5000
    assert got["fps_by_source"] == {"0": round(1 / (5000 - 503), 2)}
    c.append_reset(spark, str(tmp_path / "resets"), 400 * SECOND)
    put(18, 6000)
    run()
    assert read_state(spark, state)["entries"] == 0  # what was counted before the reset was seen is gone
    assert Line(*spark.read.schema(live.SEEN).option("recursiveFileLookup", "true").parquet(f"{root}/observations").where("track_id = 9").first().line1).y1 == 0.1


def test_what_live_queries_list_does_not_grow(spark, tmp_path, monkeypatch):
    """Many micro-batches, some rows late: carried folders stay few, and late and used rows are all rows."""
    import json

    from gatewise.config import Line
    from gatewise.sources import streams
    from gatewise.streaming import live
    from gatewise.streaming.counter import read_state

    monkeypatch.setattr(live, "KEPT", 3)
    inside, root, state = tmp_path / "in", str(tmp_path / "live"), str(tmp_path / "state.json")
    inside.mkdir()
    config = CounterConfig(width=1.0, height=1.0)
    lines = spark.createDataFrame([(0, (0.0, 0.4, 1.0, 0.4), (0.0, 0.6, 1.0, 0.6))], LINE_VERSIONS)
    number = iter(range(1000))

    def put(t, *people):
        objects = [{"class_id": 0, "object_id": k, "rect": {"left": 0.5, "top": y, "width": 0.0, "height": 0.0}} for k, y in people]
        (inside / f"{next(number):03d}.json").write_text(json.dumps({"t": round(t * SECOND), "frames": [{"source_id": 0, "objects": objects}]}))

    def run():
        live.start_ticker(streams.batch_stream(spark, str(inside), 1), root, lambda: lines, config, availableNow=True).awaitTermination()
        live.start_counter(spark, root, state, lambda: spark.createDataFrame([], "t long"), config, availableNow=True).awaitTermination()

    rows = 0
    for k in range(4):
        for i in range(3):
            put(10 * k + 1 + i, (k, 0.3 + 0.2 * i), (100, 0.1))
            rows += 2
        run()
    put(5, (0, 0.5), (200, 0.3))  # 26 s behind by now
    put(6, (200, 0.5))
    put(5000)
    rows += 3
    run()
    assert live.late_rows(spark, root) == 3
    assert sorted((r.track_id, r.t // SECOND) for r in live.happened(spark, root).where("kind = 'late'").collect()) == [(0, 5), (200, 5), (200, 6)]
    assert read_state(spark, state)["entries"] == 4
    listed = {name: len(list((tmp_path / "live" / name).iterdir())) for name in ("clock", "rates", "observations")}
    assert max(listed.values()) <= 7, listed
    assert not list((tmp_path / "live" / "unfinished").iterdir())
    assert Line(*lines.first().line1).y1 == 0.4


def test_an_epoch_is_written_once(spark, tmp_path):
    from gatewise.streaming import live

    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        live._once(spark.range(3), str(tmp_path), "rates", 4)
        live._once(spark.range(9), str(tmp_path), "rates", 4)
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert live._carried(spark, str(tmp_path), "rates", 5, "id long").count() == 3
    assert live.latest(spark, str(tmp_path), "rates", "id long").count() == 3
    with pytest.raises(FileNotFoundError):
        live._carried(spark, str(tmp_path), "rates", 4, "id long")


def test_tracks_of_a_checkpoint(spark, tmp_path):
    """The state as a table equals the fold over the table of observations, at the watermark the query had reached."""
    from gatewise.streaming.counter import checkpointed_tracks, crossing_stream, state_store, tracks_from_events

    rows = ev.ticked(spark, DATA)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("t"))
    with state_store(spark):
        query = crossing_stream(stream, ev.LINE1, ev.LINE2, ev.CONFIG).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = rows.where("class_id = 0 and track_id is not null").agg(F.max("t")).first()[0]
    upto = last // 1000 * 1000
    got = sorted(map(tuple, checkpointed_tracks(spark, str(tmp_path / "state")).collect()))
    want = tracks_from_events(rows, ev.LINE1, ev.LINE2, ev.CONFIG, upto)
    assert got and got == sorted(map(tuple, want.select("source_id", "track_id", "x", "y", "line", "at", "seen").collect()))


ANCHORS = {"sf0.001": (5, 6, 0), "sf0.01": (63, 53, 10), "sf0.1": (813, 693, 120)}


@pytest.mark.parametrize("sf", ANCHORS)
def test_anchors(spark, sf):
    assert tuple(plans.entries_exits_footfall(spark, f"/root/testdata/{sf}").first()) == ANCHORS[sf]


def test_stream_equals_batch(spark):
    from gatewise.streaming.replay import replay_events

    ticked = ev.ticked(spark, DATA)
    want = sorted(map(tuple, plans._events(spark, DATA).collect()))
    assert sorted(map(tuple, replay_events(ticked, ev.LINE1, ev.LINE2, ev.CONFIG, files=3).collect())) == want


def test_every_query_has_the_columns_of_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "embeddings", "customer", "supplier"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    slow = {"stream_counts", "live_counts", "live_source_counts"}
    sql = plans.oracle_sql()
    for name, make in plans.queries().items():
        if name in sql and name not in slow:
            df = make(spark, DATA)
            cursor = con.execute(sql[name])
            names = [c[0] for c in cursor.description]
            assert sorted(df.columns) == sorted(names), name
            order = sorted(names)
            mine = sorted(repr([r[c] for c in order]) for r in df.collect())
            theirs = sorted(repr([dict(zip(names, r, strict=True))[c] for c in order]) for r in cursor.fetchall())
            assert mine == theirs, name


def test_registry_imports_from_anywhere():
    import __spark_entry__ as e

    assert "entries_exits_footfall" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert os.path.basename(e.__file__) == "__spark_entry__.py"
