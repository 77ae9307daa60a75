"""Matching in stages, the tracker as a fold and as a stateful query."""

import random
import sys
from itertools import permutations

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gatewise.operators import assoc
from gatewise.operators.lifecycle import LifecycleConfig
from gatewise.operators.motion import Estimator, MotionConfig
from gatewise.operators.tracker import CascadeTracker, Detection, TrackerConfig, track_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOX = "source_id int, frame long, obj_seq long, class_id int, left double, top double, width double, height double"


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


def best_sum(pairs):
    """The largest sum of scores over all matchings, by trying them."""
    ts, ds = sorted({t for t, _, _ in pairs}), sorted({d for _, d, _ in pairs})
    score = {(t, d): s for t, d, s in pairs}
    small, large = (ts, ds) if len(ts) <= len(ds) else (ds, ts)
    get = lambda a, b: score.get((a, b) if small is ts else (b, a), 0.0)
    return max(sum(max(0.0, get(a, b)) for a, b in zip(small, p, strict=True)) for p in permutations(large, len(small)))


@pytest.mark.parametrize("seed", range(40))
def test_optimal_matching(seed):
    r = random.Random(seed)
    pairs = [(t, d, r.choice([0.25, 0.5, r.random()])) for t in range(r.randint(1, 6)) for d in range(10, 10 + r.randint(1, 6)) if r.random() < 0.7]
    if not pairs:
        return
    keep = assoc.optimal_mask(*(np.array(x) for x in zip(*pairs, strict=True)))
    kept = [p for p, k in zip(pairs, keep, strict=True) if k]
    assert len({t for t, _, _ in kept}) == len(kept) == len({d for _, d, _ in kept})
    assert sum(s for _, _, s in kept) == pytest.approx(best_sum(pairs))


def boxes(r, n, frame=0, **more):
    return [(r.randint(0, 1), frame, i, r.choice([0, 0, 0, 1]), r.uniform(-20, 400), r.uniform(-20, 300), r.choice([0.0, 10.0, r.uniform(5, 200)]), r.uniform(1, 150)) for i in range(n)]


@pytest.mark.parametrize("cell", [37.0, 160.0, 5000.0])
def test_cells_lose_and_repeat_no_pair(spark, cell):
    r = random.Random(1)
    a, b = boxes(r, 60), boxes(r, 60)
    want = sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and x[3] == y[3] and overlap(x[4:], y[4:]) > 0)
    got = assoc.overlapping(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["source_id", "frame"], [], cell)
    assert sorted((x.target, x.detection) for x in got.collect()) == want


def test_cells_look_at_fewer_pairs(spark):
    """In a dense frame boxes meet those of their cells, not all of the frame."""
    r = random.Random(2)
    a = spark.createDataFrame([(0, 0, i, 0, r.uniform(0, 1200), r.uniform(0, 640), 30.0, 60.0) for i in range(300)], BOX)
    plan = lambda cell: assoc.overlapping(a, a, ["source_id", "frame"], [], cell)

    def met(cell):
        joined = []
        original = F.floor
        spread = lambda df: df.withColumn("_cx", F.explode(F.sequence(original(F.col("left") / cell), original((F.col("left") + F.col("width")) / cell)))).withColumn("_cy", F.explode(F.sequence(original(F.col("top") / cell), original((F.col("top") + F.col("height")) / cell))))
        joined.append(spread(a).select("_cx", "_cy").join(spread(a).select("_cx", "_cy"), ["_cx", "_cy"]).count())
        return joined[0]

    assert sorted(map(tuple, plan(160.0).collect())) == sorted(map(tuple, plan(1e6).collect()))
    assert met(160.0) < 300 * 300 / 5


def plain_stages(targets, detections, least):
    """The three stages of one frame, pair by pair: (target, detection, stage)."""
    out = []

    def stage(number, ts, ds, score):
        pairs = sorted(((-s, t, d) for t, *a in ts for d, *b in ds if (s := score(a, b)) is not None))
        for _, t, d in pairs:
            if t not in {x for x, _, _ in out if x is not None} and d not in {x for _, x, _ in out}:
                out.append((t, d, number))

    def whole(a, b):
        iou, size = overlap(a[:4], b[:4]), min(a[2] * a[3], b[2] * b[3]) / max(a[2] * a[3], b[2] * b[3])
        s = assoc.WEIGHT_SIZE * size + assoc.WEIGHT_IOU * iou
        return s if iou >= assoc.MIN_IOU and size >= assoc.MIN_SIZE and s >= assoc.MIN_SCORE else None

    by = lambda low: lambda a, b: x if (x := overlap(a[:4], b[:4])) >= low else None
    stage(1, [t for t in targets if t[5] != "tentative"], [d for d in detections if d[5] >= least], whole)
    taken = {t for t, _, _ in out}
    stage(2, [t for t in targets if t[5] == "active" and t[0] not in taken], [d for d in detections if d[5] < least], by(assoc.MIN_TENTATIVE_IOU))
    stage(3, [t for t in targets if t[5] == "tentative"], [d for d in detections if d[5] >= least], by(assoc.MIN_IOU))
    return sorted(out)


@pytest.mark.parametrize("match", [assoc.greedy, assoc.optimal])
def test_cascade(spark, match):
    r = random.Random(3)
    targets = [(0, f, i, 0, r.uniform(0, 200), r.uniform(0, 200), r.uniform(40, 90), r.uniform(40, 90), r.choice(["active", "shadow", "tentative"])) for f in range(6) for i in range(9)]
    found = [(0, f, i, 0, r.uniform(0, 200), r.uniform(0, 200), r.uniform(40, 90), r.uniform(40, 90), r.random()) for f in range(6) for i in range(12)]
    got = assoc.cascade(spark.createDataFrame(targets, BOX + ", status string"), spark.createDataFrame(found, BOX + ", confidence double"), ["source_id", "frame"], 0.4, match=match).collect()
    assert {x.stage for x in got} == {1, 2, 3}
    for f in range(6):
        mine = sorted((x.target, x.detection, x.stage) for x in got if x.frame == f)
        if match is assoc.greedy:
            assert mine == plain_stages([(t[2], *t[4:9]) for t in targets if t[1] == f], [(d[2], *d[4:9]) for d in found if d[1] == f], 0.4)
        assert len({t for t, _, _ in mine}) == len(mine) == len({d for _, d, _ in mine})


# ---- the tracker


def plain_tracks(rows, c):
    """Ids by a fold written out: rows (frame, obj_seq, class_id, confidence, left, top, width, height) of one source."""
    targets, number, out = {}, 1, {}
    for frame in sorted({x[0] for x in rows}):
        for k in list(targets):
            t = targets[k]
            missing = frame - (t["sure"] if t["active"] else t["seen"]) - 1
            if missing > (c.life.shadow if t["active"] else c.life.early_termination):
                del targets[k]
        own = sorted(x[1:] for x in rows if x[0] == frame)
        heard = [x for x in own if x[2] >= c.least_confidence]
        status = {k: "tentative" if not t["active"] else "active" if t["well"] and frame - t["seen"] <= 1 else "shadow" for k, t in targets.items()}
        found = []
        for cls in {x[1] for x in heard}:
            ts = [(k, *t["motion"].ahead(frame), status[k]) for k, t in targets.items() if t["class"] == cls]
            found += plain_stages(ts, [(x[0], *x[3:], x[2]) for x in heard if x[1] == cls], c.tentative_confidence)
        got = {d: k for k, d, _ in found}
        for obj, cls, confidence, left, top, width, height in own:
            if obj not in got:
                continue
            t = targets[got[obj]]
            t["motion"].feed(frame, left + width / 2, top + height / 2, width, height)
            t["seen"], t["well"] = frame, confidence >= c.shadow_confidence
            t["sure"] = frame if t["well"] else t["sure"]
            t["active"] = t["active"] or frame - t["born"] + 1 >= c.life.probation
            out[frame, obj] = (got[obj], "tentative" if not t["active"] else "active" if t["well"] else "shadow")
        seen = [t["motion"].ahead(frame) for t in targets.values()]
        for obj, cls, confidence, *box in own:
            if (frame, obj) in out:
                continue
            if confidence < max(c.least_confidence, c.tentative_confidence):
                out[frame, obj] = (None, "ignored")
            elif len(targets) >= c.max_targets or any(overlap(b, box) > c.new_target_overlap for b in seen):
                out[frame, obj] = (None, "suppressed")
            else:
                one = Estimator(c.motion)
                one.feed(frame, box[0] + box[2] / 2, box[1] + box[3] / 2, box[2], box[3])
                targets[number] = {"class": cls, "born": frame, "seen": frame, "sure": frame, "active": c.life.probation <= 1, "well": True, "motion": one}
                out[frame, obj] = (number, "tentative")
                seen.append(box)
                number += 1
    return sorted((f, o, *x) for (f, o), x in out.items())


def walkers(seed, frames=40, people=6):
    """Boxes of people who walk, vanish for a while, and are not always seen well."""
    r = random.Random(seed)
    rows = []
    for p in range(people):
        x, y, dx, dy, first = r.uniform(0, 800), r.uniform(0, 400), r.uniform(-8, 8), r.uniform(-5, 5), r.randint(0, 12)
        gap = range(g := r.randint(10, 30), g + r.randint(0, 12))
        for f in range(first, frames):
            if f not in gap and r.random() < 0.9:
                rows.append((f, p, r.choice([0, 0, 0, 1]) if p == 0 else 0, r.choice([0.1, 0.15, 0.3, 0.9, 0.9]), x + dx * f + r.uniform(-3, 3), y + dy * f + r.uniform(-3, 3), 60.0, 120.0))
    rows += [(f, 100 + k, 0, r.random(), r.uniform(0, 900), r.uniform(0, 500), 60.0, 120.0) for f in range(frames) for k in range(r.randint(0, 2))]
    return rows


CONFIG = TrackerConfig(least_confidence=0.12, tentative_confidence=0.25, shadow_confidence=0.35, max_targets=9, life=LifecycleConfig(probation=4, early_termination=2, shadow=8), motion=MotionConfig())


@pytest.mark.parametrize("seed", range(8))
def test_tracker_equals_plain_fold(seed):
    rows = walkers(seed)
    one, got = CascadeTracker(CONFIG), []
    for f in sorted({x[0] for x in rows}):
        got += [(f, *x) for x in one.step(f, [Detection(*x[1:]) for x in rows if x[0] == f])]
        again = CascadeTracker(CONFIG)  # what is kept between frames is enough to go on
        again.load(*one.dump())
        one = again
    want = plain_tracks(rows, CONFIG)
    assert sorted(got) == want
    if seed == 0:
        assert {x[3] for x in want} == {"active", "tentative", "shadow", "ignored", "suppressed"}


def test_features_keep_people_apart():
    """Two people swap places between frames; their looks tell who is who."""
    look = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    one = CascadeTracker(TrackerConfig(life=LifecycleConfig(probation=1)))
    first = list(one.step(0, [Detection(0, 0, 0.9, 0.0, 0.0, 50.0, 100.0, look["a"]), Detection(1, 0, 0.9, 60.0, 0.0, 50.0, 100.0, look["b"])]))
    then = list(one.step(1, [Detection(0, 0, 0.9, 40.0, 0.0, 50.0, 100.0, look["a"]), Detection(1, 0, 0.9, 20.0, 0.0, 50.0, 100.0, look["b"])]))
    assert [x[1] for x in then] == [x[1] for x in first]


def table(spark, sources):
    rows = [(1_000_000 * x[0], s, *x) for s, own in sources.items() for x in own]
    return spark.createDataFrame(rows, "t long, source_id int, frame long, obj_seq long, class_id int, confidence double, left double, top double, width double, height double")


def test_track_table(spark):
    sources = {s: walkers(10 + s, 25) for s in range(3)}
    got = track_table(table(spark, sources), lambda: CascadeTracker(CONFIG)).collect()
    for s, rows in sources.items():
        assert sorted((x.frame, x.obj_seq, x.track_id, x.status) for x in got if x.source_id == s) == plain_tracks(rows, CONFIG)
    assert track_table(table(spark, {0: [(1, 0, 0, 0.9, None, 0.0, 1.0, 1.0)]})).count() == 0


class Counting:
    """A tracker of its own: every detection is a new target, the newest stays."""

    STATE = "frame long"

    def load(self, targets, next_id):
        self.targets, self.next_id = dict(targets), next_id

    def dump(self):
        return self.targets, self.next_id

    def step(self, frame, detections):
        for d in detections:
            self.targets = {self.next_id: (frame,)}
            yield d.obj_seq, self.next_id, "counted"
            self.next_id += 1


def test_tracked_stream_with_a_restart(spark, tmp_path):
    from gatewise.streaming.counter import state_store
    from gatewise.streaming.tracking import checkpointed_targets, tracked_stream

    sources = {s: walkers(20 + s, 30, 4) for s in range(2)}
    whole = table(spark, sources)
    inside = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(whole.schema).parquet(inside).withColumn("at", F.timestamp_micros("t"))

    def run(name, make):
        with state_store(spark):
            query = tracked_stream(stream(), make).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        query.awaitTermination()

    beat = spark.createDataFrame([(10**12, -1, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)], whole.schema)
    for part in (whole.where("frame < 12"), whole.where("frame >= 12"), beat, whole.where("frame = 3 and obj_seq = 1 and source_id = 0")):
        part.coalesce(1).write.mode("append").parquet(inside)
        run("out", lambda: CascadeTracker(CONFIG))
    got = spark.read.parquet(str(tmp_path / "out")).where("source_id >= 0").collect()
    late = [x for x in got if x.status == "late"]
    assert [(x.source_id, x.frame, x.obj_seq, x.track_id) for x in late] == [(0, 3, 1, None)] * whole.where("frame = 3 and obj_seq = 1 and source_id = 0").count()
    for s, rows in sources.items():
        assert sorted((x.frame, x.obj_seq, x.track_id, x.status) for x in got if x.source_id == s and x.status != "late") == plain_tracks(rows, CONFIG)
    held = checkpointed_targets(spark, str(tmp_path / "c-out")).where("source_id >= 0").collect()
    assert held
    assert all(x.id <= max(y.track_id or 0 for y in got if y.source_id == x.source_id) for x in held)
    run("plain", Counting)
    assert spark.read.parquet(str(tmp_path / "plain")).where("source_id = 0").agg(F.max("track_id")).first()[0] == len(sources[0]) + len(late)


def test_stream_and_table_give_the_same_ids(spark):
    from gatewise.plans import queries

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.queries()["online_tracks"](spark, sf).collect()))
    assert got and got == sorted(map(tuple, queries.queries()["tracked_detections"](spark, sf).collect()))
