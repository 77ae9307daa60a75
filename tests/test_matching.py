"""Matching inside frames against matching of listed pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import assoc, matching

BOX = "source_id int, frame long, obj_seq long, class_id int, left double, top double, width double, height double"
KEYS = ["source_id", "frame"]


def crowd(r, frames=3, n=60):
    """Boxes of all sizes, some without area, many equal ones, so that scores tie."""
    some = [(r.choice([0.0, 40.0, r.uniform(-50, 300)]), r.choice([0.0, r.uniform(-50, 200)]), r.choice([0.0, 30.0, 60.0, r.uniform(1, 900)]), r.choice([50.0, r.uniform(1, 90)])) for _ in range(25)]
    return [(0, f, 3 * i % 61, r.choice([0, 0, 1]), *r.choice(some)) for f in range(frames) for i in range(n)]


def found(df):
    return sorted((r.frame, r.class_id, r.target, r.detection, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("listed, direct", [(assoc.mutual_best, assoc.mutual_best_in_frame), (assoc.greedy, assoc.greedy_in_frame)])
def test_frames_match_as_listed_pairs_do(spark, listed, direct):
    r = random.Random(5)
    a, b = (spark.createDataFrame([*crowd(r), (0, 1, 99, 0, None, 1.0, 1.0, 1.0), (0, side + 7, 1, 0, 0.0, 0.0, 9.0, 9.0)], BOX) for side in range(2))
    want = found(listed(assoc.pairs_in_frame(a, b, KEYS), KEYS))
    assert len(want) > 20
    assert found(direct(a, b, KEYS)) == want


def test_equal_boxes_leave_together():
    """300 equal targets and 200 equal detections pair off by number without a round for each."""
    rows = np.array([[0.0, 1.0, 1.0, 50.0, 90.0]])
    a, b = (matching.Boxes(np.repeat(rows, n, axis=0), np.arange(n)[::-1]) for n in (300, 200))
    looks = []
    before = matching.Best.look
    matching.Best.look = lambda self, *args: looks.append(1) or before(self, *args)
    try:
        i, j = matching.greedy(a, b, assoc.WHOLE)
    finally:
        matching.Best.look = before
    assert list(zip(a.numbers[i], b.numbers[j], strict=True)) == [(k, k) for k in range(200)]
    assert len(looks) <= 4


def test_no_pair_of_mutual_bests_is_shuffled(spark):
    """The plan exchanges boxes; a window over pairs would exchange and sort every pair twice."""
    from gatewise.plans import queries as plans

    plan = plans.greedy_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_optimal_in_frames(spark):
    """Frames matched from boxes reach the same sum as their listed pairs do."""
    from gatewise.plans import queries as plans

    r = random.Random(6)
    a, b = (spark.createDataFrame(crowd(r, 2, 40), BOX) for _ in range(2))
    once = lambda df: df.dropDuplicates(["frame", "obj_seq"]).persist()
    a, b = once(a), once(b)
    sums = [sum(x.score for x in df.collect()) for df in (assoc.optimal(assoc.pairs_in_frame(a, b, KEYS), KEYS), assoc.optimal_in_frame(a, b, KEYS))]
    assert sums[0] > 5 and sums[1] == pytest.approx(sums[0])
    assert "Join" not in plans.optimal_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_the_greedy_matching_is_shuffled(spark):
    from gatewise.plans import queries as plans

    assert "Join" not in plans.greedy_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_no_pair_of_a_cascade_is_shuffled(spark):
    from gatewise.plans import queries as plans

    assert "Join" not in plans.cascade_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_equal_boxes_come_together(spark):
    """Rows with the same values stand side by side, so a table of all pairs packs them; nothing is lost or repeated."""
    r = random.Random(8)
    places = [(r.randrange(100, 150), r.randrange(100, 150), r.randrange(20, 60), r.randrange(20, 60)) for _ in range(12)]
    rows = [(0, 0, i, 0, *map(float, places[i % 12])) for i in range(240)]
    r.shuffle(rows)
    table = spark.createDataFrame([*rows, (0, 0, None, 0, 0.0, 0.0, 9.0, 9.0), (0, 0, 999, 0, 0.0, 0.0, None, 9.0)], BOX).repartition(3)
    got = [x for x in assoc.pairs_in_frame(table, table, KEYS).collect() if x.target is not None]
    assert len({(x.target, x.detection) for x in got}) == len(got) and not {999} & {x.target for x in got}
    kinds = {(x.target % 12, x.detection % 12) for x in got}
    assert len(got) == 400 * len(kinds) and len(kinds) > 40
    runs = sum((x.target, x.detection % 12) != (y.target, y.detection % 12) for x, y in zip(got, got[1:], strict=False))
    assert runs < len(got) / 15


@pytest.mark.parametrize("feature", [None, "feature"])
def test_a_crowded_cell_is_dealt_to_many_tasks(spark, monkeypatch, feature):
    """Boxes of one cell meet in blocks: no task has all of them, and no pair is lost or repeated."""
    monkeypatch.setattr(assoc, "BLOCK", 20, raising=False)
    r = random.Random(9)
    rows = [(0, f, i, c, float(r.randrange(20)), float(r.randrange(20)), 60.0, 80.0) for f, c, n in ((0, 0, 150), (1, 0, 5), (2, 0, 150), (2, 1, 1)) for i in range(n)]
    boxes = spark.createDataFrame(rows, BOX).withColumn("feature", F.array(F.col("left") + 30, F.col("top") + 30))
    a, b = boxes, boxes.where("frame < 2 or obj_seq < 3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = assoc.pairs_in_frame(a, b, KEYS, feature).select("frame", "class_id", "target", "detection", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = [(x.frame, x.class_id, x.target, x.detection) for x in got]
    want = [(0, 0, i, j) for i in range(150) for j in range(150)] + [(1, 0, i, j) for i in range(5) for j in range(5)] + [(2, 0, i, j) for i in range(150) for j in range(3)] + [(2, 1, 0, 0)]
    assert sorted(pairs) == sorted(want)
    tasks = [x.task for x in got if x.frame == 0]
    assert len(set(tasks)) > 2 and max(map(tasks.count, set(tasks))) < 0.7 * len(tasks)
