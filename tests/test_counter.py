"""Scripted scenarios, and the window plan against a fold over the same rows."""

import random

import pytest

from gatewise.config import OBSERVATION, SECOND, CounterConfig, Line
from gatewise.operators.ingest import with_prev_tick
from gatewise.operators.metrics import totals
from gatewise.operators.transitions import crossing_events
from gatewise.streaming.counter import TrackFold

L1, L2 = Line(0, 0.4, 1, 0.4), Line(0, 0.6, 1, 0.6)
W = H = 1.0
CONFIG = CounterConfig(width=1.0, height=1.0)


def row(t, y, track=1, source=0, cls=0, x=0.5, frame=0, obj=0):
    """A box without extent at the wanted foot point."""
    return (round(t * SECOND), frame, obj, source, cls, track, float(x), float(y), 0.0, 0.0)


def script(*steps, **more):
    return [row(t, y, frame=i, **more) for i, (t, y) in enumerate(steps)]


S01 = [(0, 0.3), (1, 0.5), (2, 0.7)]
S02 = [(0, 0.7), (1, 0.5), (2, 0.3)]
EXPIRED = [(0, 0.3), (1, 0.5), (31.001, 0.7)]
DOT = Line(0.5, 0.4, 0.5, 0.4)
SHORT = (Line(0.1, 0.4, 0.2, 0.4), Line(0.1, 0.6, 0.2, 0.6))

SCENARIOS = {
    "entry": (script(*S01), (L1, L2), (1, 0, 1)),
    "exit, occupancy never negative": (script(*S02), (L1, L2), (0, 1, 0)),
    "both lines in one step": (script((0, 0.3), (1, 0.7)), (L1, L2), (0, 0, 0)),
    "back over line 2 counts as entry": (script((0, 0.3), (1, 0.7), (2, 0.5)), (L1, L2), (1, 0, 1)),
    "window is inclusive": (script((0, 0.3), (1, 0.5), (31, 0.7)), (L1, L2), (1, 0, 1)),
    "too late": (script(*EXPIRED), (L1, L2), (0, 0, 0)),
    "too late arms again": (script(*EXPIRED, (32, 0.5), (33, 0.3)), (L1, L2), (0, 1, 0)),
    "the same line again restarts the clock": (script((0, 0.3), (1, 0.5), (20, 0.3), (40, 0.5), (60, 0.7)), (L1, L2), (1, 0, 1)),
    "a match uses the crossing up": (script(*S01, (3, 0.5), (4, 0.3), (5, 0.5), (6, 0.7)), (L1, L2), (2, 1, 1)),
    "in and out": (script(*S01, (3, 0.5), (4, 0.3)), (L1, L2), (1, 1, 0)),
    "gap without tick, window over": (script((0, 0.3), (1, 0.5), (200, 0.7)), (L1, L2), (0, 0, 0)),
    "another track's tick prunes": ([row(0, 0.3), row(130, 0.5, track=2), row(131, 0.7), row(132, 0.5)], (L1, L2), (0, 0, 0)),
    "gap without tick keeps the track": (script((0, 0.3), (131, 0.5), (132, 0.7)), (L1, L2), (1, 0, 1)),
    "gap with tick forgets it": ([row(0, 0.3), row(130.5, 0.9, track=9), row(131, 0.5), row(132, 0.7)], (L1, L2), (0, 0, 0)),
    "untracked": (script(*S01, track=None), (L1, L2), (0, 0, 0)),
    "another class": (script(*S01, cls=2), (L1, L2), (0, 0, 0)),
    "resting on a line": (script((0, 0.3), (1, 0.4), (10, 0.4), (40, 0.5), (60, 0.7)), (L1, L2), (1, 0, 1)),
    "a point as line 1 hides line 2": (script(*S01, (3, 0.5)), (DOT, L2), (0, 0, 0)),
    "lines are infinite": (script(*S01, x=0.95), SHORT, (1, 0, 1)),
    "the source is part of the key": (script(*S01) + script(*S02, source=1), (L1, L2), (1, 1, 0)),
    "order inside a tick": ([row(0, y, obj=i) for i, y in enumerate((0.3, 0.5, 0.7))], (L1, L2), (1, 0, 1)),
    "first seen past the lines": (script((0, 0.7), (1, 0.8)), (L1, L2), (0, 0, 0)),
}


def count(spark, rows, lines):
    observations = with_prev_tick(spark.createDataFrame(rows, OBSERVATION))
    return tuple(totals(crossing_events(observations, *lines, CONFIG)).first())


def test_scenarios(spark):
    """All scenarios as one table: each gets its own sources and a far-away stretch of time."""
    got = {name: count(spark, rows, lines) for name, (rows, lines, _) in SCENARIOS.items()}
    assert got == {name: want for name, (_, _, want) in SCENARIOS.items()}


def folded(rows, lines, config):
    """Events of all tracks by the sequential fold."""
    fold, tracks, out = TrackFold(*lines, config), {}, []
    ticks = sorted({r[0] for r in rows})
    for r in sorted(rows, key=lambda r: r[:3]):
        if r[4] != 0 or r[5] is None:
            continue
        before = [t for t in ticks if t < r[0]]
        key = (r[3], r[5])
        tracks[key], kind = fold.step(tracks.get(key), r[0], before[-1] if before else None, (r[6], r[7]))
        if kind:
            out.append((r[0], r[1], r[2], *key, kind))
    return sorted(out)


def trial(seed):
    r = random.Random(seed)
    pick = lambda i: row(r.randint(0, 40), r.choice([0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9]), track=r.choice([1, 2, None]), source=r.randint(0, 1), cls=r.choice([0, 0, 0, 1]), frame=i)
    rows = [pick(i) for i in range(r.randint(1, 60))]
    return rows, CounterConfig(width=1.0, height=1.0, window_us=r.choice([3, 9, 30]) * SECOND, ttl_us=r.choice([2, 5, 20]) * SECOND)


@pytest.mark.parametrize("seed", range(12))
def test_windows_equal_fold(spark, seed):
    rows, config = trial(seed)
    table = spark.createDataFrame(rows, OBSERVATION)
    events = crossing_events(with_prev_tick(table, bucket_us=7 * SECOND), L1, L2, config)
    assert sorted(map(tuple, events.collect())) == folded(rows, (L1, L2), config)
    assert sorted(map(tuple, crossing_events(table, L1, L2, config, ticks=table).collect())) == folded(rows, (L1, L2), config)


def test_empty_frames_forget_a_track(spark):
    """A frame without objects ticks like any other: the track of 0 s is gone at 131 s, so nothing links."""
    rows = spark.createDataFrame(script((0, 0.3), (131, 0.5), (132, 0.7)), OBSERVATION)
    frames = spark.createDataFrame([(round(t * SECOND),) for t in (0, 121, 131, 132)], "t long")
    assert tuple(totals(crossing_events(with_prev_tick(rows, frames), L1, L2, CONFIG)).first()) == (0, 0, 0)
    assert tuple(totals(crossing_events(rows, L1, L2, CONFIG, ticks=frames)).first()) == (0, 0, 0)
    early = frames.where(f"t <> {121 * SECOND}").union(spark.createDataFrame([(120 * SECOND,)], "t long"))
    assert tuple(totals(crossing_events(with_prev_tick(rows, early), L1, L2, CONFIG)).first()) == (1, 0, 1)
    assert tuple(totals(crossing_events(rows, L1, L2, CONFIG, ticks=early)).first()) == (1, 0, 1)


def test_no_window_orders_the_observations_by_time(spark):
    ticked = with_prev_tick(spark.createDataFrame(script(*S01), OBSERVATION))
    plan = ticked._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.split("\n") if "Window [" in line]
    assert below
    assert all("left" not in line and "track_id" not in line for line in below)


def test_first_sighting_on_a_line(spark):
    assert count(spark, script((0, 0.4), (1, 0.7)), (L1, L2)) == (0, 0, 0)
    assert count(spark, script((0, 0.6), (1, 0.3)), (L1, L2)) == (0, 0, 0)


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    empty = with_prev_tick(spark.createDataFrame([], OBSERVATION))
    assert tuple(totals(crossing_events(empty, L1, L2, CONFIG)).first()) == (0, 0, 0)
    odd = spark.createDataFrame(script(*S01), OBSERVATION).withColumns({"px": F.lit("x"), "z": F.lit("y"), "fresh": F.lit(None)})
    assert tuple(totals(crossing_events(with_prev_tick(odd), L1, L2, CONFIG)).first()) == (1, 0, 1)


def test_one_exchange_after_the_ticks(spark):
    """From ticked observations to events everything shares one partitioning."""
    ticked = with_prev_tick(spark.createDataFrame(script(*S01), OBSERVATION))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = crossing_events(ticked, L1, L2, CONFIG)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(source_id") == 1


def test_observations_are_never_exchanged_by_time(spark):
    """Whole rows go by (source, track); by time go the ticks and the rows after a gap, without their boxes."""
    rows = spark.createDataFrame(script(*S01), OBSERVATION)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(keep, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        plan = crossing_events(rows, L1, L2, CONFIG, rows.select("t"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert exchanges
    assert all("hashpartitioning(source_id" in x or "hashpartitioning(t#" in x or "hashpartitioning(_bucket" in x for x in exchanges)
