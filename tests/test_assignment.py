"""The matching with the largest sum, against one row after another, and where its frames are worked out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewise.operators import assignment, assoc, matching

BOX = "source_id int, frame long, obj_seq long, class_id int, left double, top double, width double, height double"


def one_by_one(gain):
    """The largest sum of a full table of gains, rows placed one after another along shortest paths."""
    n, m = gain.shape
    cost = np.hstack([-gain, np.zeros((n, n))])  # the last columns stand for staying alone
    u, v, owner = np.zeros(n + 1), np.zeros(m + n + 1), np.zeros(m + n + 1, int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, before, used = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, int), np.zeros(m + n + 1, bool)
        while owner[at]:
            used[at] = True
            reach = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~used[1:] & (reach < least[1:])
            least[1:][better], before[1:][better] = reach[better], at
            to = int(np.where(used[1:], np.inf, least[1:]).argmin()) + 1
            far = least[to]
            u[owner[used]] += far
            v[used] -= far
            least[~used] -= far
            at = to
        while at:
            owner[at], at = owner[before[at]], before[at]
    return sum(-cost[owner[c] - 1, c - 1] for c in range(1, m + n + 1) if owner[c])


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("few, step", [(0, 1 << 22), (3, 7), (16, 1 << 22)])
def test_sum_is_the_largest(monkeypatch, seed, few, step):
    """Ties, gains that hardly differ, large ones and pairs that are not listed; bids together, in turns and in small steps."""
    monkeypatch.setattr(assignment, "FEW", few)
    monkeypatch.setattr(assignment, "STEP", step)
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 40, 2)
    gain = [r.random((n, m)), r.choice([0.25, 0.5, 1.0], (n, m)), 0.3 + 1e-9 * r.random((n, m)), 1e6 * np.outer(r.random(n), r.random(m))][seed % 4] * (r.random((n, m)) < r.random())
    t, d = np.nonzero(gain)
    places = assignment.largest(t, d, gain[t, d], n, m)
    assert len(set(t[places])) == len(places) == len(set(d[places]))
    assert gain[t[places], d[places]].sum() == pytest.approx(one_by_one(gain), rel=1e-11)


def crowd(r, shift):
    """Copies of a few boxes that differ a little in size, so that many boxes want the same ones."""
    places = [(r.uniform(0, 400), r.uniform(0, 300)) for _ in range(20)]
    rows = [(0, x, y, 40.0 + (i + shift) % 41, 80.0 + (i + shift) % 41) for i in range(50) for x, y in places]
    return matching.Boxes(np.array(rows), np.arange(len(rows)))


def test_a_dense_frame_leaves_few_exchanges(monkeypatch):
    """The auctions place nearly every box; before, hundreds were left and each looked through the frame for a path."""
    rings = []
    before = assignment.Matching._rings
    monkeypatch.setattr(assignment.Matching, "_rings", staticmethod(lambda x: rings.append(before(x)) or rings[-1]))
    r = random.Random(3)
    a, b = crowd(r, 0), crowd(r, 7)
    i, j = matching.optimal(a, b, assoc.WHOLE)
    got = matching.measures(a, i, b, j, assoc.WHOLE)[2].sum()
    turned = sum(map(len, rings))
    k, c = np.divmod(np.arange(len(a) * len(b)), len(b))
    score, counts = matching.measures(a, k, b, c, assoc.WHOLE)[2:]
    table = np.where(counts, score, 0.0).reshape(len(a), len(b))
    assert len(i) > 500 and turned < len(a) / 20 and 0 < len(rings) < 200
    # Nothing is gained by exchanging two held pairs, or one for a free one.
    partner = np.full(len(a), -1)
    partner[i] = j
    free = np.setdiff1d(np.arange(len(b)), j)
    assert (table[i][:, free] <= table[i, j][:, None] + 1e-9).all()
    swapped = table[i][:, j] + table[i][:, j].T
    assert (swapped <= table[i, j][:, None] + table[i, j] + 1e-9).all()
    few = slice(0, 200)
    small = np.where(table[few, few] > 0, table[few, few], 0.0)
    t, d = np.nonzero(small)
    kept = assignment.largest(t, d, small[t, d], 200, 200)
    assert small[t[kept], d[kept]].sum() == pytest.approx(one_by_one(small))
    assert got > 0


def test_frames_are_not_gathered_in_fewer_tasks(spark):
    """Their few bytes say nothing of the work in them."""
    r = random.Random(4)
    rows = [(s, f, i, 0, r.uniform(0, 200), r.uniform(0, 200), 50.0, 90.0) for s in range(3) for f in range(12) for i in range(5)]
    boxes = spark.createDataFrame(rows, BOX)
    found = assoc.optimal_in_frame(boxes, boxes, ["source_id", "frame"]).select(F.spark_partition_id().alias("task"), "target", "detection").collect()
    assert len(found) == len(rows) and len({x.task for x in found}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
