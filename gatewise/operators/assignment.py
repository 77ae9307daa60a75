"""The matching of listed pairs with the largest sum: an auction whose bids are worked out together, then an exact end.

Every target and every detection may stay alone, which costs nothing. Memory grows with the
pairs, not with targets times detections, and each step looks at the pairs of many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

#: By how much a bid raises a price at least, as a part of the largest gain, from auction to auction.
RAISES = (0.1, 0.02, 0.004, 0.001, 0.0002)
#: What is less than this part of the largest gain is rounding.
ROUNDING = 1e-12
#: Most pairs that are looked at in one step, unless one row has more.
STEP = 1 << 22
#: So few bidders take turns, which is faster than to work their bids out together.
FEW = 16


class Side:
    """Rows or columns: the pairs of each, whom it holds, for which gain, and what it has of that."""

    def __init__(self, own: np.ndarray, other: np.ndarray, gain: np.ndarray, n: int):
        self.bounds, self.other, self.gain = np.r_[0, np.cumsum(np.bincount(own, minlength=n))], other.astype(np.int32), gain
        self.mate, self.held, self.value = np.full(n, -1), np.zeros(n), np.zeros(n)

    def __len__(self) -> int:
        return len(self.mate)


def spans(bounds: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(some of ``which``, the places from their bound to the next one, where those of each start, how many they are), in steps."""
    count = bounds[which + 1] - bounds[which]
    ends = np.cumsum(count)
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(STEP, ends[-1], STEP))).tolist(), len(which)] if len(which) and ends[-1] > STEP else [0, len(which)]
    for first, last in zip(cuts, cuts[1:], strict=False):
        if first < last:
            part, some = which[first:last], count[first:last]
            starts = ends[first:last] - some
            starts = starts - starts[0]
            yield part, np.arange(starts[-1] + some[-1]) + np.repeat(bounds[part] - starts, some), starts, some


def best_two(value: np.ndarray, starts: np.ndarray, count: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, its place, second best) of each run of values; of equal ones each of ``who`` takes another."""
    best = np.maximum.reduceat(value, starts)
    at = np.flatnonzero(value == np.repeat(best, count))
    if len(at) > len(best):
        run = np.searchsorted(starts, at, "right") - 1
        equal = np.bincount(run, minlength=len(starts))
        at = at[np.cumsum(equal) - equal + who % equal]
    value[at] = -np.inf
    return best, at, np.maximum.reduceat(value, starts)


def highest(what: np.ndarray, bid: np.ndarray) -> np.ndarray:
    """Places of the highest bid for each thing, the first of equal ones."""
    order = np.lexsort((-bid, what))
    things = what[order]
    first = np.ones(len(things), bool)
    first[1:] = things[1:] != things[:-1]
    return order[first]


def offers(mine: Side, theirs: Side, raised: float) -> None:
    """Whoever of ``mine`` is alone and has a value takes the best of ``theirs``, for more than that one has now.

    All bid at once and the highest bid counts, until few are left.
    """
    bidders = np.flatnonzero((mine.mate < 0) & (mine.value > 0))
    while len(bidders) > FEW:
        found = []
        for part, places, starts, count in spans(mine.bounds, bidders):
            best, at, second = best_two(mine.gain[places] - theirs.value[mine.other[places]], starts, count, part)
            found.append((best, places[at], second))
        best, places, second = (np.concatenate(f) for f in zip(*found, strict=True)) if len(found) > 1 else found[0]
        more = best > raised
        mine.value[bidders[~more]] = 0.0
        bidders, places, left = bidders[more], places[more], np.maximum(second[more] - raised, 0.0)
        wanted, gain = mine.other[places], mine.gain[places]
        won = highest(wanted, gain - left)
        who, whom, gain, left = bidders[won], wanted[won], gain[won], left[won]
        out = theirs.mate[whom]
        out = out[out >= 0]
        mine.mate[out] = -1
        mine.mate[who], mine.held[who], mine.value[who] = whom, gain, left
        theirs.mate[whom], theirs.held[whom], theirs.value[whom] = who, gain, gain - left
        lost = np.ones(len(bidders), bool)
        lost[won] = False
        bidders = np.concatenate((bidders[lost], out))
        bidders = bidders[mine.value[bidders] > 0]
    waiting = bidders.tolist()
    while waiting:
        who = waiting.pop()
        start, end = mine.bounds[who], mine.bounds[who + 1]
        others = mine.other[start:end]
        worth = mine.gain[start:end] - theirs.value[others]
        k = worth.argmax()
        if worth[k] <= raised:
            mine.value[who] = 0.0
            continue
        worth[k] = -np.inf
        whom, gain, left = others[k], mine.gain[start + k], max(worth.max() - raised, 0.0)
        out = int(theirs.mate[whom])
        if out >= 0:
            mine.mate[out] = -1
            if mine.value[out] > 0:
                waiting.append(out)
        mine.mate[who], mine.held[who], mine.value[who] = whom, gain, left
        theirs.mate[whom], theirs.held[whom], theirs.value[whom] = who, gain, gain - left


class Matching:
    """Pairs (row, column, gain) in order of rows, and which of them are held."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, gain: np.ndarray, n: int, m: int):
        by_column = np.argsort(columns, kind="stable")
        self.rows, self.columns = Side(rows, columns, gain, n), Side(columns, rows[by_column], gain[by_column], m)

    def auction(self, raised: float) -> None:
        """First rows bid for columns, then columns that kept a price but no row offer themselves to rows.

        Afterwards no pair is better by more than ``raised`` than what its row and column have together.
        """
        rows, columns = self.rows, self.columns
        some = np.flatnonzero(np.diff(rows.bounds))
        rows.value[some] = np.maximum(np.maximum.reduceat(rows.gain - columns.value[rows.other], rows.bounds[some]), 0.0)
        held = np.flatnonzero(rows.mate >= 0)
        has = rows.held[held] - columns.value[rows.mate[held]]
        loose = has < rows.value[held] - raised
        rows.value[held[~loose]] = has[~loose]
        columns.mate[rows.mate[held[loose]]] = -1
        rows.mate[held[loose]] = -1
        offers(rows, columns, raised)
        offers(columns, rows, raised)

    def pairs(self) -> np.ndarray:
        """The place of the pair that each row holds, or -1."""
        rows, found = self.rows, np.full(len(self.rows), -1)
        for part, places, starts, _ in spans(rows.bounds, np.flatnonzero(rows.mate >= 0)):
            run = np.zeros(len(places), np.int64)
            run[starts[1:]] = 1
            found[part] = places[rows.other[places] == rows.mate[part][np.cumsum(run)]]
        return found

    def improve(self, rounding: float) -> np.ndarray:
        """Change the matching until no exchange, along a path or in a ring, makes the sum larger; the pairs that rows hold then.

        Prices rise to what the rows would pay to have a column instead of theirs. Where a column's
        price rises by way of itself, the rows on the way change places, and that pays. No column at all is the last place.
        """
        x, none = self.rows, len(self.columns)
        pair, owner, price = self.pairs(), self.columns.mate.copy(), np.r_[self.columns.value, 0.0]
        at = np.where(pair >= 0, x.other[pair], none)
        by, before, active = np.full(none + 1, -1), np.arange(none + 1), np.ones(none + 1, bool)
        while active.any():
            places = np.flatnonzero(active[:none])
            free, rows = places[owner[places] < 0], owner[places]
            rows = np.concatenate((rows[rows >= 0], np.flatnonzero(pair < 0) if active[none] else rows[:0]))
            less = price[at] - np.where(pair >= 0, x.gain[pair], 0.0)  # what a row has, below zero
            found = []  # (column, its price, the pair and the place it comes from)
            for part, pairs, starts, count in spans(x.bounds, rows):
                value = x.gain[pairs] + np.repeat(less[part], count)
                up = np.flatnonzero(value > price[x.other[pairs]] + rounding)
                who = part[np.searchsorted(starts, up, "right") - 1]  # of runs that start together the last one is not empty
                found.append((x.other[pairs[up]], value[up], pairs[up], at[who]))
            rows = rows[(pair[rows] >= 0) & (less[rows] > price[none] + rounding)]
            free = free[price[free] > price[none] + rounding]
            low = np.flatnonzero(price[:none] < price[none] - rounding) if active[none] else places[:0]
            for to, value, source in ((none, less[rows], at[rows]), (none, price[free], free), (low, price[none], none)):
                found.append([y + np.zeros(np.broadcast(to, source).shape, z) for y, z in ((to, int), (value, float), (-1, int), (source, int))])
            to, value, pairs, source = (np.concatenate(f) for f in zip(*found, strict=True))
            active[:] = False
            top = highest(to, value)
            to = to[top]
            price[to], by[to], before[to], active[to] = value[top], pairs[top], source[top], True
            rings = self._rings(before)
            for ring in rings:
                sources, new = before[ring], by[ring]
                movers, new = owner[sources[sources < none]], new[new >= 0]
                movers = movers[movers >= 0]
                active[ring] = True
                if x.gain[new].sum() <= x.gain[pair[movers]].sum():
                    rounding *= 2  # what looked like a gain was rounding
                    continue
                rows = np.searchsorted(x.bounds, new, "right") - 1
                pair[movers], at[movers], owner[[y for y in ring if y < none]] = -1, none, -1
                pair[rows], at[rows], owner[x.other[new]] = new, x.other[new], rows
            if rings:
                active[none] = True
                by[:], before = -1, np.arange(none + 1)
        return pair

    @staticmethod
    def _rings(before: np.ndarray) -> list[list[int]]:
        """Places that come before themselves, ring by ring."""
        far = before
        for _ in range(len(before).bit_length()):
            far = far[far]
        rings, seen = [], set()
        for place in np.unique(far[before[far] != far]).tolist():
            ring = []
            while place not in seen:
                seen.add(place)
                ring.append(place)
                place = int(before[place])
            if ring:
                rings.append(ring)
        return rings


def largest(rows: np.ndarray, columns: np.ndarray, gain: np.ndarray, n: int, m: int) -> np.ndarray:
    """Places of the pairs, listed in order of rows, that belong to the matching with the largest sum of gains."""
    positive = np.flatnonzero(gain > 0)
    if not len(positive):
        return positive
    if len(positive) < len(gain):
        rows, columns, gain = rows[positive], columns[positive], gain[positive]
    found, most = Matching(rows, columns, gain, n, m), float(gain.max())
    for raised in RAISES:
        found.auction(raised * most)
    pair = found.improve(ROUNDING * most)
    return positive[pair[pair >= 0]]


def _ship() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
