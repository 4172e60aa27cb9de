"""Routes of many edges at once: the ways that a batch may take as arrays, the best of each edge by array operations.

Coordinates are doubles, boxes (x, y, width, height), sides indices into ``SIDES``. Memory is bounded by ``ROUTED``
edges at a time, whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values.
SAME_POINT = 0.5
LEAST_LEAD, MOST_LEAD = 18.0, 72.0
GUTTER = 28.0
SIDES = ("left", "right", "top", "bottom")
OUTWARD = np.array([(-1, 0), (1, 0), (0, -1), (0, 1)])

#: Edges whose ways are laid out at a time.
ROUTED = 1024


@dataclass(frozen=True)
class Lines:
    """Polylines one after another: the points of all, and how many each has."""

    points: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, lines) -> Lines:
        points = [p for line in lines for p in line]
        return cls(np.array(points, dtype=float).reshape(-1, 2), np.array([len(line) for line in lines], dtype=np.int64))

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def padded(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of ``rows`` that have points, and these as one array; shorter lines repeat their last point.

        Lines of a part differ in length by less than a factor of two.
        """
        rows = rows[self.sizes[rows] > 0]
        widths = np.ceil(np.log2(self.sizes[rows])).astype(np.int64)
        for width in np.unique(widths).tolist():
            of_width = rows[widths == width]
            step = max(1, ROUTED * 64 >> width)
            for at in range(0, len(of_width), step):
                part = of_width[at : at + step]
                inside = np.minimum(np.arange(1 << width), self.sizes[part][:, None] - 1)
                yield part, self.points[self.starts[part][:, None] + inside]

    def tolist(self) -> list[list[tuple[float, float]]]:
        return [[tuple(p) for p in line.tolist()] for line in np.split(self.points, np.cumsum(self.sizes)[:-1])]


#: Of some rows: which, their points as an array, how many points of each count.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def assembled(n: int, parts: list[Part]) -> Lines:
    """``n`` lines; rows of no part have no points."""
    sizes = np.zeros(n, dtype=np.int64)
    for rows, _, size in parts:
        sizes[rows] = size
    lines = Lines(np.empty((int(sizes.sum()), 2)), sizes)
    starts = lines.starts
    for rows, points, size in parts:
        place = np.arange(points.shape[1])
        counts = place < size[:, None]
        lines.points[(starts[rows][:, None] + place)[counts]] = points[counts]
    return lines


def _cleaned(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, width, 2) polylines without repeated points and without points in the middle of a straight run, and their sizes."""
    out = np.full(points.shape, -np.inf)
    size = np.zeros(len(points), dtype=np.int64)
    every = np.arange(len(points))
    for at in range(points.shape[1]):
        p = points[:, at]
        fresh = (size == 0) | (np.abs(p - out[every, size - 1]) > SAME_POINT).any(axis=1)
        rows = np.flatnonzero(fresh & (size > 1))
        while len(rows):
            last, before = out[rows, size[rows] - 1], out[rows, size[rows] - 2]
            middle = ((np.abs(before - last) <= SAME_POINT) & (np.abs(last - p[rows]) <= SAME_POINT)).any(axis=1)
            rows = rows[middle]
            size[rows] -= 1
            rows = rows[size[rows] > 1]
        rows = np.flatnonzero(fresh)
        out[rows, size[rows]] = p[rows]
        size[rows] += 1
    out[np.arange(points.shape[1]) >= size[:, None]] = -np.inf
    return out, size


def simplified(lines: Lines) -> Lines:
    """Polylines without repeated points and without points in the middle of a straight run."""
    parts = [(rows, *_cleaned(points)) for rows, points in lines.padded(np.arange(len(lines.sizes)))]
    return assembled(len(lines.sizes), parts)


def on_side(box: np.ndarray, side: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Points on sides of boxes, ``offset`` along them as far as the box goes."""
    upright = OUTWARD[side, 0] != 0
    offset = np.minimum(np.maximum(offset, 0.0), np.where(upright, box[:, 3], box[:, 2]))
    x = np.where(upright, box[:, 0] + np.where(side == SIDES.index("right"), box[:, 2], 0.0), box[:, 0] + offset)
    y = np.where(upright, box[:, 1] + offset, box[:, 1] + np.where(side == SIDES.index("bottom"), box[:, 3], 0.0))
    return np.stack([x, y], axis=1)


def _leaves(step: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether a step goes straight out of a side."""
    out = OUTWARD[side]
    along = (step * out).sum(axis=1)
    aside = np.where(out[:, 0] != 0, step[:, 1], step[:, 0])
    return (along > 0) & (np.abs(aside) <= SAME_POINT)


def respects(points: np.ndarray, size: np.ndarray, source_side: np.ndarray, target_side: np.ndarray) -> np.ndarray:
    """Whether polylines leave and arrive through the given sides along the axes."""
    every, long = np.arange(len(points)), size >= 2
    last = np.maximum(size, 2)
    with np.errstate(invalid="ignore"):  # of lines of one point
        leaves = _leaves(points[:, 1] - points[:, 0], source_side)
        arrives = _leaves(points[every, last - 2] - points[every, last - 1], target_side)
    return long & leaves & arrives


@dataclass(frozen=True)
class Ends:
    """Of edges: boxes of both ends, and where the route is anchored."""

    source: np.ndarray
    target: np.ndarray
    source_side: np.ndarray
    target_side: np.ndarray
    source_offset: np.ndarray
    target_offset: np.ndarray

    def of(self, rows: np.ndarray) -> Ends:
        return Ends(*[getattr(self, name)[rows] for name in self.__dataclass_fields__])

    @property
    def points(self) -> tuple[np.ndarray, np.ndarray]:
        return on_side(self.source, self.source_side, self.source_offset), on_side(self.target, self.target_side, self.target_offset)


def _anchored(points: np.ndarray, sizes: np.ndarray, ends: Ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded ``points``, two at least, with their ends on the anchors, their sizes, and whether they may stay so.

    The first and last corner follow the ends.
    """
    start, end = ends.points
    points, place = points.copy(), np.arange(points.shape[1])
    bent = np.flatnonzero(sizes > 2)
    for corner, side, to in ((np.ones_like(sizes), ends.source_side, start), (sizes - 2, ends.target_side, end)):
        axis = np.where(OUTWARD[side, 0] != 0, 1, 0)
        points[bent, corner[bent], axis[bent]] = to[bent, axis[bent]]
    points[:, 0] = start
    points = np.where((place >= sizes[:, None] - 1)[:, :, None], end[:, None], points)
    clean, size = _cleaned(points)
    with np.errstate(invalid="ignore"):  # beyond the end
        straight = (np.abs(np.diff(clean, axis=1)) <= SAME_POINT).any(axis=2)
    straight |= place[1:] >= size[:, None]
    return clean, size, straight.all(axis=1) & respects(clean, size, ends.source_side, ends.target_side)


def _leads(hints: Lines, rows: np.ndarray, last: bool) -> np.ndarray:
    """How far a route steps out of its box: as far as the first (or last) run of the hint, within limits."""
    sizes, starts = hints.sizes[rows], hints.starts[rows]
    lead = np.full(len(rows), GUTTER)
    long = np.flatnonzero(sizes >= 2)
    at = starts[long] + (sizes[long] - 2 if last else 0)
    lead[long] = np.clip(np.abs(hints.points[at + 1] - hints.points[at]).sum(axis=1), LEAST_LEAD, MOST_LEAD)
    return lead


def _medians(hints: Lines) -> np.ndarray:
    """(n, 2): medians of the coordinates of the corners, NaN without corners."""
    row = np.repeat(np.arange(len(hints.sizes)), hints.sizes)
    place = np.arange(len(row)) - np.repeat(hints.starts, hints.sizes)
    inner = (place > 0) & (place < hints.sizes[row] - 1)
    row, corners = row[inner], hints.points[inner]
    counts = np.maximum(hints.sizes - 2, 0)
    have = np.flatnonzero(counts)
    first, counts = (np.cumsum(counts) - counts)[have], counts[have]
    medians = np.full((len(hints.sizes), 2), np.nan)
    for k in (0, 1):
        values = corners[np.lexsort((corners[:, k], row)), k]
        medians[have, k] = (values[first + (counts - 1) // 2] + values[first + counts // 2]) / 2
    return medians


def _ways(a: np.ndarray, b: np.ndarray, tracks: np.ndarray, turns: bool) -> tuple[np.ndarray, np.ndarray]:
    """(m, ways, corners, 2) corners between the two steps, and (ways, corners) which of them are not repeats.

    One corner, or two on a track; with ``turns`` also three on two tracks.
    """
    m, n = tracks.shape[0], tracks.shape[2]
    x, y = tracks[:, 0], tracks[:, 1]
    ax, ay, bx, by = (np.repeat(c[:, None], n, axis=1) for c in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))
    at = lambda *xy: np.stack(xy, axis=-1)
    corner = np.concatenate([at(bx, ay)[:, :1], at(ax, by)[:, :1]], axis=1)
    firsts, seconds = [corner, at(x, ay), at(ax, y)], [corner, at(x, by), at(bx, y)]
    ways = np.stack([np.concatenate(firsts, axis=1), np.concatenate(seconds, axis=1)], axis=2)
    real = np.ones(ways.shape[1:3], dtype=bool)
    real[:2, 1] = False
    if turns:
        ways, real = np.concatenate([ways, ways[:, :, -1:]], axis=2), np.pad(real, ((0, 0), (0, 1)))
        every_x, every_y = np.repeat(x, n, axis=1), np.tile(y, (1, n))
        wide = lambda c: np.repeat(c[:, :1], n * n, axis=1)
        meet = at(every_x, every_y)
        by_x = np.stack([at(every_x, wide(ay)), meet, at(wide(bx), every_y)], axis=2)
        by_y = np.stack([at(wide(ax), every_y), meet, at(every_x, wide(by))], axis=2)
        ways = np.concatenate([ways, by_x, by_y], axis=1)
        real = np.concatenate([real, np.ones((2 * n * n, 3), dtype=bool)])
    return ways, real


def _best(start: np.ndarray, a: np.ndarray, ways: np.ndarray, real: np.ndarray, b: np.ndarray, end: np.ndarray, ends: Ends) -> tuple:
    """The best way of each edge: its points, size, and whether it is free.

    In this order: it respects the sides, crosses the boxes least, is shortest with a little for each corner, has the smallest points.
    """
    m, n = ways.shape[:2]
    wide = lambda p: np.repeat(p[:, None, None], n, axis=1)
    points = np.concatenate([wide(start), wide(a), ways, wide(b), wide(end)], axis=2)
    steps = np.abs(np.diff(points, axis=2)).sum(axis=3)
    length = steps[..., 0]
    for at in range(1, steps.shape[2]):
        length = length + steps[..., at]
    # Runs between the steps; those to a repeated corner are none.
    low, high = np.minimum(points[:, :, 1:-2], points[:, :, 2:-1]), np.maximum(points[:, :, 1:-2], points[:, :, 2:-1])
    crossed = np.zeros((m, n), dtype=np.int64)
    for box in (ends.source, ends.target):
        near, far = box[:, None, None, :2], (box[:, :2] + box[:, 2:])[:, None, None]
        crosses = ((low < far) & (high > near)).all(axis=3)
        crosses[:, :, :-1] &= real
        crossed += crosses.sum(axis=2)
    clean, size = _cleaned(points.reshape(m * n, -1, 2))
    fits = respects(clean, size, np.repeat(ends.source_side, n), np.repeat(ends.target_side, n)).reshape(m, n)
    clean, size = clean.reshape(m, n, -1, 2), size.reshape(m, n)
    left = np.ones((m, n), dtype=bool)
    for key in (~fits, crossed, length + 4 * size, *clean.reshape(m, n, -1).transpose(2, 0, 1)):
        key = np.where(left, key, np.inf)
        left &= key == key.min(axis=1, keepdims=True)
        if (left.sum(axis=1) == 1).all():
            break
    every, best = np.arange(m), left.argmax(axis=1)
    return clean[every, best], size[every, best], fits[every, best] & (crossed[every, best] == 0)


def orthogonal(hints: Lines, ends: Ends, rows: np.ndarray) -> Iterator[Part]:
    """Routes of ``rows`` by horizontal and vertical runs that leave and arrive through the anchored sides.

    Both ends step out of their box; of the ways to join the two steps the best is taken. Tracks that are
    tried: through either step, half way, around both boxes, and at the median of the hint's corners. Edges for
    which no way with up to two corners is free also try those with one more.
    """
    medians = _medians(hints)
    for at in range(0, len(rows), ROUTED):
        part = rows[at : at + ROUTED]
        of = ends.of(part)
        start, end = of.points
        a = start + OUTWARD[of.source_side] * _leads(hints, part, last=False)[:, None]
        b = end + OUTWARD[of.target_side] * _leads(hints, part, last=True)[:, None]
        boxes = np.stack([of.source, of.target])
        low, high = boxes[:, :, :2].min(axis=0) - GUTTER, (boxes[:, :, :2] + boxes[:, :, 2:]).max(axis=0) + GUTTER
        middle = np.where(np.isnan(medians[part]), a, medians[part])
        outer = [np.minimum(low, np.minimum(a, b)), np.maximum(high, np.maximum(a, b))]
        tracks = np.stack([a, b, (a + b) / 2, *outer, middle], axis=2)
        points, size, free = _best(start, a, *_ways(a, b, tracks, turns=False), b, end, of)
        yield part[free], points[free], size[free]
        if not free.all():
            on = np.flatnonzero(~free)
            ways = _ways(a[on], b[on], tracks[on], turns=True)
            yield part[on], *_best(start[on], a[on], *ways, b[on], end[on], of.of(on))[:2]


def resolved(lines: Lines, old_source: np.ndarray, old_target: np.ndarray, ends: Ends, rows: np.ndarray, same: float = 1.0) -> Lines:
    """Routes of ``rows`` after their boxes moved: kept on their anchors, moved along if both moved alike, else routed anew.

    A route that is kept is routed anew too, if on its anchors it would not leave and arrive through their sides by straight runs.
    """
    by_source, by_target = (ends.source - old_source)[:, :2], (ends.target - old_target)[:, :2]
    still = (np.abs(np.concatenate([by_source, by_target], axis=1)) <= same).all(axis=1)
    alike = ~still & (np.abs(by_source - by_target) <= same).all(axis=1)
    parts: list[Part] = []
    anew = ~alike
    for part, points in lines.padded(rows[still[rows] & (lines.sizes[rows] >= 2)]):
        clean, size, stays = _anchored(points, lines.sizes[part], ends.of(part))
        parts.append((part[stays], clean[stays], size[stays]))
        anew[part[stays]] = False
    for part, points in lines.padded(rows[alike[rows]]):
        parts.append((part, points + by_source[part][:, None], lines.sizes[part]))
    parts += orthogonal(lines, ends, rows[anew[rows]])
    return assembled(len(lines.sizes), parts)
