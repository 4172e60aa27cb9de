"""Brute force of the routes: one edge at a time, all ways listed. Points are (x, y), boxes (x, y, width, height)."""

from __future__ import annotations

import numpy as np
from loomgraph.operators import routing
from loomgraph.operators.routing import GUTTER, LEAST_LEAD, MOST_LEAD, SAME_POINT

OUTWARD = {"left": (-1, 0), "right": (1, 0), "top": (0, -1), "bottom": (0, 1)}


def simplified(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Polyline without repeated points and without points in the middle of a straight run."""
    out: list[tuple[float, float]] = []
    for p in points:
        if out and all(abs(a - b) <= SAME_POINT for a, b in zip(p, out[-1], strict=True)):
            continue
        while len(out) > 1 and any(abs(out[-2][k] - out[-1][k]) <= SAME_POINT and abs(out[-1][k] - p[k]) <= SAME_POINT for k in (0, 1)):
            out.pop()
        out.append(p)
    return out


def _on_side(box, side: str, offset: float) -> tuple[float, float]:
    x, y, w, h = box
    if side in ("left", "right"):
        return (x + (w if side == "right" else 0.0), y + min(max(offset, 0.0), h))
    return (x + min(max(offset, 0.0), w), y + (h if side == "bottom" else 0.0))


def _respects(points, source_side: str, target_side: str) -> bool:
    """Whether a polyline leaves and arrives through the given sides along the axes."""
    if len(points) < 2:
        return False

    def out_of(a, b, side):
        (dx, dy), (ox, oy) = (b[0] - a[0], b[1] - a[1]), OUTWARD[side]
        along, aside = (dx * ox, dy) if ox else (dy * oy, dx)
        return along > 0 and abs(aside) <= SAME_POINT

    return out_of(points[0], points[1], source_side) and out_of(points[-1], points[-2], target_side)


def _lead(points) -> float:
    if len(points) < 2:
        return GUTTER
    (ax, ay), (bx, by) = points[0], points[1]
    return min(max(abs(bx - ax) + abs(by - ay), LEAST_LEAD), MOST_LEAD)


def orthogonal(source, target, source_anchor, target_anchor, hint=()) -> list[tuple[float, float]]:
    """A route of horizontal and vertical runs that leaves and arrives through the anchored sides.

    Both ends step out of their box; of the ways to join the two steps the shortest is taken that
    crosses neither box, counting corners as a little length. Tracks that are tried: through either
    step, half way, at the median of the hint's corners, and around both boxes.
    """
    start, end = _on_side(source, *source_anchor), _on_side(target, *target_anchor)
    lead_a, lead_b = _lead(hint), _lead(hint[::-1])
    (ax, ay), (bx, by) = OUTWARD[source_anchor[0]], OUTWARD[target_anchor[0]]
    a, b = (start[0] + ax * lead_a, start[1] + ay * lead_a), (end[0] + bx * lead_b, end[1] + by * lead_b)
    boxes = (source, target)
    tracks = []
    for k, size in ((0, 2), (1, 3)):
        low = min(x[k] for x in boxes) - GUTTER
        high = max(x[k] + x[size] for x in boxes) + GUTTER
        inner = sorted(p[k] for p in hint[1:-1])
        middle = [(inner[(len(inner) - 1) // 2] + inner[len(inner) // 2]) / 2] if inner else []
        tracks.append({a[k], b[k], (a[k] + b[k]) / 2, min(low, a[k], b[k]), max(high, a[k], b[k]), *middle})
    def cost(way) -> tuple:
        points = [start, a, *way, b, end]
        runs = list(zip(points, points[1:], strict=False))
        length = sum(abs(p[0] - q[0]) + abs(p[1] - q[1]) for p, q in runs)
        crossed = sum(_crosses(p, q, box) for p, q in runs[1:-1] for box in boxes)
        clean = simplified(points)
        return (not _respects(clean, source_anchor[0], target_anchor[0]), crossed, length + 4 * len(clean), clean)

    ways = [[(b[0], a[1])], [(a[0], b[1])]]
    ways += [[(x, a[1]), (x, b[1])] for x in tracks[0]] + [[(a[0], y), (b[0], y)] for y in tracks[1]]
    best = min(map(cost, ways))
    if best[0] or best[1]:  # no simple way is free: one more turn
        ways = [[(x, a[1]), (x, y), (b[0], y)] for x in tracks[0] for y in tracks[1]]
        ways += [[(a[0], y), (x, y), (x, b[1])] for x in tracks[0] for y in tracks[1]]
        best = min(best, min(map(cost, ways)))
    return best[-1]


def _crosses(p, q, box) -> bool:
    x, y, w, h = box
    return min(p[0], q[0]) < x + w and max(p[0], q[0]) > x and min(p[1], q[1]) < y + h and max(p[1], q[1]) > y


def anchored(points, source, target, source_anchor, target_anchor) -> list[tuple[float, float]]:
    """``points`` with its ends on the anchors; rerouted if it would leave or arrive through other sides."""
    if len(points) >= 2:
        start, end = _on_side(source, *source_anchor), _on_side(target, *target_anchor)
        inner = [list(p) for p in points[1:-1]]
        if inner:  # first and last corner follow the ends
            inner[0][1 if OUTWARD[source_anchor[0]][0] else 0] = start[1 if OUTWARD[source_anchor[0]][0] else 0]
            inner[-1][1 if OUTWARD[target_anchor[0]][0] else 0] = end[1 if OUTWARD[target_anchor[0]][0] else 0]
        moved = simplified([start, *map(tuple, inner), end])
        straight = all(abs(p[0] - q[0]) <= SAME_POINT or abs(p[1] - q[1]) <= SAME_POINT for p, q in zip(moved, moved[1:], strict=False))
        if straight and _respects(moved, source_anchor[0], target_anchor[0]):
            return moved
    return orthogonal(source, target, source_anchor, target_anchor, points)


def resolved(points, old_source, old_target, source, target, source_anchor, target_anchor, same: float = 1.0):
    """The route after its boxes moved: kept, moved along if both moved alike, else rerouted."""
    shift = [(n[0] - o[0], n[1] - o[1]) for o, n in ((old_source, source), (old_target, target))]
    still = [abs(dx) <= same and abs(dy) <= same for dx, dy in shift]
    if all(still):
        return anchored(points, source, target, source_anchor, target_anchor)
    (ax, ay), (bx, by) = shift
    if abs(ax - bx) <= same and abs(ay - by) <= same:
        return [(x + ax, y + ay) for x, y in points]
    return orthogonal(source, target, source_anchor, target_anchor, points)


def batch(rows, same=1.0):
    """The library's ``resolved`` of rows (points, old source, old target, source, target, source anchor, target anchor)."""
    points, old_source, old_target, source, target, sa, ta = zip(*rows, strict=True)
    boxes = [np.array(b, dtype=float) for b in (old_source, old_target, source, target)]
    sides = [np.array([routing.SIDES.index(a[0]) for a in of]) for of in (sa, ta)]
    offsets = [np.array([a[1] for a in of], dtype=float) for of in (sa, ta)]
    ends = routing.Ends(*boxes[2:], *sides, *offsets)
    return routing.resolved(routing.Lines.of(points), *boxes[:2], ends, np.arange(len(rows)), same).tolist()
