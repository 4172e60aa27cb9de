"""Edge routes between boxes: anchors, clean polylines, orthogonal rerouting.

Anchors are column expressions. Routes are computed in Arrow batches by array operations over all edges
of a batch (:mod:`loomgraph.operators.routing`), a row per edge, so they scale with the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.operators import routing
from loomgraph.operators.routing import SAME_POINT
from loomgraph.schema import POINT

# Fixed values.
BOUNDARY = 4.0


def _clamp(value: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, high))


def anchor_side(box: Column, point: Column, next_point: Column) -> Column:
    """Side of a box that a route leaves from: the one the point lies on, else where the route goes."""
    near = lambda a, b: F.abs(a - b) <= BOUNDARY
    dx, dy = next_point["x"] - point["x"], next_point["y"] - point["y"]
    return (
        F.when(near(point["x"], box["x"]), "left")
        .when(near(point["x"], box["x"] + box["width"]), "right")
        .when(near(point["y"], box["y"]), "top")
        .when(near(point["y"], box["y"] + box["height"]), "bottom")
        .when((F.abs(dx) >= F.abs(dy)) & (dx >= 0), "right")
        .when(F.abs(dx) >= F.abs(dy), "left")
        .when(dy >= 0, "bottom")
        .otherwise("top")
    )


def anchor(box: Column, point: Column, next_point: Column) -> Column:
    side = anchor_side(box, point, next_point)
    offset = F.when(side.isin("left", "right"), _clamp(point["y"] - box["y"], box["height"])).otherwise(
        _clamp(point["x"] - box["x"], box["width"])
    )
    return F.struct(side.alias("side"), offset.alias("offset"))


def anchor_point(box: Column, anchor: Column) -> Column:
    side = anchor["side"]
    offset = _clamp(anchor["offset"], F.when(side.isin("left", "right"), box["height"]).otherwise(box["width"]))
    x = F.when(side == "left", box["x"]).when(side == "right", box["x"] + box["width"]).otherwise(box["x"] + offset)
    y = F.when(side == "top", box["y"]).when(side == "bottom", box["y"] + box["height"]).otherwise(box["y"] + offset)
    return F.struct(x.alias("x"), y.alias("y"))


def straight_route(source: Column, target: Column) -> Column:
    """Two points between the facing sides of two boxes, sides chosen by the longer axis."""
    middle = lambda b: (b["x"] + b["width"] / 2, b["y"] + b["height"] / 2)
    (sx, sy), (tx, ty) = middle(source), middle(target)
    across = F.abs(tx - sx) >= F.abs(ty - sy)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return (
        F.when(across & (tx >= sx), F.array(at(source["x"] + source["width"], sy), at(target["x"], ty)))
        .when(across, F.array(at(source["x"], sy), at(target["x"] + target["width"], ty)))
        .when(ty >= sy, F.array(at(sx, source["y"] + source["height"]), at(tx, target["y"])))
        .otherwise(F.array(at(sx, source["y"]), at(tx, target["y"] + target["height"])))
    )


def straight_routes(pairs: DataFrame, boxes: DataFrame, *, with_boxes: bool = False) -> DataFrame:
    """Routes for (source, target) pairs; pairs without both boxes are left out.

    ``with_boxes`` keeps the boxes of both ends as ``source_box`` and ``target_box``, so that no one has to look them up again.
    """
    box = F.struct("x", "y", "width", "height")
    source = boxes.select(F.col("node_id").alias("source"), box.alias("source_box"))
    target = boxes.select(F.col("node_id").alias("target"), box.alias("target_box"))
    routes = pairs.join(source, "source").join(target, "target").withColumn("points", straight_route(F.col("source_box"), F.col("target_box")))
    return routes if with_boxes else routes.drop("source_box", "target_box")


def without_repeats(points: Column) -> Column:
    """Polyline without points within half a unit of the last one kept."""
    first = F.slice(points, 1, 1)
    same = lambda a, b: (F.abs(a["x"] - b["x"]) <= SAME_POINT) & (F.abs(a["y"] - b["y"]) <= SAME_POINT)
    step = lambda kept, p: F.when(same(F.element_at(kept, -1), p), kept).otherwise(F.concat(kept, F.array(p)))
    return F.when(F.size(points) <= 1, points).otherwise(
        F.aggregate(F.slice(points, F.lit(2), F.size(points)), first, step)
    )


def shifted(points: Column, dx: Column, dy: Column) -> Column:
    """A polyline moved by the offsets of its container."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def _numbers(structs: pa.Array, *names: str) -> np.ndarray:
    """(n, names) fields of structs, NaN for nulls."""
    fields = [pc.cast(pc.struct_field(structs, name), pa.float64()) for name in names]
    return np.stack([f.to_numpy(zero_copy_only=False) for f in fields], axis=1)


def _lines(points: pa.Array) -> routing.Lines:
    """Polylines of a column; nulls have no points."""
    sizes = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return routing.Lines(_numbers(points.flatten(), "x", "y"), sizes)


def _column(lines: routing.Lines, known: np.ndarray) -> pa.Array:
    """Polylines as a column, null where not ``known``."""
    xy = np.ascontiguousarray(lines.points.T)
    offsets = pa.array(np.append(0, np.cumsum(lines.sizes)).astype(np.int32))
    values = pa.StructArray.from_arrays([pa.array(xy[0]), pa.array(xy[1])], names=["x", "y"])
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~known))


def simplify(points: Column) -> Column:
    """Polylines without repeated points and without points in the middle of a straight run; null for null."""

    @F.arrow_udf(T.ArrayType(POINT))
    def of_batches(lines: pa.Array) -> pa.Array:
        return _column(routing.simplified(_lines(lines)), lines.is_valid().to_numpy(zero_copy_only=False))

    return of_batches(points)


def moved_alike(same: float = 1.0) -> Column:
    """Whether both boxes of an edge have moved, and by the same."""
    by = lambda end, c: F.col(f"{end}_box")[c] - F.col(f"old_{end}_box")[c]
    alike = (F.abs(by("source", "x") - by("target", "x")) <= same) & (F.abs(by("source", "y") - by("target", "y")) <= same)
    still = [(F.abs(by(end, "x")) <= same) & (F.abs(by(end, "y")) <= same) for end in ("source", "target")]
    return alike & ~(still[0] & still[1])


def reroute(edges: DataFrame) -> DataFrame:
    """``edges`` with ``points`` resolved against moved boxes.

    Columns used: points, source_box, target_box, old_source_box, old_target_box, source_anchor,
    target_anchor. Routes whose boxes moved alike move along without Python. Others are null where one of these
    columns, or a number in a box or an anchor, is null or the side is unknown; a route without points is routed without a hint.
    """

    @F.arrow_udf(T.ArrayType(POINT))
    def route(points: pa.Array, sb: pa.Array, tb: pa.Array, osb: pa.Array, otb: pa.Array, sa: pa.Array, ta: pa.Array) -> pa.Array:
        source, target, old_source, old_target = (_numbers(b, "x", "y", "width", "height") for b in (sb, tb, osb, otb))
        offsets = [_numbers(a, "offset")[:, 0] for a in (sa, ta)]
        found = [pc.index_in(pc.struct_field(a, "side"), value_set=pa.array(routing.SIDES)) for a in (sa, ta)]
        sides = [pc.fill_null(f, -1).to_numpy(zero_copy_only=False).astype(np.int64) for f in found]
        numbers = np.column_stack([source, target, old_source, old_target, *offsets])
        known = points.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(numbers).any(axis=1) & (np.minimum(*sides) >= 0)
        ends = routing.Ends(source, target, *sides, *offsets)
        routes = routing.resolved(_lines(points), old_source, old_target, ends, np.flatnonzero(known))
        return _column(routes, known)

    alike = moved_alike()
    names = ("source_box", "target_box", "old_source_box", "old_target_box", "source_anchor", "target_anchor")
    turned = route(F.when(~alike, F.col("points")), *[F.col(n) for n in names])
    move = lambda c: F.col("source_box")[c] - F.col("old_source_box")[c]
    moved = F.when(alike, shifted(F.col("points"), move("x"), move("y"))).otherwise(turned)
    return edges.withColumn("points", moved)
