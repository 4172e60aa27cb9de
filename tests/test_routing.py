"""Routes of batches equal those found edge by edge, and keep their properties."""

import numpy as np
import pytest
from loomgraph.operators import geometry, routing
from pyspark.sql import functions as F

import routes_by_row as by_row
from routes_by_row import batch


def drawn(n, seed):
    """Edges of all kinds: boxes far, near and overlapping, still, moved alike or apart, hints of any length."""
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        box = lambda: (*draw.integers(-150, 150, 2).tolist(), *draw.integers(0, 120, 2).tolist())
        source, target = box(), box()
        if draw.random() < 0.1:
            target = source
        kind = draw.integers(0, 4)
        by = draw.integers(-60, 60, 4).tolist() if kind == 0 else [0, 0, 0, 0] if kind == 1 else [1, 0, 0, 1] if kind == 2 else [30, -20, 30, -20]
        moved = [(b[0] + dx, b[1] + dy, *b[2:]) for b, dx, dy in ((source, *by[:2]), (target, *by[2:]))]
        anchors = [(routing.SIDES[draw.integers(0, 4)], float(draw.integers(-20, 140))) for _ in range(2)]
        size = int(draw.choice([0, 1, 2, 2, 3, 4, 5, 9]))
        points = draw.integers(-200, 200, (size, 2)).astype(float)
        if draw.random() < 0.5:  # by straight runs, as drawn routes are
            for at in range(1, size):
                points[at, at % 2] = points[at - 1, at % 2]
        rows.append(([tuple(p) for p in points.tolist()], source, target, *moved, *anchors))
    return rows


def test_batches_equal_edges_one_by_one():
    rows = drawn(3000, seed=3)
    expected = [by_row.resolved(*row) for row in rows]
    assert batch(rows) == [[tuple(map(float, p)) for p in line] for line in expected]


def test_kept_routes_equal_edges_one_by_one():
    """Routes drawn by the router stay where boxes stay, and follow anchors that slide."""
    rows = []
    for row in drawn(400, seed=4):
        route = by_row.orthogonal(row[1], row[2], *row[5:])
        for slide in (0.0, 3.0):
            anchors = [(side, offset + slide) for side, offset in row[5:]]
            rows.append((route, row[1], row[2], row[1], row[2], *anchors))
    expected = [by_row.resolved(*row) for row in rows]
    assert batch(rows) == [[tuple(map(float, p)) for p in line] for line in expected]


def test_more_edges_than_are_laid_out_at_a_time(monkeypatch):
    rows = drawn(100, seed=5)
    whole = batch(rows)
    monkeypatch.setattr(routing, "ROUTED", 7)
    assert batch(rows) == whole


def test_long_and_short_lines_are_simplified_together():
    draw = np.random.default_rng(6)
    lines = [[tuple(p) for p in (draw.integers(0, 12, (n, 2)) / 4).tolist()] for n in [0, 1, 2, 3, 5, 8, 40, 700, 3, 0]]
    lines += [[(1.0, 1.0)] * 5, [(float(x), 0.0) for x in range(300)]]
    assert routing.simplified(routing.Lines.of(lines)).tolist() == [by_row.simplified(line) for line in lines]


@pytest.mark.parametrize("column", ["points", "source_box", "old_target_box", "source_anchor", "width", "side"])
def test_edges_without_a_part_have_no_route(spark, column):
    box = "struct<x:double,y:double,width:double,height:double>"
    anchor = "struct<side:string,offset:double>"
    schema = (
        f"points array<struct<x:double,y:double>>, source_box {box}, target_box {box}, old_source_box {box}, old_target_box {box}, "
        f"source_anchor {anchor}, target_anchor {anchor}, turned int"
    )
    a, b, c = (0.0, 0.0, 40.0, 40.0), (100.0, 0.0, 40.0, 40.0), (100.0, 90.0, 40.0, 40.0)
    whole = {
        "points": [(40.0, 20.0), (100.0, 20.0)], "source_box": a, "target_box": c, "old_source_box": a, "old_target_box": b,
        "source_anchor": ("right", 20.0), "target_anchor": ("left", 20.0), "turned": 7,
    }
    lacking = {"width": {"source_box": (0.0, 0.0, None, 40.0)}, "side": {"target_anchor": ("middle", 20.0)}}.get(column, {column: None})
    edges = spark.createDataFrame([tuple(whole.values()), tuple((whole | lacking).values()), tuple((whole | {"points": []}).values())], schema)
    found = geometry.reroute(edges)
    assert found.columns == edges.columns
    one, none, unhinted = found.collect()
    expected = by_row.resolved(whole["points"], a, b, a, c, whole["source_anchor"], whole["target_anchor"])
    assert [tuple(p) for p in one.points] == expected and one.turned == 7
    assert none.points is None
    assert [tuple(p) for p in unhinted.points] == by_row.resolved([], a, b, a, c, whole["source_anchor"], whole["target_anchor"])


def test_columns_of_lines(spark):
    lines = [[(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)], [], None, [(1.0, 1.0)]]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, points array<struct<x:double,y:double>>").coalesce(1)
    found = [r.points for r in rows.select("i", geometry.simplify(F.col("points")).alias("points")).orderBy("i").collect()]
    assert [None if p is None else [tuple(q) for q in p] for p in found] == [[(0.0, 0.0), (9.0, 0.0)], [], None, [(1.0, 1.0)]]
    assert rows.limit(0).select(geometry.simplify(F.col("points"))).collect() == []
