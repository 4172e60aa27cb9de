"""The index of boxes in files, and the join of many viewports."""

import random

import pytest
from loomgraph.operators import layout, spatial
from pyspark.sql import functions as F

SHAPE = "x double, y double, width double, height double"


def meet(a, b):
    return a[1] <= b[1] + b[3] and a[1] + a[3] >= b[1] and a[2] <= b[2] + b[4] and a[2] + a[4] >= b[2]


def made_boxes(rng, n, prefix="b"):
    side = lambda: rng.choice([0.0, 10.0, 180.0, 500.0, 501.0, 4000.0 * rng.random()])
    return [(f"{prefix}{i}", rng.uniform(-40_000, 40_000), rng.uniform(-40_000, 40_000), side(), side()) for i in range(n)]


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


@pytest.mark.parametrize("rectangle", [(0, 0, 0, 0), (5, 9, 5, 9), (3, 4, 90, 17), (1 << 30, (1 << 30) - 3, (1 << 30) + 700, (1 << 30) + 2)])
def test_curve_ranges_cover_a_rectangle(spark, rectangle):
    left, top, right, bottom = rectangle
    spans = spatial.curve_ranges(*rectangle)
    assert 1 <= len(spans) <= spatial.RANGES
    rng = random.Random(1)
    cells = [(rng.randint(left, right), rng.randint(top, bottom)) for _ in range(60)] + [(left, top), (right, bottom), (left, bottom), (right, top)]
    key = lambda c, r: sum((c >> i & 1) << 2 * i | (r >> i & 1) << 2 * i + 1 for i in range(31))
    assert all(any(low <= key(c, r) <= high for low, high in spans) for c, r in cells)
    size = spatial.CELL
    points = spark.createDataFrame([((c - spatial.MIDDLE) * size + 1, (r - spatial.MIDDLE) * size + 1) for c, r in cells], "x double, y double")
    assert [x[0] for x in points.select(spatial.curve_key(F.col("x"), F.col("y"), F.lit(0))).collect()] == [key(c, r) for c, r in cells]


def test_ranges_are_tight_for_a_small_viewport():
    spans = spatial.curve_ranges(1000, 1000, 1003, 1003)
    assert sum(high - low + 1 for low, high in spans) == 16


def test_index_matches_brute_force_and_reads_few_files(spark, tmp_path):
    rng, path = random.Random(5), str(tmp_path / "boxes")
    rows = made_boxes(rng, 3000) + [("huge", -1e18, -1e18, 2e18, 2e18), ("far", 1e17, 1e17, 1.0, 1.0)]
    spatial.create_index(spark.createDataFrame(rows, f"node_id string, {SHAPE}"), path)
    held = {r[0]: r for r in rows}

    def check():
        assert spatial.index_size(spark, path) == len(held)
        views = [("v", rng.uniform(-40_000, 40_000), rng.uniform(-40_000, 40_000), w, h) for w, h in ((0.0, 0.0), (900.0, 700.0), (9000.0, 20.0))]
        for view in [*views, ("v", 1e17 - 5, 1e17 - 5, 10.0, 10.0), ("v", -1e6, -1e6, 2e6, 2e6)]:
            found = spatial.boxes_in_view(spark, path, *view[1:]).collect()
            assert sorted(map(tuple, found)) == sorted(r for r in held.values() if meet(r, view))

    check()
    every = files_read(spatial.read_index(spark, path))
    assert every > 30 and files_read(spatial.boxes_in_view(spark, path, 0.0, 0.0, 900.0, 700.0)) < every / 3

    stamps = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "boxes").rglob("*.parquet")}
    before = stamps()
    moved = [(f"b{i}", 100.0 + i, 100.0, 50.0, 50.0) for i in range(3)] + [("new", 120.0, 130.0, 5.0, 5.0)]
    spatial.upsert(spark, path, spark.createDataFrame(moved, f"node_id string, {SHAPE}"))
    held |= {r[0]: r for r in moved}
    check()
    same = set(before.items()) & set(stamps().items())
    assert len(same) >= len(before) - 5  # three tiles left, one entered

    gone = ["huge", "b7", "new", "unknown"]
    spatial.remove(spark, path, spark.createDataFrame([(i,) for i in gone], "node_id string"))
    held = {k: v for k, v in held.items() if k not in gone}
    check()


def test_an_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    spatial.create_index(spark.createDataFrame([], f"node_id string, {SHAPE}"), path)
    assert spatial.index_size(spark, path) == 0
    spatial.upsert(spark, path, spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0)] * 2, f"node_id string, {SHAPE}"))
    assert spatial.boxes_in_view(spark, path, 0.0, 0.0, 1.0, 1.0).count() == 1


def test_one_huge_viewport_adds_only_its_own_candidates(spark):
    rng = random.Random(6)
    boxes = [(f"b{i}", rng.uniform(0, 50_000), rng.uniform(0, 50_000), 180.0, 60.0) for i in range(2000)]
    views = [(f"v{i}", rng.uniform(0, 50_000), rng.uniform(0, 50_000), 900.0, 700.0) for i in range(300)] + [("all", 0.0, 0.0, 50_000.0, 50_000.0)]
    b = spark.createDataFrame(boxes, f"node_id string, {SHAPE}")
    v = spark.createDataFrame(views, f"viewport_id string, {SHAPE}")
    expected = sorted((y[0], x[0]) for x in boxes for y in views if meet(x, y))
    assert sorted(map(tuple, layout.viewport_join(b, v).collect())) == expected
    assert layout.viewport_candidates(b, v).count() < 8 * len(expected)
    assert layout.viewport_join(b.limit(0), v).count() == 0
