"""The tree as numbers, against the same asked of arrays of containers."""

import random

from loomgraph.operators import hierarchy, intervals
from pyspark.sql import functions as F


def made_tree(spark, seed=3, n=300):
    rng, ids = random.Random(seed), [""]
    for i in range(n):
        above = rng.choice(ids[-40:] + ids[:5])
        ids.append(f"{above}/{rng.choice('abcXYZ')}{i}" if above else f"{rng.choice('abc')}{i}")
    nodes = spark.createDataFrame([(i, "Directory", i.rpartition("/")[2], None) for i in ids], "id string, type string, name string, file_path string")
    return hierarchy.with_ancestors(nodes.repartition(5)), ids


def above(i):
    parts = i.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts))]


def brute_drawn(ids, matches, expanded):
    rows = [i for i in ids if i and i in matches and all(a in expanded for a in above(i))]
    rows.sort(key=lambda i: [*above(i), i])
    return [(k, i, len(above(i))) for k, i in enumerate(rows)]


def test_ranges_hold_what_is_below(spark, tmp_path):
    nodes, ids = made_tree(spark)
    tree = intervals.write_intervals(nodes, str(tmp_path / "tree"))
    rows = {r.id: r for r in tree.collect()}
    assert sorted(r.start for r in rows.values()) == list(range(len(ids)))
    for i in random.Random(1).sample(ids, 12) + ["", "nowhere"]:
        below = {j for j in ids if j == i or i in above(j) or i == ""}
        assert {r.id for r in intervals.subtree(tree, i).collect()} == (below if i in rows else set())
        assert {r.id for r in hierarchy.subtree(nodes, i).collect()} == (below if i in rows else set())
    plan = intervals.subtree(tree, ids[7])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(start," in plan and "LessThan(start," in plan


def test_drawn_rows_and_pages(spark, tmp_path):
    nodes, ids = made_tree(spark, 4)
    tree = intervals.write_intervals(nodes, str(tmp_path / "tree"))
    rng = random.Random(2)
    for query, share in (("", 0.7), ("x", 0.9), ("a1", 1.0), ("nothing", 1.0)):
        expanded = {i for i in ids if rng.random() < share}
        found = {i for i in ids if query in i.rpartition("/")[2].lower()}
        matches = found | {a for i in found for a in above(i)} | {""}
        drawn = intervals.drawn_rows(tree, hierarchy.search(nodes, query), spark.createDataFrame([(i,) for i in expanded], "id string"))
        rows = sorted((r.ordinal, r.id, r.depth) for r in drawn.collect())
        assert rows == brute_drawn(ids, matches, expanded)
        assert sorted((r.ordinal, r.id, r.depth) for r in intervals.page(drawn, 1, 7).collect()) == rows[7:14]


def test_a_chain_and_no_nodes(spark):
    ids = ["/".join(["d"] * k) for k in range(1, 60)]
    nodes = hierarchy.with_ancestors(spark.createDataFrame([(i, "Directory", "d", None) for i in ["", *ids]], "id string, type string, name string, file_path string"))
    tree = intervals.with_intervals(nodes)
    assert sorted((r.start, r.end) for r in tree.collect()) == [(k, 60) for k in range(60)]
    closed = spark.createDataFrame([(ids[9],), ("unknown",)], "id string")
    assert intervals.not_below(tree, closed).count() == 11
    assert intervals.with_intervals(nodes.limit(0)).count() == 0
    assert intervals.drawn_rows(tree.limit(0), nodes.select("id"), nodes.select("id")).count() == 0


def test_edges_that_touch_a_subtree(spark, tmp_path):
    nodes, ids = made_tree(spark, 5, 80)
    rng = random.Random(8)
    pairs = [(rng.choice(ids), rng.choice(ids), k) for k in range(200)] + [("gone", ids[3], 999)]
    edges = spark.createDataFrame(pairs, "source string, target string, seq long")
    tree = intervals.write_intervals(nodes, str(tmp_path / "tree"))
    numbered = intervals.numbered_edges(edges, tree)
    for i in ids[1:6]:
        own = {j for j in ids if j == i or i in above(j)}
        assert {r.seq for r in intervals.touching(numbered, tree, i).collect()} == {k for s, t, k in pairs[:-1] if s in own or t in own}


def test_shown_is_decided_by_all_containers(spark):
    nodes, ids = made_tree(spark, 6)
    rng = random.Random(9)
    frame = lambda some: spark.createDataFrame([(i,) for i in some], "id string")
    for share in (0.6, 0.9, 1.0):
        visible, expanded = ({i for i in ids if rng.random() < share} for _ in range(2))
        expected = {i for i in ids if i and i in visible and all(a in visible and a in expanded for a in above(i))}
        assert {r.id for r in hierarchy.shown(nodes, frame(visible), frame(expanded)).collect()} == expected
    assert hierarchy.shown(nodes, frame([]), frame([])).count() == 0
    assert nodes.filter(F.col("id") == "").count() == 1
