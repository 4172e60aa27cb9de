"""Large rows are shuffled no more often than needed."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, merge, view
from loomgraph.plans import catalogue, workload
from loomgraph.shared import shared_folder, written
from loomgraph.sources import graph_json

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df) -> int:
    return plan(df).count("Join ")


def test_boxes_of_both_ends_come_with_the_routes(spark):
    straight = joins(catalogue.QUERIES["straight_edges"](spark, SF))
    for name in ("anchor_point", "anchor_side", "anchor_from_inside", "routes_moved_along", "reroute_edges"):
        assert joins(catalogue.QUERIES[name](spark, SF)) == straight


def test_edges_read_from_json_are_numbered_without_sorting_them(spark, tmp_path):
    edges = spark.range(500).selectExpr("cast(id % 7 as string) as source", "cast(id as string) as target", "'Import' as kind", "id as weight", "500 - id as seq")
    nodes = spark.range(7).selectExpr("cast(id as string) as id", "'File' as type", "'' as container_id", "id as child_ordinal")
    graph_json.write_parts(nodes, edges, str(tmp_path / "graph"), compression="gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / "graph").glob("part-*"))
    back = graph_json.read_parts(spark, str(tmp_path / "graph"))[1]
    assert "RepartitionByExpression" not in plan(back) and "Sort [file" not in plan(back).split("Window")[0]
    assert [(r.source, r.target, r.weight, r.seq) for r in back.orderBy("seq").collect()] == [(str(i % 7), str(i), i, 499 - i) for i in range(499, -1, -1)]


def test_edges_are_merged_once_their_source_is_lifted(spark):
    nodes = spark.createDataFrame([(i, i.split("/")[:-1]) for i in ("a", "b", "a/x", "a/y", "b/z")], "id string, ancestors array<string>")
    rows = [("a/x", "b/z", "Import", 1, 5), ("a/y", "b/z", "Call", 2, 3), ("a/x", "a/y", "Call", 1, 1), ("a", "b", "Call", 1, 2), ("a", "b/z", "Use", 4, 4)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, weight long, seq long")
    rolled = hierarchy.roll_up(edges, nodes, nodes.filter("id in ('a', 'b')").select("id"))
    assert [tuple(r) for r in rolled.collect()] == [("a", "b", "Call", 3, 7)]
    steps = [line.strip(" :+-").split()[0] for line in plan(rolled).splitlines()]
    outer = steps[: steps.index("Join", steps.index("Join") + 1)]
    assert outer.count("Aggregate") == 2  # one above either join


def test_edges_are_dealt_to_many_tasks_before_they_are_summed(spark):
    edges = spark.range(3000).selectExpr("cast(id % 1500 as string) as source", "'t' as target", "'Call' as kind", "cast(4e9 as long) + id % 1500 as weight", "id as seq")
    merged = merge.merge_edges(edges)
    assert plan(merged).index("Aggregate") < plan(merged).index("RepartitionByExpression")
    dealt = next(line for line in plan(merged).splitlines() if "RepartitionByExpression" in line)
    assert int(dealt.rsplit(", ", 1)[1]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert merged.agg(F.count("*"), F.min("weight"), F.max("weight"), F.max("seq")).first() == (1500, 4294967295, 4294967295, 1499)


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, target string, kind string, seq long")


def test_colours_of_layout_edges_need_one_shuffle(spark):
    edges = edges_of(spark, [("a", "b", "Call"), ("a", "b", "Import"), ("a", "c", None), ("x", "y", "Use"), (None, "b", "Call"), ("r", "s", "Call")])
    rolled = spark.createDataFrame([("x", "y", "Import", 9), ("p", "q", "Call", 1), ("r", "s", None, 2)], "source string, target string, kind string, count long")
    others = spark.createDataFrame([("a", "b"), ("n", "m"), ("n", "m")], "source string, target string")
    found = view.edge_colours(edges, rolled, others)
    assert {(r.source, r.target): r.kind for r in found.collect()} == {
        ("a", "b"): "Call", ("a", "c"): None, ("x", "y"): "Import", (None, "b"): None, ("r", "s"): "Call", ("p", "q"): "Call", ("n", "m"): None,
    }
    assert found.count() == 7 and joins(found) == 0 and plan(found).count("RepartitionByExpression") == 1


def test_few_shown_ids_and_few_suppliers_are_broadcast_and_many_give_the_same(spark, monkeypatch):
    nodes = written(workload.nodes(spark, SF))
    run = lambda: hierarchy.roll_up(workload.raw_edges(spark, SF), nodes, workload.directories(nodes))
    few = run()
    assert plan(workload.raw_edges(spark, SF)).count("strategy=broadcast") == 1
    assert plan(few).count("strategy=broadcast") == 3
    monkeypatch.setattr(hierarchy, "FEW_SHOWN", 0)
    monkeypatch.setattr(workload, "FEW_SUPPLIERS", 0)
    many = run()
    assert "strategy=broadcast" not in plan(many)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_diagnostics_count_edges_by_target_before_targets_are_looked_up(spark):
    nodes = spark.createDataFrame(
        [("", "Directory", None), ("f", "File", ""), ("g", "File", ""), ("f::x", "CodeBlock", "f"), ("f::y", "CodeBlock", "f")], "id string, type string, container_id string"
    )
    edges = edges_of(spark, [("f", "g", "Call"), ("f", "g", "Call"), ("f", "z", "Call"), ("z", "g", "Call"), (None, "g", "Call"), ("f", None, "Use")])
    shown, expanded = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["f", "g", "f"], ["f", "nowhere"]))
    routes = edges.filter("kind = 'Call' and seq != 2")
    found = view.diagnostics(nodes, edges, shown, expanded, edges.limit(2), routes)
    assert {r.metric: r.value for r in found.collect()} == {
        "code_blocks": 2, "files_with_children": 1, "expanded_files": 1, "edges_in_tree": 2, "edges_not_in_tree": 4,
        "edges_with_route": 3, "edges_without_route": 3, "rolled_up": 2,
    }
    none = view.diagnostics(nodes.limit(0), edges.limit(0), shown, expanded, edges.limit(0), routes)
    assert {r.value for r in none.collect()} == {0} and none.count() == 8
    steps = [line.strip(" :+-") for line in plan(found).splitlines()]
    target = next(i for i, s in enumerate(steps) if s.startswith("Join LeftOuter") and "target" in s)
    assert steps[target + 1].startswith("Aggregate [target")


def test_what_is_written_for_json_leaves_one_copy_of_the_graph(spark, tmp_path):
    before = set(Path(shared_folder(spark).removeprefix("file:")).iterdir())
    edges = spark.range(500).selectExpr("cast(id % 7 as string) as source", "cast(id as string) as target", "'Import' as kind", "id as weight", "500 - id as seq")
    nodes = spark.range(7).selectExpr("cast(id as string) as id", "'File' as type", "nullif(cast(id - 1 as string), '-1') as container_id", "id as child_ordinal")
    graph_json.write_parts(nodes, edges, str(tmp_path / "graph"))
    assert not [p.name for p in set(Path(shared_folder(spark).removeprefix("file:")).iterdir()) - before if p.name.startswith("table-")]
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "graph").glob("part-*")))
    graph = json.loads(text)
    assert len(graph["edges"]) == 500 and [e["weight"] for e in graph["edges"]] == list(range(499, -1, -1))
    assert list(graph["nodes"]) == sorted(graph["nodes"]) and graph["nodes"]["3"]["children"] == ["4"]


def test_lists_of_children_are_dealt_by_container_once(spark):
    nodes = spark.range(50).selectExpr("cast(id as string) as id", "'File' as type", "cast(id % 5 as string) as container_id", "id as child_ordinal", "cast(id as string) as name")
    listed = graph_json._listed(nodes)
    dealt = listed._jdf.queryExecution().sparkPlan().toString().count("Exchange") + plan(listed).count("RepartitionByExpression [container_id")
    assert dealt <= 2
    assert {r.id: len(r.node.children) for r in listed.collect()} == {str(i): 10 if i < 5 else 0 for i in range(50)}


def test_edges_that_hardly_repeat_are_merged_without_a_shuffle_of_those_that_are_alone(spark, monkeypatch):
    rows = [(str(i % 50), str(i % 45) if i % 10 else None, "Call" if i % 3 else "Use", i % 4, i) for i in range(600)]
    rows += [("hub", "t", "Call", 3_000_000_000, 7), ("hub", "t", "Call", 3_000_000_000, 3), ("big", "t", "Call", 5_000_000_000, 1)]
    edges = written(spark.createDataFrame(rows, "source string, target string, kind string, weight long, seq long"))
    # The hash decides where an edge is merged, not what with: here all of a source share one.
    for hashed in (merge.F.xxhash64, lambda *keys, whole=F.xxhash64: whole(keys[0])):
        monkeypatch.setattr(merge.F, "xxhash64", hashed)
        for few in (merge.FEW_REPEATED, 0):
            monkeypatch.setattr(merge, "FEW_REPEATED", few)
            merged = merge.merge_rare(edges)
            assert sorted(map(str, merged.collect())) == sorted(map(str, merge.merge_edges(edges).collect()))
    alone = plan(merged).split("Aggregate")[0]
    assert "LeftAnti" in alone and "RepartitionByExpression" not in alone
