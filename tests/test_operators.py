"""Graph operators on small fixtures."""

import json
import math
import random

import pytest
from loomgraph.functions import names, paths, style
from loomgraph.operators import geometry, hierarchy, layout, merge, resolve, routing, view
from loomgraph.schema import BLOCK_KINDS, EDGE_KINDS, edge_kinds
from loomgraph.sources import graph_json
from loomgraph.streaming import progress
from pyspark.sql import functions as F

import routes_by_row as by_row
from routes_by_row import batch

EDGE = "source string, target string, kind string, weight long, seq long"


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGE)


@pytest.mark.parametrize(
    "rows,merged",
    [
        ([("a", "b", "FunctionCall", 1)] * 2 + [("a", "b", "MethodCall", 1)], {("a", "b", "FunctionCall"): 2, ("a", "b", "MethodCall"): 1}),
        ([("a", "b", "Import", 3), ("a", "b", "Import", 7)], {("a", "b", "Import"): 10}),
        ([("a", "b", "Import", 4294967295), ("a", "b", "Import", 7)], {("a", "b", "Import"): 4294967295}),
        ([("a", "b", "Import", 1)] * 5, {("a", "b", "Import"): 5}),
    ],
)
def test_merge(spark, rows, merged):
    found = merge.merge_edges(edges(spark, rows)).collect()
    assert {(r.source, r.target, r.kind): r.weight for r in found} == merged


def test_merge_does_not_depend_on_order(spark):
    rows = [(f"n{i % 50 if i % 5 == 0 else i}", "t", "Import", 1) for i in range(1000)]
    some = merge.merge_edges(edges(spark, rows)).select("source", "weight").collect()
    random.Random(1).shuffle(rows)
    assert set(some) == set(merge.merge_edges(edges(spark, rows)).select("source", "weight").collect())
    assert len(some) == len({r[0] for r in rows})


def test_adjacency_in_parts(spark):
    df = edges(spark, [("hub", f"t{i}", "Import", 1) for i in range(10)])
    rows = merge.adjacency(df, parts=3).collect()
    assert sorted(len(r.neighbours) for r in rows) == [3, 3, 4]
    assert merge.adjacency(df, reverse=True).count() == 10


BLOCK = "id string, type string, name string, file_path string"


def test_symbols_and_resolution(spark):
    nodes = spark.createDataFrame(
        [("m.py::alpha@1", "CodeBlock", "alpha", "m.py"), ("m.py::beta@5", "CodeBlock", "beta", "m.py"), ("a.rs::Foo@1", "CodeBlock", "Foo", "a.rs"), ("m.py", "File", "m.py", "m.py")],
        BLOCK,
    )
    symbols = resolve.symbol_table(nodes)
    assert {r.symbol for r in symbols.collect()} == {"alpha", "beta", "Foo", "m.py::alpha", "m.py::beta", "a.rs::Foo"}
    refs = [
        ("m.py::alpha@1", "FunctionCall", "beta"),
        ("m.py::alpha@1", "FunctionCall", "alpha"),  # itself
        ("x", "MethodCall", "a.b.beta"),
        ("x", "FunctionCall", "m::alpha"),
        ("y", "TypeReference", "std::x::Foo<Bar>"),
        ("z", "TypeReference", "m.py::alpha"),  # found by its last part
        ("z", "FunctionCall", "nothing"),
        ("x", "MethodCall", "q.beta"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(refs)], "from_node string, kind string, name string, seq long")
    found = {(r.source, r.target, r.kind): r.weight for r in resolve.resolve_symbols(df, symbols).collect()}
    assert found == {
        ("m.py::alpha@1", "m.py::beta@5", "FunctionCall"): 1,
        ("x", "m.py::beta@5", "MethodCall"): 2,
        ("x", "m.py::alpha@1", "FunctionCall"): 1,
        ("y", "a.rs::Foo@1", "TypeReference"): 1,
        ("z", "m.py::alpha@1", "TypeReference"): 1,
    }
    qualified = symbols.filter("symbol like '%::%'")
    again = resolve.resolve_symbols(df.withColumn("name", F.lit("m.py::beta")), qualified).collect()
    assert {(r.source, r.kind) for r in again} == {("y", "TypeReference"), ("z", "TypeReference")}


FILES = ["src/utils.ts", "src/Comp.tsx", "lib/utils/index.ts", "py/mod.py", "py/pkg/__init__.py", "rs/parser.rs", "rs/deep/mod.rs", "plain", "pkg/a.py", "pkg/b.py", "pkg/__init__.py", "src/same.js", "src/same.ts"]


@pytest.mark.parametrize(
    "module,from_file,target",
    [
        ("./utils", "src/main.ts", "src/utils.ts"),
        ("./Comp", "src/main.ts", "src/Comp.tsx"),
        ("../lib/utils", "src/main.ts", "lib/utils/index.ts"),
        ("./none", "src/main.ts", None),
        ("py.mod", "x.py", "py/mod.py"),
        ("py.pkg", "x.py", "py/pkg/__init__.py"),
        ("crate::deep", "rs/x.rs", None),
        ("plain", "x.py", "plain"),
        (".", "pkg/a.py", "pkg/__init__.py"),
        (".b", "pkg/a.py", None),
        ("./same", "src/main.ts", "src/same.js"),
        ("../../../plain", "src/main.ts", "plain"),
    ],
)
def test_imports(spark, module, from_file, target):
    names_ = [*FILES, "src/main.ts", "x.py", "rs/x.rs"]
    language = lambda p: {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "py": "Python", "rs": "Rust"}.get(p.rpartition(".")[2])
    files = spark.createDataFrame([(p, p, language(p)) for p in names_], "id string, path string, language string")
    refs = spark.createDataFrame([(from_file, module)] * 2, "file_path string, module_path string")
    assert [(r.source, r.target) for r in resolve.resolve_imports(refs, files).collect()] == ([] if target is None else [(from_file, target)])


TREE = "id string, type string, name string, container_id string, ancestors array<string>"


def tree(spark):
    rows = [("", "Directory", "src", None, []), ("utils.ts", "File", "utils.ts", "", [""]), ("f", "CodeBlock", "parseInput", "utils.ts", ["", "utils.ts"])]
    return spark.createDataFrame(rows, TREE)


@pytest.mark.parametrize(
    "query,ids", [("parse", {"", "utils.ts", "f"}), ("PARSE", {"", "utils.ts", "f"}), ("", {"", "utils.ts", "f"}), ("  ", {"", "utils.ts", "f"}), ("zzz", set()), ("src", {""}), ("utils", {"", "utils.ts"}), (" parse", set()), ("%", set())]
)
def test_search(spark, query, ids):
    assert {r.id for r in hierarchy.search(tree(spark), query).collect()} == ids


def test_shown_rollup_and_toggle(spark):
    ids = ["a", "a/x", "a/y", "b", "b/z"]
    nodes = hierarchy.with_ancestors(spark.createDataFrame([(i, "File" if "/" in i else "Directory", i, i) for i in ["", *ids]], BLOCK))
    as_ids = lambda some: spark.createDataFrame([(i,) for i in some], "id string")
    everything = as_ids(["", *ids])
    shown = hierarchy.shown(nodes, everything, as_ids(["", "a"])).select("id")
    assert {r.id for r in shown.collect()} == {"a", "a/x", "a/y", "b"}
    raw = edges(spark, [("a/x", "b/z", "Import", 1), ("a/x", "b/z", "FunctionCall", 1), ("a/x", "a/y", "Import", 1), ("b/z", "a/x", "Import", 5), ("b/z", "b", "Import", 1)])
    rolled = {(r.source, r.target): (r.kind, r["count"], r.weight) for r in hierarchy.roll_up(raw, nodes, shown).collect()}
    assert rolled == {("a/x", "b"): ("Import", 2, 2), ("b", "a/x"): ("Import", 1, 5)}
    hidden = hierarchy.toggle_subtree(nodes, everything, "a")
    assert {r.id for r in hidden.collect()} == {"", "b", "b/z"}
    assert {r.id for r in hierarchy.toggle_subtree(nodes, hidden, "a").collect()} == {"", *ids}
    assert {r.id for r in hierarchy.restored(as_ids(["gone"]), nodes, as_ids(["b"])).collect()} == {"b"}
    assert {r.id for r in hierarchy.restored(as_ids(["gone", "a"]), nodes, as_ids(["b"])).collect()} == {"a"}
    assert {r.id for r in hierarchy.toggle_one(as_ids(["a"]), "a").collect()} == set()


def test_highlight_of_a_chain(spark):
    ids = [f"n{i}" for i in range(101)]
    nodes = spark.createDataFrame([(i, "File", i, "", [""]) for i in ids], TREE)
    routes = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}") for i in range(100)] + [(100, "n7", "n7")], "idx long, source string, target string")
    assert {r.idx for r in view.highlighted(routes, nodes, "n50").collect()} == {49, 50}
    assert merge.incident_edges(routes).filter("idx = 100").count() == 2


def test_names_paths_styles(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(names.call_target(F.lit("Foo::new().bar"))) == "new().bar"
    assert one(names.impl_name(F.lit(None).cast("string"), F.lit("Foo"))) == "impl Foo"
    assert one(names.rust_visibility(F.lit("pub(super)"))) == "Protected"
    assert one(names.unquoted(F.lit("'\"x\"'"))) == "x"
    assert one(paths.normalise(F.lit("/a/./b/../../../c"))) == "c"
    assert one(paths.without_suffix(F.lit("a/.env"))) == "a/.env"
    assert one(paths.crate_to_path(F.lit("crate::a::b"))) == "src/a/b"
    assert one(paths.repo_folder(F.lit("https://github.com/a/b.git/"))) == "b"
    assert one(style.darkened(F.lit("#3b82f6"))) == "#0e203d"
    assert one(style.percent_to_share(F.lit("42abc"))) == 0.42
    assert edge_kinds(spark).count() == 7 and min(EDGE_KINDS, key=lambda k: EDGE_KINDS[k][2]) == "VariableUsage"
    assert len({v[0] for v in BLOCK_KINDS.values()}) == 10


def steps(points):
    return [(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, points[1:], strict=False)]


@pytest.mark.parametrize("target,side", [((200, 0, 40, 40), "left"), ((0, 200, 40, 40), "top"), ((200, 0, 40, 40), "right"), ((60, 10, 40, 40), "bottom")])
@pytest.mark.parametrize("hint", [(), ((0.0, 20.0), (60.0, 20.0), (30.0, 20.0), (200.0, 20.0))])
def test_routes_respect_their_sides(target, side, hint):
    source = (0.0, 0.0, 40.0, 40.0)
    (route,) = batch([(list(hint), source, target, source, target, (side, 20.0), (side, 20.0))])
    assert by_row._respects(route, side, side)
    assert all(dx == 0 or dy == 0 for dx, dy in steps(route))
    assert route[0] == by_row._on_side(source, side, 20.0) and route[-1] == by_row._on_side(target, side, 20.0)


def test_moved_routes():
    a, b = (0.0, 0.0, 40.0, 40.0), (100.0, 0.0, 40.0, 40.0)
    line = [(40.0, 20.0), (100.0, 20.0)]
    ends = (("right", 20.0), ("left", 20.0))
    resolved = lambda *row: batch([row])[0]
    assert resolved(line, a, b, a, b, *ends) == line
    moved = [(x + 5, y + 9, w, h) for x, y, w, h in (a, b)]
    assert resolved(line, a, b, *moved, *ends) == [(45.0, 29.0), (105.0, 29.0)]
    assert by_row._respects(resolved(line, a, b, a, (100.0, 90.0, 40.0, 40.0), *ends), "right", "left")
    assert routing.simplified(routing.Lines.of([[(0, 0), (0.2, 0.3), (5, 0), (9, 0), (9, 4)]])).tolist() == [[(0, 0), (9, 0), (9, 4)]]


def test_polyline_columns(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 0.4, 0.8, 3)])
    kept = spark.range(1).select(geometry.without_repeats(points).alias("p")).first().p
    assert [p.x for p in kept] == [0.0, 0.8, 3.0]


def test_layout(spark):
    nodes = spark.createDataFrame([(f"n{i}", "File") for i in range(9)], "id string, type string")
    visible = spark.createDataFrame([(i, f"n{8 - i}") for i in range(9)] + [(-1, "unknown")], "pos long, id string")
    boxes = {r.node_id: (r.x, r.y, r.width, r.height) for r in layout.grid_layout(visible, nodes).collect()}
    assert boxes["n8"] == (20.0, 20.0, 180.0, 40.0) and boxes["n0"] == (20.0, 80.0, 180.0, 40.0)
    df = layout.grid_layout(visible, nodes)
    views = spark.createDataFrame([(1, 0.0, 0.0, 10000.0, 10000.0), (2, 5000.0, 0.0, 1.0, 1.0)], "viewport_id long, x double, y double, width double, height double")
    assert layout.viewport_join(df, views).count() == 9
    scaled = layout.fit_scale(layout.world_bounds(df), 1e6, 1e6).first()
    assert scaled.scale == 1.0 and math.isclose(scaled.max_x, 20 + 220 * 7 + 180)


RUN = [
    ("r", 0, "FileStart", "a", None, None, None, None),
    ("r", 1, "FileDone", "a", 3, None, None, None),
    ("r", 2, "FileStart", "b", None, None, None, None),
    ("r", 3, "Error", "b", None, "bad", None, None),
    ("q", 0, "FileStart", "c", None, None, None, None),
    ("r", 4, "Complete", None, None, None, 2, 3),
]
EVENT = "run_id string, seq long, type string, path string, blocks long, message string, total_files long, total_blocks long"


def test_progress_in_batch_and_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame(RUN, EVENT)
    batch = progress.fold(events)
    rows = {r.run_id: r for r in batch.collect()}
    assert (rows["r"].current_path, rows["r"].parsed_files, rows["r"].parsed_blocks, rows["r"].n_errors, rows["r"].complete) == ("b", 2, 3, 1, True)
    assert (rows["q"].parsed_files, rows["q"].total_files, rows["q"].complete) == (0, None, False)
    assert [r.message for r in progress.errors(events).collect()] == ["bad"]
    events.repartition(3).write.json(str(tmp_path / "in"))
    stream = lambda: progress.read_event_files(spark, str(tmp_path / "in"))
    progress.watch_progress(stream(), "folded", str(tmp_path / "state")).awaitTermination(60)
    assert set(spark.table("folded").collect()) == set(batch.collect())
    changed = {}
    keep = lambda rows, _: changed.update({r.run_id: r for r in rows.collect()})
    progress.write_progress(stream(), str(tmp_path / "other"), to_batch=keep).awaitTermination(60)
    assert set(changed.values()) == set(batch.collect())
    results = spark.createDataFrame([(0, "a", 3, None), (1, "b", None, "bad")], "seq long, path string, blocks long, message string")
    again = progress.fold(progress.file_events(results, "r")).first()
    assert (again.parsed_files, again.parsed_blocks, again.n_errors) == (2, 3, 1)
    assert tuple(progress.run_totals(results).first()) == (2, 3)


def test_closure_without_paths_has_no_limit_of_rows_or_levels(spark):
    chain = [(str(i), str(i - 1) if i else None) for i in range(150)] + [("lone", None), ("twig", "3")]
    nodes = spark.createDataFrame(chain, "id string, container_id string")
    found = sorted((r.id, r.ancestor) for r in hierarchy.closure_by_recursion(nodes).collect())
    assert found == sorted([(str(i), str(j)) for i in range(150) for j in range(i)] + [("twig", str(j)) for j in range(4)])
    assert hierarchy.closure_by_recursion(nodes.limit(0)).count() == 0
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")  # a stand-in for the default of a million
    try:
        assert hierarchy.closure_by_recursion(nodes.filter("id < '2'")).count() > 50
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    with pytest.raises(ValueError):
        hierarchy.closure_by_recursion(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, container_id string"))


def test_row_numbers_follow_the_order(spark):
    from loomgraph.operators import numbering

    rows = spark.range(1000).selectExpr("id", "pmod(id * 7919, 1009) as k").repartition(7)
    found = numbering.with_row_numbers(rows, "k").collect()
    assert [r.number for r in sorted(found, key=lambda r: r.k)] == list(range(1000))
    assert numbering.with_row_numbers(rows.limit(0), "k").count() == 0


def test_containers_grow_with_what_they_hold(spark):
    from loomgraph.operators import layout

    nodes = spark.createDataFrame(
        [("", "Directory", None, []), ("a", "Directory", "", [""]), ("a/f", "File", "a", ["", "a"]), ("b", "Directory", "", [""])],
        "id string, type string, container_id string, ancestors array<string>",
    )
    boxes = spark.createDataFrame(
        [("", 0.0, 0.0, 1.0, 1.0), ("a", 0.0, 0.0, 1.0, 1.0), ("a/f", -300.5, 50.0, 180.0, 40.0), ("b", 5.0, 5.0, 1.0, 1.0)],
        "node_id string, x double, y double, width double, height double",
    )
    found = {r.node_id: tuple(r)[1:] for r in layout.fitted_containers(boxes, nodes, nodes.select("id")).collect()}
    assert found == {"a": (-310.5, 0.0, 511.0, 100.0), "": (-320.5, -30.0, 531.0, 140.0)}
    assert layout.fitted_containers(boxes, nodes, nodes.select("id").limit(0)).count() == 0
    assert layout.fitted_containers(boxes.limit(0), nodes, nodes.select("id")).count() == 0


def test_view_is_a_value(spark):
    from loomgraph.operators.view import View
    from loomgraph.sources.view_state import restore_wanted

    nodes = spark.createDataFrame(
        [("", "Directory", None, []), ("a", "File", "", [""]), ("b", "File", "", [""]), ("a::f@1", "CodeBlock", "a", ["", "a"])],
        "id string, type string, container_id string, ancestors array<string>",
    )
    edges = spark.createDataFrame([("a", "b", "Import"), ("b", "a::f@1", "FunctionCall")], "source string, target string, kind string")
    start = View.of(nodes)
    shown = lambda v: {r.id for r in v.shown().collect()}
    assert shown(start) == {"a", "b", "a::f@1"} and start.edges(edges).count() == 2
    assert shown(start.toggle_expanded("a")) == {"a", "b"}
    assert shown(start.set_expanded("a", False).set_expanded("a", True)) == {"a", "b", "a::f@1"}
    assert shown(start.toggle_visible("a")) == {"b"} and shown(start.toggle_visible("a").toggle_visible("a")) == shown(start)
    assert [r.kind for r in start.toggle_kind("FunctionCall").edges(edges).collect()] == ["Import"]
    with pytest.raises(ValueError):
        start.toggle_kind("NoSuchKind")
    assert restore_wanted(["app"]) and not restore_wanted(["app", "--norestore"])


def test_lists_of_hubs_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(merge, "LISTED", 10)
    edges = spark.createDataFrame([("hub", f"n{i}", i) for i in range(95)] + [("few", "n1", 200)], "source string, target string, seq long")
    rows = merge.adjacency(edges).collect()
    assert {r.part for r in rows if r.node == "few"} == {0} and len([r for r in rows if r.node == "hub"]) > 5
    assert sorted(n.seq for r in rows if r.node == "hub" for n in r.neighbours) == list(range(95))
    nodes = spark.createDataFrame([(f"n{i}", "d", i) for i in range(25)], "id string, container_id string, child_ordinal long")
    assert [len(r.children) for r in merge.children(nodes).orderBy("part").collect()] == [10, 10, 5]


def test_viewports_of_any_size_match_brute_force(spark):
    from loomgraph.operators import layout

    rng = random.Random(2)
    rect = lambda: (rng.uniform(-3e3, 3e3), rng.uniform(-3e3, 3e3), rng.choice([0.0, 5.0, 400.0, 1e4, 1e6]), rng.choice([1.0, 60.0, 3e3, 1e6]))
    boxes, views = ([(f"{p}{i}", *rect()) for i in range(60)] for p in "bv")
    shape = "x double, y double, width double, height double"
    found = layout.viewport_join(spark.createDataFrame(boxes, f"node_id string, {shape}"), spark.createDataFrame(views, f"viewport_id string, {shape}"))
    meets = lambda a, b: a[1] <= b[1] + b[3] and a[1] + a[3] >= b[1] and a[2] <= b[2] + b[4] and a[2] + a[4] >= b[2]
    assert sorted(map(tuple, found.collect())) == sorted((v[0], b[0]) for v in views for b in boxes if meets(b, v))


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from loomgraph import shared

    with shared.scratch(spark):
        kept = shared.written(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert kept.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_edge_index_in_bounded_rows(spark):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), rng.choice("xyz"), rng.choice(["Import", "FunctionCall"]), k) for k in range(50)] + [("hub", f"t{k}", "Import", 50 + k) for k in range(25)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, seq long").repartition(3)
    indexed = merge.positioned(edges)
    found = {(r.node, r.chunk): r for r in merge.adjacency_rows(indexed, listed=10).collect()}
    for node in ("a", "b", "c", "hub"):
        own = [(t, k) for s, t, _, k in rows if s == node]
        listed = [tuple(e) for c in range(-(-len(own) // 10)) for e in found[node, c].entries]
        assert listed == own and all(len(r.entries) <= 10 and r.degree == len(own) for (n, _), r in found.items() if n == node)
    slots = sorted((r.first_slot, len(r.entries)) for r in found.values())
    assert all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:]))
    last = {(s, t, kind): k for s, t, kind, k in rows}
    assert {(r.source, r.target, r.kind): r.idx for r in merge.last_positions(indexed).collect()} == last


def test_json_in_parts_is_one_document(spark, tmp_path):
    ids = ["", "a", "a/b", "we ird\"]:{/x", "é,"]
    nodes = spark.createDataFrame([(i, "Directory", i.rpartition("/")[2], None, k) for k, i in enumerate(ids)], "id string, type string, name string, file_path string, child_ordinal long")
    nodes = hierarchy.with_ancestors(nodes.unionByName(spark.createDataFrame([('we ird"]:{', "Directory", "w", None, 9)], nodes.schema)))
    edges = spark.createDataFrame([("a", ids[3], "Import", 7, 1), ("a", "a/b", "Import", 2, 1), (ids[4], "a", "FunctionCall", 1, 0)], "source string, target string, kind string, weight long, seq long")
    graph_json.write_parts(nodes.repartition(4), edges.repartition(3), str(tmp_path / "graph"), root="r\"")
    text = "".join(p.read_text() for p in sorted((tmp_path / "graph").glob("part-*")))
    document = json.loads(text)
    assert set(document["nodes"]) == {*ids, 'we ird"]:{'} and document["root"] == "r\""
    assert [(e["source"], e["target"]) for e in document["edges"]] == [(ids[4], "a"), ("a", "a/b"), ("a", ids[3])]
    assert document["nodes"]["a"]["children"] == ["a/b"]
    back, links = graph_json.read_parts(spark, str(tmp_path / "graph"))
    assert {(r.id, r.parent_id, r.name) for r in back.collect()} == {(r.id, r.container_id, r.name) for r in nodes.collect()}
    assert sorted(map(tuple, links.collect()), key=lambda r: r[4]) == [(e["source"], e["target"], e["kind"], e["weight"], k) for k, e in enumerate(document["edges"])]
    graph_json.write_parts(nodes.limit(0), edges.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"nodes": {}, "edges": [], "root": ""}
