"""References resolve by classes of blocks; edges are not shuffled."""

import random
from collections import defaultdict

from loomgraph.operators import resolve


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_hand(refs, symbols):
    known, found = {s for s, _ in symbols}, defaultdict(list)
    for source, kind, name, seq in refs:
        symbol = (name.split("<")[0] if kind == "TypeReference" else name).rsplit("::", 1)[-1]
        symbol = name if kind == "TypeReference" and symbol not in known else symbol
        for s, node in symbols:
            if s == symbol and node != source:
                found[source, node, kind].append(seq)
    return {(*k, len(v), min(v)) for k, v in found.items()}


def test_edges_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(6)] + ["f::n1", "f::n2", "n3<T>", "g::n7", "nowhere", "n9<U>"]
    # Blocks under several names, one name twice for one block, and blocks that refer to themselves.
    symbols = [(rng.choice(names[:-2]), f"b{rng.randrange(12)}") for _ in range(40)]
    symbols += [(f"f::{s}" if "::" not in s else s, b) for s, b in symbols[:20]] + symbols[:5] + [(None, "b1")]
    refs = [(f"b{rng.randrange(14)}", rng.choice(["FunctionCall", "TypeReference"]), rng.choice(names), i) for i in range(300)]
    asked = spark.createDataFrame(refs, "from_node string, kind string, name string, seq long")
    table = spark.createDataFrame(symbols, "symbol string, node_id string")
    edges = [tuple(r) for r in resolve.resolve_symbols(asked, table).select("source", "target", "kind", "weight", "seq").collect()]
    assert len(edges) == len(set(edges))
    assert set(edges) == by_hand(refs, [s for s in symbols if s[0] is not None])


def test_what_all_blocks_of_a_name_share_is_merged_before_the_edges_are_made(spark):
    nodes = spark.createDataFrame([(f"f::x@{i}", "CodeBlock", "x", "f") for i in range(300)], "id string, type string, name string, file_path string")
    refs = nodes.selectExpr("id as from_node", "'FunctionCall' as kind", "name", "cast(1 as long) as seq")
    edges = resolve.resolve_symbols(refs, resolve.symbol_table(nodes))
    assert edges.count() == 300 * 299
    steps = [line.strip(" :+-") for line in plan(edges).splitlines()]
    first = next(i for i, s in enumerate(steps) if s.startswith("Join"))
    assert not any(s.startswith("Aggregate") for s in steps[:first])


def test_classes_in_several_parts_and_turns_give_the_same_edges(spark, monkeypatch):
    monkeypatch.setattr(resolve, "LISTED", 3)
    monkeypatch.setattr(resolve, "ASKED", 4)
    rng = random.Random(5)
    symbols = [(f"n{rng.randrange(3)}", f"b{i}") for i in range(30)] + [("f::n1", "b3"), ("n1", "b3")]
    refs = [(f"b{rng.randrange(40)}", rng.choice(["FunctionCall", "TypeReference"]), rng.choice(["n0", "n1", "f::n1", "n2", "n3"]), i) for i in range(200)]
    asked = spark.createDataFrame(refs, "from_node string, kind string, name string, seq long")
    table = spark.createDataFrame(symbols, "symbol string, node_id string")
    edges = [tuple(r) for r in resolve.resolve_symbols(asked, table).select("source", "target", "kind", "weight", "seq").collect()]
    assert len(edges) == len(set(edges))
    assert set(edges) == by_hand(refs, symbols)


def test_symbols_that_nobody_asks_for_do_not_tell_classes_apart(spark, monkeypatch):
    tables, write = [], resolve.written
    monkeypatch.setattr(resolve, "written", lambda df: tables.append(write(df)) or tables[-1])
    nodes = spark.range(40).selectExpr("concat('f', id, '::x@1') as id", "'CodeBlock' as type", "'x' as name", "concat('f', id) as file_path")
    refs = nodes.selectExpr("id as from_node", "'FunctionCall' as kind", "name", "cast(1 as long) as seq")
    assert resolve.resolve_symbols(refs, resolve.symbol_table(nodes)).count() == 40 * 39
    assert tables[1].select("names").distinct().count() == 1
