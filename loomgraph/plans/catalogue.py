"""Every graph query over the given tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.extract import job
from loomgraph.functions import names, paths, style
from loomgraph.operators import containment, geometry, hierarchy, intervals, layout, merge, numbering, resolve, spatial, view
from loomgraph.plans import sources_workload as sw
from loomgraph.plans import workload as w
from loomgraph.schema import BLOCK_ICONS, BLOCK_KINDS, EDGE_KINDS, NO_BLOCK_COLOUR, NO_ICON, NODE_COLOURS, NODE_ICONS, NODE_SIZES, SUFFIXES
from loomgraph.shared import durable, scratch, shared_folder, shuffles_deleted, written
from loomgraph.sources import graph_json
from loomgraph.streaming import live, progress, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _case(column: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


EDGE_COLOUR = _case("kind", {k: f"'{v[0]}'" for k, v in EDGE_KINDS.items()}, "'#64748b'")
EDGE_WIDTH = _case("kind", {k: f"{v[1]}::DOUBLE" for k, v in EDGE_KINDS.items()}, "2.0::DOUBLE")
EDGE_ALPHA = _case("kind", {k: f"{v[2]}::DOUBLE" for k, v in EDGE_KINDS.items()}, "0.85::DOUBLE")
BLOCK_PREFIX = _case("kind", {k: f"'{v[1]}'" for k, v in BLOCK_KINDS.items()})
BLOCK_COLOUR = _case("kind", {k: f"'{v[0]}'" for k, v in BLOCK_KINDS.items()})
WIDTH = _case("type", {k: f"{v[0]}::DOUBLE" for k, v in NODE_SIZES.items()})
HEIGHT = _case("type", {k: f"{v[1]}::DOUBLE" for k, v in NODE_SIZES.items()})


# Edges.


@query(f"WITH {w.TREE}, {w.RAW} SELECT source, target, kind, CAST(least(sum(weight), 4294967295) AS BIGINT) AS weight, min(seq) AS seq FROM raw GROUP BY ALL")
def edge_merge(spark, d):
    return merge.merge_edges(w.raw_edges(spark, d))


@query(
    f"""WITH {w.TREE}, {w.RAW} SELECT source, target, kind, CAST(least(sum(quantity * 100000000), 4294967295) AS BIGINT) AS weight, min(seq) AS seq
    FROM raw GROUP BY source, target, kind"""
)
def edge_merge_saturating(spark, d):
    return merge.merge_edges(w.raw_edges(spark, d).withColumn("weight", F.col("quantity") * 100000000))


@query(f"WITH {w.TREE}, {w.RAW} SELECT DISTINCT source, target, 'Import' AS kind, 1::BIGINT AS weight FROM raw")
def import_dedup(spark, d):
    return merge.distinct_imports(w.raw_edges(spark, d))


def _listed(lists: DataFrame) -> DataFrame:
    text = F.transform("neighbours", lambda n: F.concat_ws(":", n["neighbour"], n["seq"].cast("string")))
    return lists.select("node", "part", F.size("neighbours").cast("long").alias("n"), F.array_join(text, ",").alias("neighbours"))


def _adjacency_sql(node: str, neighbour: str, parts: int) -> str:
    return f"""WITH {w.TREE}, {w.RAW} SELECT {node} AS node, CAST(seq % {parts} AS INTEGER) AS part, count(*) AS n,
      string_agg({neighbour} || ':' || seq, ',' ORDER BY {neighbour}, seq) AS neighbours FROM raw GROUP BY {node}, seq % {parts}"""


@query(_adjacency_sql("source", "target", 1))
def adjacency_forward(spark, d):
    return _listed(merge.adjacency(w.raw_edges(spark, d)))


@query(_adjacency_sql("target", "source", 8))
def adjacency_reverse(spark, d):
    return _listed(merge.adjacency(w.raw_edges(spark, d), reverse=True, parts=8))


@query(
    f"""WITH {w.TREE}, {w.RAW} SELECT kind, node, count(*) AS degree
    FROM (SELECT kind, source AS node FROM raw UNION ALL SELECT kind, target FROM raw) GROUP BY kind, node"""
)
def degree_by_kind(spark, d):
    return merge.degree_by_kind(w.raw_edges(spark, d))


@query(f"WITH {w.NODES}, {w.RAW} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT source, target, kind FROM raw)) AS edge_count")
def graph_counts(spark, d):
    n = w.nodes(spark, d).agg(F.count(F.lit(1)).alias("node_count"))
    return n.crossJoin(F.broadcast(merge.merge_edges(w.raw_edges(spark, d)).agg(F.count(F.lit(1)).alias("edge_count"))))


@query(f"WITH {w.TREE}, {w.RAW} SELECT source, target, kind, count(*) AS count FROM raw WHERE kind IN ('FunctionCall', 'TypeReference') GROUP BY ALL")
def kind_filter(spark, d):
    return merge.counted_edges(merge.of_kinds(w.raw_edges(spark, d), ["FunctionCall", "TypeReference"]))


@query(
    f"""WITH {w.TREE}, {w.RAW}, idx AS (SELECT seq AS idx, source, target FROM raw)
    SELECT node, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx
    FROM (SELECT source AS node, idx FROM idx UNION ALL SELECT target, idx FROM idx) GROUP BY node"""
)
def incident_index(spark, d):
    pairs = merge.incident_edges(w.raw_edges(spark, d).withColumn("idx", F.col("seq")))
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


_INDEXED = "indexed AS (SELECT *, row_number() OVER (ORDER BY seq, source, target, kind) - 1 AS idx FROM raw)"


def _index_sql(node: str, neighbour: str) -> str:
    return f"""WITH {w.TREE}, {w.RAW}, {_INDEXED},
    slots AS (SELECT {node} AS node, {neighbour} AS neighbour, idx, row_number() OVER (ORDER BY {node}, idx) - 1 AS slot, count(*) OVER (PARTITION BY {node}) AS degree,
      (row_number() OVER (PARTITION BY {node} ORDER BY idx) - 1) // 20 AS chunk FROM indexed)
    SELECT node, chunk, degree, min(slot) AS first_slot, string_agg(neighbour || ':' || idx, ',' ORDER BY idx) AS entries FROM slots GROUP BY node, chunk, degree"""


def _index_rows(spark, d, reverse: bool) -> DataFrame:
    rows = merge.adjacency_rows(merge.positioned(w.raw_edges(spark, d)), reverse=reverse, listed=20)
    text = F.transform("entries", lambda e: F.concat_ws(":", e["neighbour"], e["idx"].cast("string")))
    return rows.withColumn("entries", F.array_join(text, ","))


@query(_index_sql("source", "target"))
def edge_index_forward(spark, d):
    return _index_rows(spark, d, False)


@query(_index_sql("target", "source"))
def edge_index_reverse(spark, d):
    """Suppliers have many edges, which come in rows of 20."""
    return _index_rows(spark, d, True)


@query(f"WITH {w.TREE}, {w.RAW}, {_INDEXED} SELECT source, target, kind, max(idx) AS idx FROM indexed GROUP BY source, target, kind")
def edge_key_index(spark, d):
    return merge.last_positions(merge.positioned(w.raw_edges(spark, d)))


def _json_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """A graph written as JSON in parts and read again."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    with scratch(spark):
        with shuffles_deleted(spark):
            raw = written(w.raw_edges(spark, d))
        graph_json.write_parts(w.nodes(spark, d), merge.merge_rare(raw), path, compression="gzip")
    return graph_json.read_parts(spark, path)


@query(
    f"""WITH {w.NODES} SELECT id, type, name, language, kind, container_id AS parent_id,
      CASE WHEN container_id IS NOT NULL THEN row_number() OVER (PARTITION BY container_id ORDER BY child_ordinal, id) - 1 END AS child_ordinal FROM nodes"""
)
def json_parts_nodes(spark, d):
    return _json_parts(spark, d)[0].select("id", "type", "name", "language", "kind", "parent_id", "child_ordinal")


@query(
    f"""WITH {w.TREE}, {w.RAW}, merged AS (SELECT source, target, kind, least(sum(weight), 4294967295) AS weight, min(seq) AS first FROM raw GROUP BY source, target, kind)
    SELECT source, target, kind, CAST(weight AS BIGINT) AS weight, row_number() OVER (ORDER BY first, source, target, kind) - 1 AS seq FROM merged"""
)
def json_parts_edges(spark, d):
    return _json_parts(spark, d)[1]


# Nodes.


@query(f"WITH {w.NODES} SELECT type, kind, language, count(*) AS n FROM nodes GROUP BY type, kind, language")
def nodes_by_type(spark, d):
    return w.nodes(spark, d).groupBy("type", "kind", "language").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {w.NODES} SELECT id, id AS path, language FROM nodes WHERE type = 'File' AND language IS NOT NULL")
def known_language_files(spark, d):
    return w.nodes(spark, d).filter("type = 'File' and language is not null").select("id", "path", "language")


@query(f"WITH {w.NODES} SELECT id, type, name, container_id FROM nodes WHERE id = 'EUROPE/NATION_3' OR id LIKE '%@7'")
def point_lookup(spark, d):
    found = w.nodes(spark, d).filter((F.col("id") == "EUROPE/NATION_3") | F.endswith("id", F.lit("@7")))
    return found.select("id", "type", "name", "container_id")


@query(
    f"""WITH {w.NODES} SELECT container_id, child_ordinal // {merge.LISTED} AS part, count(*) AS n, string_agg(id, ',' ORDER BY child_ordinal, id) AS children FROM nodes
    WHERE container_id IS NOT NULL GROUP BY container_id, child_ordinal // {merge.LISTED}"""
)
def children_list(spark, d):
    lists = merge.children(w.nodes(spark, d))
    return lists.select("container_id", "part", F.size("children").cast("long").alias("n"), F.array_join("children", ",").alias("children"))


@query(
    """SELECT o_orderpriority || '@' || o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status
    FROM orders GROUP BY o_orderpriority, o_custkey"""
)
def last_definition(spark, d):
    o = w.table(spark, d, "orders").select(
        F.concat("o_orderpriority", F.lit("@"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status")
    )
    return merge.last_definitions(o)


@query(f"WITH {w.NODES} SELECT id, a AS ancestor, CAST(depth AS INTEGER) AS depth FROM (SELECT id, unnest(ancestors) AS a, unnest(range(0, len(ancestors))) AS depth FROM nodes)")
def ancestor_closure(spark, d):
    return hierarchy.closure(w.nodes(spark, d))


@query(
    f"""WITH RECURSIVE {w.NODES}, up AS (SELECT id, container_id AS ancestor FROM nodes WHERE container_id IS NOT NULL AND type <> 'CodeBlock'
      UNION ALL SELECT up.id, n.container_id FROM up JOIN nodes n ON up.ancestor = n.id WHERE n.container_id IS NOT NULL)
    SELECT id, ancestor FROM up"""
)
def ancestor_closure_recursive(spark, d):
    return hierarchy.closure_by_recursion(w.nodes(spark, d).filter("type <> 'CodeBlock'").select("id", "container_id"))


@query("SELECT DISTINCT unnest(['', r_name, r_name || '/' || n_name]) AS id FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def missing_directories(spark, d):
    return hierarchy.missing_directories(w.customer_files(spark, d).select(F.col("id").alias("path")))


@query(f"WITH {w.NODES} SELECT id, type FROM nodes WHERE id = 'ASIA' OR list_contains(ancestors, 'ASIA')")
def subtree(spark, d):
    return hierarchy.subtree(w.nodes(spark, d), "ASIA").select("id", "type")


@query(f"WITH {w.NODES} SELECT id, CAST(len(ancestors) AS INTEGER) AS depth, array_to_string(list_append(ancestors, id), '>') AS place FROM nodes WHERE type <> 'CodeBlock'")
def tree_order(spark, d):
    return hierarchy.tree_order(w.nodes(spark, d).filter("type <> 'CodeBlock'")).withColumn("place", F.array_join("place", ">"))


_TREE_NUMBERS = """numbers AS (SELECT id, type, ancestors, row_number() OVER (ORDER BY list_append(ancestors, id)) - 1 AS start FROM nodes),
below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(ancestors) AS a FROM nodes) GROUP BY a)"""


def _tree(spark, d) -> DataFrame:
    return intervals.write_intervals(w.nodes(spark, d), f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}")


@query(
    f"""WITH {w.NODES}, {_TREE_NUMBERS} SELECT id, start, start + 1 + coalesce(n, 0) AS "end", CAST(len(ancestors) AS INTEGER) AS depth
    FROM numbers LEFT JOIN below USING (id)"""
)
def tree_intervals(spark, d):
    return intervals.with_intervals(w.nodes(spark, d)).select("id", "start", "end", "depth")


@query(f"WITH {w.NODES} SELECT id, type FROM nodes WHERE id = 'ASIA' OR list_contains(ancestors, 'ASIA')")
def subtree_by_range(spark, d):
    return intervals.subtree(_tree(spark, d), "ASIA").select("id", "type")


@query(
    f"""WITH {w.NODES}, {w.RAW}, below AS (SELECT id FROM nodes WHERE id = 'EUROPE/NATION_3' OR list_contains(ancestors, 'EUROPE/NATION_3'))
    SELECT source, target, kind, seq FROM raw WHERE source IN (SELECT id FROM below) OR target IN (SELECT id FROM below)"""
)
def edges_by_range(spark, d):
    """Edges that touch a subtree, by the numbers of their ends."""
    tree = _tree(spark, d)
    edges = intervals.numbered_edges(w.raw_edges(spark, d), tree)
    return intervals.touching(edges, tree, "EUROPE/NATION_3").select("source", "target", "kind", "seq")


_DRAWN = f"""WITH {w.NODES}, {w.VIEW}, matches AS (SELECT DISTINCT unnest(list_append(ancestors, id)) AS id FROM nodes WHERE contains(lower(name), lower('1'))),
    rows AS (SELECT id, type, ancestors FROM nodes WHERE id <> '' AND id IN (SELECT id FROM matches)
      AND id NOT IN (SELECT i FROM (SELECT id AS i, unnest(ancestors) AS a FROM nodes) WHERE a <> '' AND a NOT IN (SELECT id FROM expanded))),
    drawn AS (SELECT id, type, CAST(len(ancestors) - 1 AS INTEGER) AS depth, row_number() OVER (ORDER BY list_append(ancestors, id)) - 1 AS ordinal FROM rows)"""


def _drawn_rows(spark, d) -> DataFrame:
    n, tree = w.nodes(spark, d), _tree(spark, d)
    return intervals.drawn_rows(tree, hierarchy.search(tree, "1"), w.expanded(n)).select("id", "type", "depth", "ordinal")


@query(f"{_DRAWN} SELECT * FROM drawn")
def drawn_tree(spark, d):
    """Rows of the drawn tree in their order, under a search and with closed nodes."""
    return _drawn_rows(spark, d)


@query(f"{_DRAWN} SELECT * FROM drawn WHERE ordinal BETWEEN 100 AND 149")
def drawn_page(spark, d):
    return intervals.page(_drawn_rows(spark, d), 2, 50)


@query(f"WITH {w.NODES}, {w.VIEW}, {w.SHOWN} SELECT id, type FROM shown")
def shown_tree(spark, d):
    n = durable(w.nodes(spark, d))
    return hierarchy.shown(n, w.visible(n), w.expanded(n)).select("id", "type")


@query(f"WITH {w.NODES}, {w.VIEW}, {w.SHOWN}, lifted_to AS (SELECT id FROM shown), {w.PLACE} SELECT id, shown_id FROM place")
def visible_ancestor(spark, d):
    n = durable(w.nodes(spark, d))
    return hierarchy.nearest_shown(n, durable(hierarchy.shown(n, w.visible(n), w.expanded(n)).select("id")))


@query(f"WITH {w.NODES}, {w.RAW}, {w.ROLLED} SELECT source, target, kind, count, weight FROM rolled")
def rollup_edges(spark, d):
    n = w.nodes(spark, d)
    return hierarchy.roll_up(w.raw_edges(spark, d), n, w.directories(n))


def _search(q: str) -> str:
    return f"""WITH {w.NODES} SELECT DISTINCT unnest(list_append(ancestors, id)) AS id FROM nodes WHERE contains(lower(name), lower('{q}'))"""


@query(_search("on_1"))
def search_with_ancestors(spark, d):
    return hierarchy.search(w.nodes(spark, d), "on_1")


@query(_search("LE e"))
def search_untrimmed(spark, d):
    return hierarchy.search(w.nodes(spark, d), "LE e")


@query(
    f"""WITH {w.NODES}, {w.VIEW}, below AS (SELECT id FROM nodes WHERE id = 'ASIA' OR list_contains(ancestors, 'ASIA'))
    SELECT id FROM visible WHERE NOT EXISTS (SELECT 1 FROM visible WHERE id = 'ASIA') OR id NOT IN (SELECT id FROM below)
    UNION SELECT id FROM below WHERE NOT EXISTS (SELECT 1 FROM visible WHERE id = 'ASIA')"""
)
def toggle_visible(spark, d):
    n = w.nodes(spark, d)
    return hierarchy.toggle_subtree(n, w.visible(n), "ASIA")


@query(f"WITH {w.NODES}, {w.VIEW} SELECT id FROM expanded WHERE id <> 'ASIA' UNION SELECT 'ASIA' WHERE NOT EXISTS (SELECT 1 FROM expanded WHERE id = 'ASIA')")
def toggle_expanded(spark, d):
    return hierarchy.toggle_one(w.expanded(w.nodes(spark, d)), "ASIA")


@query(f"WITH {w.NODES} SELECT id FROM nodes WHERE type IN ('Directory', 'File') AND id IN (SELECT container_id FROM nodes)")
def default_expanded(spark, d):
    return hierarchy.default_expanded(w.nodes(spark, d))


@query(f"WITH {w.NODES}, saved AS (SELECT n_name AS id FROM nation UNION ALL SELECT r_name FROM region) SELECT id FROM nodes WHERE id IN (SELECT id FROM saved)")
def restore_state(spark, d):
    n = w.nodes(spark, d)
    saved = w.table(spark, d, "nation").select(F.col("n_name").alias("id")).union(w.table(spark, d, "region").select("r_name"))
    return hierarchy.restored(saved, n, hierarchy.default_expanded(n))


# Sub-graphs and views.


@query(
    f"""WITH {w.NODES}, wanted AS (SELECT c_custkey AS pos, nation_id || '/' || c_name AS id FROM customer JOIN places ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
      UNION ALL SELECT -1, 'ASIA' UNION ALL SELECT -2, 'ASIA' UNION ALL SELECT -3, 'nowhere')
    SELECT pos, nodes.id, type, name FROM wanted JOIN nodes ON nodes.id = wanted.id"""
)
def subgraph_nodes(spark, d):
    wanted = w.customer_files(spark, d).filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pos"), "id")
    wanted = wanted.union(spark.createDataFrame([(-1, "ASIA"), (-2, "ASIA"), (-3, "nowhere")], "pos long, id string"))
    return view.subgraph(w.nodes(spark, d), w.raw_edges(spark, d), wanted).nodes.select("pos", "id", "type", "name")


_HALF = "half AS (SELECT id FROM nodes WHERE child_ordinal % 2 = 0)"


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_HALF} SELECT source, target, kind, seq FROM raw
    WHERE kind IN ('FunctionCall', 'MethodCall') AND source IN (SELECT id FROM half) AND target IN (SELECT id FROM half)"""
)
def subgraph_edges(spark, d):
    n = w.nodes(spark, d)
    half = n.filter("child_ordinal % 2 = 0").select("id")
    return view.subgraph(n, w.raw_edges(spark, d), half, ["FunctionCall", "MethodCall"]).edges.select("source", "target", "kind", "seq")


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_HALF} SELECT source, target, kind, count(*) AS count FROM raw
    WHERE source IN (SELECT id FROM half) AND target IN (SELECT id FROM half) GROUP BY ALL"""
)
def subgraph_aggregated(spark, d):
    n = w.nodes(spark, d)
    return view.subgraph(n, w.raw_edges(spark, d), n.filter("child_ordinal % 2 = 0").select("id")).aggregated


@query(
    f"""WITH {w.NODES}, {w.RAW}, {w.VIEW}, {w.SHOWN} SELECT source, target, kind, seq,
    source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) AS in_tree FROM raw"""
)
def edges_in_tree_split(spark, d):
    n = durable(w.nodes(spark, d))
    shown = hierarchy.shown(n, w.visible(n), w.expanded(n)).select("id")
    return view.split_by_tree(w.raw_edges(spark, d), shown).select("source", "target", "kind", "seq", "in_tree")


def _tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes and raw edges, written for queries that read them several times."""
    with shuffles_deleted(spark):
        return written(w.nodes(spark, d)), written(w.raw_edges(spark, d))


_PAIRS = """pairs AS (SELECT source, target FROM rolled UNION SELECT source, target FROM raw UNION SELECT r_name, 'nowhere' FROM region)"""


@query(
    f"""WITH {w.NODES}, {w.RAW}, {w.ROLLED}, {_PAIRS},
    direct AS (SELECT source, target, kind AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY seq, kind) AS r FROM raw) WHERE r = 1),
    joined AS (SELECT p.source, p.target, coalesce(rolled.kind, direct.k) AS kind FROM pairs p
      LEFT JOIN rolled ON p.source = rolled.source AND p.target = rolled.target LEFT JOIN direct ON p.source = direct.source AND p.target = direct.target)
    SELECT *, {EDGE_COLOUR} AS colour FROM joined"""
)
def edge_colour_lookup(spark, d):
    n, raw = _tables(spark, d)
    rolled = hierarchy.roll_up(raw, n, w.directories(n))
    nowhere = w.table(spark, d, "region").select(F.col("r_name").alias("source"), F.lit("nowhere").alias("target"))
    return view.edge_colours(raw, rolled, nowhere)


@query(
    f"""WITH {w.NODES}, {w.RAW}, below AS (SELECT id FROM nodes WHERE id = 'EUROPE/NATION_3' OR list_contains(ancestors, 'EUROPE/NATION_3'))
    SELECT DISTINCT seq AS idx FROM raw WHERE source IN (SELECT id FROM below) OR target IN (SELECT id FROM below)"""
)
def hover_highlight(spark, d):
    return view.highlighted(w.raw_edges(spark, d).withColumn("idx", F.col("seq")), w.nodes(spark, d), "EUROPE/NATION_3")


def _drawn(spark, d) -> DataFrame:
    """Edges with some of a kind that views hide from afar."""
    kind = F.when(F.col("quantity") % 10 == 0, "VariableUsage").otherwise(F.col("kind")).alias("kind")
    return w.raw_edges(spark, d).select("source", "target", kind).distinct()


def _draw_sql(level: str, opacity: float, width: float) -> str:
    hidden = "AND kind <> 'VariableUsage'" if level == "overview" else ""
    return f"""WITH {w.TREE}, {w.RAW}, k AS (SELECT source, target, CASE WHEN quantity % 10 = 0 THEN 'VariableUsage' ELSE kind END AS kind FROM raw),
    e AS (SELECT DISTINCT source, target, kind FROM k WHERE true {hidden})
    SELECT source, target, kind, {EDGE_ALPHA} * {opacity}::DOUBLE AS alpha, {EDGE_WIDTH} * {width}::DOUBLE AS width, {EDGE_COLOUR} AS colour FROM e
    WHERE {EDGE_ALPHA} * {opacity}::DOUBLE >= 0.05"""


@query(_draw_sql("overview", 0.5, 0.75))
def lod_draw_list(spark, d):
    return view.draw_list(_drawn(spark, d), 0.1)


@query(_draw_sql("minimap", 0.064, 0.5))
def faint_edge_cut(spark, d):
    """At this opacity calls are drawn, type references and variables are too faint."""
    return view.draw_list(_drawn(spark, d), 0.01, style.DetailSettings(minimap_opacity=0.064))


@query(
    f"""WITH {w.NODES} SELECT id, CASE WHEN type = 'CodeBlock' THEN {BLOCK_PREFIX} || ' ' || name ELSE name END AS label, {BLOCK_COLOUR} AS colour,
    type = 'File' OR type = 'Directory' AS shown_at_overview FROM nodes"""
)
def node_labels(spark, d):
    kind, type_ = F.col("kind"), F.col("type")
    return w.nodes(spark, d).select(
        "id",
        style.node_label(type_, kind, F.col("name")).alias("label"),
        style.block_colour(kind).alias("colour"),
        style.label_shown(type_, F.lit("overview")).alias("shown_at_overview"),
    )


@query(
    f"""WITH {w.NODES}, sizes AS (SELECT container_id AS c, count(*) AS n FROM nodes WHERE container_id IS NOT NULL GROUP BY container_id)
    SELECT id, CASE type WHEN 'CodeBlock' THEN kind || ' ' || name || ' | ' || 'order ' || child_ordinal
      WHEN 'File' THEN coalesce(language, 'unknown') || ' | ' || id ELSE coalesce(n, 0) || ' items' END AS tooltip
    FROM nodes LEFT JOIN sizes ON c = id"""
)
def tooltip(spark, d):
    return view.tooltips(w.nodes(spark, d).withColumn("signature", F.concat(F.lit("order "), F.col("child_ordinal").cast("string"))))


@query(
    f"""WITH {w.NODES}, {w.RAW}, {w.VIEW}, {w.SHOWN}, {w.ROLLED}, routed AS (SELECT DISTINCT source, target FROM raw WHERE seq % 3 = 0),
    parents AS (SELECT DISTINCT container_id AS id FROM nodes),
    e AS (SELECT source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) AS in_tree, (source, target) IN (SELECT (source, target) FROM routed) AS routed FROM raw)
    SELECT 'code_blocks' AS metric, count(*) FILTER (type = 'CodeBlock') AS value FROM nodes
    UNION ALL SELECT 'files_with_children', count(*) FILTER (type = 'File' AND id IN (SELECT id FROM parents WHERE id IS NOT NULL)) FROM nodes
    UNION ALL SELECT 'expanded_files', count(*) FILTER (type = 'File' AND id IN (SELECT id FROM expanded)) FROM nodes
    UNION ALL SELECT 'edges_in_tree', count(*) FILTER (in_tree) FROM e UNION ALL SELECT 'edges_not_in_tree', count(*) FILTER (NOT in_tree) FROM e
    UNION ALL SELECT 'edges_with_route', count(*) FILTER (routed) FROM e UNION ALL SELECT 'edges_without_route', count(*) FILTER (NOT routed) FROM e
    UNION ALL SELECT 'rolled_up', count(*) FROM rolled"""
)
def diagnostics(spark, d):
    n, raw = _tables(spark, d)
    shown = hierarchy.shown(n, w.visible(n), w.expanded(n)).select("id")
    rolled = hierarchy.roll_up(raw, n, w.directories(n))
    return view.diagnostics(n, raw, shown, w.expanded(n), rolled, raw.filter("seq % 3 = 0"))


# Names and paths.


@query(f"WITH {w.TREE}, {w.REFS} SELECT DISTINCT name, p_name AS looked_up FROM refs WHERE kind <> 'TypeReference'")
def normalise_callee(spark, d):
    refs = w.raw_refs(spark, d).filter("kind <> 'TypeReference'")
    return refs.select("name", names.callee(F.col("name")).alias("looked_up")).distinct()


@query(f"WITH {w.TREE}, {w.REFS} SELECT DISTINCT 'std::' || name AS name, p_name AS looked_up FROM refs WHERE kind = 'TypeReference'")
def normalise_type(spark, d):
    refs = w.raw_refs(spark, d).filter("kind = 'TypeReference'").select(F.concat(F.lit("std::"), "name").alias("name"))
    return refs.select("name", names.type_name(F.col("name")).alias("looked_up")).distinct()


_NORMAL = """list_reduce(list_prepend('', string_split(p, '/')), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc
  WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END)"""


@query(f"WITH q AS (SELECT page_id, {w.PAGE_PATH} || '/../x/./' || page_id % 7 || '/../../../y' AS p FROM pages) SELECT page_id, {_NORMAL} AS normal FROM q")
def normalise_path(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/+$", "")
    full = F.concat(path, F.lit("/../x/./"), (F.col("page_id") % 7).cast("string"), F.lit("/../../../y"))
    return w.table(spark, d, "pages").select("page_id", paths.normalise(full).alias("normal"))


@query(
    rf"""WITH {w.PAGE_FILES} SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name,
    regexp_replace(path, '([^/])\.[^./]*$', '\1') AS bare, regexp_extract(path, '[^/]\.([^./]+)$', 1) AS suffix FROM pf"""
)
def path_parts(spark, d):
    path = F.col("path")
    return w.page_files(spark, d).select(
        "path",
        paths.parent_dir(path).alias("dir"),
        paths.file_name(path).alias("name"),
        paths.without_suffix(path).alias("bare"),
        paths.extension(paths.file_name(path)).alias("suffix"),
    )


@query(
    f"""WITH {w.NODES}, h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(id, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END::BIGINT)),
      lambda a, c: (a * 31 + c) & 4294967295) AS u FROM nodes WHERE type <> 'CodeBlock')
    SELECT id, lower(to_base(abs(CASE WHEN u > 2147483647 THEN u - 4294967296 ELSE u END), 36)) AS key FROM h"""
)
def path_hash(spark, d):
    return w.nodes(spark, d).filter("type <> 'CodeBlock'").select("id", paths.path_hash(F.col("id")).alias("key"))


_URL = "CASE c_custkey % 5 WHEN 0 THEN 'https://github.com/' WHEN 1 THEN 'git@gitlab.com:' WHEN 2 THEN 'http://github.com/' WHEN 3 THEN 'https://gitlab.com/' ELSE 'https://example.org/' END || c_mktsegment || '/' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '' END"


@query(
    rf"""WITH u AS (SELECT {_URL} AS url FROM customer) SELECT url,
    starts_with(url, 'https://github.com/') OR starts_with(url, 'git@github.com:') OR starts_with(url, 'https://gitlab.com/') OR starts_with(url, 'git@gitlab.com:') AS allowed,
    regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '(\.git)+$', ''), '[^/]*$') AS folder FROM u"""
)
def repo_url(spark, d):
    url = w.table(spark, d, "customer").select(F.expr(_URL).alias("url"))
    return url.select("url", paths.is_repo_url(F.col("url")).alias("allowed"), paths.repo_folder(F.col("url")).alias("folder"))


@query(
    f"""WITH {w.NODES}, n AS (SELECT id, name, instr(lower(name), 'on_') AS i FROM nodes WHERE type <> 'CodeBlock')
    SELECT id, CASE WHEN i = 0 THEN name ELSE substr(name, 1, i - 1) END AS before, CASE WHEN i = 0 THEN '' ELSE substr(name, i, 3) END AS match,
    CASE WHEN i = 0 THEN '' ELSE substr(name, i + 3) END AS after FROM n"""
)
def highlight_split(spark, d):
    n = w.nodes(spark, d).filter("type <> 'CodeBlock'")
    return n.withColumn("h", names.highlight(F.col("name"), F.lit("On_"))).select("id", "h.before", "h.match", "h.after")


@query(
    """WITH scales AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 160.0::DOUBLE - 0.00625::DOUBLE AS scale FROM part),
    levels AS (SELECT *, CASE WHEN scale < 0.05 THEN 'minimap' WHEN scale < 0.2 THEN 'overview' ELSE 'detail' END AS level FROM scales)
    SELECT *, CASE level WHEN 'minimap' THEN 0.2::DOUBLE WHEN 'overview' THEN 0.5 ELSE 1.0 END AS opacity,
      CASE level WHEN 'minimap' THEN 0.5::DOUBLE WHEN 'overview' THEN 0.75 ELSE 1.0 END AS width FROM levels"""
)
def lod_levels(spark, d):
    scale = F.col("p_size").cast("double") / F.lit(160.0) - F.lit(0.00625)
    scales = w.table(spark, d, "part").select("p_partkey", scale.alias("scale"))
    level = style.level_of_detail(F.col("scale"))
    return scales.select("*", level.alias("level"), style.opacity_factor(level).alias("opacity"), style.width_factor(level).alias("width"))


def _darkened_sql(colour: str) -> str:
    channels = " || ".join(
        f"printf('%02x', CAST(floor(CAST('0x' || substr({colour}, {at}, 2) AS INTEGER) * 0.25) AS INTEGER))" for at in (2, 4, 6)
    )
    return f"'#' || {channels}"


@query(
    f"""WITH {w.NODES} SELECT id, {_case('type', {k: f"'{v}'" for k, v in NODE_ICONS.items()},
      _case('kind', {k: f"'{v}'" for k, v in BLOCK_ICONS.items()}, f"'{NO_ICON}'"))} AS icon,
    {_case('type', {k: f"'{v}'" for k, v in NODE_COLOURS.items()}, _darkened_sql(f"coalesce({BLOCK_COLOUR}, '{NO_BLOCK_COLOUR}')"))} AS colour FROM nodes"""
)
def node_icons_and_colours(spark, d):
    kind, type_ = F.col("kind"), F.col("type")
    return w.nodes(spark, d).select("id", style.node_icon(type_, kind).alias("icon"), style.node_colour(type_, kind).alias("colour"))


@query(f"WITH {w.TREE}, {w.RAW} SELECT DISTINCT kind, {_case('kind', {k: f"'{v[3]}'" for k, v in EDGE_KINDS.items()})} AS label FROM raw")
def edge_labels(spark, d):
    return w.raw_edges(spark, d).select("kind", style.edge_label(F.col("kind")).alias("label")).distinct()


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '_' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS trait,
      CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS type FROM customer)
    SELECT c_custkey, c_custkey % 3 = 0 AS private, CASE WHEN type IS NULL THEN 'impl' WHEN trait IS NULL THEN 'impl ' || type ELSE trait || ' for ' || type END AS impl,
      name AS unquoted, CAST(c_custkey % 100 AS DOUBLE) / 100.0::DOUBLE AS share,
      CASE c_custkey % 4 WHEN 0 THEN 'Private' WHEN 1 THEN 'Public' WHEN 2 THEN 'Crate' ELSE 'Protected' END AS visibility,
      CASE WHEN c_custkey % 2 = 0 THEN 'new().' || c_name ELSE c_name END AS callee FROM n JOIN customer USING (c_custkey)"""
)
def name_helpers(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("_"), "c_name")).otherwise(F.col("c_name"))
    quote = F.when(k % 2 == 0, "'").otherwise('"')
    modifier = F.when(k % 4 == 1, "pub").when(k % 4 == 2, "pub(in crate::a)").when(k % 4 == 3, "pub(super)")
    text = F.when(k % 2 == 0, F.concat(F.lit("Foo::new()."), "c_name")).otherwise(F.concat(F.lit("a.b."), "c_name"))
    return w.table(spark, d, "customer").select(
        "c_custkey",
        names.is_private(name).alias("private"),
        names.impl_name(F.when(k % 4 != 0, F.col("c_mktsegment")), F.when(k % 5 != 0, F.col("c_name"))).alias("impl"),
        names.unquoted(F.concat(quote, name, quote)).alias("unquoted"),
        style.percent_to_share(F.concat((k % 100).cast("string"), F.lit("%"))).alias("share"),
        names.rust_visibility(modifier).alias("visibility"),
        names.call_target(text).alias("callee"),
    )


@query(
    f"""WITH {w.NODES}, ids AS (SELECT id FROM nodes WHERE type = 'CodeBlock' OR child_ordinal % 2 = 0 UNION ALL SELECT 'unknown ' || n_name FROM nation)
    SELECT ids.id, coalesce(file_path, ids.id) AS file FROM ids LEFT JOIN nodes ON nodes.id = ids.id"""
)
def file_of_node(spark, d):
    n = w.nodes(spark, d)
    unknown = w.table(spark, d, "nation").select(F.concat(F.lit("unknown "), "n_name").alias("id"))
    return view.files_of(n.filter("type = 'CodeBlock' or child_ordinal % 2 = 0").select("id").unionByName(unknown), n)


@query(f"WITH {w.NODES}, {w.RAW}, {w.ROLLED} SELECT source, target FROM raw UNION SELECT source, target FROM rolled")
def layout_pairs(spark, d):
    n, raw = w.nodes(spark, d), w.raw_edges(spark, d)
    return view.layout_pairs(raw, hierarchy.roll_up(raw, n, w.directories(n)))


@query(f"WITH {w.SYMBOLS} SELECT symbol, node_id FROM symbols ORDER BY symbol, node_id LIMIT 5")
def symbol_samples(spark, d):
    return view.samples(resolve.symbol_table(w.part_nodes(spark, d)), "symbol", "node_id")


@query(f"WITH {w.TREE}, {w.RAW} SELECT source, target, kind, seq FROM raw ORDER BY seq, source, target, kind LIMIT 1")
def first_edge(spark, d):
    return view.samples(w.raw_edges(spark, d).select("source", "target", "kind", "seq"), "seq", "source", "target", "kind", n=1)


@query(
    f"""WITH {w.NODES}, {w.RAW}, {w.VIEW},
    seen AS (SELECT id FROM visible WHERE NOT (id = 'EUROPE' OR id LIKE 'EUROPE/%'))
    SELECT seq, kind FROM raw WHERE kind <> 'MethodCall' AND source IN (SELECT id FROM seen) AND target IN (SELECT id FROM seen)"""
)
def view_verbs(spark, d):
    """Edges of a view after a region was hidden and a kind switched off, another off and on again."""
    n = w.nodes(spark, d)
    seen = view.View(n, w.visible(n), w.expanded(n)).toggle_visible("EUROPE").toggle_kind("MethodCall").toggle_kind("Import").toggle_kind("Import")
    return seen.edges(w.raw_edges(spark, d)).select("seq", "kind")


# Resolution.


@query(f"WITH {w.SYMBOLS} SELECT symbol, node_id FROM symbols")
def symbol_table(spark, d):
    return resolve.symbol_table(w.part_nodes(spark, d))


@query(
    f"""WITH {w.TREE}, {w.SYMBOLS}, {w.REFS}, g AS (SELECT from_node, kind, p_name, count(*) AS n, min(seq) AS seq FROM refs GROUP BY ALL)
    SELECT from_node AS source, node_id AS target, kind, CAST(sum(n) AS BIGINT) AS weight, min(seq) AS seq FROM g JOIN symbols ON p_name = symbol GROUP BY ALL"""
)
def resolve_symbols(spark, d):
    return resolve.resolve_symbols(w.raw_refs(spark, d), resolve.symbol_table(w.part_nodes(spark, d)))


@query(
    f"""WITH {w.TREE}, {w.SYMBOLS}, {w.REFS}, g AS (SELECT from_node, p_brand || '::' || p_name AS s, count(*) AS n, min(seq) AS seq FROM refs
      WHERE kind = 'TypeReference' GROUP BY ALL)
    SELECT from_node AS source, node_id AS target, 'TypeReference' AS kind, CAST(sum(n) AS BIGINT) AS weight, min(seq) AS seq FROM g JOIN symbols ON s = symbol GROUP BY ALL"""
)
def resolve_fallback(spark, d):
    """Only qualified names are known, so calls miss and type references are found by their full name."""
    symbols = resolve.symbol_table(w.part_nodes(spark, d)).filter(F.contains("symbol", F.lit("::")))
    return resolve.resolve_symbols(w.raw_refs(spark, d).withColumn("name", F.concat("p_brand", F.lit("::"), "p_name")), symbols)


@query(f"WITH {w.SYMBOLS} SELECT symbol, count(*) AS n FROM symbols GROUP BY symbol HAVING count(*) > 1")
def resolve_ambiguous(spark, d):
    return resolve.symbol_table(w.part_nodes(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(f"WITH {w.SYMBOLS} SELECT symbol, count(*) AS n FROM symbols GROUP BY symbol ORDER BY n DESC, symbol LIMIT 20")
def top_symbols(spark, d):
    counted = resolve.symbol_table(w.part_nodes(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "symbol").limit(20)


@query(f"WITH {w.PAGE_FILES}, {w.PATH_KEYS} SELECT key, node_id FROM keys")
def path_keys(spark, d):
    return resolve.path_keys(w.page_files(spark, d))


def _suffixes(language: str | None) -> str:
    return "[" + ", ".join(f"'{s}'" for s in SUFFIXES[language]) + "]"


_PROBE = f"""list_transform(CASE language WHEN 'TypeScript' THEN {_suffixes('TypeScript')} WHEN 'Python' THEN {_suffixes('Python')}
  WHEN 'Rust' THEN {_suffixes('Rust')} ELSE {_suffixes(None)} END, lambda s: base || s)"""


@query(
    f"""WITH {w.PAGE_FILES}, {w.PATH_KEYS}, asked AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'Python' WHEN 2 THEN 'Rust' END AS language,
      'en/' || (page_id * 37 % 1000) AS base FROM pages),
    tried AS (SELECT page_id, unnest(c) AS key, unnest(range(0, len(c))) AS pos FROM (SELECT page_id, {_PROBE} AS c FROM asked))
    SELECT page_id, arg_min(node_id, pos) AS node_id FROM tried JOIN keys USING (key) GROUP BY page_id"""
)
def extension_probe(spark, d):
    turn = F.col("page_id") % 4
    language = F.when(turn == 0, "TypeScript").when(turn == 1, "Python").when(turn == 2, "Rust")
    base = F.concat(F.lit("en/"), (F.col("page_id") * 37 % 1000).cast("string"))
    asked = w.table(spark, d, "pages").select("page_id", resolve.probe_candidates(base, language).alias("candidates"))
    return resolve.first_match(asked, resolve.path_keys(w.page_files(spark, d)), "candidates", ["page_id"])


@query(
    f"""WITH {w.PAGE_FILES}, {w.PATH_KEYS}, {w.PAGE_IMPORTS},
    based AS (SELECT file_path, module_path, language, regexp_replace(file_path, '/?[^/]*$', '') || '/' || module_path AS p FROM imports LEFT JOIN pf ON path = file_path),
    normal AS (SELECT *, CASE WHEN starts_with(module_path, '.') THEN {_NORMAL} WHEN contains(module_path, '.') AND NOT contains(module_path, '/') THEN replace(module_path, '.', '/')
      WHEN starts_with(module_path, 'crate::') THEN 'src/' || replace(module_path[8:], '::', '/') ELSE module_path END AS base FROM based),
    cand AS (SELECT file_path, module_path, CASE WHEN starts_with(module_path, '.') THEN list_prepend(base, {_PROBE})
      WHEN contains(module_path, '.') AND NOT contains(module_path, '/') THEN [base, base || '.py', base || '/__init__.py']
      WHEN starts_with(module_path, 'crate::') THEN [base || '.rs', base || '/mod.rs'] ELSE [base] END AS c FROM normal),
    tried AS (SELECT file_path, module_path, unnest(c) AS key, unnest(range(0, len(c))) AS pos FROM cand),
    found AS (SELECT file_path, module_path, arg_min(node_id, pos) AS node_id FROM tried JOIN keys USING (key) GROUP BY ALL)
    SELECT DISTINCT file_path AS source, node_id AS target, 'Import' AS kind, 1::BIGINT AS weight FROM found WHERE file_path <> node_id"""
)
def resolve_imports(spark, d):
    return resolve.resolve_imports(w.page_imports(spark, d), w.page_files(spark, d))


# Progress.


@query(
    f"""WITH {w.EVENTS} SELECT run_id, arg_max(path, seq) FILTER (type = 'FileStart') AS current_path,
    coalesce(max(total_files), count(*) FILTER (type = 'FileDone')) AS parsed_files,
    CAST(coalesce(max(total_blocks), sum(blocks), 0) AS BIGINT) AS parsed_blocks, count(*) FILTER (type = 'Error') AS n_errors,
    max(total_files) AS total_files, bool_or(type = 'Complete') AS complete FROM ev GROUP BY run_id"""
)
def progress_fold(spark, d):
    return progress.fold(w.events(spark, d))


@query(f"WITH {w.EVENTS} SELECT run_id, seq, path, message FROM ev WHERE type = 'Error'")
def progress_errors(spark, d):
    return progress.errors(w.events(spark, d))


@query(
    f"""WITH {w.EVENTS}, f AS (SELECT run_id, count(*) FILTER (type = 'FileDone') AS done, max(total_files) AS total FROM ev GROUP BY run_id)
    SELECT run_id, CASE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, done * 100.0::DOUBLE / total) END AS ratio FROM f"""
)
def progress_ratio(spark, d):
    runs = w.events(spark, d).groupBy("run_id").agg(F.count_if(F.col("type") == "FileDone").alias("done"), F.max("total_files").alias("total"))
    return runs.select("run_id", progress.ratio(F.col("done"), F.col("total")).alias("ratio"))


@query(f"WITH {w.EVENTS} SELECT count(*) AS total_files, CAST(coalesce(sum(blocks) FILTER (message IS NULL), 0) AS BIGINT) AS total_blocks FROM ev WHERE type IN ('FileDone', 'Error')")
def run_totals(spark, d):
    return progress.run_totals(w.events(spark, d).filter("type in ('FileDone', 'Error')"))


@query(
    f"""WITH {w.EVENTS}, timed AS (
      SELECT ev.*, ts FROM ev JOIN events ON event_id = seq
      UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'Start', NULL, NULL, NULL, NULL, NULL, ts FROM events WHERE event_type = 'click'),
    numbered AS (SELECT *, count(*) FILTER (type = 'Start') OVER (PARTITION BY run_id ORDER BY ts, seq) AS attempt FROM timed),
    active AS (SELECT *, count(*) FILTER (type = 'Complete') OVER (PARTITION BY run_id, attempt ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
      FROM numbered WHERE attempt > 0)
    SELECT run_id, max(seq) FILTER (type = 'Start') AS start_seq, arg_max(path, (ts, seq)) FILTER (type = 'FileStart') AS current_path,
      count(*) FILTER (type = 'FileDone') AS parsed_files, coalesce(max(total_files), 0) AS total_files,
      CAST(coalesce(max(total_blocks), sum(blocks), 0) AS BIGINT) AS total_blocks, count(*) FILTER (type = 'Error') AS n_errors, bool_or(type = 'Complete') AS complete
    FROM active WHERE ended = 0 GROUP BY run_id, attempt"""
)
def replayed_runs(spark, d):
    return runs.replay(w.timed_events(spark, d))


@query(
    """WITH b AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR AS new FROM events),
    n AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM b)
    SELECT user_id, max(ts) + INTERVAL 6 HOUR AS written_at, count(*) AS n_writes, max(event_id) AS event_id, max(ts) AS ts,
      arg_max(value, event_id) AS value FROM n GROUP BY user_id, burst"""
)
def debounced_writes(spark, d):
    """Saved values of each user; events here are hours apart, so the gap is."""
    writes = w.table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return runs.debounced(writes, "user_id", gap="6 hours", order="event_id")


@query(
    """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS frame, count(*) AS n_requests, max(event_id) AS event_id, max(ts) AS ts,
      arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL"""
)
def requests_per_frame(spark, d):
    """The last request of each user in a frame, here of a day."""
    return runs.per_frame(w.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", frame="1 day", order="event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_request(spark, d):
    return progress.latest(w.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    f"""WITH {w.SYMBOLS} SELECT p.id AS source, s.node_id AS target, 'FunctionCall' AS kind, CAST(count(*) AS BIGINT) AS weight, min(p_key) AS seq
    FROM (SELECT *, CAST(split_part(id, '@', 2) AS BIGINT) AS p_key FROM parts) p JOIN symbols s ON s.symbol = p.p_name WHERE s.node_id <> p.id GROUP BY ALL"""
)
def self_edges_left_out(spark, d):
    """Every part refers to its own name: only others of that name are reached."""
    nodes = w.part_nodes(spark, d)
    refs = nodes.select(
        F.col("id").alias("from_node"), F.lit("FunctionCall").alias("kind"), "name", F.substring_index("id", "@", -1).cast("long").alias("seq")
    )
    return resolve.resolve_symbols(refs, resolve.symbol_table(nodes))


# Layout.

_GRID = f"""grid AS (SELECT id AS node_id, 20.0::DOUBLE + 220.0::DOUBLE * ((k - 1) % 8) AS x, 20.0::DOUBLE + 60.0::DOUBLE * ((k - 1) // 8) AS y,
  {WIDTH} AS width, {HEIGHT} AS height FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE type <> 'CodeBlock'))"""


def _grid(spark, d) -> DataFrame:
    n = w.nodes(spark, d).filter("type <> 'CodeBlock'")
    return layout.grid_layout(n.select("id", F.col("id").alias("pos")), n)


@query(f"WITH {w.NODES}, {_GRID} SELECT * FROM grid")
def grid_layout(spark, d):
    return _grid(spark, d)


@query(f"WITH {w.NODES}, {_GRID} SELECT min(x) AS min_x, min(y) AS min_y, max(x + width) AS max_x, max(y + height) AS max_y FROM grid")
def world_bounds(spark, d):
    return layout.world_bounds(_grid(spark, d))


@query(
    f"""WITH {w.NODES}, {_GRID}, b AS (SELECT min(x) AS min_x, min(y) AS min_y, max(x + width) AS max_x, max(y + height) AS max_y FROM grid)
    SELECT *, least((1200.0::DOUBLE - 100.0) / (max_x - min_x), (800.0::DOUBLE - 100.0) / (max_y - min_y), 1.0) AS scale FROM b"""
)
def fit_scale(spark, d):
    return layout.fit_scale(layout.world_bounds(_grid(spark, d)), 1200.0, 800.0)


@query(
    f"""WITH {w.NODES}, {_GRID}, b AS (SELECT min(x) AS x0, min(y) AS y0, least(142.0::DOUBLE / (max(x + width) - min(x)), 92.0::DOUBLE / (max(y + height) - min(y))) AS s FROM grid)
    SELECT node_id, 4.0 + (x - x0) * s AS x, 4.0 + (y - y0) * s AS y, greatest(2.0, width * s) AS width, greatest(1.0, height * s) AS height FROM grid, b"""
)
def minimap_rects(spark, d):
    return layout.minimap_rectangles(_grid(spark, d))


@query(f"WITH {w.NODES}, {_GRID} SELECT node_id FROM grid WHERE x <= 900 AND x + width >= 240 AND y <= 1000 AND y + height >= 380")
def viewport_query(spark, d):
    return layout.in_viewport(_grid(spark, d), 240.0, 380.0, 660.0, 620.0).select("node_id")


@query(
    f"""WITH {w.NODES}, {_GRID}, v AS (SELECT n_nationkey AS viewport_id, 100.0 * n_nationkey AS vx, 150.0 * n_nationkey AS vy, 900.0 AS vw, 700.0 AS vh FROM nation)
    SELECT viewport_id, node_id FROM grid JOIN v ON x <= vx + vw AND x + width >= vx AND y <= vy + vh AND y + height >= vy"""
)
def viewport_join(spark, d):
    n = F.col("n_nationkey")
    views = w.table(spark, d, "nation").select(
        n.alias("viewport_id"), (n * 100.0).alias("x"), (n * 150.0).alias("y"), F.lit(900.0).alias("width"), F.lit(700.0).alias("height")
    )
    return layout.viewport_join(_grid(spark, d), views)


def _changed_boxes(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes moved to the left and made large, and ids that go."""
    number = F.regexp_extract("node_id", "([0-9]+)$", 1)
    moved = grid.filter(number.endswith("7")).select("node_id", (F.col("x") - 700.0).alias("x"), "y", (F.col("width") * 12.0).alias("width"), "height")
    return moved, grid.filter(number.endswith("5")).select("node_id")


_CHANGED = """changed AS (SELECT node_id, CASE WHEN node_id SIMILAR TO '.*7' THEN x - 700.0 ELSE x END AS x, y,
  CASE WHEN node_id SIMILAR TO '.*7' THEN width * 12.0 ELSE width END AS width, height FROM grid WHERE node_id NOT SIMILAR TO '.*5')"""


def _box_index(spark, d) -> str:
    """An index of the grid, some of whose boxes were then put elsewhere and some taken out."""
    grid, path = durable(_grid(spark, d)), f"{shared_folder(spark)}/boxes-{uuid.uuid4().hex}"
    moved, gone = _changed_boxes(grid)
    spatial.create_index(grid, path)
    spatial.upsert(spark, path, moved)
    spatial.remove(spark, path, gone)
    return path


@query(f"WITH {w.NODES}, {_GRID}, {_CHANGED} SELECT * FROM changed WHERE x <= 900 AND x + width >= 240 AND y <= 1000 AND y + height >= 380")
def box_index_view(spark, d):
    return spatial.boxes_in_view(spark, _box_index(spark, d), 240.0, 380.0, 660.0, 620.0)


@query(f"WITH {w.NODES}, {_GRID}, {_CHANGED} SELECT * FROM changed")
def box_index_rows(spark, d):
    return spatial.read_index(spark, _box_index(spark, d))


def _fitted_sql() -> str:
    """Level by level: ``now3`` are the boxes of files, ``nowK`` those of depth K grown around what lies in them."""
    seen = f"SELECT id, type, container_id, len(ancestors) AS depth, {w.VISIBLE} AS seen FROM nodes WHERE type <> 'CodeBlock'"
    ctes = [f"facts AS ({seen})", "now3 AS (SELECT grid.*, facts.*, true AS fits FROM grid JOIN facts ON id = node_id WHERE depth = 3)"]
    for depth in (2, 1, 0):
        ctes.append(
            f"""span{depth} AS (SELECT container_id AS c, min(x) AS l, min(y) AS t, max(x + width) AS r, max(y + height) AS b FROM now{depth + 1} WHERE seen GROUP BY container_id),
    spot{depth} AS (SELECT grid.*, facts.*, c IS NOT NULL AS fits, CASE WHEN c IS NULL THEN x ELSE least(x, l - 10) END AS nx, CASE WHEN c IS NULL THEN y ELSE least(y, t - 30) END AS ny, r, b
      FROM grid JOIN facts ON id = node_id LEFT JOIN span{depth} ON c = node_id WHERE depth = {depth}),
    now{depth} AS (SELECT node_id, nx AS x, ny AS y,
      CASE WHEN fits THEN greatest({WIDTH}, CAST(ceil(greatest(x + {WIDTH} - 10, r) - nx + 10) AS DOUBLE)) ELSE width END AS width,
      CASE WHEN fits THEN greatest({HEIGHT}, CAST(ceil(greatest(y + {HEIGHT} - 10, b) - ny + 10) AS DOUBLE)) ELSE height END AS height,
      id, type, container_id, depth, seen, fits FROM spot{depth})"""
        )
    union = " UNION ALL ".join(f"SELECT node_id, x, y, width, height FROM now{depth} WHERE fits" for depth in (2, 1, 0))
    return f"WITH {w.NODES}, {_GRID}, {', '.join(ctes)} {union}"


@query(_fitted_sql())
def fitted_containers(spark, d):
    n = durable(w.nodes(spark, d).filter("type <> 'CodeBlock'"))
    return layout.fitted_containers(_grid(spark, d), n, w.visible(n))


@query(
    f"""WITH {w.NODES}, {_GRID}, {w.VIEW}, below AS (SELECT id, list_filter(ancestors, lambda a: a = 'EUROPE' OR starts_with(a, 'EUROPE/')) AS above FROM nodes
      WHERE (id = 'EUROPE' OR list_contains(ancestors, 'EUROPE')) AND id IN (SELECT id FROM visible)),
    moved AS (SELECT id FROM below WHERE id NOT IN (SELECT i FROM (SELECT id AS i, unnest(above) AS a FROM below) WHERE a NOT IN (SELECT id FROM visible)))
    SELECT node_id, x + CASE WHEN node_id IN (SELECT id FROM moved) THEN 15.0 ELSE 0.0 END AS x,
      y + CASE WHEN node_id IN (SELECT id FROM moved) THEN -5.0 ELSE 0.0 END AS y, width, height FROM grid"""
)
def moved_subtree(spark, d):
    n = durable(w.nodes(spark, d).filter("type <> 'CodeBlock'"))
    return layout.moved_subtree(_grid(spark, d), n, w.visible(n), "EUROPE", 15.0, -5.0)


@query(
    f"""WITH {w.NODES}, {_GRID}, {w.VIEW}, below AS (SELECT id, list_filter(ancestors, lambda a: a = 'EUROPE' OR starts_with(a, 'EUROPE/')) AS above FROM nodes
      WHERE type <> 'CodeBlock' AND (id = 'EUROPE' OR list_contains(ancestors, 'EUROPE')) AND id IN (SELECT id FROM visible)),
    kept AS (SELECT id FROM below WHERE id NOT IN (SELECT i FROM (SELECT id AS i, unnest(above) AS a FROM below) WHERE a NOT IN (SELECT id FROM visible)))
    SELECT g.node_id, g.x - t.x AS dx, g.y - t.y AS dy FROM grid g, grid t WHERE t.node_id = 'EUROPE' AND g.node_id IN (SELECT id FROM kept)"""
)
def displayed_descendants(spark, d):
    n = durable(w.nodes(spark, d).filter("type <> 'CodeBlock'"))
    return layout.offsets_from(_grid(spark, d), layout.displayed_below(n, w.visible(n), "EUROPE"), "EUROPE")


@query(
    f"""WITH {w.NODES}, {_GRID}, o AS (SELECT i, sum(x) AS ox, sum(y) AS oy FROM (SELECT id AS i, unnest(ancestors) AS a FROM nodes) JOIN grid ON node_id = a GROUP BY i)
    SELECT node_id, x + coalesce(ox, 0.0) AS x, y + coalesce(oy, 0.0) AS y, width, height FROM grid LEFT JOIN o ON i = node_id"""
)
def absolute_boxes(spark, d):
    return layout.absolute_boxes(_grid(spark, d), w.nodes(spark, d).filter("type <> 'CodeBlock'"))


@query(
    f"""WITH {w.NODES}, {_GRID}, b AS (SELECT min(x) AS x0, min(y) AS y0, least(142.0::DOUBLE / (max(x + width) - min(x)), 92.0::DOUBLE / (max(y + height) - min(y))) AS s FROM grid)
    SELECT 4.0 + (240.0 - x0) * s AS x, 4.0 + (380.0 - y0) * s AS y, 660.0 * s AS width, 620.0 * s AS height FROM b"""
)
def minimap_viewport(spark, d):
    return layout.minimap_viewport(_grid(spark, d), 240.0, 380.0, 660.0, 620.0)


@query(f"WITH {w.NODES}, {_GRID} SELECT node_id, CASE WHEN hash % 3 = 0 THEN x + 1000.0 ELSE x END AS x, y, width, height FROM (SELECT *, length(node_id) AS hash FROM grid) UNION ALL SELECT 'new', 1.0, 2.0, 3.0, 4.0")
def upserted_boxes(spark, d):
    boxes = _grid(spark, d)
    moved = boxes.filter(F.length("node_id") % 3 == 0).withColumn("x", F.col("x") + 1000.0)
    fresh = spark.range(1).select(F.lit("new").alias("node_id"), *[F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 2.0), ("width", 3.0), ("height", 4.0))])
    return layout.upsert_boxes(boxes, moved.unionByName(fresh))


def _nested_edges(spark, d) -> DataFrame:
    """From each customer's file to the first supplier's file of its nation, routed within the nation or not at all."""
    files = w.customer_files(spark, d).select("c_custkey", F.col("id").alias("source"), F.substring_index("id", "/", 2).alias("container_id"))
    first = w.supplier_files(spark, d).groupBy(F.col("nation_id").alias("container_id")).agg(F.min("id").alias("target"))
    k = F.col("c_custkey").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    section = F.array(at(k, k + 1), at(k + 0.25, k + 1.25), at(k, k + 50), at(k + 70, k + 50))
    single = F.array(at(k, k), at(k + 0.25, k))
    return files.join(first, "container_id").select(
        "container_id", "source", "target", F.when(F.col("c_custkey") % 3 == 0, section).when(F.col("c_custkey") % 3 == 1, single).alias("section")
    )


@query(
    f"""WITH {w.NODES}, {_GRID}, o AS (SELECT i, sum(x) AS ox, sum(y) AS oy FROM (SELECT id AS i, unnest(ancestors) AS a FROM nodes) JOIN grid ON node_id = a GROUP BY i),
    boxes AS (SELECT node_id, x + coalesce(ox, 0.0) AS x, y + coalesce(oy, 0.0) AS y, width AS w, height AS h FROM grid LEFT JOIN o ON i = node_id),
    firsts AS (SELECT nation_id, min(id) AS target FROM sf GROUP BY nation_id),
    e AS (SELECT CAST(c_custkey AS DOUBLE) AS k, c_custkey % 3 AS turn, cf.id AS source, target, c.x AS cx, c.y AS cy, a.x + a.w / 2 AS sx, a.y + a.h / 2 AS sy, b.x + b.w / 2 AS tx, b.y + b.h / 2 AS ty
      FROM cf JOIN firsts USING (nation_id) JOIN boxes a ON a.node_id = cf.id JOIN boxes b ON b.node_id = target JOIN boxes c ON c.node_id = nation_id)
    SELECT source, target, CASE WHEN turn = 0 THEN 3 ELSE 2 END AS n, CASE WHEN turn = 0 THEN cx + k ELSE sx END AS x1, CASE WHEN turn = 0 THEN cy + k + 1 ELSE sy END AS y1,
      CASE WHEN turn = 0 THEN cx + k + 70 ELSE tx END AS x2, CASE WHEN turn = 0 THEN cy + k + 50 ELSE ty END AS y2 FROM e WHERE turn <> 1"""
)
def flatten_layout(spark, d):
    n = w.nodes(spark, d).filter("type <> 'CodeBlock'")
    routes = layout.flatten_layout(_grid(spark, d), n, _nested_edges(spark, d))
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return routes.select("source", "target", F.size("points").alias("n"), first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2"))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 10")
def log_tail(spark, d):
    return progress.tail(w.table(spark, d, "events").select("event_id", "event_type", "value"), 10, "event_id")


# Geometry.


def _routes(spark, d, with_boxes: bool = False) -> DataFrame:
    ends = w.raw_edges(spark, d).select(F.substring_index("source", "::", 1).alias("source"), "target")
    # Hardly a pair repeats: dealt by source once, pairs are made distinct and meet their first box without another shuffle.
    pairs = ends.repartition("source").distinct()
    return geometry.straight_routes(pairs, _grid(spark, d), with_boxes=with_boxes)


_MIDDLES = """mid AS (SELECT p.source, p.target, a.x AS ax, a.y AS ay, a.width AS aw, a.height AS ah, b.x AS b_x, b.y AS b_y, b.width AS b_w, b.height AS b_h,
    a.x + a.width / 2 AS sx, a.y + a.height / 2 AS sy, b.x + b.width / 2 AS tx, b.y + b.height / 2 AS ty
  FROM (SELECT DISTINCT split_part(source, '::', 1) AS source, target FROM raw) p JOIN grid a ON p.source = a.node_id JOIN grid b ON p.target = b.node_id),
ends AS (SELECT *, CASE WHEN abs(tx - sx) >= abs(ty - sy) THEN CASE WHEN tx >= sx THEN 'right' ELSE 'left' END WHEN ty >= sy THEN 'bottom' ELSE 'top' END AS side FROM mid)"""


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES}
    SELECT source, target, CASE side WHEN 'right' THEN ax + aw WHEN 'left' THEN ax ELSE sx END AS x1, CASE side WHEN 'bottom' THEN ay + ah WHEN 'top' THEN ay ELSE sy END AS y1,
      CASE side WHEN 'right' THEN b_x WHEN 'left' THEN b_x + b_w ELSE tx END AS x2, CASE side WHEN 'bottom' THEN b_y WHEN 'top' THEN b_y + b_h ELSE ty END AS y2 FROM ends"""
)
def straight_edges(spark, d):
    p = F.col("points")
    return _routes(spark, d).select("source", "target", p[0]["x"].alias("x1"), p[0]["y"].alias("y1"), p[1]["x"].alias("x2"), p[1]["y"].alias("y2"))


def _boxed(spark, d) -> DataFrame:
    return _routes(spark, d, with_boxes=True)


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES} SELECT source, target, side, CASE WHEN side IN ('left', 'right') THEN ah / 2 ELSE aw / 2 END AS "offset" FROM ends"""
)
def anchor_side(spark, d):
    a = geometry.anchor(F.col("source_box"), F.col("points")[0], F.col("points")[1])
    return _boxed(spark, d).withColumn("a", a).select("source", "target", "a.side", "a.offset")


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES} SELECT source, target, CASE side WHEN 'right' THEN ax + aw WHEN 'left' THEN ax ELSE sx END AS x,
    CASE side WHEN 'bottom' THEN ay + ah WHEN 'top' THEN ay ELSE sy END AS y FROM ends"""
)
def anchor_point(spark, d):
    a = geometry.anchor(F.col("source_box"), F.col("points")[0], F.col("points")[1])
    return _boxed(spark, d).withColumn("p", geometry.anchor_point(F.col("source_box"), a)).select("source", "target", "p.x", "p.y")


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES} SELECT source, target, side, CASE WHEN side IN ('left', 'right') THEN ah / 2 ELSE aw / 2 END AS "offset" FROM ends"""
)
def anchor_from_inside(spark, d):
    """From the centre of a box the side is that towards which the route goes."""
    middle = lambda b: F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))
    a = geometry.anchor(F.col("source_box"), middle(F.col("source_box")), middle(F.col("target_box")))
    return _boxed(spark, d).withColumn("a", a).select("source", "target", "a.side", "a.offset")


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES}
    SELECT source, target, CASE side WHEN 'right' THEN ax + aw ELSE ax END AS x1, sy AS y1, CASE side WHEN 'right' THEN b_x ELSE b_x + b_w END AS x2, ty AS y2
    FROM ends WHERE sy = ty AND sx <> tx"""
)
def anchored_routes(spark, d):
    """Boxes beside one another that did not move: the straight route already leaves and arrives through its anchors."""
    sb, tb, p = F.col("source_box"), F.col("target_box"), F.col("points")
    level = _boxed(spark, d).filter((p[0]["y"] == p[1]["y"]) & (sb["y"] + sb["height"] / 2 == tb["y"] + tb["height"] / 2) & (sb["x"] != tb["x"]))
    edges = level.withColumns({"old_source_box": sb, "old_target_box": tb, "source_anchor": geometry.anchor(sb, p[0], p[1]), "target_anchor": geometry.anchor(tb, p[1], p[0])})
    return geometry.reroute(edges).select("source", "target", p[0]["x"].alias("x1"), p[0]["y"].alias("y1"), p[1]["x"].alias("x2"), p[1]["y"].alias("y2"))


@query(
    f"""WITH {w.NODES}, {w.RAW}, {_GRID}, {_MIDDLES}
    SELECT source, target, 25.0 + CASE side WHEN 'right' THEN ax + aw WHEN 'left' THEN ax ELSE sx END AS x1, CASE side WHEN 'bottom' THEN ay + ah WHEN 'top' THEN ay ELSE sy END - 7.0 AS y1,
      25.0 + CASE side WHEN 'right' THEN b_x WHEN 'left' THEN b_x + b_w ELSE tx END AS x2, CASE side WHEN 'bottom' THEN b_y WHEN 'top' THEN b_y + b_h ELSE ty END - 7.0 AS y2 FROM ends"""
)
def routes_moved_along(spark, d):
    """Both boxes moved by the same: the route moves along."""
    sb, tb, p = F.col("source_box"), F.col("target_box"), F.col("points")
    move = lambda b: F.struct((b["x"] + 25.0).alias("x"), (b["y"] - 7.0).alias("y"), b["width"].alias("width"), b["height"].alias("height"))
    edges = _boxed(spark, d).select(
        "source", "target", "points", sb.alias("old_source_box"), tb.alias("old_target_box"), move(sb).alias("source_box"), move(tb).alias("target_box"),
        geometry.anchor(sb, p[0], p[1]).alias("source_anchor"), geometry.anchor(tb, p[1], p[0]).alias("target_anchor"),
    )
    return geometry.reroute(edges).select("source", "target", p[0]["x"].alias("x1"), p[0]["y"].alias("y1"), p[1]["x"].alias("x2"), p[1]["y"].alias("y2"))


def _polylines(spark, d) -> DataFrame:
    """(p_partkey, points): a repeated point, a run with points in its middle, a corner, a repeated end."""
    k = F.col("p_size").cast("double")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    points = F.array(at(zero, zero), at(zero + 0.25, zero), at(k + 1, zero), at(k + 2, zero), at(k + 10, zero), at(k + 10, k + 5), at(k + 10.25, k + 5.25))
    return w.table(spark, d, "part").select("p_partkey", points.alias("points"))


def _polyline_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"))), ", ")


@query("SELECT p_partkey, '0 0, ' || (p_size + 1) || ' 0, ' || (p_size + 2) || ' 0, ' || (p_size + 10) || ' 0, ' || (p_size + 10) || ' ' || (p_size + 5) AS points FROM part")
def polylines_without_repeats(spark, d):
    return _polylines(spark, d).select("p_partkey", _polyline_text(geometry.without_repeats(F.col("points"))).alias("points"))


@query("SELECT p_partkey, '0 0, ' || (p_size + 10) || ' 0, ' || (p_size + 10) || ' ' || (p_size + 5) AS points FROM part")
def polylines_simplified(spark, d):
    return _polylines(spark, d).select("p_partkey", _polyline_text(geometry.simplify(F.col("points"))).alias("points"))


@query("SELECT l_orderkey AS track, median(CAST(l_quantity AS DOUBLE)) AS median FROM lineitem GROUP BY l_orderkey")
def track_median(spark, d):
    return w.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(F.percentile("l_quantity", 0.5).alias("median"))


@query()
def reroute_edges(spark, d):
    """Routes after every second node moved: tested by properties, as SQL cannot express a router."""
    move = lambda box, by: F.struct((box["x"] + by).alias("x"), box["y"].alias("y"), box["width"].alias("width"), box["height"].alias("height"))
    sb, tb, p = F.col("source_box"), F.col("target_box"), F.col("points")
    edges = _boxed(spark, d).select(
        "source",
        "target",
        "points",
        sb.alias("old_source_box"),
        tb.alias("old_target_box"),
        move(sb, F.pmod(F.xxhash64("source"), F.lit(2)) * 40.0).alias("source_box"),
        move(tb, F.pmod(F.xxhash64("target"), F.lit(2)) * 40.0).alias("target_box"),
        geometry.anchor(sb, p[0], p[1]).alias("source_anchor"),
        geometry.anchor(tb, p[1], p[0]).alias("target_anchor"),
    )
    return geometry.reroute(edges).select("source", "target", F.size("points").alias("n_points"), F.to_json("points").alias("points"))


# Blocks around sites.


@query(
    """WITH items AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_path, l_orderkey || ':' || l_linenumber AS id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS start,
      CAST(l_quantity AS BIGINT) AS length, row_number() OVER () AS item FROM lineitem)
    SELECT s.file_path, s.id AS site, b.id AS block,
      CAST(row_number() OVER (PARTITION BY s.item ORDER BY b.start DESC, b.length, b.id DESC) - 1 AS INTEGER) AS level
    FROM items s JOIN items b ON s.file_path = b.file_path AND b.start <= s.start AND s.start < b.start + b.length"""
)
def blocks_around(spark, d):
    """Suppliers as files, days as positions: a line item is a block as long as its quantity and a site where it begins. Their ids repeat."""
    day, length = F.unix_date(F.col("l_shipdate").cast("date")).cast("long"), F.col("l_quantity").cast("long")
    items = w.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("file_path"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), day.alias("start"), (day + length).alias("end")
    )
    return containment.around(items.withColumn("end", F.col("start")), items)


# Extraction.


def _extracted_blocks(language: str) -> None:
    def blocks(spark, d):
        found = job.blocks_of(job.extract_sites(sw.source_files(spark, d, language)))
        lines = [F.col(f"span.{c}").alias(c) for c in ("start_line", "end_line")]
        return found.select("id", "kind", "name", "visibility", "signature", *lines, "parent_id", "file_path")

    blocks.__name__ = f"extract_blocks_{language.lower()}"
    query(sw.blocks_sql(language))(blocks)


def _extracted_references(language: str) -> None:
    def references(spark, d):
        found = job.references_of(job.extract_sites(sw.source_files(spark, d, language)))
        return found.select("from_node", "kind", "name", "module_path", "file_path")

    references.__name__ = f"extract_references_{language.lower()}"
    query(sw.references_sql(language))(references)


for _language in sw.LANGUAGES:
    _extracted_blocks(_language)
    _extracted_references(_language)


@query(sw.results_sql())
def extract_results(spark, d):
    """A row per file in the order of paths: its blocks, or that it could not be read."""
    results = durable(job.results_of(job.extract_sites(sw.source_files(spark, d))))  # numbering reads them twice
    numbered = numbering.with_row_numbers(results, "path", name="seq")
    return numbered.select("path", "blocks", F.col("message").isNotNull().alias("failed"), "seq")


@query(
    f"""WITH results AS ({sw.results_sql()})
    SELECT 'Start' AS type, NULL::VARCHAR AS path, NULL::BIGINT AS blocks, NULL::BIGINT AS total_files, NULL::BIGINT AS total_blocks
    UNION ALL SELECT 'FileStart', path, NULL, NULL, NULL FROM results
    UNION ALL SELECT CASE WHEN failed THEN 'Error' ELSE 'FileDone' END, path, blocks, NULL, NULL FROM results
    UNION ALL SELECT 'Complete', NULL, NULL, count(*), CAST(coalesce(sum(blocks), 0) AS BIGINT) FROM results"""
)
def live_events(spark, d):
    """What extraction tasks told of the files while they read them."""
    run = live.begin(f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", "run")
    results = durable(job.results_of(job.extract_sites(sw.source_files(spark, d), run)))
    run.complete(*progress.run_totals(results).first())
    return live.told(spark, run.folder).select("type", "path", "blocks", "total_files", "total_blocks")
