"""Graphs as JSON: one object with ``nodes`` by id, ``edges`` and ``root``.

``write_parts`` writes a graph of any size as text files which, one after the other in the order of their names, are
one such document; every node and edge is a line of its own, so ``read_parts`` reads it line by line. ``to_json`` and
``from_json`` hold a whole graph in one row, for viewers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import merge
from loomgraph.schema import NODES
from loomgraph.shared import scratch, shuffles_deleted, written

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
NODE = f"struct<type:string,id:string,name:string,path:string,language:string,kind:string,span:{SPAN},signature:string,visibility:string,parent:string,children:array<string>>"
EDGE = "struct<source:string,target:string,kind:string,weight:bigint>"
GRAPH = f"nodes map<string,{NODE}>, edges array<{EDGE}>, root string"


def _listed(nodes: DataFrame) -> DataFrame:
    """(id, node) as they stand in the document; columns that ``nodes`` lacks are null."""
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in NODES if f.name not in nodes.columns and f.name != "parent_id"]
    parent = [] if "parent_id" in nodes.columns else [F.col("container_id").alias("parent_id")]
    nodes = nodes.select("*", *parent, *absent)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "children"))), lambda p: p["children"]))
    # Dealt by container once, for both steps and the join.
    kids = merge.children(nodes.repartition("container_id")).groupBy(F.col("container_id").alias("id")).agg(whole.alias("children"))
    return nodes.join(kids, "id", "left").select(
        "id",
        F.struct(
            *["type", "id", "name", "path", "language", "kind", "span", "signature", "visibility"],
            F.col("parent_id").alias("parent"),
            F.coalesce("children", F.array().cast("array<string>")).alias("children"),
        ).alias("node"),
    )


def _quoted(text: Column) -> Column:
    """A string as JSON has it."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def write_parts(nodes: DataFrame, edges: DataFrame, path: str, root: str = "", compression: str | None = None) -> None:
    """The graph as text files in a new folder: nodes in the order of their ids, edges in that of ``seq``.

    Lines are sorted by ranges over all files; nothing is gathered but the children of one node. Edges
    become text once they are in order. ``compression`` is one of Spark's for text files.
    """
    spark = nodes.sparkSession
    place = ["section", "seq", "source", "target", "kind"]
    text, no_text = F.col("text"), F.lit(None).cast("string")
    entry = F.concat(_quoted(F.col("id")), F.lit(":"), F.to_json("node"))
    node_lines = _listed(nodes).select(
        F.lit(1).alias("section"), F.lit(0).cast("long").alias("seq"), F.col("id").alias("source"), F.lit("").alias("target"), F.lit("").alias("kind"),
        F.lit(None).cast("long").alias("weight"), entry.alias("text"),
    )
    edge_lines = edges.select(F.lit(3).alias("section"), "seq", "source", "target", "kind", F.col("weight").cast("long").alias("weight"), no_text.alias("text"))
    with scratch(spark), shuffles_deleted(spark):
        lines = written(node_lines.unionByName(edge_lines))
        first = lines.groupBy("section").agg(F.min(F.struct(*place[1:])).alias("first"))
        tail = F.concat(F.lit('],"root":'), _quoted(F.lit(root)), F.lit("}"))
        frame = spark.createDataFrame([(0, '{"nodes":{'), (2, '},"edges":['), (4, None)], "section int, text string")
        empty = [F.lit("").alias(c) for c in ("source", "target", "kind")]
        frame = frame.select("section", F.lit(0).cast("long").alias("seq"), *empty, no_text.cast("long").alias("weight"), F.coalesce("text", tail).alias("text"))
        # All entries of a section but its first begin with a comma. The first are looked up after the shuffle and before the sort.
        marked = lines.unionByName(frame).repartitionByRange(*place).join(F.broadcast(first), "section", "left").sortWithinPartitions(*place)
        comma = F.when(F.col("section").isin(1, 3) & (F.struct(*place[1:]) != F.col("first")), F.lit(",")).otherwise(F.lit(""))
        line = F.when(F.col("section") == 3, F.to_json(F.struct("source", "target", "kind", "weight"))).otherwise(text)
        marked.select(F.concat(comma, line).alias("text")).write.option("compression", compression or "none").text(path)


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph that :func:`write_parts` wrote; a malformed line stops the job."""
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    lines = spark.read.text(path).select(F.regexp_replace("value", "^,", "").alias("value"), *place)
    strict = {"mode": "FAILFAST"}
    # Filters may be reordered, a case is not: only lines of a kind are parsed as such.
    is_node, is_edge = F.expr("value like '\"%'"), F.expr("value like '{%' and value != '{\"nodes\":{'")
    entry = lines.filter(is_node).select(F.when(is_node, F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string,{NODE}>", strict)).alias("m"))
    nodes = entry.select(F.explode(F.map_values("m")).alias("n")).select("n.*")
    kids = nodes.select(F.col("id").alias("container_id"), F.posexplode("children").alias("child_ordinal", "child"))
    kids = kids.withColumnRenamed("child", "id").withColumn("child_ordinal", F.col("child_ordinal").cast("long"))
    found = lines.filter(is_edge).select(F.when(is_edge, F.from_json("value", EDGE, strict)).alias("e"), "file", "block", "row")
    # Edges stand one after the other: one is numbered by its place in its block of a file, blocks by what is before them.
    blocks = found.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    seq = (F.col("offset") + F.col("row") - F.col("first")).alias("seq")
    edges = found.join(F.broadcast(offsets), ["file", "block"]).select("e.source", "e.target", "e.kind", "e.weight", seq)
    return nodes.drop("children").withColumnRenamed("parent", "parent_id").join(kids, "id", "left"), edges


def to_json(nodes: DataFrame, edges: DataFrame, root: str = "") -> DataFrame:
    """One row with the column ``json``."""
    listed = _listed(nodes)
    all_nodes = listed.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "node")))).alias("nodes"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "source", "target", "kind", "weight")))
    all_edges = edges.agg(F.transform(ordered, lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["kind"].alias("kind"), e["weight"].alias("weight"))).alias("edges"))
    return all_nodes.crossJoin(F.broadcast(all_edges)).select(F.to_json(F.struct("nodes", "edges", F.lit(root).alias("root"))).alias("json"))


def from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, root) of the graphs in a text file or folder, each file one graph; malformed JSON stops the job."""
    text = spark.read.text(path, wholetext=True)
    graph = text.select(F.from_json("value", GRAPH, {"mode": "FAILFAST"}).alias("g"))
    nodes = graph.select(F.explode(F.map_values("g.nodes")).alias("n")).select("n.*")
    kids = nodes.select(F.col("id").alias("container_id"), F.posexplode("children").alias("child_ordinal", "child"))
    nodes = nodes.drop("children").withColumnRenamed("parent", "parent_id").join(
        kids.withColumnRenamed("child", "id").withColumn("child_ordinal", F.col("child_ordinal").cast("long")), "id", "left"
    )
    edges = graph.select(F.posexplode("g.edges").alias("seq", "e")).select("e.source", "e.target", "e.kind", "e.weight", F.col("seq").cast("long").alias("seq"))
    return nodes, edges, graph.select("g.root")
