"""A tree as numbers: the subtree of a node is a range, and a drawn list is paged by rank.

Nodes are numbered in tree order (a node before what is below it), so all below a node follow it without a gap.
``start`` is a node's number, ``end`` the number after the last one below it. What asked for arrays of
containers becomes a comparison of two numbers, which reaches the files as a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import numbering
from loomgraph.shared import durable


def with_intervals(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, ancestors) with ``start``, ``end`` and ``depth``; ids that share a container come in their order."""
    placed = nodes.withColumn("tree_place", F.concat("ancestors", F.array("id")))
    numbered = numbering.with_row_numbers(placed, "tree_place", name="start").drop("tree_place")
    below = nodes.select(F.explode("ancestors").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_below"))
    whole = numbered.join(below, "id", "left")
    return whole.withColumn("end", F.col("start") + 1 + F.coalesce("n_below", F.lit(0))).withColumn("depth", F.size("ancestors")).drop("n_below")


def write_intervals(nodes: DataFrame, path: str) -> DataFrame:
    """The numbered tree in files that each hold a run of numbers, and what they read as."""
    with_intervals(nodes).repartitionByRange("start").sortWithinPartitions("start").write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


def bounds(tree: DataFrame, node_id: str) -> tuple[int, int]:
    """(start, end) of a node; an empty range for an unknown one."""
    row = tree.filter(F.col("id") == node_id).select("start", "end").first()
    return (row["start"], row["end"]) if row else (0, 0)


def subtree(tree: DataFrame, node_id: str) -> DataFrame:
    """The node and everything below it."""
    start, end = bounds(tree, node_id)
    return tree.filter((F.col("start") >= start) & (F.col("start") < end))


def numbered_edges(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """``edges`` with the numbers of both ends; those with an end that is not in the tree are left out."""
    number = lambda end: tree.select(F.col("id").alias(end), F.col("start").alias(f"{end}_start"))
    return edges.join(number("source"), "source").join(number("target"), "target")


def touching(edges: DataFrame, tree: DataFrame, node_id: str) -> DataFrame:
    """Numbered edges with an end at a node or below it."""
    start, end = bounds(tree, node_id)
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    return edges.filter(inside("source_start") | inside("target_start"))


def not_below(tree: DataFrame, closed: DataFrame) -> DataFrame:
    """Nodes with none of the ``closed`` ids above them.

    Ranges of a tree lie inside one another or apart, so a node is below a closed one if and only if the furthest
    end of the closed nodes before it lies behind it: a running maximum. It goes through range partitions; only
    one row each, the furthest end, is brought together.
    """
    marked = tree.join(closed.select("id").distinct().withColumn("is_closed", F.lit(True)), "id", "left")
    placed = durable(marked.repartitionByRange("start").sortWithinPartitions("start"))
    parted = placed.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    end = F.when(F.col("is_closed"), F.col("end"))
    furthest = parted.groupBy("part").agg(F.max(end).alias("furthest"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = furthest.select("part", F.max("furthest").over(before).alias("carried"))
    inside = Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(end).over(inside), F.col("carried"))  # without a value where there is none
    joined = parted.join(F.broadcast(carried), "part").withColumn("reach", reach)
    return joined.filter("reach is null or reach <= start").drop("part", "carried", "reach", "is_closed")


def drawn_rows(tree: DataFrame, matches: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows of a drawn tree in their order: ``tree`` with ``ordinal``, and ``depth`` from 0 below the root.

    A row is drawn if it is among ``matches`` and everything above it, but for the root, is expanded. ``matches`` holds
    the containers of each of its ids, as :func:`hierarchy.search` gives them.
    """
    parents = tree.filter("end > start + 1 and id <> ''").select("id", "start")
    closed = parents.join(expanded.select("id").distinct(), "id", "left_anti")
    seen = not_below(tree, closed).filter("id <> ''").join(matches.select("id").distinct(), "id", "left_semi")
    return numbering.with_row_numbers(seen, "start", name="ordinal").withColumn("depth", F.col("depth") - 1)


def page(drawn: DataFrame, number: int, rows: int = 100) -> DataFrame:
    """A page of a drawn tree, from 0."""
    return drawn.filter((F.col("ordinal") >= number * rows) & (F.col("ordinal") < (number + 1) * rows))
