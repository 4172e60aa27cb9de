"""Edge merging, adjacency and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import numbering
from loomgraph.schema import MAX_WEIGHT, check_edge_kinds
from loomgraph.shared import broadcast_if_few, durable, written

#: Entries of a list in one row, about.
LISTED = 100_000
#: Tasks that merge edges, as a multiple of the session's shuffle partitions.
SMALLER = 4
#: Hashes of repeated edges that are broadcast at most.
FEW_REPEATED = 500_000


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, target, kind): summed weight, saturated; ``seq`` of the first.

    Weights are not negative, so saturating the total equals saturating step by step.

    Where edges hardly repeat, sums before the shuffle would hold every edge of a task in memory, beside what made
    them; so edges are dealt out first, to several times the usual number of tasks.
    """
    keys = ["source", "target", "kind"]
    n_tasks = SMALLER * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(n_tasks, *keys).groupBy(*keys).agg(
        F.least(F.sum("weight"), F.lit(MAX_WEIGHT)).cast("long").alias("weight"), F.min("seq").alias("seq")
    )


def merge_rare(edges: DataFrame) -> DataFrame:
    """The same as :func:`merge_edges` for a written table of edges that hardly repeat.

    Hashes are shuffled instead of edges. An edge whose hash is alone is a merged edge as it is and stays where it lies; only
    the others, which repeat or share a hash by chance, are merged by their keys.
    """
    keys = ["source", "target", "kind"]
    n_tasks = SMALLER * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = edges.select(*keys, "weight", "seq", F.xxhash64(*keys).alias("hash"))
    again = written(hashed.select("hash").repartition(n_tasks, "hash").groupBy("hash").count().filter("count > 1").select("hash"))
    again = broadcast_if_few(again, FEW_REPEATED)
    alone = hashed.join(again, "hash", "left_anti")
    once = alone.select(*keys, F.least("weight", F.lit(MAX_WEIGHT)).cast("long").alias("weight"), "seq")
    return once.unionByName(merge_edges(hashed.join(again, "hash", "left_semi")))


def distinct_imports(edges: DataFrame) -> DataFrame:
    """One import edge per (source, target), weights not summed."""
    return edges.select("source", "target").distinct().select("source", "target", F.lit("Import").alias("kind"), F.lit(1).cast("long").alias("weight"))


def counted_edges(edges: DataFrame) -> DataFrame:
    """Aggregated edges: number of rows per (source, target, kind)."""
    return edges.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("count"))


def adjacency(edges: DataFrame, *, reverse: bool = False, parts: int | None = None) -> DataFrame:
    """(node, part, neighbours): neighbours in order, each with the ``seq`` of its edge.

    A node of very high degree is listed in several rows, so that no task has to hold all its
    neighbours: in ``parts`` rows, dealt by ``seq``; without that in as many as its degree asks for
    at about ``LISTED`` a row.
    """
    node, neighbour = ("target", "source") if reverse else ("source", "target")
    dealt = edges.select(F.col(node).alias("node"), F.col(neighbour).alias("neighbour"), "seq")
    if parts is None:
        degrees = dealt.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("parts"))
        hubs = degrees.filter("parts > 1")  # a LISTED-th of the edges at most
        dealt = dealt.join(hubs, "node", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("seq"), "parts"), F.lit(0)).cast("int"))
    else:
        dealt = dealt.withColumn("part", F.pmod("seq", F.lit(parts)).cast("int"))
    return dealt.groupBy("node", "part").agg(F.sort_array(F.collect_list(F.struct("neighbour", "seq"))).alias("neighbours"))


def positioned(edges: DataFrame) -> DataFrame:
    """``edges`` with ``idx``, their positions in the order of ``seq``; ties by source, target and kind."""
    return numbering.with_row_numbers(edges, "seq", "source", "target", "kind", name="idx")


def adjacency_rows(indexed: DataFrame, *, reverse: bool = False, listed: int = LISTED) -> DataFrame:
    """(node, chunk, first_slot, degree, entries): neighbours with edge positions as compressed sparse rows.

    All (node, position) pairs are numbered in order; a node's entries fill the slots from ``first_slot`` of its chunk
    0 on, in the order of positions, with ``listed`` of them in a row. So a hub is cut evenly into bounded
    rows, and no task holds all its neighbours.
    """
    node, neighbour = ("target", "source") if reverse else ("source", "target")
    slots = numbering.with_row_numbers(indexed.select(F.col(node).alias("node"), F.col(neighbour).alias("neighbour"), "idx"), "node", "idx", name="slot")
    spans = durable(slots.groupBy("node").agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("degree")))
    chunk = F.floor((F.col("slot") - F.col("first")) / listed).cast("long")
    rows = slots.join(spans, "node").withColumn("chunk", chunk)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("idx", "neighbour"))), lambda e: F.struct(e["neighbour"].alias("neighbour"), e["idx"].alias("idx")))
    return rows.groupBy("node", "chunk", "degree").agg(F.min("slot").alias("first_slot"), packed.alias("entries"))


def last_positions(indexed: DataFrame) -> DataFrame:
    """(source, target, kind, idx): the key of an edge and its last position; weights of duplicates are not merged."""
    return indexed.groupBy("source", "target", "kind").agg(F.max("idx").alias("idx"))


def incident_edges(routes: DataFrame, idx: str = "idx") -> DataFrame:
    """(node, idx): every edge under both its ends; a loop is listed twice."""
    return routes.select(F.explode(F.array("source", "target")).alias("node"), F.col(idx).alias("idx"))


def degree_by_kind(edges: DataFrame) -> DataFrame:
    ends = edges.select("kind", F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node", "kind").agg(F.count(F.lit(1)).alias("degree"))


def of_kinds(edges: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    """Edges of the given kinds; None: all."""
    return edges if kinds is None else edges.filter(F.col("kind").isin(*check_edge_kinds(kinds)))


def children(nodes: DataFrame) -> DataFrame:
    """(container_id, part, children): child ids in order, those of ``LISTED`` ordinals in a row."""
    part = F.floor(F.coalesce("child_ordinal", F.lit(0)) / LISTED).cast("long").alias("part")
    return nodes.filter("container_id is not null").groupBy("container_id", part).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("child_ordinal", "id"))), lambda c: c["id"]).alias("children")
    )


def last_definitions(nodes: DataFrame) -> DataFrame:
    """One row per id: the one with the highest ``seq``."""
    columns = nodes.columns
    return nodes.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("n")).select(*[F.col(f"n.{c}").alias(c) for c in columns])
