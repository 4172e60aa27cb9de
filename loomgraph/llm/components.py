"""Connected components of a graph given as edges, by alternating large and small stars.

First, blocks of at most ``BLOCK`` edges are contracted to stars within tasks; if that was one block,
it is the answer. Else stars are joined in rounds until nothing changes. Each round rewires every
node to the smallest neighbour it knows, so long chains shrink by a constant factor per round. A
round is two aggregations and two joins over the edges, written to the shared checkpoint folder;
edges are never gathered for one node or on the driver, which sees only the count and checksum
that tell whether a round changed anything. A node with a ``HUB``-th of all edges is a hub; there
are at most ``2 * HUB`` of them, so they are broadcast and their edges are not shuffled to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import durable, written


#: Edges that one task contracts at a time, which bounds its memory.
BLOCK = 200_000
HUB = 1_000


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of a partition to edges (node, smallest node linked with it within a block)."""
    root: dict[int, int] = {}
    seen = 0

    def find(node: int) -> int:
        while (above := root.setdefault(node, node)) != node:
            root[node] = node = root[above]
        return node

    def stars() -> pd.DataFrame:
        pairs = [(n, find(n)) for n in list(root)]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
        seen += len(batch)
        if seen >= BLOCK:
            yield stars()
            root.clear()
            seen = 0
    yield stars()


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with the smallest neighbour ``m`` of their end ``a``."""
    is_hub = F.col("degree") * HUB >= total
    hubs = F.broadcast(least.filter(is_hub).drop("degree"))
    of_hubs = edges.join(hubs, "a")
    others = edges.join(hubs, "a", "left_anti").join(least.filter(~is_hub).drop("degree"), "a")
    return of_hubs.unionByName(others)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("degree")))
    larger = _with_least(both.filter("b > a"), least, total)
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")))
    others = _with_least(edges, least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node, root), root the smallest node it is connected with.

    Only nodes that have a link appear. Self links and repeated links change nothing, rows with
    a null end are no links, no links give no rows.
    """
    edges = durable(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    blocks = -(-_state(edges)[0] // BLOCK)
    edges = durable(edges.coalesce(max(1, blocks)).mapInPandas(_contracted, "a long, b long").distinct())
    before = _state(edges)
    while blocks > 1 and before[0]:
        larger = durable(_large_star(edges, before[0]))
        edges = durable(_small_star(larger, before[0]))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
