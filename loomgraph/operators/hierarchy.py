"""Containment queries over the ``ancestors`` column: no recursion, no climbing.

Sets of ids (visible, expanded, shown) are DataFrames with a column ``id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import prefixes
from loomgraph.shared import broadcast_if_few, durable, written

#: Shown ids that are broadcast at most; to more, the containers of all nodes are shuffled.
FEW_SHOWN = 10_000


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, type, file_path for blocks) with ``container_id`` and ``ancestors`` from their paths."""
    path = F.when(F.col("type") == "CodeBlock", F.col("file_path")).otherwise(F.col("id"))
    chain = F.when(F.col("type") == "CodeBlock", F.concat(prefixes(path), F.array("file_path"))).otherwise(prefixes(path))
    return nodes.withColumn("ancestors", chain).withColumn("container_id", F.get("ancestors", F.size("ancestors") - 1))


def missing_directories(files: DataFrame) -> DataFrame:
    """Ids of all directories above ``path``, the root included, each once."""
    return files.select(F.explode(prefixes(F.col("path"))).alias("id")).distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth): every node with every container above it; depth 0 is the root."""
    return nodes.select("id", F.posexplode("ancestors").alias("depth", "ancestor"))


def closure_by_recursion(nodes: DataFrame) -> DataFrame:
    """The same from ``container_id`` alone, for trees without path ids: (id, ancestor).

    Each round doubles the distance that is known, so a tree of n levels takes log2(n) rounds, each
    written to the shared checkpoint folder; neither levels nor rows are limited. A cycle raises.
    """
    jump = durable(nodes.select("id", F.col("container_id").alias("ancestor")).filter("ancestor is not null"))
    found = jump  # ancestors up to the distance of ``jump``
    while not jump.isEmpty():
        if not found.filter("id = ancestor").isEmpty():
            raise ValueError("containers form a cycle")
        start = jump.select(F.col("id").alias("start"), F.col("ancestor").alias("id"))
        further = start.join(found, "id").select(F.col("start").alias("id"), "ancestor")
        longer = start.join(jump, "id").select(F.col("start").alias("id"), "ancestor")
        found, jump = durable(found.unionByName(further)), durable(longer)
    return found


def subtree(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node and everything below it."""
    return nodes.filter((F.col("id") == node_id) | F.array_contains("ancestors", node_id))


def shown(nodes: DataFrame, visible: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes below the root that are visible and whose containers are all visible and expanded.

    Containers are judged first, each once: those that are open themselves bring the open ones above them,
    and lie open if these are all. Of the nodes only ``container_id`` is looked up.
    """
    marks = visible.select("id", F.lit(True).alias("seen"), F.lit(False).alias("wide"))
    marks = marks.unionByName(expanded.select("id", F.lit(False).alias("seen"), F.lit(True).alias("wide")))
    state = written(marks.groupBy("id").agg(F.bool_or("seen").alias("seen"), F.bool_or("wide").alias("wide")).filter("seen"))
    opened = state.filter("wide").select("id")
    chains = nodes.filter("id <> ''").join(opened, "id", "left_semi").select("id", F.filter(F.concat("ancestors", F.array("id")), lambda a: a != "").alias("chain"))
    steps = chains.select("id", F.size("chain").alias("n"), F.explode("chain").alias("step"))
    met = steps.join(opened.withColumnRenamed("id", "step"), "step").groupBy("id", "n").agg(F.count(F.lit(1)).alias("met"))
    lying_open = met.filter("met = n").select(F.col("id").alias("container_id"))
    root = nodes.sparkSession.range(1).select(F.lit("").alias("container_id"))
    present = nodes.filter("id <> ''").join(state.select("id"), "id", "left_semi")
    return present.join(lying_open.unionByName(root), "container_id", "left_semi").select(*nodes.columns)


def nearest_shown(nodes: DataFrame, shown_ids: DataFrame) -> DataFrame:
    """(id, shown_id): the node itself if shown, else its nearest shown container; others are left out."""
    chain = F.concat("ancestors", F.array("id"))
    pairs = nodes.select("id", F.posexplode(chain).alias("depth", "candidate"))
    shown_as = broadcast_if_few(shown_ids.select(F.col("id").alias("candidate")).distinct(), FEW_SHOWN)
    kept = pairs.join(shown_as, "candidate", "left_semi")
    return kept.groupBy("id").agg(F.max_by("candidate", "depth").alias("shown_id"))


def roll_up(edges: DataFrame, nodes: DataFrame, shown_ids: DataFrame) -> DataFrame:
    """Edges lifted to the nearest shown containers of their ends: source, target, kind, count, weight.

    Pairs already shown as they are, with an end below nothing shown, or inside one container are
    left out. ``kind`` is that of the first edge by ``seq``, then by name. Edges are merged once their
    source is lifted, which leaves few of them to meet the containers of their targets.
    """
    place = nearest_shown(nodes, shown_ids)
    own = (F.col("s") == F.col("source")).alias("own")
    lifted = (
        edges.select("source", "target", "kind", "weight", "seq")
        .join(place.select(F.col("id").alias("source"), F.col("shown_id").alias("s")), "source")
        .groupBy("s", "target", "kind", own)
        .agg(F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight"), F.min("seq").alias("seq"))
        .join(place.select(F.col("id").alias("target"), F.col("shown_id").alias("t")), "target")
        .filter("s <> t and not (own and t = target)")
    )
    return lifted.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(
        F.min_by("kind", F.struct("seq", "kind")).alias("kind"), F.sum("count").alias("count"), F.sum("weight").alias("weight")
    )


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Ids of nodes whose name contains ``query`` in any case, and of their containers.

    A blank query finds everything; otherwise blanks at its ends count.
    """
    if not query.strip():
        return nodes.select("id")
    found = nodes.filter(F.contains(F.lower("name"), F.lower(F.lit(query))))
    return found.select(F.explode(F.concat("ancestors", F.array("id"))).alias("id")).distinct()


def toggle_subtree(nodes: DataFrame, visible: DataFrame, node_id: str) -> DataFrame:
    """Visible ids after a click on ``node_id``: its subtree hidden if it was visible, shown if not."""
    below = subtree(nodes, node_id).select("id")
    was = visible.select(F.coalesce(F.bool_or(F.col("id") == node_id), F.lit(False)).alias("was"))
    every = visible.select("id", F.lit(1).alias("in")).unionByName(below.select("id", F.lit(2).alias("in")))
    state = every.groupBy("id").agg(F.max((F.col("in") == 1).cast("int")).alias("seen"), F.max((F.col("in") == 2).cast("int")).alias("below"))
    return state.crossJoin(F.broadcast(was)).filter("(seen = 1 and below = 0) or (below = 1 and not was)").select("id")


def default_expanded(nodes: DataFrame) -> DataFrame:
    """Directories and files with at least one child."""
    parents = nodes.select(F.col("container_id").alias("id")).filter("id is not null").distinct()
    return nodes.filter("type in ('Directory', 'File')").join(parents, "id", "left_semi").select("id")


def restored(saved: DataFrame, nodes: DataFrame, default: DataFrame) -> DataFrame:
    """Saved ids that still exist; ``default`` if none does."""
    existing = saved.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    none = existing.agg((F.count(F.lit(1)) == 0).alias("none"))
    return existing.unionByName(default.select("id").crossJoin(F.broadcast(none)).filter("none").select("id"))


def toggle_one(ids: DataFrame, one: str) -> DataFrame:
    """``ids`` with ``one`` added, or taken out if it was there."""
    single = ids.sparkSession.createDataFrame([(one,)], "id string")
    return ids.select("id").distinct().unionByName(single).groupBy("id").count().filter("count = 1").select("id")


def tree_order(nodes: DataFrame) -> DataFrame:
    """(id, depth, place): depth below the root, and the chain of ids to sort a drawn tree by."""
    return nodes.select("id", F.size("ancestors").alias("depth"), F.concat("ancestors", F.array("id")).alias("place"))
