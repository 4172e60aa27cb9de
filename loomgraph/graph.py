"""Facade: scan a repository, extract and resolve it, query the graph.

    graph = CodeGraph.scan(spark, "/path").parse()
    graph.subgraph(ids, ["FunctionCall"]).edges

Graphs are immutable and lazy; ``parse`` is a function of the scan, so parsing twice gives the same.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.extract import job
from loomgraph.operators import hierarchy, merge, numbering, resolve, view
from loomgraph.schema import EDGES, NODES
from loomgraph.sources import frontier, graph_json, repo_tree
from loomgraph.streaming import progress
from loomgraph.streaming.live import LiveRun


@dataclass(frozen=True)
class CodeGraph:
    nodes: DataFrame
    edges: DataFrame
    root: str = ""
    location: str | None = None
    sites: DataFrame | None = field(default=None, repr=False)
    listed: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def scan(spark: SparkSession, path: str, *, by_executors: bool = False) -> CodeGraph:
        """Directories and files below ``path``; no edges yet.

        The driver lists the names, or with ``by_executors`` the executors do once, for trees beyond the driver's memory.
        """
        repo_tree.check_root(path)
        location = os.path.realpath(path)
        listed = frontier.list_tree(spark, location) if by_executors else None
        if listed is None:
            repo_tree.register(spark)
            tree = spark.read.format("repo_tree").load(location).select("path", "name", "type", "language")
        else:
            tree = listed.select("path", "name", "type", "language")
        name = os.path.basename(location) or "root"
        root = spark.createDataFrame([("", name, "Directory", None)], "path string, name string, type string, language string")
        found = root.unionByName(tree).withColumn("id", F.col("path"))
        missing = hierarchy.missing_directories(tree).join(found, "id", "left_anti")
        found = found.unionByName(
            missing.select(F.col("id").alias("path"), F.substring_index("id", "/", -1).alias("name"), F.lit("Directory").alias("type"), F.lit(None).cast("string").alias("language"), "id")
        )
        filled = hierarchy.with_ancestors(found.withColumn("file_path", F.when(F.col("type") == "File", F.col("path"))))
        order = Window.partitionBy("container_id").orderBy("name")
        ordered = filled.withColumn("child_ordinal", (F.row_number().over(order) - 1).cast("long")).withColumn("parent_id", F.col("container_id"))
        return CodeGraph(_conform(ordered, NODES), spark.createDataFrame([], EDGES), "", location, listed=listed)

    def files(self) -> DataFrame:
        """Files of a known language: id, path, language."""
        return self.nodes.filter("type = 'File' and language is not null").select("id", "path", "language")

    def parse(self, report: LiveRun | None = None) -> CodeGraph:
        """The graph with the blocks of its files and all edges that resolve; ``report`` is told of files as they are read."""
        if self.location is None:
            raise ValueError("only a scanned graph can be parsed")
        spark = self.nodes.sparkSession
        known = "type = 'File' and language is not null"
        if self.listed is None:
            content = spark.read.format("repo_tree").option("content", "true").load(self.location).filter(known)
        else:
            content = frontier.with_content(self.listed.filter(known), self.location)
        sites = job.extract_sites(content, report).persist()
        blocks = hierarchy.with_ancestors(job.blocks_of(sites)).withColumn("seq", F.col("child_ordinal"))
        blocks = merge.last_definitions(blocks)
        base = self.nodes.filter("type <> 'CodeBlock'")
        nodes = base.unionByName(_conform(blocks, NODES))
        # References in the order of their files' paths, then of the text.
        last = job.results_of(sites).agg(F.coalesce(F.max("n_refs"), F.lit(0)).alias("last"))
        places = numbering.with_row_numbers(job.results_of(sites).select("path", F.split("path", "/").alias("parts")), "parts", name="place")
        if report is not None:  # numbering the files has read them all
            report.complete(*progress.run_totals(job.results_of(sites)).first())
        placed = job.references_of(sites).join(places.select(F.col("path").alias("file_path"), "place"), "file_path")
        refs = placed.crossJoin(F.broadcast(last)).withColumn("seq", F.col("place") * (F.col("last") + 1) + F.col("ordinal"))
        symbols = resolve.symbol_table(nodes)
        by_name = resolve.resolve_symbols(refs, symbols)
        imports = resolve.resolve_imports(refs.filter("kind = 'Import'"), base.filter("type = 'File'"))
        every = by_name.unionByName(imports.withColumn("seq", F.lit((1 << 62)).cast("long")))
        return replace(self, nodes=nodes, edges=_conform(merge.merge_edges(every), EDGES), sites=sites)

    def events(self, run_id: str = "run") -> DataFrame:
        """Progress events of the parse."""
        if self.sites is None:
            raise ValueError("the graph has not been parsed")
        results = job.results_of(self.sites).withColumn("parts", F.split("path", "/"))
        results = numbering.with_row_numbers(results, "parts", name="seq").drop("parts")
        return progress.file_events(results, run_id)

    def release(self) -> None:
        """Give up what the parse keeps cached; later uses extract again."""
        if self.sites is not None:
            self.sites.unpersist()

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def subgraph(self, ids: Iterable[str] | DataFrame, kinds: Iterable[str] | None = None) -> view.SubGraph:
        """Nodes in the order of ``ids`` (column ``pos``), and the edges of ``kinds`` between them."""
        visible = ids
        if not isinstance(ids, DataFrame):
            visible = self.nodes.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return view.subgraph(self.nodes, self.edges, visible, kinds)

    def search(self, query: str) -> DataFrame:
        return hierarchy.search(self.nodes, query)

    def counts(self) -> tuple[int, int]:
        return self.nodes.count(), self.edges.count()

    def to_json(self) -> DataFrame:
        return graph_json.to_json(self.nodes, self.edges, self.root)


def _conform(df: DataFrame, schema) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )
