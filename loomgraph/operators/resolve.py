"""Name resolution: references to symbols, imports to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import names, paths
from loomgraph.operators.merge import SMALLER
from loomgraph.schema import SUFFIXES, TYPE_LIKE
from loomgraph.shared import written

#: Blocks of a class in one row, about; and references that meet such a row in one task, about.
LISTED, ASKED = 4096, 5_000


def symbol_table(nodes: DataFrame) -> DataFrame:
    """(symbol, node_id): every block under its name and under ``file::name``."""
    blocks = nodes.filter("type = 'CodeBlock'")
    both = F.array(F.col("name"), F.concat("file_path", F.lit("::"), F.col("name")))
    return blocks.select(F.explode(both).alias("symbol"), F.col("id").alias("node_id"))


def group_references(refs: DataFrame) -> DataFrame:
    """References counted per (from_node, kind, symbol, original): what the join has to carry.

    ``original`` is the unshortened name where it may be looked up as well, else null.
    """
    symbol = names.lookup_name(F.col("kind"), F.col("name"))
    original = F.when(F.col("kind").isin(*TYPE_LIKE) & (symbol != F.col("name")), F.col("name"))
    return (
        refs.select("from_node", "kind", symbol.alias("symbol"), original.alias("original"), "seq")
        .groupBy("from_node", "kind", "symbol", "original")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("seq").alias("seq"))
    )


def symbol_classes(symbols: DataFrame) -> DataFrame:
    """(node_id, names): every block with all symbols that it is found by, each with how often.

    Blocks of equal ``names`` are the targets of the same references.
    """
    counted = symbols.filter("symbol is not null").groupBy("node_id", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("symbol", "n"))).alias("names"))


def listed_classes(members: DataFrame, askers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, parts, turns) of classes, and their blocks in rows (names, part, turn, blocks) of about ``LISTED``.

    ``members`` is a table as :func:`symbol_classes` makes it; ``askers`` (symbol, askers) says how many references a symbol
    has. A class is cut into ``parts``, which come once for each of the ``turns`` of its references, about ``ASKED`` in a turn.
    """
    sizes = members.groupBy("names").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("parts"))
    turns = F.greatest(F.ceil(F.sum("askers") / ASKED), F.lit(1)).cast("int").alias("turns")
    classes = sizes.select("names", "parts", F.inline("names")).join(askers, "symbol").groupBy("names", "parts").agg(turns)
    part = F.pmod(F.xxhash64("node_id"), "parts").cast("int").alias("part")
    lists = members.join(classes, "names").groupBy("names", "turns", part).agg(F.collect_list("node_id").alias("blocks"))
    return classes, lists.select("names", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "blocks")


def resolve_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Merged edges from references to all blocks of the name they look up.

    References are counted before the join, so a name used r times and defined d times makes at
    most (distinct referrers) x d rows instead of r x d. Type-like references that miss are looked
    up again by their original name. They are merged per class of blocks that have all names in common, as an edge to one
    of them is an edge to each; symbols that nobody asks for do not tell classes apart. The edges themselves, of which there
    may be many more, come last, from rows that list blocks, and are neither shuffled nor sorted; tasks get parts of like size.
    """
    grouped = written(group_references(refs))
    looked_up = grouped.select(F.explode(F.array("symbol", "original")).alias("symbol")).filter("symbol is not null")
    askers = looked_up.groupBy("symbol").agg(F.count(F.lit(1)).alias("askers"))
    members = written(symbol_classes(symbols.join(askers.select("symbol"), "symbol", "left_semi")))
    classes, lists = listed_classes(members, askers)
    named = classes.select("names", "parts", "turns", F.inline("names"))
    known = named.select("symbol").distinct().withColumn("known", F.lit(True))
    asked = grouped.join(known, "symbol", "left").select(
        "from_node", "kind", F.when(F.col("known"), F.col("symbol")).otherwise(F.col("original")).alias("symbol"), "weight", "seq"
    )
    merged = (
        asked.join(named, "symbol")
        .groupBy("from_node", "kind", "names", "parts", "turns")
        .agg(F.least(F.sum(F.col("weight") * F.col("n")), F.lit(4294967295)).cast("long").alias("weight"), F.min("seq").alias("seq"))
        .withColumn("turn", F.pmod(F.xxhash64("from_node"), "turns").cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    place = ["names", "part", "turn"]
    n_tasks = SMALLER * int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = merged.repartition(n_tasks, *place).join(lists.repartition(n_tasks, *place), place).withColumn("node_id", F.explode("blocks"))
    return edges.filter("from_node <> node_id").select(F.col("from_node").alias("source"), F.col("node_id").alias("target"), "kind", "weight", "seq")


def path_keys(files: DataFrame) -> DataFrame:
    """(key, node_id): a file under its path and under its path without suffix.

    Where keys collide a full path wins, then the smallest path.
    """
    key = F.explode(
        F.array(
            F.struct(F.col("path").alias("key"), F.lit(0).alias("rank")),
            F.struct(paths.without_suffix(F.col("path")).alias("key"), F.lit(1).alias("rank")),
        )
    )
    keyed = files.select(F.col("id").alias("node_id"), "path", key.alias("k"))
    return keyed.groupBy("k.key").agg(F.min_by("node_id", F.struct("k.rank", "path")).alias("node_id"))


def probe_candidates(base: Column, language: Column) -> Column:
    """Paths to try for ``base``, in order."""
    with_suffixes = lambda suffixes: F.array(*[F.concat(base, F.lit(s)) for s in suffixes])
    out = F.when(F.lit(False), with_suffixes(SUFFIXES[None]))
    for name, suffixes in SUFFIXES.items():
        if name is not None:
            out = out.when(language == name, with_suffixes(suffixes))
    return out.otherwise(with_suffixes(SUFFIXES[None]))


def import_candidates(module: Column, file_path: Column, language: Column) -> Column:
    """Keys that an import may mean, in order of preference."""
    relative = paths.relative_to(file_path, module)
    dotted = paths.dotted_to_path(module)
    crate = paths.crate_to_path(module)
    python, rust = F.lit("Python"), F.lit("Rust")
    return (
        F.when(F.startswith(module, F.lit(".")), F.concat(F.array(relative), probe_candidates(relative, language)))
        .when(
            F.contains(module, F.lit(".")) & ~F.contains(module, F.lit("/")),
            F.concat(F.array(dotted), probe_candidates(dotted, python)),
        )
        .when(F.startswith(module, F.lit("crate::")), probe_candidates(crate, rust))
        .otherwise(F.array(module))
    )


def first_match(asked: DataFrame, keys: DataFrame, candidates: str, by: list[str]) -> DataFrame:
    """``by`` and ``node_id`` of the first of ``candidates`` that is a key; rows without a match are left out."""
    tried = asked.select(*by, F.posexplode(candidates).alias("pos", "key"))
    return tried.join(keys, "key").groupBy(*by).agg(F.min_by("node_id", "pos").alias("node_id"))


def resolve_imports(refs: DataFrame, files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Import edges from file to file, each once, weight 1.

    ``refs`` has ``file_path`` (file of the reference) and ``module_path``.
    """
    keys = path_keys(files) if keys is None else keys
    languages = files.select(F.col("path").alias("file_path"), "language")
    asked = (
        refs.select("file_path", "module_path")
        .filter("module_path is not null")
        .distinct()
        .join(languages, "file_path", "left")
        .withColumn("candidates", import_candidates(F.col("module_path"), F.col("file_path"), F.col("language")))
    )
    found = first_match(asked, keys, "candidates", ["file_path", "module_path"])
    return (
        found.filter("file_path <> node_id")
        .select(F.col("file_path").alias("source"), F.col("node_id").alias("target"))
        .distinct()
        .select("source", "target", F.lit("Import").alias("kind"), F.lit(1).cast("long").alias("weight"))
    )
