"""Sites and the blocks around them, for sites that come from elsewhere than the extractors: diagnostics, search hits, traces.

Sites and blocks have ``file_path``, ``id``, and ``start`` and ``end``, positions in the file. A block lies around a
site if it starts at or before it, ends behind its start, and does not end before its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.shared import durable

PAIRS = "file_path string, site string, block string, level int"
#: Pairs handed over at a time.
ROWS = 10_000
#: Open blocks that are kept before ended ones among them are looked for.
OPEN = 64
ORDER = ("file_path", "start", "back", "is_site", "id")


def position(line: Column, column: Column) -> Column:
    """A line and a column as one number, in the order of the text."""
    return F.shiftleft(line.cast("long"), 32) + column


def with_positions(spans: DataFrame) -> DataFrame:
    """``spans``, with a ``span`` as blocks and references have it, with ``start`` and ``end``."""
    at = lambda end: position(F.col(f"span.{end}_line"), F.col(f"span.{end}_col"))
    return spans.withColumns({"start": at("start"), "end": at("end")})


def around(sites: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_path, site, block, level), a row for each site and block around it; level 0 is the innermost.

    The innermost block is that which starts last, of those the one that ends first, then the largest id. Ids become
    strings. Sites and blocks with a null in a column that counts give no rows, nor do blocks that end where they
    start; blocks may cross one another, and repeated rows count each for themselves.

    A sweep instead of a range join: sites and blocks are range partitioned in the order of the text, however long
    a file is. Blocks that are still open where a later partition begins are copied to it, which are as
    many as blocks lie around that place; each partition is then read once with the blocks open at the moment in
    memory.
    """
    fields = lambda df: df.select("file_path", F.col("id").cast("string").alias("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).dropna()
    rows = fields(blocks).filter("start < end").withColumn("is_site", F.lit(False)).unionByName(fields(sites).withColumn("is_site", F.lit(True)))
    rows = rows.withColumn("back", -F.col("end"))
    placed = durable(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)).withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    every = placed.unionByName(_carried(placed)).repartition("part").sortWithinPartitions("part", *ORDER)
    return every.select("part", "file_path", "start", "end", "is_site", "id").mapInPandas(_swept, PAIRS)


def _carried(placed: DataFrame) -> DataFrame:
    """Blocks once more for each later partition that begins inside them.

    The first place of each partition is all that is broadcast. Only blocks that reach the next partition are
    joined with the further ones.
    """
    firsts = placed.groupBy("part").agg(F.min(F.struct("file_path", "start")).alias("first"))
    following = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("next"))
    reaching = placed.filter("not is_site").join(F.broadcast(following), "part").filter("next.file_path = file_path and next.start < end").drop("next")
    later = firsts.select(F.col("part").alias("later"), F.col("first.file_path").alias("file_path"), F.col("first.start").alias("from"))
    copies = reaching.join(F.broadcast(later), "file_path").filter((F.col("later") > F.col("part")) & (F.col("from") < F.col("end")))
    return copies.withColumn("part", F.col("later")).drop("later", "from")


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place, still, limit, found = None, [], OPEN, []
    for batch in batches:
        for part, path, start, end, is_site, name in batch.itertuples(index=False, name=None):
            if place != (part, path):
                place, still, limit = (part, path), [], OPEN
            while still and still[-1][0] <= start:
                still.pop()
            if len(still) > limit:  # blocks that cross leave ended ones below
                still = [b for b in still if b[0] > start]
                limit = max(OPEN, 2 * len(still))
            if not is_site:
                still.append((end, name))
                continue
            over = (block for until, block in reversed(still) if until > start and until >= end)
            found += ((path, name, block, level) for level, block in enumerate(over))
            if len(found) >= ROWS:
                yield pd.DataFrame(found, columns=["file_path", "site", "block", "level"])
                found = []
    yield pd.DataFrame(found, columns=["file_path", "site", "block", "level"])


def innermost(sites: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_path, site, block): the innermost block around each site that has one."""
    return around(sites, blocks).filter("level = 0").drop("level")
