"""An index of boxes in files: a viewport reads only tiles that may hold what it shows, an upsert rewrites only those it changes.

A box has a level at which square cells are as large as it, and lies in the cell of its lower corner. Cells of a
level are numbered along a space-filling curve (bits of column and row in turn). The table is partitioned by
level and tile, a run of the curve, and sorted by the curve within files, so a viewport becomes a few
ranges: partitions are pruned by tile, row groups by key. Boxes of one viewport are never compared with
all others.

Defined results: edges that touch meet; widths and heights are not negative; of rows with an equal id the last
upsert holds, and an upsert itself gives each id once; ids and coordinates are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.shared import durable

#: Cells of the finest level; beyond the last level boxes of any size share one.
CELL, LAST_LEVEL = 500.0, 40
#: Bits of a column or row, and by how much cells are moved so that none is negative; cells further out share the outermost.
BITS, MIDDLE = 31, 1 << 30
#: Cells across a tile, as a power of two; ranges of the curve that a viewport becomes at a level, at most.
TILE_BITS, RANGES = 5, 16
BOX = ("node_id", "x", "y", "width", "height")
ROWS_PER_FILE = 1_000_000


def level_of(width: Column, height: Column) -> Column:
    """The finest level whose cells are as large as a box."""
    wanted = F.ceil(F.log2(F.greatest(width, height) / F.lit(CELL)))
    return F.least(F.greatest(F.coalesce(wanted, F.lit(0)), F.lit(0)), F.lit(LAST_LEVEL)).cast("int")


def _apart(value: Column) -> Column:
    """A number of 31 bits with a zero bit behind each of its bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def curve_key(x: Column, y: Column, level: Column) -> Column:
    """Place on the curve of the cell that holds a point."""
    size = F.lit(CELL) * F.pow(F.lit(2.0), level)
    cell = lambda v: (F.least(F.greatest(F.floor(v / size), F.lit(-MIDDLE)), F.lit(MIDDLE - 1)) + MIDDLE).cast("long")
    return _apart(cell(x)).bitwiseOR(F.shiftleft(_apart(cell(y)), 1))


def curve_ranges(left: int, top: int, right: int, bottom: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, at most ``most``, that cover the cells of a rectangle, ends included.

    Squares of the curve are split as long as there are few enough; those outside are left out.
    """
    squares, whole = [(0, 0, BITS)], []
    while squares:
        parts = []
        for column, row, bits in squares:
            half = 1 << (bits - 1) if bits else 0
            for c, r in ((column, row), (column + half, row), (column, row + half), (column + half, row + half)) if bits else ((column, row),):
                size = max(half, 1)
                if c > right or r > bottom or c + size <= left or r + size <= top:
                    continue
                inside = left <= c and c + size - 1 <= right and top <= r and r + size - 1 <= bottom
                (whole if inside or size == 1 else parts).append((c, r, max(bits - 1, 0)))
        if len(parts) + len(whole) > most:
            whole += parts
            break
        squares = parts
    spans = []
    for column, row, bits in whole:
        low = sum((column >> i & 1) << 2 * i | (row >> i & 1) << 2 * i + 1 for i in range(BITS))
        spans.append((low, low + (1 << 2 * bits) - 1))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and merged[-1][1] + 1 >= low:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    while len(merged) > most:  # the two that are nearest become one
        at = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[at : at + 2] = [(merged[at][0], merged[at + 1][1])]
    return merged


def keyed(boxes: DataFrame) -> DataFrame:
    """``boxes`` with level, tile and key."""
    leveled = boxes.select(*BOX).withColumn("level", level_of(F.col("width"), F.col("height")))
    placed = leveled.withColumn("key", curve_key(F.col("x"), F.col("y"), F.col("level")))
    return placed.withColumn("tile", F.shiftright("key", 2 * TILE_BITS))


def _written(rows: DataFrame, path: str, mode: str) -> None:
    """A tile is in one file or, where it is large, in several."""
    dealt = rows.repartition("level", "tile").sortWithinPartitions("level", "tile", "key")
    writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.partitionBy("level", "tile").parquet(path)


def create_index(boxes: DataFrame, path: str) -> None:
    _written(keyed(boxes), path, "errorifexists")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = "node_id string, x double, y double, width double, height double, key long, level int, tile long"
    return spark.read.schema(schema).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All boxes."""
    return _rows(spark, path).filter("node_id is not null").select(*BOX)


def index_size(spark: SparkSession, path: str) -> int:
    return _rows(spark, path).filter("node_id is not null").count()


def viewport_filter(x: float, y: float, width: float, height: float) -> Column:
    """The levels, tiles and keys at which boxes may meet a viewport, then the meeting itself."""
    some = F.col("level") == LAST_LEVEL
    for level in range(LAST_LEVEL):
        size = CELL * 2.0**level
        cell = lambda v, size=size: int(min(max(v // size, -MIDDLE), MIDDLE - 1)) + MIDDLE
        spans = curve_ranges(max(cell(x) - 1, 0), max(cell(y) - 1, 0), cell(x + width), cell(y + height))
        keys = tiles = F.lit(False)
        for low, high in spans:
            keys = keys | F.col("key").between(low, high)
            tiles = tiles | F.col("tile").between(low >> 2 * TILE_BITS, high >> 2 * TILE_BITS)
        some = some | ((F.col("level") == level) & tiles & keys)
    meets = (F.col("x") <= x + width) & (F.col("x") + F.col("width") >= x) & (F.col("y") <= y + height) & (F.col("y") + F.col("height") >= y)
    return some & meets


def boxes_in_view(spark: SparkSession, path: str, x: float, y: float, width: float, height: float) -> DataFrame:
    """Boxes of the index that meet a viewport."""
    return _rows(spark, path).filter(viewport_filter(x, y, width, height)).filter("node_id is not null").select(*BOX)


def _replace(spark: SparkSession, path: str, ids: DataFrame, fresh: DataFrame | None) -> None:
    """Rewrite the tiles that hold one of ``ids``, which go, or receive ``fresh`` rows.

    A tile that is left without boxes keeps a row without an id in its place, so that it is overwritten too.
    """
    rows = _rows(spark, path)
    ids = durable(ids.select("node_id").distinct())
    touched = rows.join(ids, "node_id", "left_semi").select("level", "tile")
    if fresh is not None:
        touched = touched.unionByName(fresh.select("level", "tile"))
    touched = durable(touched.distinct())
    kept = rows.filter("node_id is not null").join(touched, ["level", "tile"], "left_semi").join(ids, "node_id", "left_anti")
    marks = touched.select("level", "tile")
    every = (kept if fresh is None else kept.unionByName(fresh)).unionByName(marks, allowMissingColumns=True)
    _written(durable(every), path, "overwrite")


def upsert(spark: SparkSession, path: str, boxes: DataFrame) -> None:
    """Boxes put in place of those of equal ids, others added; of an id that is given twice any one box."""
    _replace(spark, path, boxes, durable(keyed(boxes.dropDuplicates(["node_id"]))))


def remove(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Boxes of ``ids`` (node_id) taken out; unknown ids change nothing."""
    _replace(spark, path, ids, None)
