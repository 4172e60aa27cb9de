"""Global row numbers in an order, without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.shared import durable


def with_row_numbers(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... in ``order``; rows equal in it are numbered as they come. A column of that name is replaced.

    Rows are range partitioned and sorted within partitions; a partition's numbers start after the
    rows of those before it. Only the counts, a row per partition, are brought together. The
    sorted rows are written to the shared folder, so that both uses see the same partitions.
    """
    ordered = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ordered.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    split = placed.withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c != name]
    return split.join(F.broadcast(offsets), "part").select(*kept, (F.col("offset") + inside).alias(name))
