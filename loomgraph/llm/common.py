"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.shared import durable, shared_folder, written

__all__ = ["durable", "shared_folder", "written"]

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): a number for each row beside the row itself, so names of its columns clash with nothing.

    Written, so that a row has the same number in every use.
    """
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns(docs)).alias("doc")))
