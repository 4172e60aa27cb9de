"""Saved view state: per folder the ids of the expanded and of the visible nodes, and detail settings.

One Parquet table partitioned by folder key and set name; saving a set replaces its partition.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.paths import path_hash
from loomgraph.functions.style import DetailSettings

SETS = ("expanded", "visible")


def restore_wanted(arguments: list[str]) -> bool:
    """Whether a start with these arguments takes up the saved state: not with ``--norestore``."""
    return "--norestore" not in arguments


def folder_key(spark: SparkSession, folder: str) -> str:
    return spark.range(1).select(path_hash(F.lit(folder)).alias("key")).first()["key"]


def save(ids: DataFrame, table_path: str, folder: str, set_name: str) -> None:
    if set_name not in SETS:
        raise ValueError(f"unknown set: {set_name}")
    key = folder_key(ids.sparkSession, folder)
    ids.select("id").distinct().write.mode("overwrite").parquet(f"{table_path}/folder_key={key}/set_name={set_name}")


def load(spark: SparkSession, table_path: str, folder: str, set_name: str) -> DataFrame:
    """Saved ids; none if nothing was saved."""
    path = f"{table_path}/folder_key={folder_key(spark, folder)}/set_name={set_name}"
    try:
        return spark.read.schema("id string").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "id string")


def save_settings(spark: SparkSession, settings: DetailSettings, path: str) -> None:
    values = asdict(settings) | {"hidden_at_overview": list(settings.hidden_at_overview)}
    spark.createDataFrame([values], SETTINGS).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str) -> DetailSettings:
    """Saved settings, a default for each field that is missing."""
    default = asdict(DetailSettings())
    try:
        saved = spark.read.schema(SETTINGS).json(path).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        saved = None
    values = default | {k: v for k, v in (saved.asDict() if saved else {}).items() if v is not None}
    return DetailSettings(**values | {"hidden_at_overview": tuple(values["hidden_at_overview"])})


SETTINGS = "minimap_opacity double, overview_opacity double, edges_in_minimap boolean, hidden_at_overview array<string>"
