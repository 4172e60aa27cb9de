"""The folder that driver and executors share, for what must outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset: a folder in the warehouse, or with a local master a temporary one. A warehouse on a
    disk of each machine, as it is by default, is refused, as the machines would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(chosen or _unnamed_folder(spark, context.master.startswith("local")))
    return context.getCheckpointDir()


def _unnamed_folder(spark: SparkSession, local: bool) -> str:
    if local:
        return tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/loomgraph-checkpoint"
    if _store(spark, folder)[0].getUri().getScheme() == "file":
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {folder} is on each machine's own disk")
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back from there.

    Lineage ends at the files, so a lost executor costs no recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, for tables that are large or read more than once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go when a write ends, not when its plan is collected as garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def broadcast_if_few(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, marked for broadcast if they are ``most`` at most; they are counted for that, so they should be cheap to read."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: The tables written in the innermost open ``scratch`` of this thread.
_open: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _store(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark sees it."""
    store, folder = _store(spark, path)
    store.delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What :func:`written` writes inside is deleted at the end: for steps whose result is itself written."""
    made: list[str] = []
    outer = _open.set(made)
    try:
        yield
    finally:
        _open.reset(outer)
        for path in made:
            delete(spark, path)
