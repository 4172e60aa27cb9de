"""Progress of extraction runs: events, and their fold in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.schema import EVENTS


def file_events(results: DataFrame, run_id: str) -> DataFrame:
    """Start and end events of each file, and the final one, from (seq, path, blocks, message).

    ``message`` is null for files that were read.
    """
    end = F.struct(
        (F.col("seq") * 2 + 1).alias("seq"),
        F.when(F.col("message").isNull(), "FileDone").otherwise("Error").alias("type"),
        F.when(F.col("message").isNull(), F.col("blocks").cast("long")).alias("blocks"),
        F.col("message").alias("message"),
    )
    start = F.struct(
        (F.col("seq") * 2).alias("seq"),
        F.lit("FileStart").alias("type"),
        F.lit(None).cast("long").alias("blocks"),
        F.lit(None).cast("string").alias("message"),
    )
    none = F.lit(None).cast("long")
    files = results.select("path", F.explode(F.array(start, end)).alias("e")).select(
        F.lit(run_id).alias("run_id"), "e.seq", "e.type", "path", "e.blocks", "e.message", none.alias("total_files"), none.alias("total_blocks")
    )
    last = results.agg(
        F.coalesce(F.max("seq") * 2 + 2, F.lit(0)).alias("seq"),
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("message").isNull(), F.col("blocks"))), F.lit(0)).cast("long").alias("total_blocks"),
    ).select(
        F.lit(run_id).alias("run_id"),
        "seq",
        F.lit("Complete").alias("type"),
        F.lit(None).cast("string").alias("path"),
        none.alias("blocks"),
        F.lit(None).cast("string").alias("message"),
        "total_files",
        "total_blocks",
    )
    return files.unionByName(last)


def _of(type_: str, value: Column) -> Column:
    return F.when(F.col("type") == type_, value)


def fold(events: DataFrame) -> DataFrame:
    """Progress per run: current path, files and blocks done, errors, totals, whether it has ended.

    Totals of the Complete event override the counts. Works on batches and streams alike: it is
    one aggregation over events, in whatever order they arrive.
    """
    done = F.count_if(F.col("type") == "FileDone")
    blocks = F.coalesce(F.sum(_of("FileDone", F.col("blocks"))), F.lit(0))
    return events.groupBy("run_id").agg(
        F.max_by(_of("FileStart", F.col("path")), _of("FileStart", F.col("seq"))).alias("current_path"),
        F.coalesce(F.max(_of("Complete", F.col("total_files"))), done).alias("parsed_files"),
        F.coalesce(F.max(_of("Complete", F.col("total_blocks"))), blocks).cast("long").alias("parsed_blocks"),
        F.count_if(F.col("type") == "Error").alias("n_errors"),
        F.max(_of("Complete", F.col("total_files"))).alias("total_files"),
        F.bool_or(F.col("type") == "Complete").alias("complete"),
    )


def errors(events: DataFrame) -> DataFrame:
    """(run_id, seq, path, message), a row per failed file."""
    return events.filter("type = 'Error'").select("run_id", "seq", "path", "message")


def ratio(parsed: Column, total: Column) -> Column:
    """Per cent done, at most 100; 0 while the total is unknown."""
    return F.coalesce(F.least(F.lit(100.0), F.try_divide(parsed * F.lit(100.0), total)), F.lit(0.0))


def run_totals(results: DataFrame) -> DataFrame:
    """Files, failed ones included, and blocks of the files that were read."""
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("message").isNull(), F.col("blocks"))), F.lit(0)).cast("long").alias("total_blocks"),
    )


def read_event_files(spark, path: str) -> DataFrame:
    """Stream of events from JSON files that appear in a folder."""
    return spark.readStream.schema(EVENTS).json(path)


def write_progress(
    events: DataFrame, checkpoint: str, *, to_batch: Callable[[DataFrame, int], None], seconds: int | None = None
) -> StreamingQuery:
    """Run the fold as a stream; ``to_batch`` gets the runs that have changed, with a number, at every trigger.

    State is a row per run, kept by the executors. ``seconds`` limits how often it is brought up to
    date; without it all available events are folded and the query ends.
    """
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    stream = fold(events).writeStream.outputMode("update").foreachBatch(to_batch)
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def watch_progress(events: DataFrame, name: str, checkpoint: str, *, seconds: int | None = None) -> StreamingQuery:
    """The same into the in-memory table ``name``, which the driver holds: for watching a few runs."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    stream = fold(events).writeStream.outputMode("complete").format("memory").queryName(name)
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest(results: DataFrame, key: str, order: str) -> DataFrame:
    """Per ``key`` the row with the highest ``order``: the last of several requests or writes wins."""
    columns = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def tail(log: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """The last ``n`` lines of a log."""
    return log.orderBy(F.desc(order)).limit(n)
