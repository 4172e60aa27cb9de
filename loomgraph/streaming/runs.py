"""Runs replayed exactly: a start resets, what is outside a run is ignored, a completion overrides totals and ends it.

A run is told by (``run_id``, ``start_seq``), the number of the event that began it, so an id that
starts again begins from zero. ``replay`` does it over a table; ``replayed_stream`` does the same over a
stream whose events come in any order within ``delay``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomgraph.schema import EVENTS

#: Events with their time; ``Start`` begins a run.
TIMED_EVENTS = T.StructType([*EVENTS.fields, T.StructField("ts", T.TimestampType())])
RUNS = "run_id string, start_seq long, current_path string, parsed_files long, total_files long, total_blocks long, n_errors long, complete boolean"
#: What is kept of a run, and of an event that waits for the watermark.
KEPT = "start_seq long, current_path string, parsed_files long, total_files long, total_blocks long, n_errors long, complete boolean, last_ms long"
WAITING = "ms long, seq long, type string, path string, blocks long, total_files long, total_blocks long"


def replay(events: DataFrame) -> DataFrame:
    """One row per run, from events ordered by (ts, seq) within their id.

    Files that are done are counted, their blocks added up; ``total_files`` is 0 until the run is complete.
    Events before the first start of an id, and from a completion to the next start, count nowhere. Events
    without an id, a time or a number are left out.
    """
    order = Window.partitionBy("run_id").orderBy("ts", "seq")
    known = events.filter("run_id is not null and ts is not null and seq is not null")
    begun = known.withColumn("start_seq", F.last(F.when(F.col("type") == "Start", F.col("seq")), ignorenulls=True).over(order))
    begun = begun.withColumn("start_ts", F.last(F.when(F.col("type") == "Start", F.col("ts")), ignorenulls=True).over(order))
    inside = Window.partitionBy("run_id", "start_ts", "start_seq").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.bool_or(F.col("type") == "Complete").over(inside), F.lit(False))
    active = begun.filter("start_seq is not null").withColumn("ended", ended).filter("not ended")
    of = lambda kind, value: F.when(F.col("type") == kind, F.col(value))
    done = F.coalesce(F.sum(of("FileDone", "blocks")), F.lit(0))
    return active.groupBy("run_id", "start_ts", "start_seq").agg(
        F.max_by(of("FileStart", "path"), F.when(F.col("type") == "FileStart", F.struct("ts", "seq"))).alias("current_path"),
        F.count_if(F.col("type") == "FileDone").alias("parsed_files"),
        F.coalesce(F.max(of("Complete", "total_files")), F.lit(0)).alias("total_files"),
        F.coalesce(F.max(of("Complete", "total_blocks")), done).alias("total_blocks"),
        F.count_if(F.col("type") == "Error").alias("n_errors"),
        F.bool_or(F.col("type") == "Complete").alias("complete"),
    ).drop("start_ts")


def _applied(run: dict | None, event: dict) -> dict | None:
    """The state of an id after an event; None while no run was begun."""
    if event["type"] == "Start":
        run = {"start_seq": event["seq"], "current_path": None, "parsed_files": 0, "total_files": 0, "total_blocks": 0, "n_errors": 0, "complete": False}
    elif run is None or run["complete"]:
        return run
    elif event["type"] == "FileStart":
        run = run | {"current_path": event["path"]}
    elif event["type"] == "FileDone":
        run = run | {"parsed_files": run["parsed_files"] + 1, "total_blocks": run["total_blocks"] + (event["blocks"] or 0)}
    elif event["type"] == "Error":
        run = run | {"n_errors": run["n_errors"] + 1}
    elif event["type"] == "Complete":
        blocks = run["total_blocks"] if event["total_blocks"] is None else event["total_blocks"]
        run = run | {"total_files": event["total_files"] or 0, "total_blocks": blocks, "complete": True}
    return run | {"last_ms": event["ms"]}


class ReplayRuns(StatefulProcessor):
    """State of one id: its present run, and the events that the watermark has not passed yet."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", KEPT)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark, soonest = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            for row in frame.itertuples(index=False):
                if pd.isna(row.seq) or row.ms < mark:
                    continue
                whole = [None if pd.isna(v) else int(v) for v in (row.blocks, row.total_files, row.total_blocks)]
                self.waiting.appendValue((int(row.ms), int(row.seq), row.type, row.path, *whole))
                soonest = row.ms if soonest is None else min(soonest, row.ms)
        if soonest is not None:
            self.handle.registerTimer(int(soonest) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        names = [c.split(" ")[0] for c in WAITING.split(", ")]
        events = [dict(zip(names, e, strict=True)) for e in self.waiting.get()]
        ready = sorted((e for e in events if e["ms"] < mark), key=lambda e: (e["ms"], e["seq"]))
        later = [e for e in events if e["ms"] >= mark]
        kept = [c.split(" ")[0] for c in KEPT.split(", ")]
        run = dict(zip(kept, self.run.get(), strict=True)) if self.run.exists() else None
        changed: dict[int, dict] = {}
        for event in ready:
            after = _applied(run, event)
            if after is not None and after != run:
                changed[after["start_seq"]] = after
            run = after
        if later:
            self.waiting.put([tuple(e[n] for n in names) for e in later])
            self.handle.registerTimer(min(e["ms"] for e in later) + 1)
        else:
            self.waiting.clear()
        if run is None or (not later and run["last_ms"] + self.forget_ms < mark):
            self.run.clear()
        else:
            self.run.update(tuple(run[n] for n in kept))
            if not later:
                self.handle.registerTimer(run["last_ms"] + self.forget_ms + 1)
        if changed:
            yield pd.DataFrame([{"run_id": key[0], **{k: v for k, v in r.items() if k != "last_ms"}} for r in changed.values()])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams begun inside keep their state in RocksDB, which arbitrary state needs; they keep the setting, the session does not."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_timed_events(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of events from JSON files that appear in a folder."""
    reader = spark.readStream.schema(TIMED_EVENTS)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).json(path)


def replayed_stream(events: DataFrame, *, delay: str = "10 minutes", forget_hours: float = 24.0) -> DataFrame:
    """Runs that have changed, as a stream in update mode: the last row of a (run_id, start_seq) holds.

    An event waits until the watermark, ``delay`` behind the latest event, has passed it, and is then applied in
    order of (ts, seq); what comes later than that is dropped. A run of which nothing was heard for
    ``forget_hours`` of event time is forgotten. State is a row per id and its waiting events.
    """
    named = events.filter("run_id is not null and ts is not null").withWatermark("ts", delay)
    given = named.select("run_id", "ts", F.unix_millis("ts").alias("ms"), "seq", "type", "path", "blocks", "total_files", "total_blocks")
    processor = ReplayRuns(int(forget_hours * 3_600_000))
    return given.groupBy("run_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=RUNS, outputMode="Update", timeMode="EventTime")


def write_runs(
    events: DataFrame,
    checkpoint: str,
    *,
    to_batch: Callable[[DataFrame, int], None],
    delay: str = "10 minutes",
    forget_hours: float = 24.0,
    seconds: int | None = None,
) -> StreamingQuery:
    """Run the replay as a stream; ``to_batch`` gets the changed runs with a number at every trigger."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    with _rocksdb(events.sparkSession):
        stream = replayed_stream(events, delay=delay, forget_hours=forget_hours).writeStream.outputMode("update").foreachBatch(to_batch)
        return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def debounced(writes: DataFrame, key: str, *, gap: str = "500 milliseconds", order: str = "seq") -> DataFrame:
    """The last write of each burst of a key: no other within ``gap`` after it. ``written_at`` is when it takes effect.

    A batch, or a stream with a watermark on ``ts`` in append mode. Equal times are told apart by ``order``.
    """
    columns = [c for c in writes.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct("ts", order)).alias("row")
    bursts = writes.filter(F.col("ts").isNotNull()).groupBy(key, F.session_window("ts", gap).alias("burst")).agg(last, F.count(F.lit(1)).alias("n_writes"))
    return bursts.select(key, F.col("burst.end").alias("written_at"), "n_writes", "row.*")


def per_frame(requests: DataFrame, key: str, *, frame: str = "16667 microseconds", order: str = "seq") -> DataFrame:
    """The last request of a key in each frame: at most one redraw a frame. As :func:`debounced`, in batch or as a stream."""
    columns = [c for c in requests.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct("ts", order)).alias("row")
    frames = requests.filter(F.col("ts").isNotNull()).groupBy(key, F.window("ts", frame).alias("frame")).agg(last, F.count(F.lit(1)).alias("n_requests"))
    return frames.select(key, F.col("frame.start").alias("frame"), "n_requests", "row.*")
