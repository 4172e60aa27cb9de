"""Progress while files are read: extraction tasks append event files to a folder that a stream watches.

    run = live.begin("/shared/events", "run-1")
    stream = runs.write_runs(runs.read_timed_events(spark, run.folder), checkpoint, to_batch=show, seconds=1)
    graph = CodeGraph.scan(spark, path).parse(run)

The folder is one that driver and executors share, on a disk that all mount or on any store that Arrow can write to.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomgraph.streaming.runs import TIMED_EVENTS

#: A task appends a file of events after so many source files or bytes of them; after more, an eighth of those it has told, where it has many.
FILES = 20
MOST_FILES = 1000
BYTES = 4 << 20
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _now() -> int:
    return time.time_ns() // 1000


@dataclass(frozen=True)
class LiveRun:
    """A run that is told of as it goes; ``started`` is the number of its first event, microseconds since 1970.

    Each event is told once, also where tasks are repeated: an event file is named by the run, the partition and its place
    in it, and one that is there already is not written again. For this a partition must hold the same
    files in the same order when it is repeated, as one of a scan does. A file's start and end are told
    together. Clocks of executors may differ: no event comes before the run's start, and the totals of the
    completion hold whatever was counted.
    """

    folder: str
    run_id: str
    started: int

    def log(self, partition: int | None = None) -> TaskLog:
        """What the present task tells."""
        return TaskLog(self, TaskContext.get().partitionId() if partition is None else partition)

    def complete(self, total_files: int, total_blocks: int) -> None:
        self.append("complete", [self.event("Complete", _now(), total_files=total_files, total_blocks=total_blocks)])

    def event(self, kind: str, at: int, **fields) -> dict:
        at = max(at, self.started)
        stamp = (EPOCH + timedelta(microseconds=at)).isoformat(timespec="microseconds")
        return {"run_id": self.run_id, "seq": at, "type": kind, "ts": stamp, **fields}

    def append(self, name: str, events: list[dict]) -> None:
        """A file of events that appears as a whole, unless it is there already."""
        store, folder = _store(self.folder)
        path = f"{folder}/{self.started}-{name}.json"
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return
        hidden = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write("\n".join(map(json.dumps, events)).encode())
        store.move(hidden, path)


class TaskLog:
    def __init__(self, run: LiveRun, partition: int):
        self.run, self.partition, self.part, self.events, self.files, self.size, self.last = run, partition, 0, [], 0, 0, run.started
        self.told = 0

    def done(self, path: str, size: int, began: int, blocks: int | None, message: str | None) -> None:
        """A file was read, or could not be."""
        began = max(began, self.last + 1)
        self.last = max(_now(), began + 1)
        end = ("FileDone", {"blocks": blocks}) if message is None else ("Error", {"message": message})
        self.events += [self.run.event("FileStart", began, path=path), self.run.event(end[0], self.last, path=path, **end[1])]
        self.files, self.size = self.files + 1, self.size + size
        if self.files >= max(FILES, min(self.told // 8, MOST_FILES)) or self.size >= BYTES:
            self.close()

    def close(self) -> None:
        """Tell what was not told yet; not called by a task that fails, whose repetition tells it."""
        if self.events:
            self.run.append(f"{self.partition:06}-{self.part:06}", self.events)
            self.told += self.files
            self.part, self.events, self.files, self.size = self.part + 1, [], 0, 0


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def begin(folder: str, run_id: str) -> LiveRun:
    """Begin a run; an earlier one of the same id in the folder ends with it."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    run = LiveRun(folder, run_id, _now())
    run.append("start", [run.event("Start", run.started)])
    return run


def told(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a folder so far, as a table; :func:`runs.read_timed_events` gives them as a stream."""
    return spark.read.schema(TIMED_EVENTS).json(folder)
