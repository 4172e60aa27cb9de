"""Replayed runs, debounce and frames: batch, and the same as a stream."""

import json
import random
from datetime import datetime, timedelta, timezone

from loomgraph.streaming import runs
from pyspark.sql import functions as F

BEGAN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made_events(seed, n=600, ids=4):
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choice(["Start", "FileStart", "FileStart", "FileDone", "FileDone", "Error", "Complete"])
        event = {"run_id": f"r{rng.randrange(ids)}", "seq": seq, "type": kind, "ts": (BEGAN + timedelta(seconds=seq)).strftime("%Y-%m-%dT%H:%M:%S.000Z")}
        if kind in ("FileStart", "FileDone", "Error"):
            event["path"] = f"f{seq}"
        if kind == "FileDone":
            event["blocks"] = rng.choice([None, rng.randrange(9)])
        if kind == "Error":
            event["message"] = "bad"
        if kind == "Complete":
            event |= {"total_files": seq, "total_blocks": rng.choice([None, seq * 2])}
        out.append(event)
    return out


def brute(events):
    state, found = {}, {}
    for e in sorted(events, key=lambda e: e["seq"]):
        run = state.get(e["run_id"])
        if e["type"] == "Start":
            run = state[e["run_id"]] = [e["run_id"], e["seq"], None, 0, 0, 0, 0, False]
            found[e["run_id"], e["seq"]] = run
        elif run is None or run[7]:
            continue
        elif e["type"] == "FileStart":
            run[2] = e["path"]
        elif e["type"] == "FileDone":
            run[3] += 1
            run[5] += e["blocks"] or 0
        elif e["type"] == "Error":
            run[6] += 1
        else:
            run[4], run[7] = e["total_files"], True
            run[5] = run[5] if e["total_blocks"] is None else e["total_blocks"]
    return sorted(map(tuple, found.values()))


COLUMNS = ["run_id", "start_seq", "current_path", "parsed_files", "total_files", "total_blocks", "n_errors", "complete"]


def write(folder, events):
    folder.mkdir(exist_ok=True)
    for k in range(0, len(events), 60):
        (folder / f"{k:05}.json").write_text("\n".join(map(json.dumps, events[k : k + 60])))


def test_batch_and_stream_replay_runs(spark, tmp_path):
    events = made_events(1)
    rng = random.Random(2)
    shuffled = sorted(events, key=lambda e: e["seq"] + rng.uniform(0, 200))  # out of order by some minutes
    write(tmp_path / "in", shuffled)
    batch = spark.read.schema(runs.TIMED_EVENTS).json(str(tmp_path / "in"))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in runs.replay(batch).collect()) == brute(events)

    late = {"run_id": "end", "seq": 10**6, "type": "Start", "ts": "2024-01-01T06:00:00.000Z"}
    (tmp_path / "in" / "99999.json").write_text(json.dumps(late))
    last, told = {}, []

    def keep(rows, _):
        for r in rows.collect():
            told.append(r)
            last[r.run_id, r.start_seq] = tuple(r[c] for c in COLUMNS)

    stream = runs.read_timed_events(spark, str(tmp_path / "in"), files_per_trigger=4)
    query = runs.write_runs(stream, str(tmp_path / "state"), to_batch=keep, delay="10 minutes", forget_hours=1)
    assert query.awaitTermination(150)
    assert sorted(last.values()) == brute(events)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    # The ids were forgotten after an hour; one that goes on without a start has no run.
    more = [{"run_id": "r0", "seq": 10**6 + 1, "type": "FileDone", "blocks": 3, "ts": "2024-01-01T07:00:00.000Z"}]
    more += [{"run_id": "r1", "seq": 10**6 + 2, "type": "Start", "ts": "2024-01-01T07:00:00.000Z"}, late | {"seq": 10**6 + 3, "ts": "2024-01-01T12:00:00.000Z"}]
    (tmp_path / "in" / "999999.json").write_text("\n".join(map(json.dumps, more)))
    told.clear()
    stream = runs.read_timed_events(spark, str(tmp_path / "in"))
    assert runs.write_runs(stream, str(tmp_path / "state"), to_batch=keep, delay="10 minutes", forget_hours=1).awaitTermination(150)
    assert {(r.run_id, r.parsed_files) for r in told} == {("r1", 0), ("end", 0)}


def test_rows_without_id_time_or_number_are_left_out(spark):
    rows = [(None, 1, "Start", BEGAN), ("a", None, "Start", BEGAN), ("a", 2, "Start", None), ("a", 3, "FileDone", BEGAN)]
    events = spark.createDataFrame(rows, "run_id string, seq long, type string, ts timestamp").select(
        "*", *[F.lit(None).cast(k).alias(c) for c, k in (("path", "string"), ("blocks", "long"), ("total_files", "long"), ("total_blocks", "long"))]
    )
    assert runs.replay(events).count() == 0


def writes(spark, tmp_path):
    rng, at, rows = random.Random(4), BEGAN, []
    for seq in range(200):
        at += timedelta(milliseconds=rng.choice([5, 40, 499, 501, 900]))
        rows.append({"key": f"k{rng.randrange(2)}", "seq": seq, "value": seq, "ts": at.isoformat()})
    write(tmp_path / "writes", rows)
    return rows, "key string, seq long, value long, ts timestamp"


def bursts(rows, gap):
    out = []
    for key in {r["key"] for r in rows}:
        own = [r for r in rows if r["key"] == key]
        for r, after in zip(own, [*own[1:], None], strict=True):
            if after is None or datetime.fromisoformat(after["ts"]) - datetime.fromisoformat(r["ts"]) > gap:
                out.append((key, r["value"]))
    return sorted(out)


def test_debounce_and_frames_in_batch_and_as_streams(spark, tmp_path):
    rows, schema = writes(spark, tmp_path)
    batch = spark.read.schema(schema).json(str(tmp_path / "writes"))
    assert sorted((r.key, r.value) for r in runs.debounced(batch, "key").collect()) == bursts(rows, timedelta(milliseconds=500))
    frames = {}
    for r in rows:
        micros = int(datetime.fromisoformat(r["ts"]).timestamp() * 1e6 + 0.5)
        frames[r["key"], micros // 16667] = (r["key"], r["value"])
    assert sorted((r.key, r.value) for r in runs.per_frame(batch, "key").collect()) == sorted(frames.values())

    end = {"key": "end", "seq": 10**6, "value": -1, "ts": "2024-01-02T00:00:00+00:00"}
    (tmp_path / "writes" / "99999.json").write_text(json.dumps(end))
    for name, made in (("debounced", lambda df: runs.debounced(df, "key")), ("frames", lambda df: runs.per_frame(df, "key"))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "writes")).withWatermark("ts", "5 minutes")
        query = made(stream).writeStream.outputMode("append").format("memory").queryName(name)
        assert query.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(150)
        assert sorted(map(tuple, spark.table(name).drop("ts").collect())) == sorted(map(tuple, made(batch).drop("ts").collect()))
