"""Events told while files are read: before the job ends, and once where tasks are repeated."""

import time
from collections import Counter

import pytest
from loomgraph.extract import job, sites
from loomgraph.graph import CodeGraph
from loomgraph.streaming import live, progress, runs


@pytest.fixture
def slow():
    def extractor(source):
        time.sleep(0.05)
        return []

    sites.register_language("Slow", extractor)
    yield
    del sites.EXTRACTORS["Slow"]


def slow_files(spark, n):
    rows = [(f"f{i:03}", "Slow", b"\xff" if i % 10 == 3 else b"text") for i in range(n)]
    return spark.createDataFrame(rows, "path string, language string, content binary").coalesce(2)


def test_a_stream_sees_files_before_the_job_ends_and_once_after_a_repetition(spark, tmp_path, slow):
    run = live.begin(f"file:{tmp_path}/events", "r")
    seen = []

    def keep(rows, _):
        now = time.monotonic()
        seen.extend((now, r.type, r.path) for r in rows.collect())

    stream = runs.read_timed_events(spark, run.folder).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state"))
    query = stream.trigger(processingTime="200 milliseconds").start()
    try:
        query.processAllAvailable()
        found = job.extract_sites(slow_files(spark, 240), run)
        assert found.count() == 240
        ended = time.monotonic()
        run.complete(*progress.run_totals(job.results_of(found)).first())  # reads all files again
        query.processAllAvailable()
    finally:
        query.stop()
    before = [kind for at, kind, _ in seen if at < ended]
    assert before.count("FileDone") >= 18
    assert set(Counter((kind, path) for _, kind, path in seen).values()) == {1}
    assert Counter(kind for _, kind, _ in seen) == {"Start": 1, "FileStart": 240, "FileDone": 216, "Error": 24, "Complete": 1}
    state = runs.replay(live.told(spark, run.folder)).first()
    assert (state.parsed_files, state.total_files, state.total_blocks, state.n_errors, state.complete) == (216, 240, 0, 24, True)


def test_an_attempt_that_fails_tells_what_it_finished_and_its_repetition_the_rest(spark, tmp_path):
    flag = str(tmp_path / "flag")

    def fails_once(source):
        import os

        if source == "55" and not os.path.exists(flag):
            raise RuntimeError("lost")
        return []

    sites.register_language("Once", fails_once)
    try:
        rows = [(f"f{i:03}", "Once", str(i).encode()) for i in range(70)]
        files = spark.createDataFrame(rows, "path string, language string, content binary").coalesce(1)
        run = live.begin(str(tmp_path / "events"), "r")
        with pytest.raises(Exception, match="lost"):
            job.extract_sites(files, run).count()
        assert live.told(spark, run.folder).filter("type = 'FileDone'").count() == 40
        (tmp_path / "flag").write_text("")
        job.extract_sites(files, run).count()
    finally:
        del sites.EXTRACTORS["Once"]
    done = live.told(spark, run.folder).filter("type = 'FileDone'")
    assert done.count() == 70 and done.select("path").distinct().count() == 70


def test_parse_tells_its_files_and_a_second_run_of_the_id_starts_from_zero(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.py").write_text("def f(): pass\ndef g(): f()\n")
    (tmp_path / "repo" / "b.py").write_bytes(b"\xff")
    graph = CodeGraph.scan(spark, str(tmp_path / "repo"))
    states = []
    for _ in range(2):
        run = live.begin(str(tmp_path / "events"), "same")
        assert graph.parse(run).edges.count() == 1
        states.append(run.started)
    found = runs.replay(live.told(spark, run.folder)).orderBy("start_seq").collect()
    assert [r.start_seq for r in found] == states
    assert {(r.parsed_files, r.total_files, r.total_blocks, r.n_errors, r.complete) for r in found} == {(1, 2, 2, 1, True)}
