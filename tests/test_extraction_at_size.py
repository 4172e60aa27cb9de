"""Extraction is dealt to all tasks and reads each file once."""

import os
import uuid

import pytest

from loomgraph.extract import job, sites
from loomgraph.plans import sources_workload as sw
from loomgraph.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_a_table_in_one_block_are_dealt_to_all_tasks(spark):
    files = sw.source_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    sizes = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < sum(sizes) / 4


@pytest.fixture
def counted(tmp_path):
    folder = str(tmp_path)

    def extract(source):
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield sites.Site("Function", "f", 0, len(source), "Public")
        yield sites.Site("Function", "g", 1, len(source) - 1, "Public")
        yield sites.Site("FunctionCall", "h", 2, 3)

    sites.register_language("Counted", extract)
    yield lambda: len(os.listdir(folder))
    del sites.EXTRACTORS["Counted"]


def test_blocks_and_references_need_one_reading_of_a_file(spark, counted):
    files = spark.createDataFrame([("a", "Counted", b"{{ x }}"), ("b", "Counted", b"\n{{ x }}")], "path string, language string, content binary")
    found = job.extract_sites(files)
    blocks = {(r.id, r.parent_id) for r in job.blocks_of(found).collect()}
    assert blocks == {("a::f@1", "a"), ("a::g@1", "a::f@1"), ("b::f@1", "b"), ("b::g@2", "b::f@1")}
    assert counted() == 2
    refs = {(r.from_node, r.name) for r in job.references_of(found).collect()}
    assert refs == {("a::f@1", "h"), ("a::g@1", "h"), ("b::f@1", "h"), ("b::g@2", "h")}
    assert counted() == 4
    assert "Join" not in plan(job.blocks_of(found)) + plan(job.references_of(found))


def test_a_task_with_many_files_tells_them_in_few_event_files(tmp_path):
    run = live.begin(str(tmp_path), "r")
    log = run.log(partition=0)
    for i in range(20_000):
        log.done(f"f{i}", 1, 0, 1, None)
    log.close()
    parts = [f for f in os.listdir(tmp_path) if "000000-" in f]
    assert len(parts) < 80
    lines = [line for f in parts for line in (tmp_path / f).read_text().splitlines()]
    assert len(lines) == len(set(lines)) == 40_000
