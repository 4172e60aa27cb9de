"""Sites and the blocks around them: equal to a range join, in one huge file too."""

import random

import pytest
from loomgraph.extract import job
from loomgraph.operators import containment
from pyspark.sql import functions as F

ROWS = "file_path string, id string, start long, end long"


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(sites, blocks):
    found = []
    for path, site, start, end in sites:
        over = [b for b in blocks if b[0] == path and b[2] <= start < b[3] and end <= b[3]]
        over.sort(key=lambda b: (b[2], -b[3], b[1]), reverse=True)
        found += [(path, site, b[1], level) for level, b in enumerate(over)]
    return sorted(found)


def nested(path, start, end, depth, rng, out):
    out.append((path, f"b{len(out)}", start, end))
    at = start + 1
    while depth and at + 4 < end:
        until = rng.randrange(at + 1, end)
        if rng.random() < 0.7:
            nested(path, at, until, depth - 1, rng, out)
        at = until + 1


@pytest.mark.parametrize("crossing", [False, True])
def test_one_huge_file_and_small_ones(spark, many_partitions, crossing):
    rng, blocks, sites = random.Random(5), [], []
    for path, size in [("huge", 4000), ("a", 40), ("z", 40), ("zz", 3)]:
        if crossing:
            blocks += [(path, f"{path}{i}", s := rng.randrange(size), s + rng.randrange(size // 8 + 1)) for i in range(size // 4)]
        else:
            nested(path, 0, size, 6, rng, blocks)
        for i in range(size // 2):
            start = rng.randrange(size)
            sites.append((path, f"{path}-s{i}", start, start + rng.choice([0, 1, 5])))
    expected = brute(sites, blocks)
    found = containment.around(spark.createDataFrame(sites, ROWS), spark.createDataFrame(blocks, ROWS))
    assert sorted(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_open_over_several_partitions_are_carried(spark, many_partitions):
    blocks = [("f", "whole", 0, 10_000), ("f", "half", 10, 5_000)]
    sites = [("f", f"s{i}", i, i + 1) for i in range(10_000)]
    found = containment.around(spark.createDataFrame(sites, ROWS), spark.createDataFrame(blocks, ROWS))
    assert found.count() == 10_000 + 4_990
    assert containment.innermost(spark.createDataFrame(sites, ROWS), spark.createDataFrame(blocks, ROWS)).groupBy("block").count().sort("block").collect() == [("half", 4_990), ("whole", 5_010)]


def test_nulls_empty_blocks_repeats_and_nothing(spark):
    blocks = [("f", "b", 0, 9), ("f", "b", 0, 9), ("f", "empty", 3, 3), (None, "n", 0, 9), ("f", "open", 0, None), ("f", None, 0, 9)]
    sites = [("f", "s", 3, 4), ("f", "at the end", 9, 9), ("f", "too long", 8, 10), (None, "n", 1, 2), ("f", "n", None, 2), ("g", "no block", 1, 2)]
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    assert sorted(map(tuple, containment.around(make(sites), make(blocks)).collect())) == [("f", "s", "b", 0), ("f", "s", "b", 1)]
    assert containment.around(make([]), make(blocks)).count() == 0
    assert containment.around(make(sites), make([])).count() == 0


def test_extracted_references_find_the_blocks_that_the_extractor_found(spark):
    text = "class A:\n    def f(self):\n        g(1)\n        def h():\n            k()\n    def m(self):\n        n()\n"
    found = job.extract_sites(spark.createDataFrame([("a.py", "Python", text.encode())], "path string, language string, content binary"))
    blocks = containment.with_positions(job.blocks_of(found))
    references = job.references_of(found).filter("kind <> 'Import'")
    sites = containment.with_positions(references.dropDuplicates(["ordinal"])).withColumn("id", F.col("ordinal"))
    pairs = containment.around(sites, blocks)
    expected = references.select(F.col("ordinal").cast("string"), "from_node")
    assert sorted(map(tuple, pairs.select("site", "block").collect())) == sorted(map(tuple, expected.collect()))
