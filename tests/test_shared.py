"""Tables in the shared folder, and row numbers over them."""

import threading
from pathlib import Path

import pytest
from loomgraph import shared
from loomgraph.operators.numbering import with_row_numbers


def tables(df):
    return {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}


def test_each_scratch_deletes_its_own_tables(spark):
    with shared.scratch(spark):
        outer = tables(shared.written(spark.range(3)))
        with shared.scratch(spark):
            inner = tables(shared.written(spark.range(3)))
        assert all(t.exists() for t in outer) and not any(t.exists() for t in inner)
    assert not any(t.exists() for t in outer)
    kept = shared.written(spark.range(3))
    assert kept.count() == 3 and all(t.exists() for t in tables(kept))


def test_threads_do_not_delete_each_others_tables(spark):
    made, ended = threading.Event(), threading.Event()
    counts = []

    def other():
        with shared.scratch(spark):
            table = shared.written(spark.range(5))
            made.set()
            ended.wait(60)
            counts.append(table.count())

    thread = threading.Thread(target=other)
    with shared.scratch(spark):
        thread.start()
        assert made.wait(60)
        mine = tables(shared.written(spark.range(2)))
    ended.set()
    thread.join()
    assert counts == [5] and not any(t.exists() for t in mine)


def test_a_scratch_is_closed_by_an_error(spark):
    with pytest.raises(RuntimeError), shared.scratch(spark):
        made = tables(shared.written(spark.range(2)))
        raise RuntimeError
    assert not any(t.exists() for t in made)


def test_disks_of_machines_are_no_shared_folder(spark):
    assert Path(shared._unnamed_folder(spark, local=True)).is_dir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared._unnamed_folder(spark, local=False)


def test_row_numbers_beside_columns_of_any_name(spark):
    names = ["_place", "_part", "_offset", "part", "place", "row", "offset", "count"]
    rows = spark.createDataFrame([tuple([i] * len(names)) for i in (5, 3, 9, 3)], ", ".join(f"{n} int" for n in names))
    numbered = with_row_numbers(rows, "part")
    assert numbered.columns == [*names, "number"]
    assert [(r.number, r.part, r.row, r.offset) for r in numbered.orderBy("number").collect()] == [(0, 3, 3, 3), (1, 3, 3, 3), (2, 5, 5, 5), (3, 9, 9, 9)]
    assert {r.place for r in with_row_numbers(rows, "part", name="place").collect()} == {0, 1, 2, 3}
    assert with_row_numbers(rows.limit(0), "part").count() == 0
