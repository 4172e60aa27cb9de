"""Filter audit against brute force over all orders, and against its SQL."""

import math
import re
from collections import defaultdict
from itertools import permutations
from pathlib import Path

import pytest
from loomgraph.llm import filter_audit

SF = Path("/root/testdata/sf0.001")
TALLIES = ("good", "toxic")


def test_swaps_of_neighbours_lead_through_all_orders():
    for k in range(1, 7):
        order, met = list(range(k)), {tuple(range(k))}
        for at in filter_audit.neighbour_swaps(k):
            order[at], order[at + 1] = order[at + 1], order[at]
            met.add(tuple(order))
        assert met == set(permutations(range(k)))
        assert sum(1 for _ in filter_audit.neighbour_swaps(k)) == math.factorial(k) - 1


def failures(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, fails in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", bool(re.search("[#$%&*|]", text))),
            ("E", copy),
        )
        if fails
    )


def brute(docs, labels):
    """docs: (id, part, text); labels: id -> (good, toxic)."""
    texts = defaultdict(list)
    for i, _, t in docs:
        texts[t or ""].append(i)
    late = lambda i: (i is None, i or 0)
    first = {t: min(map(late, ids)) for t, ids in texts.items()}
    parts = defaultdict(list)
    for i, part, t in docs:
        parts[part or ""].append((failures(t or "", late(i) > first[t or ""]), *labels.get(i, (False, False))))
    rows, shapley = [], defaultdict(int)
    for part, found in parts.items():
        for order in permutations("ABCDE"):
            left = found
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[0]]
                left = [d for d in left if letter not in d[0]]
                shapley[part, letter] += len(gone)
                alone, failing = sum(d[0] == letter for d in found), sum(letter in d[0] for d in found)
                rows.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit_matches_brute_force(spark, docs, no_docs):
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect()]
    said = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(3, 1, False), (3, 0, True), (3, None, None), (None, 1, True), (9999, 1, True), (5, None, None)]
    labels = spark.createDataFrame([(i, q if q is None else int(q), t if t is None else int(t)) for i, q, t in said], "doc_id long, quality int, toxic int")
    known = {i: (any(q for j, q, _ in said if j == i), any(t for j, _, t in said if j == i)) for i, _, _ in said if i is not None}
    found = filter_audit.audit_filters(docs, labels)
    assert sorted(map(tuple, found.collect())) == brute(rows, known)
    awkward = docs.withColumnsRenamed({"kept": "good", "size": "n_words", "fp": "sha", "bucket": "first"})
    assert sorted(map(tuple, filter_audit.audit_filters(awkward, labels.limit(0)).collect())) == brute(rows, {})
    assert filter_audit.audit_filters(no_docs, labels).count() == 0


def test_a_part_without_failures_has_rows_of_zeros(spark):
    text = " ".join(f"w{i}" for i in range(250))
    docs = spark.createDataFrame([(1, text, None), (2, text + " x", "en"), (2, text + " x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(docs, labels).collect()
    assert len(found) == 1200 and {r.part for r in found} == {"", "en"}
    assert {(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found if r.part == "en"} == {(2, 0, 0, 0, 0)}


def test_shapley_values_add_up_to_all_that_is_removed(spark, docs):
    audit = filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    values, removed = defaultdict(float), {r.part: r.n for r in audit.filter("filter_order = 'ABCDE'").groupBy("part").agg({"removed": "sum"}).toDF("part", "n").collect()}
    for r in filter_audit.shapley_values(audit).collect():
        values[r.part] += r.value
    assert dict(values) == pytest.approx(removed)


def test_other_filters_and_too_many(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(docs, labels, filters={"x": "n_words = 0", "y": "is_copy"}).collect()
    assert {(r.filter_order, r.step) for r in found} == {("xy", 1), ("xy", 2), ("yx", 1), ("yx", 2)}
    with pytest.raises(ValueError):
        filter_audit.audit_filters(docs, labels, filters={c: "is_copy" for c in "abcdefghi"})


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_audit_matches_its_sql(spark):
    import duckdb
    from loomgraph.llm.queries import op11_filter_audit

    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"create view {name} as select * from read_parquet('{SF / name}.parquet')")
    expected = duck.sql(filter_audit.ORACLE)
    found = op11_filter_audit(spark, str(SF)).select(*expected.columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
