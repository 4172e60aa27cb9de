"""Repeats across documents against brute force over all windows, and against their SQL."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from loomgraph.llm import rolling, substring_dedup
from pyspark.sql import functions as F

SF = Path("/root/testdata/sf0.001")


def brute(rows, window):
    """(id, text) to sorted (id, words, kept text, removed runs)."""
    late = lambda i: (i is None, i or 0)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, late(i)), late(i))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < late(i):
                gone[s : s + window] = [True] * window
        runs, at = [], 0
        while at < len(words):
            end = at
            while end < len(words) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                runs.append((at, end))
            at = end
        out.append((i, len(words), " ".join(w for w, g in zip(words, gone, strict=True) if not g), runs))
    return sorted(out, key=str)


def found_rows(found):
    return sorted(((r.doc_id, r.n_words, r.kept_text, [tuple(x) for x in r.removed]) for r in found.collect()), key=str)


@pytest.mark.parametrize("k", [1, 2, 3, 25, 50, 64])
def test_rolled_hashes_are_those_of_the_words_alone(k):
    words = np.random.default_rng(k).integers(0, 1 << 63, 200, dtype=np.uint64)
    base = rolling.BASES[0]
    expected = [sum(int(w) * pow(base, k - 1 - j, 1 << 64) for j, w in enumerate(words[i : i + k])) % (1 << 64) for i in range(201 - k)]
    assert rolling.rolled(words, k, base).tolist() == expected


def passages(rng, few):
    """Texts over few words, so that blocks hit by chance, with shared passages at all offsets."""
    word = lambda: rng.choice(few)
    shared = [[word() for _ in range(rng.randint(4, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [word() for _ in range(rng.randint(0, 15))]
            passage = rng.choice(shared)
            at = rng.randrange(len(passage))
            parts += passage[at:] if rng.random() < 0.5 else passage
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return texts


@pytest.mark.parametrize(("window", "options"), [(10, {}), (9, {"block_words": 30}), (2, {"slots": 2}), (1, {"block_words": 1}), (13, {"block_words": 100, "slots": 4096})])
def test_repeats_match_brute_force(spark, window, options):
    rng = random.Random(window)
    texts = passages(rng, ["a", "b", "été", "Dog", "dog", "日本"]) + passages(rng, [f"w{i}" for i in range(300)])
    ids = list(range(-3, len(texts) - 3))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(5, texts[0]), (5, texts[0]), (None, texts[1]), (None, texts[1]), (1 << 62, texts[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_rows(substring_dedup.find_repeats(frame, window=window, **options)) == brute(rows, window)


def test_a_passage_in_all_documents_stays_once(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randint(0, 30))] + passage + [f"y{rng.random()}"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = substring_dedup.digest(substring_dedup.find_repeats(frame, block_words=500)).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: 70 * (i > 0) for i, _ in rows}


def test_windows_of_49_words_stay(spark):
    shared = " ".join(f"s{i}" for i in range(49))
    rows = [(1, f"a {shared} b"), (2, f"c {shared} d"), (3, f"{shared} b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_rows(substring_dedup.find_repeats(frame)) == brute(rows, 50)


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.filter(F.length("text").isNull() | (F.length("text") < 10_000)).collect()]
    short = docs.filter(F.length("text").isNull() | (F.length("text") < 10_000))
    for frame in (short, short.withColumnsRenamed({"kept": "row", "size": "block", "fp": "id", "bucket": "slot"})):
        assert found_rows(substring_dedup.find_repeats(frame, window=7)) == brute(rows, 7)
    long = docs.filter(F.length("text") > 10_000).select(F.explode(F.array("doc_id", F.col("doc_id") + 500)).alias("doc_id"), "text")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.digest(substring_dedup.find_repeats(long)).collect()) == [(60_000, 0), (60_000, 60_000)]
    assert substring_dedup.find_repeats(no_docs).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_repeats_match_their_sql(spark):
    import duckdb
    from loomgraph.llm.queries import op12_substring_dedup

    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    expected = duck.sql(substring_dedup.ORACLE)
    found = op12_substring_dedup(spark, str(SF)).select(*expected.columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
