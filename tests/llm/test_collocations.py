"""Collocations against brute force over all phrases, and against their SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from loomgraph.llm import collocations

SF = Path("/root/testdata/sf0.001")
LOWER = str.maketrans(collocations.CAPITALS, collocations.CAPITALS.lower())


def brute(rows, longest, least, top, percent):
    """(lang, text) to rows of the result."""
    found, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals["und" if lang is None else lang] += len(words)
            found.update((("und" if lang is None else lang), *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: a for p, a in found.items() if a >= least}
    whole = Counter()
    for (lang, *words), a in often.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    whole[lang, *words[i:j]] = max(whole[lang, *words[i:j]], a)
    out = {}
    for (lang, *words), a in often.items():
        if len(words) > 1 and not (100 * whole[lang, *words] >= percent * a and whole[lang, *words]):
            n = totals[lang]
            cuts = [(1000 * a * n // (often[lang, *words[:k]] * often[lang, *words[k:]]), k) for k in range(1, len(words))]
            value, k = min(cuts)
            out.setdefault(lang, []).append((-value, -a, " ".join(words).encode(), often[lang, *words[:k]], often[lang, *words[k:]], n))
    return sorted((lang, rank, p.decode(), -a, left, r, n, -v) for lang, x in out.items() for rank, (v, a, p, left, r, n) in enumerate(sorted(x)[:top], 1))


def texts(rng, n):
    words = ["The", "the", "été", "É", "cat", "sat", "日本", "x\x01", "new", "york", "city"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\r\n", " \x0b"]
    made = []
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))]
        parts += ["New york city hall "] * rng.randint(0, 3)
        made.append((rng.choice(["en", "en", "de", None, ""]), "".join(parts)))
    return made


@pytest.mark.parametrize(
    "options",
    [
        {"least": 3, "bits": 3},
        {"least": 2, "bits": 17, "block_words": 40, "top": 7},
        {"least": 300, "block_words": 500},
        {"least": 5, "longest": 3, "percent": 60, "bits": 4},
        {"least": 4, "longest": 1},
    ],
)
def test_collocations_match_brute_force(spark, options):
    rows = texts(random.Random(len(options) + options["least"]), 300)
    rows += [("en", None), ("fr", "no phrase is frequent here"), ("en", "")] + [("es", "uno dos tres")] * 400
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    defaults = {"longest": 5, "least": 100, "top": 2000, "percent": 100}
    expected = brute(rows, **{k: options.get(k, v) for k, v in defaults.items()})
    assert sorted(map(tuple, collocations.find_collocations(frame, **options).collect())) == expected


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    for frame in (docs, docs.withColumnsRenamed({"kept": "words", "size": "n_words", "fp": "phrase", "bucket": "slice"})):
        assert sorted(map(tuple, collocations.find_collocations(frame, least=4).collect())) == brute(rows, 5, 4, 2000, 100)
    assert collocations.find_collocations(no_docs).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 3 * 10**12 + 7, 9 * 10**12 + 1, 5 * 10**12 + 3, 4 * 10**12 + 9
    phrases = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, left), ("en", "y", 1, right)], "lang string, phrase string, k int, a long")
    row = collocations.score(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (left * right)


def test_counters_end_at_the_threshold():
    import numpy as np

    buckets = collocations._Buckets(16, 100)
    for _ in range(5):
        buckets.add(np.array([7] * 60 + [9], dtype=np.uint64))
    assert buckets.counters[7] == 100 and buckets.counters[9] == 5
    assert buckets.counters.dtype == np.uint8


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_collocations_match_their_sql(spark):
    import duckdb
    from loomgraph.llm.queries import op13_collocations

    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    expected = duck.sql(collocations.ORACLE)
    found = op13_collocations(spark, str(SF)).select(*expected.columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
