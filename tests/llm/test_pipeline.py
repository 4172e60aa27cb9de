"""The whole pipeline against stage-by-stage brute force on the smallest tables."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from loomgraph.llm import classifier, mixing, tokenizing
from test_similar_copies import kept_by_brute_force

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in classifier.score_quality(docs, labels).collect() if r.predicted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    seen = {}
    for i in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    left = sorted(seen.values())
    left = [left[i] for i in sorted(kept_by_brute_force([rows[i].text for i in left]))]
    frame = spark.createDataFrame([tuple(rows[i]) for i in left], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(frame).collect()}
    tokenizer = tokenizing._tokenizer(tokenizing.VOCABULARY)
    expected = Counter()
    for i, n in copies.items():
        tokens = len(tokenizer.encode(rows[i].text or "", add_special_tokens=False).ids) + 1
        for start in range(0, tokens, 2048):
            expected[i, start, min(2048, tokens - start), tokens] += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in found) == +expected
    used = defaultdict(int)
    for r in found:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_stages_keep_the_columns(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, None, None, None), (2, "", "en", "s", 0)], columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.pack(spark, docs, SF).count() == 3


CLASHING = "row doc id s node n print first key rest one label score bucket order_key size copies turn norm hash content kept".split()


def test_stages_keep_columns_of_clashing_names(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, f"some words {i % 3} and more", "en", f"s{i % 2}", 5) for i in range(9)], columns)
    for i, name in enumerate(CLASHING + ["a.b", "with `ticks`"]):
        docs = docs.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        assert {(r["row"], r["a.b"]) for r in found.collect()} <= {(0, len(CLASHING))}, name
    assert corpus_pipeline.pack(spark, docs, SF).count() == 9
