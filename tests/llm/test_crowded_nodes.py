"""A large group of texts alike, but not alike enough, is not paired text by text."""

import random

from loomgraph.llm import simhash

from test_similar_copies import kept_by_brute_force


def test_texts_of_a_crowded_node_that_can_reach_no_other_are_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(60):  # the first thirty are near copies, the others 0.73 like these: no copies, but within the budget of the fingerprints
        words = list(base)
        for at in rng.sample(range(0, 200, 10), 1 if i < 30 else 5):
            words[at] = f"own{i}_{at}"
        texts.append(" ".join(words))
    made = []
    before = simhash._tried

    def tried(pairs, *rest):
        made.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(simhash, "_tried", tried)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, prefix=2).collect()}
    assert kept == kept_by_brute_force(texts)
    assert 1 < len(kept) and sum(made) < 400, made
