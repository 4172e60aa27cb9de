"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from loomgraph.llm import simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept_by_brute_force(texts, least=0.8):
    """Smallest index of each component of ``texts``."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            if similarity(sets[a], sets[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_matches_brute_force_jaccard(spark):
    rng = random.Random(8)
    texts = [None, "", " \t", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 250))]
        texts += [" ".join(edited(rng, base, rng.randrange(len(base) // 30 + 2))) for _ in range(6)]
    hot = [f"h{i}" for i in range(200)]
    texts += [" ".join(edited(rng, hot, rng.randrange(9))) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    expected = kept_by_brute_force(texts)
    assert {r.doc_id for r in kept.collect()} == expected
    assert len(texts) - len(expected) > 40


def test_pairs_left_by_the_drawn_text_are_found(spark):
    """Links between texts of a band that are no links of the text drawn for it."""
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[k : k + 50]) for k in range(0, 10, 2)]  # neighbours are alike, the ends are not
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept_by_brute_force(chain) == {0}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_stage_on_a_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    expected = {rows[i].doc_id for i in kept_by_brute_force([r.text for r in rows])}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == expected


def test_rows_without_ids_and_repeated_ids(spark):
    rows = [(None, "x y z"), (None, "x y z"), (None, "other text"), (5, "p q r"), (5, "p q r"), (5, "another"), (None, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, simhash.keep_one(docs).collect()))
    assert found == Counter([(None, "x y z"), (None, "other text"), (5, "p q r"), (5, "another")])
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_meetings(rows, budget, stands):
    """What is met in each trie node, by comparing its rows directly; ``stands``: what stands for the large ones."""
    by_key = {}
    for key, node, rest in rows:
        by_key.setdefault(key, []).append((node, rest))
    small, large = set(), set()
    for key, texts in by_key.items():
        texts.sort()
        if len(texts) <= simhash.SMALL:
            small |= {(a, b) for i, (b, r) in enumerate(texts) for a, s in texts[i + 1 :] if bin(r ^ s).count("1") <= budget}
        else:
            first, r = next(t for t in texts if t[0] == stands[key])
            large |= {(key, n, first if n != first and bin(r ^ s).count("1") <= budget else None, bin(r ^ s).count("1")) for n, s in texts}
    return small, large


@pytest.mark.parametrize("batch", [1, 3, 7, 50, 10_000])
def test_meetings_match_brute_force_however_batches_cut(batch):
    rng = random.Random(batch)
    rows = [(key, 1000 * key + i, rng.getrandbits(6)) for key in range(40) for i in range(rng.choice([1, 1, 2, 3, 16, 17, 40]))]
    met, found = simhash._Met(2), []
    for at in range(0, len(rows), batch):
        found += met.add(*[np.array(c, dtype=np.int64) for c in zip(*rows[at : at + batch], strict=True)])
    small, large, stands = set(), set(), {}
    for key, x, y, apart, within in found + met.end():
        if key is None:
            assert within.all()
            small |= set(zip(x.tolist(), y.tolist(), strict=True))
        else:
            rows_of = list(zip(key.tolist(), x.tolist(), y.tolist(), apart.tolist(), within.tolist(), strict=True))
            large |= {(k, a, b if w else None, n) for k, a, b, n, w in rows_of}
            for k, _, b, _, _ in rows_of:
                assert stands.setdefault(k, b) == b
    assert (small, large) == brute_meetings(rows, 2, stands)


def test_the_original_of_edited_copies_stands_for_them():
    rng = random.Random(1)
    base = rng.getrandbits(60)
    rest = np.array([base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(30)] + [base], dtype=np.int64)
    assert simhash._Met.standing_for(np.zeros(31, dtype=np.int64), np.arange(31), rest)[2] == base


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(300)] + [f"quite another text number {i} of its own" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept_by_brute_force(texts)
