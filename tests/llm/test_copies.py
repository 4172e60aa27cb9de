"""Exact dedup, SimHash groups, components."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from loomgraph.llm import components, exact_dedup, simhash
from loomgraph.llm.components import connected_components
from pyspark.sql import functions as F


def key(i):
    return (i is not None, i or 0)


def brute_copies(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda x: (key(x[0]), x[4]))


def test_exact_matches_brute_force_even_with_colliding_hashes(docs, no_docs):
    expected = brute_copies(docs.collect())
    for hashed in (exact_dedup.content_hash, lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))):
        found = [tuple(r) for r in exact_dedup.find_copies(docs, hashed=hashed).collect()]
        assert sorted(found, key=lambda x: (key(x[0]), x[4])) == expected
    assert exact_dedup.find_copies(no_docs).count() == 0


def test_drop_copies_keeps_columns_and_smallest_ids(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    expected = {(i, sha) for i, _, _, keep, sha in brute_copies(docs.collect()) if keep}
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in expected}


def brute_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force_in_blocks_too(docs, monkeypatch):
    texts = [r.text for r in docs.collect() if len(r.text or "") < 10_000]
    for block in (1 << 16, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = " ".join(str(i % 700) for i in range(3000))
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_jvm_hash_is_the_same(spark):
    text = "some shingle of words"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_links(prints, budget):
    prints = sorted(prints)
    return {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= budget}


def test_trie_join_finds_all_links(spark):
    rng = random.Random(4)
    prints = {0, 1, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):  # clusters that share prefixes
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = {signed(x) for x in prints}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for budget in (1, 2, 3):
        links = [tuple(r) for r in simhash.trie_links(df, budget).collect()]
        assert len(links) == len(set(links))
        assert set(links) == brute_links(prints, budget)


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [200_000, 10])
def test_components_match_union_find(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 540)] + [(7, 7)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links + [(None, 5)], "a long, b long")
    found = connected_components(df).collect()
    assert len(found) == len(nodes)
    assert {r.node: r.root for r in found} == brute_components(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_groups_match_brute_force(spark, docs, no_docs):
    rows = docs.collect()
    prints = {r.text: brute_fingerprint(r.text) if len(r.text or "") < 10_000 else simhash.fingerprint(r.text) for r in rows}
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in brute_links(set(prints.values()), 2)]
    component = brute_components(set(prints.values()), links)
    smallest = defaultdict(list)
    for r in rows:
        smallest[component[prints[r.text]]].append(r.doc_id)
    first = {c: min((i for i in ids if i is not None), default=None) for c, ids in smallest.items()}
    expected = sorted(((r.doc_id, f"{prints[r.text]:016x}", first[component[prints[r.text]]]) for r in rows), key=lambda x: (key(x[0]), x[1]))
    found = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=lambda x: (key(x[0]), x[1]))
    assert found == expected
    assert simhash.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("keep", [exact_dedup.drop_copies, simhash.keep_one])
def test_rows_without_ids_and_repeated_ids_stay_once(spark, keep):
    rows = [(None, "x y z"), (None, "x y z"), (None, "other text"), (5, "p q r"), (5, "p q r"), (5, "another"), (None, "p q r")]
    found = keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == [(5, "another"), (5, "p q r"), (None, "other text"), (None, "x y z")]
