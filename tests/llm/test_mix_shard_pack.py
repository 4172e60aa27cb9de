"""Mixing, sharding, packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from loomgraph.llm import mixing, packing, sharding, tokenizing


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_filling(sizes, weights, total, most):
    """Clamp what is above its cap and share the rest by weight, again and again."""
    target, clamped = {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in clamped)
        open_weight = sum(w for s, w in weights.items() if s not in clamped)
        target = {s: most * sizes[s] if s in clamped else rest * w / open_weight for s, w in weights.items()}
        above = {s for s in target if s not in clamped and target[s] > most * sizes[s]}
        if not above or above | clamped == set(sizes):
            return target
        clamped |= above


def test_mix_plan(docs, no_docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = water_filling(sizes, weights, 1.5 * sum(sizes.values()), 2)
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(rows)
    taken, largest = Counter(), Counter()
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.plan_mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, plan)) == Counter(map(tuple, again))
    assert mixing.plan_mix(no_docs).count() == 0


def test_mix_repeats_rows(docs):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(unique).collect()}
    mixed = mixing.mix(unique)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_mix_decides_for_each_row(spark):
    rng = random.Random(9)
    rows = [
        (None if i % 3 == 0 else i // 2, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 30))), f"s{rng.randrange(3)}")
        for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target = water_filling(sizes, {"s0": 3, "s1": 1, "s2": 2}, 1.5 * sum(sizes.values()), 2)
    mixed = mixing.mix(docs).collect()
    taken, without_id = Counter(), 0
    for r in mixed:
        taken[r.source] += words(r.text)
        without_id += r.doc_id is None
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 15
    assert without_id > len(mixed) / 5
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_clamped_everywhere(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, "", None)], "doc_id long, text string, source string")
    assert {r.doc_id: (r.target, r.taken) for r in mixing.plan_mix(one, share=5.0).collect()} == {1: (6.0, 6), 2: (0.0, 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 200, 1000, 5000])
def test_permutation(spark, n):
    found = spark.range(n).select(sharding.permute(F.col("id"), n, 3).alias("p"))
    values = [r.p for r in found.collect()]
    assert sorted(values) == list(range(n))
    if n >= 1000:  # shuffled: neighbours do not stay neighbours
        assert sum(abs(a - b) == 1 for a, b in zip(values, values[1:], strict=False)) < n / 50


def test_shards(docs, no_docs):
    rows = sharding.assign_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == docs.count()
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    texts = defaultdict(set)
    for r in docs.collect():
        data = (r.text or "").encode()
        texts[r.doc_id].add((len(data) + 8, zlib.crc32(data)))
    assert all((r["size"], r.text_crc32) in texts[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in rows)
    again = sharding.assign_shards(docs.repartition(2)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert sharding.assign_shards(no_docs).count() == 0


def naive_first_fit(lengths, capacity):
    rooms, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, room in enumerate(rooms):
            if room >= lengths[i]:
                break
        else:
            b = len(rooms)
            rooms.append(capacity)
        where[i] = (b, capacity - rooms[b])
        rooms[b] -= lengths[i]
    return [where[i] for i in range(len(lengths))]


def test_tree_gives_first_fit():
    rng = random.Random(8)
    for n in (1, 2, 3, 7, 50, 300):
        lengths = [rng.choice([1, 5, 40, 60, 99, 100]) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(lengths), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == naive_first_fit(lengths, 100)


def test_packed_pieces_rebuild_documents(docs, no_docs):
    tokenizer = tokenizing._tokenizer(tokenizing.VOCABULARY)
    pieces = packing.pack(docs, group=16).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    expected = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            part = np.array(ids[start : start + 2048], dtype="<u4")
            expected[r.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == expected
    assert packing.pack(no_docs).count() == 0


def test_ids_that_are_no_integers(spark):
    texts = ["one two three", None, "", "four five"] * 10
    rows = [(None if i % 3 == 0 else f"doc-{i}", t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(3)
    ids = sorted(map(str, (r[0] for r in rows)))
    sharded = sharding.assign_shards(docs, shards=7).collect()
    assert sorted(str(r.doc_id) for r in sharded) == ids
    assert sorted(r.position for r in sharded) == list(range(40))
    packed = packing.pack(docs)
    assert dict(packed.dtypes)["doc_id"] == "string" and sorted(str(r.doc_id) for r in packed.collect()) == ids
    assert sorted(str(r.doc_id) for r in mixing.plan_mix(docs).collect()) == ids


def test_bucket_digits_do_not_change_the_mix(docs):
    plans = [Counter(map(tuple, mixing.plan_mix(docs, bucket_digits=n).collect())) for n in (1, 2, 4)]
    assert plans[0] == plans[1] == plans[2] == Counter(map(tuple, mixing.plan_mix(docs).collect()))


def test_rows_without_ids_are_spread(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    crc = F.crc32(F.col("text").cast("binary")).cast("long")
    key = sharding.bucket_key(F.col("doc_id"), docs.schema[0].dataType, crc)
    assert docs.select(sharding.bucket_of(key, 64).alias("b")).distinct().count() > 50
    assert sorted(r.position for r in sharding.assign_shards(docs, buckets=64).collect()) == list(range(2000))
