"""Near-duplicate groups by SimHash: fingerprints, binary trie self-join, components.

:func:`near_groups` links fingerprints of 64 bits that differ in a few bits; :func:`keep_one` keeps one
of the documents whose word shingles have a Jaccard similarity of 0.8 or more.

The trie join works on distinct fingerprints. Trie nodes are bit prefixes; pairs of nodes are
walked down together, a block of levels per join, the differing bits so far are added up, and
a pair over the budget is dropped with everything below it. With a budget of k bits, k + 1
disjoint blocks cannot all differ, so the trie is walked once for each of k + 1 rotations of the
bits, each with no error allowed in its first block. That keeps the number of node pairs near
the number of fingerprints, where one walk with errors allowed from the root would visit every
pair of short prefixes. Below the first block a node has at most ``2 ** STEP`` children per
join, so no join key fans out further, however many fingerprints share a prefix.

All links within the budget are found; a component is what links reach.

A similarity of 0.8 is about 15 % of the bits, far too many for blocks without an error. So
:func:`keep_one` takes fingerprints of ``WIDE`` bits and walks many tries, each over 64 bits drawn from
them: the first ``prefix`` levels without an error, the other levels and then the whole fingerprint
within the errors expected at that similarity and a few standard deviations more. Every pair that is left is verified
by its shingle sets, so no pair below the similarity is a link. The tries are as many as it takes to
miss a pair of exactly the similarity with a chance of ``MISSED``, nearer pairs far less often. A
trie node is reached by chance by ``documents / 2 ** prefix`` texts, so ``prefix`` grows with the
logarithm of the distinct texts, and with it the number of walks: recall is the same at every size.

Not every pair of a trie node needs a look, as only components matter. In a node of more than ``SMALL`` texts the one
nearest to the majority of the node's bits stands for it, as the original of edited copies does: first each text is
compared with the nearest text that stands for a node of its own, one pair a text; then those not yet linked with one of
each other component among those that stand for their nodes. Then each text outside the main component of a node meets
one text of each other component there, by which most components unite; last, all pairs of a node that are still
in different components and within the budget of the whole fingerprint, each once, so that no link is lost. Before these
two steps, of the texts in nodes of more than ``CROWD``, pairs that share a shingle which at most ``RARE`` of them hold are
verified if they may reach the similarity. Other pairs there have in common at most the other shingles of either: if these
are too few the pair is no link, and a text for which they are too few beside any text of its node leaves the node.

Defined results: A-Z are lower-cased; a text of fewer words than a shingle is one shingle. A null or
wordless text has fingerprint 0, linked like any other, and for :func:`keep_one` such texts are
copies of one another; equal texts share a fingerprint and so a component; a component none of whose
rows has an id gets the null id; an empty table gives no rows. Texts are taken whole, however
long, ``BLOCK`` shingles at a time; shingles are known by 64-bit hashes. Extra columns are ignored by
:func:`near_groups` and kept by :func:`keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import durable, numbered, written
from loomgraph.llm.components import connected_components

SEED = 42
BITS = 64
#: Trie levels that one join descends below the first block.
STEP = 11
#: Shingles hashed at a time, which bounds memory for very long texts.
BLOCK = 1 << 16

# Near copies by similarity.
NEAR_SHINGLE, LEAST = 5, 0.8
WIDE = 1024
#: Standard deviations of differing bits allowed beyond those expected at the least similarity, in a walk and in all bits.
SPREAD_OF_WALK, SPREAD = 2.5, 4.0
#: Levels without an error, at least, and the chance to miss a pair of just the least similarity.
PREFIX, MISSED = 20, 0.02
#: Texts of a trie node that are all compared with one another at once.
SMALL = 2
#: Texts that hold a shingle, at most, for it to count as rare.
RARE = 8
#: Texts of a trie node above which its texts' rare shingles are looked for.
CROWD = 16
#: Rows of the table of signs that shingles draw from.
SIGN_ROWS = 1 << 14
WIDE_BLOCK = 1 << 12
#: Texts whose walks one task makes.
NODES = 1 << 12


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` (uint64) have bit i set, for each i."""
    spread = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    total = np.zeros(BITS, dtype=np.int64)
    whole = len(spread) // 255 * 255
    if whole:  # byte lanes hold up to 255
        total += spread[:whole].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    if whole < len(spread):
        total += spread[whole:].sum(axis=0).view(np.uint8).astype(np.int64)
    return total


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes (uint64) of the word shingles in order, ``BLOCK`` at a time; none for a wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, BLOCK):
        upto = min(at + BLOCK, last)
        pairs = zip(starts[at:upto].tolist(), ends[at + span - 1 : upto + span - 1].tolist(), strict=True)
        yield np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), dtype=np.uint64, count=upto - at)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text with A-Z lower-cased."""
    sums, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        sums += _bit_sums(hashes)
        n += len(hashes)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(prints.view(np.int64))

    return of_batches(text)


def _rotated(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by)) if by else value


def trie_links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints with at most ``budget`` differing bits.

    ``prints`` has a column ``fp`` (long) without repeats.
    """
    starts = [BITS * k // (budget + 1) for k in range(budget + 1)]
    first = min(b - a for a, b in zip(starts, [*starts[1:], BITS], strict=True))
    depths = [*range(first, BITS, STEP), BITS]

    def prefix(bits: Column, depth: int) -> Column:
        return F.shiftrightunsigned(bits, BITS - depth)

    def key(turn: Column, node: Column) -> Column:
        """Turn and node (of at most 56 bits) in one long: joins on it stay small in memory."""
        return F.shiftleft(turn.cast("long"), 56).bitwiseOR(node)

    turned = prints.select(F.posexplode(F.array(*[_rotated(F.col("fp"), s) for s in starts])).alias("turn", "bits"))
    turned = turned.withColumn("node", key(F.col("turn"), prefix(F.col("bits"), first)))
    shared = turned.groupBy("node").count().filter("count > 1").drop("count")
    leaves = durable(turned.join(shared, "node").select("turn", "bits"))

    pairs = leaves.select("turn", prefix(F.col("bits"), first).alias("a")).distinct()
    pairs = pairs.select("turn", "a", F.col("a").alias("b"), F.lit(0).alias("errors"))
    for above, depth in zip(depths, depths[1:], strict=False):
        nodes = leaves.select(
            key(F.col("turn"), prefix(F.col("bits"), above)).alias("parent"), prefix(F.col("bits"), depth).alias("child")
        ).distinct()
        left = nodes.select(F.col("parent").alias("key_a"), F.col("child").alias("child_a"))
        right = nodes.select(F.col("parent").alias("key_b"), F.col("child").alias("child_b"))
        keyed = pairs.select("*", key(F.col("turn"), F.col("a")).alias("key_a"), key(F.col("turn"), F.col("b")).alias("key_b"))
        fresh = F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND(F.lit((1 << (depth - above)) - 1)))
        within = F.col("errors") + fresh <= budget
        once = (F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b"))
        half = keyed.join(left, "key_a").withColumnRenamed("key_b", "own_b")
        pairs = half.join(right, (F.col("own_b") == F.col("key_b")) & within & once).select(
            "turn", F.col("child_a").alias("a"), F.col("child_b").alias("b"), (F.col("errors") + fresh).alias("errors")
        )

    def home(bits: Column) -> Column:
        return F.coalesce(*[F.when(F.col("turn") == k, _rotated(bits, (BITS - s) % BITS)) for k, s in enumerate(starts)])

    found = pairs.filter("a <> b").select(home(F.col("a")).alias("a"), home(F.col("b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(
    docs: DataFrame, *, shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = durable(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = durable(connected_components(trie_links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp"))
    linked = distinct.join(roots, "fp")
    # Written, so that the join is by broadcast or of two fresh shuffles, which the adaptive join can split at a large component.
    smallest = written(linked.groupBy("root").agg(F.min("first_id").alias("component_id")))
    of_linked = roots.join(smallest, "root").select("fp", "component_id")
    # Written, so that the last join shuffles both sides and the adaptive join can split a fingerprint of very many rows.
    of_print = durable(
        distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity.


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the word shingles."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_hashes(text, shingle)]))


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SIGN_ROWS, WIDE), dtype=np.int8) * 2 - 1


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDE`` bits, as longs: each shingle adds or takes a row of random signs, both chosen by its hash."""
    sums = np.zeros(WIDE, dtype=np.int64)
    rows = (hashes & np.uint64(SIGN_ROWS - 1)).astype(np.int64)
    added = (hashes >> np.uint64(63)).astype(bool)
    for chosen, sign in ((rows[added], 1), (rows[~added], -1)):
        for at in range(0, len(chosen), WIDE_BLOCK):
            sums += sign * _signs()[chosen[at : at + WIDE_BLOCK]].sum(axis=0, dtype=np.int64)
    return np.packbits(sums > 0, bitorder="little").view(np.int64)


def share_of_bits(least: float) -> float:
    """Share of bits in which sets of a Jaccard similarity are expected to differ."""
    return math.acos(2 * least / (1 + least)) / math.pi


def walks_for(prefix: int, least: float = LEAST, missed: float = MISSED) -> int:
    """Walks after which a pair of similarity ``least`` has had equal prefixes but for a chance of ``missed``."""
    return math.ceil(math.log(missed) / math.log1p(-((1 - share_of_bits(least)) ** prefix)))


def error_budget(bits: int, least: float, spread: float = SPREAD) -> int:
    """Differing bits allowed among so many."""
    differs = share_of_bits(least)
    return min(bits, math.ceil(bits * differs + spread * math.sqrt(bits * differs * (1 - differs))))


@lru_cache(maxsize=4)
def _drawn_bits(walks: int) -> np.ndarray:
    """(walks, 64) bit numbers: the bits that a walk looks at, in order of its levels."""
    draw = np.random.default_rng(SEED)
    return np.stack([draw.permutation(WIDE)[:BITS] for _ in range(walks)])


def _sketch(text: Column, shingle: int) -> Column:
    @F.pandas_udf("node long, n int, print array<long>")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for one in texts:
                hashes = shingle_set(one, shingle)
                node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
                rows.append((int(node), len(hashes), wide_fingerprint(hashes)))
            yield pd.DataFrame(rows, columns=["node", "n", "print"])

    return of_batches(text)


def _walked(prints: Column, prefix: int, walks: int) -> Column:
    """Of each walk the trie node at depth ``prefix``, together with the walk's number, and the bits of the other levels."""

    @F.pandas_udf("key array<long>, rest array<long>")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drawn = _drawn_bits(walks).ravel()
        turn = np.arange(walks, dtype=np.uint64) << np.uint64(prefix)
        for batch in batches:
            keys, rests = [], []
            for one in batch:
                bits = np.unpackbits(np.asarray(one, dtype=np.int64).view(np.uint8), bitorder="little")[drawn]
                leaves = np.packbits(bits.reshape(walks, BITS), axis=1, bitorder="big").view(">u8").ravel().astype(np.uint64)
                keys.append(((leaves >> np.uint64(BITS - prefix)) | turn).view(np.int64))
                rests.append((leaves << np.uint64(prefix)).view(np.int64))
            yield pd.DataFrame({"key": keys, "rest": rests})

    return of_batches(prints)


def _set_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(one, shingle).view(np.int64) for one in texts], dtype=object)

    return of_batches(text)


class _Met:
    """Walks down the sorted leaves of a partition; what meets in a trie node within the budget."""

    def __init__(self, budget: int):
        self.budget = budget
        self.open = tuple(np.empty(0, dtype=np.int64) for _ in range(3))  # the last node so far, whole if small
        self.stands: tuple[int, int, int] | None = None  # for the last node so far, if large: key, text, rest

    def _close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x ^ y) <= self.budget

    def _of_large(self, key, node, rest, stands) -> list[tuple]:
        met = self._close(rest, stands[2]) & (node != stands[1])
        return [(key, node, np.full(len(node), stands[1]), np.bitwise_count(rest ^ stands[2]).astype(np.int64), met)]

    @staticmethod
    def standing_for(key, node, rest) -> tuple[int, int, int]:
        """Of the texts of a node, as far as they are at hand, the one nearest to the majority of bits, then the first."""
        bits = np.unpackbits(rest.view(np.uint8).reshape(-1, 8), axis=1)
        majority = np.packbits(2 * bits.sum(axis=0) > len(rest)).view(np.int64)[0]
        at = int(np.argmin(np.bitwise_count(rest ^ majority)))
        return int(key[at]), int(node[at]), int(rest[at])

    def add(self, key: np.ndarray, node: np.ndarray, rest: np.ndarray) -> list[tuple]:
        """Tuples of arrays: key (None for small nodes), text, other text, bits apart, whether the two met."""
        out = []
        if self.stands is not None:
            same = int(np.searchsorted(key, self.stands[0], side="right"))
            out += self._of_large(key[:same], node[:same], rest[:same], self.stands)
            key, node, rest = key[same:], node[same:], rest[same:]
            if not len(key):
                return out
            self.stands = None
        key, node, rest = (np.concatenate(pair) for pair in zip(self.open, (key, node, rest), strict=True))
        if not len(key):
            return out
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        out += self._whole(key, node, rest, starts[:-1], sizes[:-1])
        last = slice(int(starts[-1]), None)
        self.open = (key[last], node[last], rest[last])
        if sizes[-1] > SMALL:
            self.stands = self.standing_for(*self.open)
            out += self._of_large(*self.open, self.stands)
            self.open = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        return out

    def end(self) -> list[tuple]:
        key, node, rest = self.open
        return self._whole(key, node, rest, np.array([0]), np.array([len(key)])) if len(key) else []

    def _whole(self, key, node, rest, starts, sizes) -> list[tuple]:
        out = []
        small = (sizes > 1) & (sizes <= SMALL)
        inside = np.repeat(starts, np.where(small, sizes, 0))
        at = inside + np.arange(len(inside)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
        k, n, r = key[at], node[at], rest[at]
        for step in range(1, min(SMALL, len(k))):
            met = (k[step:] == k[:-step]) & self._close(r[step:], r[:-step])
            apart = np.bitwise_count(r[step:][met] ^ r[:-step][met]).astype(np.int64)
            out.append((None, n[step:][met], n[:-step][met], apart, np.ones(len(apart), dtype=bool)))
        for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            whole = slice(start, start + size)
            out += self._of_large(key[whole], node[whole], rest[whole], self.standing_for(key[whole], node[whole], rest[whole]))
        return out


def _meetings(leaves: DataFrame, budget: int) -> DataFrame:
    """(key, node, rest), together and in order by key and node, to (key, x, y, apart).

    Of a small trie node: its pairs (x, y) within the budget, without key. Of a large one: a row for each text x, y the
    text that stands for the node if within the budget. ``apart`` are the bits in which the two differ.
    """
    schema = pa.schema({"key": pa.int64(), "x": pa.int64(), "y": pa.int64(), "apart": pa.int64()})

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met(budget)

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            for key, x, y, apart, within in found:
                if len(x):
                    keys = pa.nulls(len(x), pa.int64()) if key is None else pa.array(key)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(x), pa.array(y, mask=~within), pa.array(apart)], schema=schema)

        for batch in batches:
            yield from rows(met.add(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "rest")]))
        yield from rows(met.end())

    return leaves.mapInArrow(of_batches, "key long, x long, y long, apart long")


def _errors() -> Column:
    """Bits in which two whole fingerprints differ."""
    fresh = F.zip_with("print_a", "print_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(fresh, F.lit(0), lambda total, n: total + n)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose whole fingerprints are within the budget, and whose shingle sets have a Jaccard similarity of ``least``."""

    def joined(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(values.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]), end)
        return pairs

    sized = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    close = written(joined(pairs, nodes, "n", "print").filter(sized & (_errors() <= error_budget(WIDE, least))).select("a", "b"))
    ends = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
    needed = ends.join(nodes.select("node", "row"), "node")
    sets = written(texts.join(needed, "row").select("node", _set_column(F.col("text"), shingle).alias("set")))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    sizes = F.size("set_a") + F.size("set_b")
    return joined(close, sets, "set").filter(shared >= F.lit(least) * (sizes - shared)).select("a", "b")


def _labelled(rows: DataFrame, roots: DataFrame, name: str, label: str) -> DataFrame:
    """``rows`` with the component that ``name`` is known to be in, at first its own."""
    found = roots.select(F.col("node").alias(name), F.col("root").alias(label))
    return rows.join(found, name, "left").withColumn(label, F.coalesce(label, name))


def _rare_shingles(chosen: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(x, hash): the shingles that at most ``RARE`` of the ``chosen`` texts hold."""
    needed = chosen.join(nodes.select(F.col("node").alias("x"), "row"), "x")
    held = written(texts.join(needed, "row").select("x", F.explode(_set_column(F.col("text"), shingle)).alias("hash")))
    few = written(held.groupBy("hash").count().filter(F.col("count") <= RARE).select("hash"))
    return written(held.join(few, "hash").select("x", "hash"))


def _sharing(rare: DataFrame, prints: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs of different components that share rare shingles, and with all others of either would reach the similarity.

    At most ``RARE`` texts share a shingle, so their number grows with the texts.
    """
    ends = rare.repartition("hash")
    shared = ends.join(ends.withColumnRenamed("x", "y"), "hash").filter("x < y").groupBy("x", "y").count()
    sizes = prints.select("x", F.col("n").alias("n_a"), F.col("usual").alias("usual_a"))
    shared = shared.join(sizes, "x").join(sizes.toDF("y", "n_b", "usual_b"), "y")
    close = shared.filter(_may_reach(F.col("count") + F.least("usual_a", "usual_b"), F.col("n_a"), F.col("n_b"), least))
    apart = _labelled(_labelled(close.select("x", "y"), roots, "x", "label_x"), roots, "y", "label_y").filter("label_x <> label_y")
    return _ordered(apart)


def _may_reach(shared: Column, n_a: Column, n_b: Column, least: float) -> Column:
    """Whether sets of these sizes that share so many shingles at most can have a Jaccard similarity of ``least``."""
    return shared >= F.lit(least) * (n_a + n_b - shared)


def similar_links(nodes: DataFrame, texts: DataFrame, *, shingle: int, least: float, prefix: int) -> DataFrame:
    """(node, root) of the components that links join.

    ``nodes`` is (node, n, print, row) with a row for each distinct shingle set, ``texts`` (row, text).
    """
    walked = _walked(F.col("print"), prefix, walks_for(prefix, least))
    leaves = nodes.filter("n > 0").select("node", walked.alias("w")).select("node", F.inline(F.arrays_zip("w.key", "w.rest")))
    budget = error_budget(BITS - prefix, least, SPREAD_OF_WALK)
    met = written(_meetings(leaves.repartition("key").sortWithinPartitions("key", "node"), budget))
    large = met.filter("key is not null")

    nearest = large.filter("y is not null").groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    tested = written(_ordered(met.filter("key is null").select("x", "y").unionByName(nearest)))
    links = durable(_verified(tested, nodes, texts, shingle, least))
    roots = connected_components(links)

    others = large.filter("y is not null").select("x", "y", "apart").distinct()
    others = _labelled(_labelled(others, roots, "x", "label_x"), roots, "y", "label_y").filter("label_x <> label_y")
    others = others.groupBy("x", "label_y").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    tested, roots, links = _tried(_ordered(others), tested, nodes, texts, links, shingle, least)

    members = written(large.select("key", "x", "apart"))
    kinds = _labelled(members, roots, "x", "label").groupBy("key")
    kinds = kinds.agg(F.min("label").alias("low"), F.max("label").alias("high"), (F.count(F.lit(1)) > CROWD).alias("crowded"))
    members = written(members.join(kinds.filter("low <> high").select("key", "crowded"), "key"))
    rare = _rare_shingles(members.filter("crowded").select("x").distinct(), nodes, texts, shingle)
    counts = rare.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("rare"))
    usual = F.col("n") - F.coalesce("rare", F.lit(0))
    prints = written(nodes.select(F.col("node").alias("x"), "print", "n").join(counts, "x", "left").withColumn("usual", usual).drop("rare"))
    tested, roots, links = _tried(_sharing(rare, prints, roots, least), tested, nodes, texts, links, shingle, least)
    within = _errors() <= error_budget(WIDE, least)
    reach = _may_reach(F.least("usual_a", "usual_b"), F.col("n_a"), F.col("n_b"), least)
    for everyone in (False, True):
        # Texts of a node outside its main component, with one text of each other component there, then with all.
        mixed = _labelled(members, roots, "x", "label")
        by_label = mixed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("count"), F.min_by("x", F.struct("apart", "x")).alias("best"))
        major = by_label.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.count(F.lit(1)).alias("labels"))
        major = written(major.filter("labels > 1").drop("labels"))
        usual = F.when(F.col("crowded"), F.col("usual")).otherwise(F.col("n")).alias("usual")
        mixed = written(mixed.join(major, "key").join(prints, "x").select("key", "x", "label", "major", "print", "n", usual))
        smallest = written(mixed.groupBy("key").agg(F.min("n").alias("smallest")))
        hopeful = mixed.join(smallest, "key").filter(_may_reach(F.col("usual"), F.col("n"), F.greatest("usual", "smallest"), least))
        left = hopeful.filter("label <> major").select(
            F.col("key").alias("key_x"), "x", F.col("label").alias("label_x"), F.col("print").alias("print_a"), F.col("n").alias("n_a"), F.col("usual").alias("usual_a")
        )
        right = hopeful if everyone else hopeful.join(written(by_label.select("key", F.col("best").alias("x"))), ["key", "x"], "left_semi")
        main = (F.col("label") == F.col("major")).alias("main")
        right = right.select(
            "key", F.col("x").alias("y"), F.col("label").alias("label_y"), F.col("print").alias("print_b"), F.col("n").alias("n_b"), F.col("usual").alias("usual_b"), main
        )
        once = F.col("main") | (F.col("x") < F.col("y")) if everyone else F.lit(True)
        pairs = left.join(right, (F.col("key_x") == F.col("key")) & (F.col("label_x") != F.col("label_y")) & once & reach & within)
        tested, roots, links = _tried(_ordered(pairs), tested, nodes, texts, links, shingle, least)
    return roots


def _tried(
    pairs: DataFrame, tested: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, least: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pairs tested so far, the components of the links found so far, and these links."""
    fresh = written(pairs.join(tested, ["a", "b"], "left_anti"))
    links = durable(links.unionByName(_verified(fresh, nodes, texts, shingle, least)))
    return tested.unionByName(fresh), connected_components(links), links


def keep_one(
    docs: DataFrame,
    *,
    shingle: int = NEAR_SHINGLE,
    least: float = LEAST,
    prefix: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    It is the row of the smallest id, rows without an id last, any one of rows with an equal id.
    """
    rows = numbered(docs)
    text, own_id = F.col("doc")[text_col], F.col("doc")[id_col]
    read = rows.select("row", own_id.alias("id"), _sketch(text, shingle).alias("s"))
    nodes = written(
        read.groupBy("s.node").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.first("s.n").alias("n"), F.first("s.print").alias("print")
        )
    )
    count = nodes.count()
    if prefix is None:
        prefix = max(PREFIX, count.bit_length())
    spread = nodes.select("node", "n", "print", F.col("first.row").alias("row")).repartition(-(-count // NODES) or 1, "node")
    roots = similar_links(
        spread,
        rows.select("row", text.alias("text")),
        shingle=shingle,
        least=least,
        prefix=prefix,
    )
    groups = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    return rows.join(groups.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")
