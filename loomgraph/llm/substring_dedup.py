"""Passages that repeat across documents: fixed-block anchors, extended to maximal exact repeats.

A word is removed if it lies in a window of ``window`` consecutive words whose sequence also starts in a
document with a smaller id. Every document is cut into reference blocks of ``(window + 1) // 2`` words that
do not overlap; any window holds a whole one of them. The method has these steps:

1. *Anchors.* The reference blocks of all documents are indexed by hash and probed with every rolling block of
   every document. A probe hits if its hash is in the index and is met in more than one document.
2. *Extension.* A hit reaches at most ``window - block`` words to either side in a window that holds it, so
   the windows around hits are all that can repeat. Those with the same 96 bits of two rolling hashes
   over 128-bit word hashes are equal; what starts in the smallest document of each is kept. Repeated windows
   that overlap or touch unite to maximal repeats.

Documents are taken in blocks of about ``block_words`` words. Hashes of a block are made distinct, sorted and
dealt by their first bits to slots; a slice, what one block has for one slot, is one compressed row, and its
answer has a bit for each hash. So a passage that is in every document is in a slot once per
block, not once per document, and no pair of documents is ever formed. A task holds one block, or the slices of one
slot, whose number grows with the words. The blocks are written first: what identifies a document must not
change when a lost task runs again.

Defined results: null and wordless texts have no words and nothing removed; texts shorter than a window are kept
whole; ids are integers; rows without an id come after all others and are not earlier than each other, as are
rows with an equal id, so a passage within one document or among those stays; equal rows are judged
each; an empty table gives no rows. Extra columns are ignored. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.rolling import BASES, mixed, rolled
from loomgraph.llm.token_counts import packed, packed_strings, unpacked, unpacked_bytes

WINDOW = 50
#: Words after which a block of documents ends; with one document more, this bounds the memory of a task.
BLOCK_WORDS = 1 << 19
#: Rolling hashes a slot, and bounds for the number of slots, a power of two. Any number gives the same rows.
HASHES_PER_SLOT, FEWEST_SLOTS, MOST_SLOTS = 1 << 21, 128, 1 << 16
#: Compression of texts, which are written twice and shuffled once.
LEVEL = 6
#: In place of a missing id; ids are compared as unsigned numbers with the first bit flipped.
NO_ID = (1 << 64) - 1

SLICE = "block long, slot int, n int, keys binary, flags binary, first binary"
ANSWER = "block long, slot int, bits binary"


class _Words:
    """The words of a block's documents as one sequence."""

    def __init__(self, texts: list[bytes]):
        split = [text.split() for text in texts]  # at the white space of ASCII
        self.split = split
        self.sizes = np.array([len(s) for s in split], dtype=np.int64)
        coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.to_pylist())
        halves = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.halves = halves[codes, 0], halves[codes, 1]
        self.document = np.repeat(np.arange(len(split)), self.sizes)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if len(split) else np.zeros(0, np.int64)
        self.place = np.arange(len(codes)) - np.repeat(self.starts, self.sizes)

    def windows(self, k: int) -> np.ndarray:
        """Positions at which ``k`` words of one document start."""
        return np.flatnonzero(self.place + k <= np.repeat(self.sizes, self.sizes))

    def hashes(self, k: int, half: int, at: np.ndarray) -> np.ndarray:
        return mixed(rolled(self.halves[half], k, BASES[half])[at]) if len(at) else np.zeros(0, np.uint64)


class _Distinct:
    """Distinct keys of a block in order, and what holds of all positions that have one."""

    def __init__(self, *keys: np.ndarray):
        self.order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
        ordered = [k[self.order] for k in keys]
        new = np.ones(len(self.order), dtype=bool)
        if len(new):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in ordered])
        self.starts = np.flatnonzero(new)
        self.keys = [k[self.starts] for k in ordered]
        self.number = np.cumsum(new) - 1

    def over(self, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
        return reduce.reduceat(values[self.order], self.starts) if len(self.starts) else values[:0]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """From a value for each key to one for each position."""
        out = np.empty(len(self.order), dtype=values.dtype)
        out[self.order] = values[self.number]
        return out

    def slots(self, bits: int) -> Iterator[tuple[int, slice]]:
        slot = (self.keys[0] >> np.uint64(64 - bits)).astype(np.int64)
        found, at = np.unique(slot, return_index=True)
        ends = np.append(at[1:], len(slot)) if len(at) else at
        for s, i, j in zip(found.tolist(), at.tolist(), ends.tolist(), strict=True):
            yield s, slice(i, j)


def _low(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64(0xFFFFFFFF)


def _two(numbers: np.ndarray) -> bytes:
    """64-bit numbers as their low, then their high halves."""
    return packed(np.concatenate([_low(numbers), numbers >> np.uint64(32)]))


def _joined(data: bytes) -> np.ndarray:
    low, high = np.split(unpacked(data).astype(np.uint64), 2)
    return low | (high << np.uint64(32))


def _record(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], type=f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def document_blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """(id long, text) to (block, n_words, ids, texts): compressed blocks of documents."""
    ddl = "block long, n_words long, ids binary, texts binary"
    out = _schema(ddl)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, n = None, [], [], 0

        def block() -> pa.RecordBatch:
            return _record(out, block=number, n_words=n, ids=_two(np.array(ids, dtype=np.uint64)), texts=packed_strings(texts, LEVEL))

        for batch in batches:
            columns = [batch.column("row"), batch.column("id"), batch.column("text").cast(pa.binary())]
            for row, doc_id, text in zip(*columns, strict=True):
                number = row.as_py() if number is None else number
                ids.append(NO_ID if (i := doc_id.as_py()) is None else i + (1 << 63))
                texts.append(text.as_py() or b"")
                n += len(texts[-1].split())
                if n >= block_words:
                    yield block()
                    number, ids, texts, n = None, [], [], 0
        if ids:
            yield block()

    return docs.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(of_batches, ddl)


def _probes(words: _Words, block: int) -> tuple[np.ndarray, _Distinct]:
    at = words.windows(block)
    return at, _Distinct(words.hashes(block, 0, at))


def anchor_slices(blocks: DataFrame, block: int, bits: int) -> DataFrame:
    """For each block and slot its distinct rolling hashes; flags: in the index, in several documents."""
    out = _schema(SLICE)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column("block").to_pylist(), batch.column("texts"), strict=True):
                words = _Words(unpacked_bytes(texts.as_py()))
                at, distinct = _probes(words, block)
                indexed = distinct.over(np.logical_or, words.place[at] % block == 0)
                several = distinct.over(np.minimum, words.document[at]) != distinct.over(np.maximum, words.document[at])
                keys = _low(distinct.keys[0] >> np.uint64(32 - bits))
                for slot, part in distinct.slots(bits):
                    flags = np.packbits(np.concatenate([indexed[part], several[part]])).tobytes()
                    steps = np.diff(keys[part], prepend=np.uint64(0))
                    yield _record(out, block=number, slot=slot, n=len(steps), keys=packed(steps), flags=flags)

    return blocks.select("block", "texts").mapInArrow(of_batches, SLICE)


def _answers(slices: pa.Table, said: list[np.ndarray]) -> pa.Table:
    bits = pa.array([np.packbits(s).tobytes() for s in said], pa.binary())
    return pa.table([slices.column("block"), slices.column("slot"), bits], schema=_schema(ANSWER))


def shared_anchors(slices: DataFrame) -> DataFrame:
    """Which hashes of each slice are in the index and in several documents."""

    def of_slot(group: pa.Table) -> pa.Table:
        def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for n, keys, flags in zip(*(group.column(c).to_pylist() for c in ("n", "keys", "flags")), strict=True):
                both = np.unpackbits(np.frombuffer(flags, dtype=np.uint8), count=2 * n).astype(bool)
                yield np.cumsum(unpacked(keys), dtype=np.uint64), both[:n], both[n:]

        index = np.unique(np.concatenate([keys[indexed] for keys, indexed, _ in read()]))
        times = np.zeros(len(index) + 1, dtype=np.int64)
        found = []
        for keys, _, several in read():
            at = np.searchsorted(index, keys)
            at[(index[np.minimum(at, len(index) - 1)] != keys) if len(index) else slice(None)] = len(index)
            times += np.bincount(at, weights=1 + several, minlength=len(index) + 1).astype(np.int64)
            hit = np.flatnonzero(at < len(index))
            found.append((len(keys), hit, at[hit]))
        said = []
        for n, hit, at in found:
            bits = np.zeros(n, dtype=bool)
            bits[hit] = times[at] > 1
            said.append(bits)
        return _answers(group, said)

    return slices.groupBy("slot").applyInArrow(of_slot, ANSWER)


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    by_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("answers"))
    return blocks.join(by_block, "block", "left").select(*blocks.columns, F.col("answers.bits").alias("answers"))


def _answered(distinct: _Distinct, bits: int, answers: list[bytes] | None) -> np.ndarray:
    """The answers to a block as one for each key."""
    sizes = [part.stop - part.start for _, part in distinct.slots(bits)]
    parts = [np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=n) for a, n in zip(answers or [], sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


#: A document without a hit (``kept_text`` is not null) or the block of those with one.
JUDGED = "block long, doc_id long, n_words long, kept_text string, ids binary, texts binary, windows binary, counts binary"


def windows_around_hits(blocks: DataFrame, window: int, block: int, bits: int) -> DataFrame:
    """Documents without hits as they are, and for each block its other documents with the windows that may repeat."""
    out = _schema(JUDGED)

    def of_block(number: int, ids: np.ndarray, texts: list[bytes], answers: list[bytes] | None) -> Iterator[pa.RecordBatch]:
        words = _Words(texts)
        at, distinct = _probes(words, block)
        hit = np.zeros(len(words.place) + 1, dtype=np.int64)
        hit[at + 1] = distinct.spread(_answered(distinct, bits, answers))
        before = np.cumsum(hit)
        starts = words.windows(window)
        starts = starts[before[starts + window - block + 1] > before[starts]]
        counts = np.bincount(words.document[starts], minlength=len(texts))
        plain = [[], [], []]
        for i in np.flatnonzero(counts == 0).tolist():
            plain[0].append(None if ids[i] == NO_ID else int(ids[i]) - (1 << 63))
            plain[1].append(len(words.split[i]))
            plain[2].append(b" ".join(words.split[i]).decode("utf-8", "replace"))
        n = len(plain[0])
        columns = {"block": [number] * n, "doc_id": plain[0], "n_words": plain[1], "kept_text": plain[2]}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in out], schema=out)
        if len(some := np.flatnonzero(counts)):
            kept = [b" ".join(words.split[i]) for i in some.tolist()]
            place = packed(words.place[starts])
            yield _record(out, block=number, ids=_two(ids[some]), texts=packed_strings(kept, LEVEL), windows=place, counts=packed(counts[some]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {c: batch.column(c)[row].as_py() for c in ("block", "ids", "texts", "answers")}
                yield from of_block(value["block"], _joined(value["ids"]), unpacked_bytes(value["texts"]), value["answers"])

    return blocks.mapInArrow(of_batches, JUDGED)


class _Candidates:
    """The windows of a block that may repeat, equal ones together, with the smallest document of each."""

    def __init__(self, ids: bytes, texts: bytes, windows: bytes, counts: bytes, window: int):
        self.ids, self.words = _joined(ids), _Words(unpacked_bytes(texts))
        document = np.repeat(np.arange(len(self.ids)), unpacked(counts))
        self.at = self.words.starts[document] + unpacked(windows).astype(np.int64)
        self.owner = self.ids[document]
        self.distinct = _Distinct(self.words.hashes(window, 0, self.at), _low(self.words.hashes(window, 1, self.at)))
        self.first = self.distinct.over(np.minimum, self.owner)


def window_slices(judged: DataFrame, window: int, bits: int) -> DataFrame:
    out = _schema(SLICE)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, *data = (batch.column(c)[row].as_py() for c in ("block", "ids", "texts", "windows", "counts"))
                found = _Candidates(*data, window)
                one, two = found.distinct.keys
                for slot, part in found.distinct.slots(bits):
                    steps, first = _two(np.diff(one[part], prepend=np.uint64(0))), _two(found.first[part])
                    yield _record(out, block=number, slot=slot, n=part.stop - part.start, keys=steps, flags=packed(two[part]), first=first)

    return judged.mapInArrow(of_batches, SLICE)


def earlier_windows(slices: DataFrame) -> DataFrame:
    """Which windows of each slice start in a smaller document of another block."""

    def of_slot(group: pa.Table) -> pa.Table:
        steps, second, first = (group.column(c).to_pylist() for c in ("keys", "flags", "first"))
        one = np.concatenate([np.cumsum(_joined(x), dtype=np.uint64) for x in steps])
        two, first = np.concatenate([unpacked(x) for x in second]), np.concatenate([_joined(x) for x in first])
        distinct = _Distinct(one, two)
        earlier = distinct.spread(distinct.over(np.minimum, first)) < first
        return _answers(group, np.split(earlier, np.cumsum(group.column("n").to_numpy())[:-1]))

    return slices.groupBy("slot").applyInArrow(of_slot, ANSWER)


FOUND = "doc_id long, n_words long, kept_text string, removed array<struct<start: long, end: long>>"


def without_repeats(judged: DataFrame, window: int, bits: int) -> DataFrame:
    """Documents with windows that may repeat, and the answers to these, to rows of FOUND."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_text", pa.string()), ("removed", span)])

    def of_block(data: list[bytes], answers: list[bytes] | None) -> pa.RecordBatch:
        found, rows = _Candidates(*data, window), []
        earlier = _answered(found.distinct, bits, answers) if len(found.at) else np.zeros(0, dtype=bool)
        repeated = found.at[found.distinct.spread(earlier) | (found.owner > found.distinct.spread(found.first))]
        edges = np.bincount(repeated, minlength=len(found.words.place) + 1) - np.bincount(repeated + window, minlength=len(found.words.place) + 1)
        covered = np.cumsum(edges)[:-1] > 0
        for i, (start, words) in enumerate(zip(found.words.starts.tolist(), found.words.split, strict=True)):
            gone = covered[start : start + len(words)]
            turns = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
            text = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "replace")
            doc_id = None if found.ids[i] == NO_ID else int(found.ids[i]) - (1 << 63)
            rows.append((doc_id, len(words), text, [{"start": a, "end": b} for a, b in turns]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                *data, answers = (batch.column(c)[row].as_py() for c in ("ids", "texts", "windows", "counts", "answers"))
                yield of_block(data, answers)

    return judged.mapInArrow(of_batches, FOUND)


def find_repeats(
    docs: DataFrame,
    *,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    slots: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, kept_text (words joined by one space), removed (maximal runs of words, as counted from 0)."""
    block = (window + 1) // 2
    blocks = written(document_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), block_words))
    if slots is None:
        words = blocks.agg(F.sum("n_words")).first()[0] or 0
        slots = min(MOST_SLOTS, max(FEWEST_SLOTS, -(-words // HASHES_PER_SLOT)))
    bits = max(1, (slots - 1).bit_length())
    anchors = shared_anchors(anchor_slices(blocks, block, bits))
    judged = written(windows_around_hits(_with_answers(blocks.drop("n_words"), anchors), window, block, bits))
    open_ = judged.filter("kept_text is null").select("block", "ids", "texts", "windows", "counts")
    repeats = _with_answers(open_, earlier_windows(window_slices(open_, window, bits)))
    whole = judged.filter("kept_text is not null").select(
        "doc_id", "n_words", "kept_text", F.array().cast("array<struct<start: long, end: long>>").alias("removed")
    )
    return whole.union(without_repeats(repeats, window, bits))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])
    return found.select("doc_id", "n_words", length.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
           FROM documents),
p AS (SELECT k, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW}),
w AS (SELECT k, doc_id, i, sha256(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
r AS (SELECT k, i FROM w JOIN f USING (h) WHERE first < coalesce(doc_id, 9223372036854775807)),
c AS (SELECT DISTINCT k, unnest(range(i, i + {WINDOW})) AS i FROM r),
g AS (SELECT k, count(*) AS n, list(i) AS gone FROM c GROUP BY k),
t AS (SELECT k, list(word ORDER BY i) AS kept
      FROM (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) ANTI JOIN c USING (k, i) GROUP BY k)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(t.kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (k) LEFT JOIN t USING (k)
"""
