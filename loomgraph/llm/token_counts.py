"""Token counts per document without token ids.

Every text is cut into pre-tokens and equal ones of a document are counted together. Documents
are taken in blocks. A block keeps a sparse matrix of its documents and its distinct pre-tokens
(which document has which one how often); the pre-tokens themselves are dealt by hash to
``buckets`` slices. One shuffle brings the slices of a bucket together, where each distinct
pre-token is counted once; the numbers of pieces then go back to the block and are multiplied with
its matrix. A pre-token that is in every document is in a slice once per block, whatever its
frequency, so no bucket is hot, and a slice crosses the shuffle as one compressed row, not as a row
for each pre-token.

Blocks are written to the shared checkpoint folder first: they are read twice, and what identifies
a document there must not change when a lost task runs again.

A task holds one block (``block_pairs`` pairs and one document more), or the distinct pre-tokens of
one bucket and the slices of an Arrow batch. A very long text is a block of its own and is cut
into parts only in front of white space, where no pre-token can span, so it is counted whole.

Defined results: null counts as empty, with no bytes and no tokens; special strings inside a
text are one token each, as the library has it; equal rows and rows without an id are counted
each; an empty table gives no rows. Ids may have any type that survives a cast to string and
back. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.tokenizing import VOCABULARY, PreTokens

#: (document, pre-token) pairs after which a block ends; with one document more, this bounds its memory.
BLOCK = 1 << 19
#: Buckets of pre-tokens: one for so many documents, between the two bounds. Any number gives the same counts.
DOCUMENTS_PER_BUCKET, FEWEST_BUCKETS, MOST_BUCKETS = 4096, 32, 4096

#: A slice of a block's pre-tokens (``slot`` is not null), or the block's documents and matrix.
BLOCKS = pa.schema(
    {
        "block": pa.int64(),
        "slot": pa.int32(),
        "strings": pa.binary(),
        "doc_id": pa.list_(pa.string()),
        "n_bytes": pa.list_(pa.int64()),
        "specials": pa.list_(pa.int64()),
        "documents": pa.binary(),
        "place": pa.binary(),
        "times": pa.binary(),
    }
)
BLOCKS_DDL = (
    "block long, slot int, strings binary, doc_id array<string>, n_bytes array<long>, specials array<long>, "
    "documents binary, place binary, times binary"
)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, first their low bytes, last their high ones, which compress to nothing."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_strings(strings: list[bytes], level: int = 1) -> bytes:
    """UTF-8 strings as their number, their lengths and their bytes."""
    lengths = np.array([len(strings), *map(len, strings)], dtype="<u4")
    return zstandard.compress(lengths.tobytes() + b"".join(strings), level)


def unpacked_bytes(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, dtype="<u4", count=n, offset=4), dtype=np.int64) + 4 * (n + 1)
    starts = np.concatenate(([4 * (n + 1)], ends))[:n]
    return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


def unpacked_strings(data: bytes) -> list[str]:
    return [s.decode("utf-8", "surrogatepass") for s in unpacked_bytes(data)]


class _Block:
    """Documents of one task and the frequencies of their pre-tokens, pre-tokens of each form apart."""

    def __init__(self, number: int):
        self.number = number
        self.doc_id, self.n_bytes, self.specials = [], [], []
        self.names: tuple[list[str], list[str]] = ([], [])
        self.times: tuple[list[int], list[int]] = ([], [])
        self.sizes: tuple[list[int], list[int]] = ([], [])

    def add(self, doc_id: str | None, n_bytes: int, specials: int, frequencies: tuple[Counter, Counter]) -> None:
        self.doc_id.append(doc_id)
        self.n_bytes.append(n_bytes)
        self.specials.append(specials)
        for form, found in enumerate(frequencies):
            self.names[form].extend(found)
            self.times[form].extend(found.values())
            self.sizes[form].append(len(found))

    def pairs(self) -> int:
        return len(self.names[0]) + len(self.names[1])

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The slices in order of their slots, then the documents, with the matrix by string in the order of all slices."""
        named, slots, columns, before = [], [], [], 0
        for form, names in enumerate(self.names):
            coded = pa.array(names, pa.string()).dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            named += distinct
            slots.append(np.array([zlib.crc32(s) % buckets * 2 + form for s in distinct], dtype=np.int64))
            columns.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + before)
            before += len(distinct)
        slot = np.concatenate(slots)
        order = np.argsort(slot, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        found, starts = np.unique(slot[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)] if len(order) else []
        for at, start, end in zip(found.tolist(), starts.tolist(), ends, strict=True):
            yield self._row(slot=at, strings=packed_strings([named[i] for i in order[start:end].tolist()]))
        string = rank[np.concatenate(columns)]
        by_string = np.argsort(string, kind="stable")
        place = np.concatenate([np.repeat(np.arange(len(s)), s) for s in self.sizes])
        yield self._row(
            doc_id=self.doc_id,
            n_bytes=self.n_bytes,
            specials=self.specials,
            documents=packed(np.bincount(string, minlength=len(order))),
            place=packed(place[by_string]),
            times=packed(np.array(self.times[0] + self.times[1], dtype=np.int64)[by_string]),
        )

    def _row(self, **values) -> pa.RecordBatch:
        row = {"block": self.number, **values}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], type=f.type) for f in BLOCKS], schema=BLOCKS)


def frequency_blocks(docs: DataFrame, buckets: int, vocabulary: str = VOCABULARY, block_pairs: int = BLOCK) -> DataFrame:
    """(doc_id string, n_bytes, text) to slices and matrices."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens, block = PreTokens(vocabulary), None
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("row", "doc_id", "n_bytes", "text")], strict=True):
                number, doc_id, n_bytes, text = (value.as_py() for value in row)
                block = block or _Block(number)
                block.add(doc_id, n_bytes, *pre_tokens.frequencies(text))
                if block.pairs() >= block_pairs:
                    yield from block.rows(buckets)
                    block = None
        if block:
            yield from block.rows(buckets)

    return docs.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(of_batches, BLOCKS_DDL)


def count_pieces(slices: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(block, slot, strings), slots together and in order, to (block, slot, pieces): each pre-token of a slot is counted once."""
    out = pa.schema({"block": pa.int64(), "slot": pa.int32(), "pieces": pa.binary()})

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens, current, known = PreTokens(vocabulary), None, {}
        for batch in batches:
            pieces = []
            for slot, strings in zip(batch.column("slot").to_pylist(), batch.column("strings").to_pylist(), strict=True):
                if slot != current:
                    current, known = slot, {}
                names = unpacked_strings(strings)
                for name in names:
                    if name not in known:
                        known[name] = pre_tokens.pieces_of(name, bool(slot % 2))
                pieces.append(packed(np.array([known[name] for name in names], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("slot"), pa.array(pieces, pa.binary())], schema=out)

    return slices.mapInArrow(of_batches, "block long, slot int, pieces binary")


def _document_tokens(blocks: DataFrame) -> DataFrame:
    """Blocks with the ``pieces`` of all their slices, in order, to a row per document."""
    out = pa.schema({"doc_id": pa.string(), "n_bytes": pa.int64(), "n_tokens": pa.int64()})

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                tokens = np.array(block["specials"], dtype=np.int64)
                if block["pieces"]:
                    pieces = np.concatenate([unpacked(p) for p in block["pieces"]]).astype(np.int64)
                    counts = np.repeat(pieces, unpacked(block["documents"])) * unpacked(block["times"])
                    tokens += np.bincount(unpacked(block["place"]), weights=counts, minlength=len(tokens)).astype(np.int64)
                columns = [pa.array(block["doc_id"], pa.string()), pa.array(block["n_bytes"], pa.int64()), pa.array(tokens)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return blocks.mapInArrow(of_batches, "doc_id string, n_bytes long, n_tokens long")


def count_tokens(
    docs: DataFrame,
    *,
    limit: int = 512,
    vocabulary: str = VOCABULARY,
    block_pairs: int = BLOCK,
    buckets: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    named = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, -(-docs.count() // DOCUMENTS_PER_BUCKET)))
    blocks = written(frequency_blocks(named, buckets, vocabulary, block_pairs))
    slices = blocks.filter("slot is not null").select("block", "slot", "strings")
    pieces = count_pieces(slices.repartition("slot").sortWithinPartitions("slot"), vocabulary)
    by_block = pieces.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "pieces"))).alias("slices"))
    matrices = blocks.filter("slot is null").drop("slot", "strings")
    kept = ("doc_id", "n_bytes", "specials", "documents", "place", "times")
    joined = matrices.join(by_block, "block", "left").select(*kept, F.col("slices.pieces").alias("pieces"))
    return _document_tokens(joined).select(
        F.col("doc_id").cast(docs.select(id_col).schema[0].dataType).alias("doc_id"),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
