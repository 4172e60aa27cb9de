"""Packing documents into token sequences: first-fit decreasing in randomised groups.

Documents are tokenised, closed with an end id and cut into pieces of at most ``capacity``
ids. Pieces are dealt to random groups of about ``GROUP`` pieces; each group is packed on its
own by first-fit decreasing. A tournament tree over the free room of the sequences finds the
first one with room in logarithmic time. Groups are a fixed size whatever the input, so packing
scales with the number of groups, and a group of thousands leaves little padding.

Defined results: null counts as the empty text, which is one piece of one id (the end); equal
rows are packed each; a very long text is cut into as many pieces as it takes; an empty table gives
no rows. Ids may have any type that survives a cast to string and back. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import durable
from loomgraph.llm.tokenizing import VOCABULARY, TokenIds

CAPACITY = 2048
END_ID = 1
#: Pieces per group, on average.
GROUP = 8192

PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"


def cut(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id string, text) to pieces."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TokenIds(vocabulary)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate((encoder.ids(text), end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInPandas(of_batches, PIECE)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, in the given order: its bin and its offset in the bin.

    Lengths are taken largest first, ties in the given order. ``room[1]`` is the root of the
    tree, ``room[k]`` the larger of its two children, leaves are the free room of the bins.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
    return bins, offsets


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group: int = GROUP,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    named = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(cut(named, capacity=capacity, end_id=end_id, vocabulary=vocabulary))
    groups = max(1, -(-pieces.count() // group))

    def place(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(dtype=np.int64), capacity)
        return pieces.drop(columns="group").assign(
            sequence_id=pieces["group"].to_numpy(dtype=np.int64) * (1 << 32) + bins, offset=offsets
        )

    # Numbered by place in the written pieces, not by document: equal rows spread over groups.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    id_type = docs.select(id_col).schema[0].dataType
    return dealt.groupBy("group").applyInPandas(place, PLACED).withColumn("doc_id", F.col("doc_id").cast(id_type))
