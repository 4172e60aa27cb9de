"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes weighted counts of hashed features: its words (``TERMS`` slots, case ignored), and the forms
of its words (letters, case, digits and marks, runs collapsed), their endings and lengths, and how much of it
repeats. A bounded sample of labelled rows gives inverse document frequencies and, by a
truncated singular value decomposition, the latent space. The labelled vectors are broadcast;
every document's cosine with each of them is computed exactly, in blocks, and the labels of the
``NEIGHBOURS`` nearest are averaged, weighted by similarity. Cosines count to five digits; of equal ones the
labelled row that comes first in the order of the sample is nearer, so scores do not depend on blocks.

The bound of the sample, ``EXAMPLES`` labelled rows that have a document, bounds the broadcast (about 3 MB)
and the memory of a block. Everything else covers all rows: each document is scored from its whole text,
however long.

Defined results: a null or empty text is scored like any other (it has the features of an empty
text); rows without an id are scored, and are held out as crc32 of nothing is 0; without any
labelled row every score is 0.5; equal rows score equally; an empty table gives no rows. Extra
columns are ignored by :func:`score_quality`, kept by :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learnt from, at most: those with the smallest hash of their id.
EXAMPLES = 4096
#: Slots of hashed forms, and after them of hashed words.
FORMS, TERMS = 2048, 2048
FEATURES = FORMS + TERMS
#: What words count beside forms.
TERM_WEIGHT = 0.5
DIMENSIONS = 48
NEIGHBOURS = 24
#: Votes weigh similarity to this power, so that close neighbours count most.
SHARPNESS = 6
#: Cosines are counted in this part of one.
DIGITS = 100_000
THRESHOLD = 0.3
FOLDS = 5
#: Documents scored at a time.
BLOCK = 256
SEED = 7

REMEMBERED = 1 << 18


@lru_cache(maxsize=1 << 16)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FORMS


def _term(word: str) -> int:
    return FORMS + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % TERMS


def _shape(word: str) -> str:
    stem, last = word[:-1], word[-1]
    mark = "" if last.isalpha() else last
    if mark == "":
        stem = word
    if stem.isalpha():  # most words
        if stem.islower():
            return "a" + mark
        if stem.isupper():
            return "A" + mark
        if stem[1:].islower():
            return "Aa" + mark
    letters = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", letters)[:8]


class _WordSlots(dict):
    """Word -> slot of the word itself, and row of ``table``, which has the slots of its forms; words of one form share a row."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, 3), dtype=np.int64)
        self.kinds: dict[tuple, int] = {}

    def slots(self, words: Counter) -> np.ndarray:
        """For each word its three form slots and its own."""
        if len(self) >= REMEMBERED or len(self.kinds) >= REMEMBERED:
            self.clear()
            self.kinds.clear()
        row, term = np.divmod(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)), FEATURES)
        return np.column_stack((self.table[row], term))

    def __missing__(self, word: str) -> int:
        size = len(word)
        shape = "a" if word.isalpha() and word.islower() else _shape(word)
        kind = (shape, word.lower() if size <= 3 else min(size, 20) // 3)
        row = self.kinds.get(kind)
        if row is None:
            row = self._new_row(kind)
        self[word] = row * FEATURES + _term(word)
        return self[word]

    def _new_row(self, kind: tuple) -> int:
        shape, own = kind
        row = self.kinds[kind] = len(self.kinds)
        if row >= len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        own = f"word {own}" if isinstance(own, str) else f"length {own}"
        self.table[row] = _slot(f"shape {shape}"), _slot(f"end {shape[-2:]}"), _slot(own)
        return row


def _level(share: float) -> int:
    return int(min(share, 1.0) * 10)


def features(text: str | None, slots: _WordSlots) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and their counts, normalised by length."""
    words = (text or "").split()
    n = len(words)
    found = Counter(words)
    counts = np.zeros(FEATURES)
    if words:
        times = np.fromiter(found.values(), dtype=np.float64, count=len(found))
        counts = np.bincount(slots.slots(found).ravel(), weights=np.repeat(times, 4), minlength=FEATURES)
    lines = [line for line in (text or "").split("\n") if line and not line.isspace()]
    doubled = sum(map(str.__eq__, words, words[1:]))
    windows = len(set(zip(words, words[1:], words[2:], strict=False)))
    whole = {
        "size": min(n.bit_length(), 7),
        "repeats": _level(1 - windows / max(1, n - 2)) if n > 2 else 0,
        "doubled": _level(doubled / max(1, n)),
        "lines": _level(1 - len(set(lines)) / max(1, len(lines))) if lines else 0,
        "distinct": _level(len(found) / max(1, n)),
    }
    slot_of = np.flatnonzero(counts)
    value = np.sqrt(counts[slot_of] / max(1, 3 * n)) * np.where(slot_of < FORMS, 1.0, TERM_WEIGHT)
    pseudo = np.array([_slot(f"{k} {v}") for k, v in whole.items()], dtype=np.int64)
    return np.concatenate((slot_of, pseudo)), np.concatenate((value, np.full(len(pseudo), 0.35)))


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for i, (slots, values) in enumerate(rows):
        np.add.at(out[i], slots, values)
    return out


def _projected(rows: list[tuple[np.ndarray, np.ndarray]], axes: np.ndarray) -> np.ndarray:
    """The rows in the latent space; every row has features."""
    starts = np.cumsum([0, *(len(slots) for slots, _ in rows[:-1])])
    weighted = axes[np.concatenate([s for s, _ in rows])] * np.concatenate([v for _, v in rows])[:, None].astype(np.float32)
    return np.add.reduceat(weighted, starts, axis=0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Latent axes (with the frequencies folded in), labelled vectors and their labels."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        n = len(self.labels)
        cosines = np.rint(_unit(_projected(rows, self.axes)) @ self.vectors.T * DIGITS).astype(np.int64)
        k = min(NEIGHBOURS, n)
        ranked = -np.sort(-np.partition(cosines * n + (n - 1 - np.arange(n)), n - k, axis=1)[:, n - k :], axis=1)
        near, cosines = n - 1 - ranked % n, ranked // n
        weight = np.maximum(cosines / DIGITS, 1e-6) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    x = _matrix(rows)
    if not len(x):
        return Model(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x *= idf.astype(np.float32)
    k = min(DIMENSIONS, len(x))
    basis = x @ np.random.default_rng(SEED).standard_normal((FEATURES, k + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis, _r = np.linalg.qr(x @ (x.T @ basis))
    _u, _s, axes = np.linalg.svd(basis.T @ x, full_matrices=False)
    axes = (axes[:k].T * idf[:, None]).astype(np.float32)
    blocks = [_projected(rows[i : i + BLOCK], axes) for i in range(0, len(rows), BLOCK)]
    return Model(axes, _unit(np.concatenate(blocks)).astype(np.float32), labels)


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the labelled rows outside the held-out fold, ``EXAMPLES`` of them at most."""
    chosen = (
        labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).alias("_label"))
        .filter((fold(F.col("_label_id")) != 0) & F.col("_label").isNotNull())
        .join(docs.select(F.col(id_col).alias("_label_id")), "_label_id", "left_semi")
        .withColumn("_order", F.md5(F.col("_label_id").cast("string")))
        .orderBy("_order", "_label")
        .limit(EXAMPLES)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_order", "_label", "_text")

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = _WordSlots()
        for batch in batches:
            made = [features(t, slots) for t in batch["_text"]]
            packed = {"slots": [s.astype("<u2").tobytes() for s, _ in made], "counts": [v.astype("<f4").tobytes() for _, v in made]}
            yield pd.DataFrame({"_order": batch["_order"], "_label": batch["_label"], **packed})

    rows = (
        joined.mapInPandas(of_batches, "_order string, _label int, slots binary, counts binary")
        .orderBy("_order", "_label")
        .limit(EXAMPLES)
        .collect()
    )
    found = [(np.frombuffer(r["slots"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(np.float64)) for r in rows]
    return fit(found, np.array([r["_label"] for r in rows], float))


def score_column(text: Column, model: Model, context) -> Column:
    shared = context.broadcast(model)

    @F.pandas_udf("double")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _WordSlots()
        for texts in batches:
            blocks = (texts.iloc[i : i + BLOCK] for i in range(0, len(texts), BLOCK))
            scores = [shared.value.scores([features(t, slots) for t in block]) for block in blocks]
            yield pd.Series(np.concatenate(scores) if scores else np.empty(0))

    return of_batches(text)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(F.col(id_col)) == 0).alias("held_out"),
        score_column(F.col(text_col), model, docs.sparkSession.sparkContext).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    return docs.filter(score_column(F.col(text_col), model, docs.sparkSession.sparkContext) >= threshold)
