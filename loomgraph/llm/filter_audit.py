"""Interaction of filters: what each one removes, in every order in which they can be applied.

Each document is reduced once to the bits of the filters it fails. Counts of documents by
(part, bits), the mask cells, hold all that any order of the filters can tell: with k filters a part
has 2^k cells at most, whatever its documents. All k! orders are then visited by exchanging two
neighbours at a time (Steinhaus, Johnson, Trotter). An exchange changes only the two steps it
touches: what both remove together stays, what the earlier one removes is summed anew from the
cells. Each filter's removals are added up along the walk; divided by k! they are its Shapley value.

Copies are found table-wide by SHA-256 of the text, over narrow rows: texts never cross a shuffle.
The rows of a hot text meet the smallest id of their text in a join that the adaptive planner splits.

Defined results: a null text counts as empty; a null part is the empty string; parts have rows
only if they have documents; a row is a copy if a row with the same text has a smaller id, rows without
an id come after all others, and rows equal in id and text are not copies of each other; a document
is good (toxic) if any of its label rows says so, and rows with an equal id share its labels; labels without
a document and an empty table give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, written

#: Orders grow with the factorial of the filters; more than this is refused.
MOST_FILTERS = 8
WHITE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letter -> SQL condition under which a document fails, over the columns of :func:`measure`. Integer arithmetic only.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}


def measure(docs: DataFrame, *, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, part, sha, n_words, n_distinct, n_capitals, n_chars, has_symbol. Written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.split(F.btrim(text, F.lit(WHITE)), SPACES).alias("words"),
        F.length(text).cast("long").alias("n_chars"),
        (F.length(text) - F.length(F.translate(text, CAPITALS, ""))).cast("long").alias("n_capitals"),
        text.rlike("[#$%&*|]").alias("has_symbol"),
    )
    # A text without words is split into one empty string.
    counted = lambda words: F.when(F.get("words", F.lit(0)) == "", F.lit(0)).otherwise(F.size(words)).cast("long")
    found = read.select("*", counted(F.col("words")).alias("n_words"), counted(F.array_distinct("words")).alias("n_distinct"))
    return written(found.drop("words"))


def mark_copies(measured: DataFrame) -> DataFrame:
    """``measured`` with ``is_copy``."""
    several = measured.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = written(several.filter("first is not null").select("sha", "first"))
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return measured.join(firsts, "sha", "left").withColumn("is_copy", copy).drop("first", "sha")


def mark_labels(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``measured`` with ``good`` and ``toxic``."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias("good" if c == "quality" else c)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(said("quality"), said("toxic"))
    return measured.join(written(known.filter("good or toxic")), "doc_id", "left")


def mask_cells(measured: DataFrame, filters: Mapping[str, str], tallies: tuple[str, ...]) -> DataFrame:
    """(part, cells): for each part an array of (mask, n, and how many of these each tally holds for)."""
    mask = F.lit(0)
    for bit, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0))
    one = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    cells = measured.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *map(one, tallies))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", F.array("n", *tallies).alias("counts"))).alias("cells"))


def neighbour_swaps(k: int) -> Iterator[int]:
    """Places whose exchange with the next one leads through all k! orders, each met once."""
    order, direction = list(range(k)), [-1] * k
    while True:
        movable = [i for i, x in enumerate(order) if 0 <= i + direction[x] < k and order[i + direction[x]] < x]
        if not movable:
            return
        at = max(movable, key=order.__getitem__)
        item, to = order[at], at + direction[order[at]]
        yield min(at, to)
        order[at], order[to] = order[to], order[at]
        for larger in range(item + 1, k):
            direction[larger] = -direction[larger]


class _Walk:
    """The steps of an order of filters over the cells of one part, kept right from exchange to exchange."""

    def __init__(self, k: int, masks: np.ndarray, counts: np.ndarray):
        self.masks, self.counts = masks, counts
        self.order = list(range(k))
        self.removed = [self.removes(place) for place in range(k)]

    def removes(self, place: int) -> np.ndarray:
        """Documents that fail the filter at a place and none before it."""
        before = sum(1 << f for f in self.order[:place])
        return self.counts[(self.masks & before == 0) & (self.masks >> self.order[place] & 1 == 1)].sum(axis=0)

    def swap(self, place: int) -> None:
        both = self.removed[place] + self.removed[place + 1]
        self.order[place], self.order[place + 1] = self.order[place + 1], self.order[place]
        self.removed[place] = self.removes(place)
        self.removed[place + 1] = both - self.removed[place]


def visit_orders(k: int, masks: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], list[np.ndarray]]], np.ndarray]:
    """All orders with what each step removes, and per filter its removals summed over all orders."""
    walk, shapley, visited = _Walk(k, masks, counts), np.zeros(k, dtype=np.int64), []
    for swap in (None, *neighbour_swaps(k)):
        if swap is not None:
            walk.swap(swap)
        visited.append((tuple(walk.order), list(walk.removed)))
        for f, gone in zip(walk.order, walk.removed, strict=True):
            shapley[f] += gone[0]
    return visited, shapley


def all_orders(cells: DataFrame, letters: tuple[str, ...], tallies: tuple[str, ...]) -> DataFrame:
    """A row per part, order and step."""
    k = len(letters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {k}")
    counted = ("kept", "removed", "redundant", "unique_fails", *(f"{t}_lost" for t in tallies), "shapley")
    out = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in counted)])

    def of_part(part: str, found: list[dict]) -> pa.RecordBatch:
        masks = np.array([c["mask"] for c in found], dtype=np.int64)
        counts = np.array([c["counts"] for c in found], dtype=np.int64).reshape(len(found), 1 + len(tallies))
        failing = [counts[masks >> f & 1 == 1, 0].sum() for f in range(k)]
        alone = [counts[masks == 1 << f, 0].sum() for f in range(k)]
        visited, shapley = visit_orders(k, masks, counts)
        rows = []
        for order, removed in visited:
            name, kept = "".join(letters[f] for f in order), int(counts[:, 0].sum())
            for step, (f, gone) in enumerate(zip(order, removed, strict=True), 1):
                kept -= int(gone[0])
                rows.append((part, name, step, kept, gone[0], failing[f] - gone[0], alone[f], *gone[1:], shapley[f]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column("part"), batch.column("cells"), strict=True):
                yield of_part(part.as_py(), found.as_py())

    return cells.mapInArrow(of_batches, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counted))


def audit_filters(docs: DataFrame, labels: DataFrame, *, filters: Mapping[str, str] = FILTERS, id_col: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step; letters of ``filters`` are one character each."""
    measured = mark_labels(mark_copies(measure(docs, id_col=id_col)), labels, id_col=id_col)
    return all_orders(mask_cells(measured, filters, ("good", "toxic")), tuple(filters), ("good", "toxic"))


def shapley_values(audit: DataFrame) -> DataFrame:
    """(part, letter, value): how many documents each filter removes on average over all orders, from the rows of an audit."""
    own = audit.filter("step = 1").select("part", F.substring("filter_order", 1, 1).alias("letter"), "shapley", F.length("filter_order").alias("k"))
    return own.distinct().select("part", "letter", (F.col("shapley") / F.factorial("k")).alias("value"))


def _oracle() -> str:
    words = f"list_filter(regexp_split_to_array(t, '{SPACES}'), lambda w: w <> '')"
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(FILTERS.values()))
    letters = "".join(FILTERS)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, len({words}) AS n_words, len(list_distinct({words})) AS n_distinct, length(t) AS n_chars,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         regexp_matches(t, '[#$%&*|]') AS has_symbol,
         f.first IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > f.first) AS is_copy,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM d JOIN f USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, {bits} AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM m GROUP BY part, mask),
o(name) AS (
  SELECT '' UNION ALL
  SELECT o.name || x FROM o, (SELECT unnest(string_split('{letters}', '')) AS x) WHERE NOT contains(o.name, x)),
s AS (
  SELECT name AS filter_order, step, 1 << (strpos('{letters}', name[step]) - 1) AS bit,
         coalesce(list_sum([1 << (strpos('{letters}', name[i]) - 1) for i in range(1, step)]), 0)::INT AS earlier
  FROM o, (SELECT unnest(range(1, {len(letters) + 1})) AS step) WHERE length(name) = {len(letters)}),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
    CAST(sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


ORACLE = _oracle()
