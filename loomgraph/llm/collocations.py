"""Phrases whose words stand together more often than apart, by the hash passes of PCY and DHP.

Texts are cut into pieces and words once and kept as blocks of word codes. Pass k counts phrases of k words.
It counts exactly only those that may be frequent: both phrases of k - 1 words in it are (Apriori), and
the bucket into which it is hashed has been met often enough. For that, each pass adds up the buckets of the
phrases of k + 1 words whose two parts it counts itself; sums end at the threshold, so a counter is one
byte. What passes from one pass to the next is two broadcast bitmaps of ``1 << bits`` bits, one of the buckets that are
full, one of the frequent phrases; ``bits`` is between the two bounds, 16 MB a bitmap at most, whatever the data.
A wrong bit costs a phrase counted in vain and never changes the result, as counts decide.

Equal phrases of a block are added up before they are shuffled, so a phrase that is everywhere comes once a
block. Scores and enclosing phrases are joins over the frequent phrases, with tables freshly written, which
the adaptive planner splits where one word begins a third of them. The best of each language are taken in
``SALTS`` parts first, so the last ranking has ``SALTS * top`` rows a language at most.

Defined results: null counts as empty and gives nothing; a null language is ``und``; a language without a frequent
phrase has no rows; equal rows and rows without an id are counted each; texts are taken whole, however
long; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.rolling import BASES, MODULUS, mixed
from loomgraph.llm.token_counts import packed, packed_strings, unpacked, unpacked_bytes

#: Shortest and longest phrase, fewest occurrences, rows a language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Words after which a task's blocks, one a language, end; with one document more, this bounds its memory.
BLOCK_WORDS = 1 << 20
#: Words for each bucket, and bounds for the bits of a bucket's number. Any number gives the same rows.
WORDS_PER_BUCKET, FEWEST_BITS, MOST_BITS = 16, 20, 27
#: Buckets whose counters cross a shuffle as one row.
SLICE = 1 << 16
SALTS = 16

ENDS = ".,;:!?\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans((CAPITALS + "\t" + ENDS).encode(), (CAPITALS.lower() + " " + "\n" * len(ENDS)).encode())


def tokens(text: bytes) -> list[bytes]:
    """Words, a line feed after each piece, and some empty strings."""
    return [*text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" "), b"\n"]


BLOCK = pa.schema([("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("codes", pa.binary())])


def _block(lang: str, found: list[bytes]) -> pa.RecordBatch:
    """Codes are places among the words, from 1, and 0 between pieces."""
    coded = pa.array(found, pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers, kept = np.zeros(len(names), dtype=np.int64), [name for name in names if name not in (b"", b"\n")]
    numbers[[i for i, name in enumerate(names) if name not in (b"", b"\n")]] = np.arange(1, len(kept) + 1)
    blank = np.array([name == b"" for name in names], dtype=bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    codes = numbers[codes[~blank[codes]]]
    row = (lang, int(np.count_nonzero(codes)), packed_strings(kept), packed(codes))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK.types, strict=True)], schema=BLOCK)


def word_blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """(lang, text) to blocks of word codes."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[bytes]] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary()), strict=True):
                found = tokens(text.as_py() or b"")
                open_.setdefault(lang.as_py(), []).extend(found)
                n += len(found)
                if n >= block_words:
                    yield from (_block(*x) for x in open_.items())
                    open_, n = {}, 0
        yield from (_block(*x) for x in open_.items())

    return docs.mapInArrow(of_batches, "lang string, n_words long, words binary, codes binary")


class _Bitmap:
    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, dtype=np.uint8)

    def has(self, buckets: np.ndarray) -> np.ndarray:
        places = buckets.astype(np.int64)
        return (self.data[places >> 3] >> (7 - (places & 7)) & 1).astype(bool)


class _Phrases:
    """Word hashes and phrase hashes of a block."""

    def __init__(self, lang: str, words: list[bytes], codes: np.ndarray, bits: int):
        self.words, self.codes, self.shift = words, codes.astype(np.int64), np.uint64(64 - bits)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.names = np.array([0, *(xxhash.xxh3_64_intdigest(w, seed) for w in words)], dtype=np.uint64)
        self.of_word = self.names[self.codes]
        self.levels = [None, self.of_word]

    def hashes(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, n = self.levels[-1], len(self.levels) - 1
            self.levels.append(last[:-1] * np.uint64(BASES[0]) + self.of_word[n:] if len(last) else last)
        return self.levels[k]

    def buckets(self, k: int, at: np.ndarray) -> np.ndarray:
        return mixed(self.hashes(k)[at]) >> self.shift

    def starts(self, k: int) -> np.ndarray:
        """Positions at which ``k`` words of one piece start."""
        word = self.codes > 0
        whole = word[: max(0, len(word) - k + 1)].copy()
        for j in range(1, k):
            whole &= word[j : j + len(whole)]
        return np.flatnonzero(whole)

    def counts(self, k: int, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The distinct phrases that start at some positions, told apart by all their words, and how often each does."""
        key = self.codes[at]
        for j in range(1, k):
            key = np.unique(key, return_inverse=True)[1] << 32 | self.codes[at + j]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        phrases = [b" ".join([self.words[c - 1] for c in row]).decode("utf-8", "replace") for row in self.codes[at[first][:, None] + np.arange(k)].tolist()]
        return phrases, times


class _Buckets:
    """Counters that end at the threshold."""

    def __init__(self, bits: int, least: int):
        self.least, self.counters = least, np.zeros(1 << bits, dtype=np.min_scalar_type(least))

    def add(self, buckets: np.ndarray) -> None:
        found, times = np.unique(buckets.astype(np.int64), return_counts=True)
        room = self.least - self.counters[found].astype(np.int64)
        self.counters[found] += np.minimum(times, room).astype(self.counters.dtype)

    def fill(self, buckets: np.ndarray) -> None:
        self.counters[buckets.astype(np.int64)] = self.least

    def slices(self) -> Iterator[tuple[int, bytes]]:
        for i in range(0, len(self.counters), SLICE):
            part = self.counters[i : i + SLICE]
            if part.any():
                yield i // SLICE, zstandard.compress(part.tobytes(), 1)


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("slice", pa.int32()), ("counters", pa.binary())])
COUNTED_DDL = "lang string, phrase string, a long, slice int, counters binary"


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in COUNTED], schema=COUNTED)


def count_pass(blocks: DataFrame, k: int, bits: int, least: int, longest: int, full=None, frequent=None) -> DataFrame:
    """Counts of the phrases of ``k`` words that may be frequent, by block, and counters of buckets for ``k + 1`` by task.

    ``full`` and ``frequent`` are broadcast bitmaps of full buckets for ``k`` and frequent phrases of ``k - 1`` words.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits, least)
        for batch in batches:
            for lang, words, codes in zip(*(batch.column(c) for c in ("lang", "words", "codes")), strict=True):
                block = _Phrases(lang.as_py(), unpacked_bytes(words.as_py()), unpacked(codes.as_py()), bits)
                at = block.starts(k)
                if k > 1:
                    at = at[_Bitmap(full.value).has(block.buckets(k, at))]
                    part = _Bitmap(frequent.value)
                    at = at[part.has(block.buckets(k - 1, at))]
                    at = at[part.has(block.buckets(k - 1, at + 1))]
                if len(at):
                    phrases, times = block.counts(k, at)
                    yield _rows(lang=[lang.as_py()] * len(phrases), phrase=phrases, a=times)
                if k < longest and len(at):
                    longer = np.intersect1d(block.starts(k + 1), at, assume_unique=True)
                    longer = longer[np.isin(longer + 1, at, assume_unique=True)]
                    buckets.add(block.buckets(k + 1, longer))
        for number, counters in buckets.slices():
            yield _rows(slice=[number], counters=[counters])

    return blocks.select("lang", "words", "codes").mapInArrow(of_batches, COUNTED_DDL)


def frequent_buckets(frequent: DataFrame, k: int, bits: int, least: int) -> DataFrame:
    """(lang, phrase) of ``k`` words to counters of buckets that are full where a phrase is."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits, least)
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.uint64)
            for row, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)):
                seed, value = xxhash.xxh3_64_intdigest(lang.encode()), 0
                for word in phrase.split(" "):
                    value = (value * BASES[0] + xxhash.xxh3_64_intdigest(word.encode(), seed)) % MODULUS
                found[row] = value
            buckets.fill(mixed(found) >> np.uint64(64 - bits))
        for number, counters in buckets.slices():
            yield _rows(slice=[number], counters=[counters])

    return frequent.select("lang", "phrase").mapInArrow(of_batches, COUNTED_DDL)


def bitmap(counted: DataFrame, bits: int, least: int) -> bytes:
    """Counters of all tasks to one bit for each bucket that is full: ``1 << bits`` bits, whatever the data."""
    kind = np.min_scalar_type(least)

    def of_slice(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(zstandard.decompress(c), dtype=kind) for c in group.column("counters").to_pylist()]
        total = np.zeros(len(parts[0]), dtype=np.int64)
        for part in parts:
            total += part
        return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    rows = counted.filter("slice is not null").select("slice", "counters")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in rows.groupBy("slice").applyInArrow(of_slice, "slice int, bits binary").toLocalIterator():
        start = row["slice"] * (SLICE // 8)
        out[start : start + len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def frequent_phrases(blocks: DataFrame, *, longest: int = WORDS, least: int = LEAST, bits: int) -> DataFrame:
    """(lang, phrase, k, a): all phrases of up to ``longest`` words that are met ``least`` times, with exact counts."""
    spark, full, frequent, levels = blocks.sparkSession, None, None, []
    for k in range(1, longest + 1):
        counted = written(count_pass(blocks, k, bits, least, longest, full, frequent))
        sums = counted.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
        level = written(sums.select("lang", "phrase", F.lit(k).alias("k"), "a"))
        levels.append(level)
        if k < longest:
            full = spark.sparkContext.broadcast(bitmap(counted, bits, least))
            frequent = spark.sparkContext.broadcast(bitmap(frequent_buckets(level, k, bits, least), bits, least))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def _words(phrase: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def score(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with the cut at which they hold together least: lang, phrase, k, a, l, r, n, score."""
    known = lambda part, n: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = phrases.filter("k > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select(
        "*",
        _words(F.col("phrase"), F.lit(1), F.col("cut")).alias("first"),
        _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"),
    )
    both = parts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    value = F.expr("cast(1000 * top as decimal(38,0)) div bottom")
    scored = both.withColumn("top", exact("a") * exact("n")).withColumn("bottom", exact("l") * exact("r")).withColumn("score", value)
    least = F.min(F.struct("score", "cut", "l", "r")).alias("least")
    return scored.groupBy("lang", "phrase", "k", "a", "n").agg(least).select("lang", "phrase", "k", "a", "least.l", "least.r", "n", "least.score")


def enclosed(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase) of the phrases that lie in a longer one met at least ``percent`` of the times."""
    inner = F.explode(
        F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> struct(i as i, m as m))))")
    )
    parts = phrases.filter("k > 2").select("lang", "phrase", F.col("a").alias("whole"), inner.alias("at"))
    longer = parts.groupBy("lang", _words(F.col("phrase"), F.col("at.i"), F.col("at.m")).alias("phrase")).agg(F.max("whole").alias("whole"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return phrases.filter("k > 1").join(longer, ["lang", "phrase"]).filter(exact("whole") * 100 >= exact("a") * percent).select("lang", "phrase")


def best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ranks."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    for keys in (("lang", salt), ("lang",)):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return scored


def find_collocations(
    docs: DataFrame,
    *,
    longest: int = WORDS,
    least: int = LEAST,
    top: int = TOP,
    percent: int = 100,
    bits: int | None = None,
    block_words: int = BLOCK_WORDS,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    blocks = written(word_blocks(docs.select(lang.alias("lang"), F.col(text_col).alias("text")), block_words))
    totals = written(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    if bits is None:
        words = blocks.agg(F.sum("n_words")).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, (words // WORDS_PER_BUCKET).bit_length()))
    phrases = written(frequent_phrases(blocks, longest=longest, least=least, bits=bits))
    scored = score(phrases, totals).join(enclosed(phrases, percent), ["lang", "phrase"], "left_anti")
    return best(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, {WORDS + 1}) AS s(k) WHERE len(words) >= k),
f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING a >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, t.n, 1000::HUGEINT * c.a * t.n // (x.a::HUGEINT * y.a) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS whole
  FROM (SELECT lang, a, k, string_split(phrase, ' ') AS words FROM f WHERE k > 2), range(2, {WORDS}) AS x(m), range(1, {WORDS}) AS y(i)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inner_phrases z ON z.lang = b.lang AND z.phrase = b.phrase WHERE z.whole IS NULL OR 100 * z.whole < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= {TOP}
"""
