"""Sharding by a keyed permutation of row numbers.

Rows get the global numbers 0 .. n-1. A Feistel network over an a x b rectangle that just
covers n permutes them; a value that lands outside 0 .. n-1 is sent through again (cycle
walking), which keeps the map a permutation of 0 .. n-1. Row p of the shuffle lies in shard
``p % shards`` at slot ``p div shards``, so shard and slot can be computed for any row without
looking at others, shards differ by one row at most, and slots have no gaps.

Global numbers come without a global sort: ids are dealt to ``buckets`` by arithmetic (rows without
an id by a checksum of their text, so they do not share a bucket), counted, and numbered inside their bucket after one narrow shuffle. The
table of bucket offsets has ``buckets`` rows whatever the input, so it is broadcast.

Defined results: a null text counts as no bytes (size 8, CRC 0); rows with a null id are
numbered like any other; equal rows are interchangeable; a very long text is only measured; an empty table gives no rows.
Ids may have any type that casts to string. Extra columns are ignored by :func:`assign_shards`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 11
BUCKETS = 4096
ROUNDS = 8
#: Prime modulus and multiplier of the round function and of the deal into buckets.
PRIME = 2147483647
MULTIPLIER = 1103515245
MAX_WALKS = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    keys, state = [], seed % PRIME + 1
    for _ in range(rounds):
        state = state * 48271 % PRIME
        keys.append(state % (1 << 20))
    return keys


def bucket_key(id_col: Column, id_type: T.DataType, text_crc32: Column) -> Column:
    """A long that spreads rows: the id, a checksum of an id that is no integer, that of the text where there is no id."""
    number = id_col.cast("long") if isinstance(id_type, T.IntegralType) else F.crc32(id_col.cast("string").cast("binary")).cast("long")
    return F.coalesce(number, text_crc32)


def bucket_of(key: Column, buckets: int) -> Column:
    mixed = F.pmod(F.pmod(key, F.lit(PRIME)) * F.lit(MULTIPLIER), F.lit(PRIME))
    return F.pmod(mixed, F.lit(buckets)).cast("int")


def permute(number: Column, n: int, seed: int) -> Column:
    """``number`` in 0 .. n-1 through the keyed permutation of 0 .. n-1."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def state(x: Column, y: Column, mx: Column, my: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), mx.alias("mx"), my.alias("my"))

    def half_round(s: Column, key: Column) -> Column:
        v = s["y"] + key
        f = (v * v) % F.lit(PRIME) * F.lit(MULTIPLIER) % F.lit(PRIME)
        return state(s["y"], (s["x"] + f) % s["mx"], s["my"], s["mx"])

    def once(p: Column) -> Column:
        start = state(p % F.lit(a).cast("long"), F.floor(p / F.lit(a)).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"))
        return F.aggregate(keys, start, half_round, lambda s: s["x"] + s["y"] * F.lit(a).cast("long"))

    # At most a of the a * b values lie outside. Up to n = 4096 no walk can be longer than
    # MAX_WALKS; beyond, the chance of a longer one is under (1 / 64) ** 64, and it would stop the job.
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALKS)), once(number), lambda p, _: F.when(p < F.lit(n), p).otherwise(once(p))
    )
    first = once(number)
    done = F.when(first < F.lit(n), first).otherwise(walked)
    return F.when(done < F.lit(n), done).otherwise(F.raise_error("cycle walk did not end").cast("long"))


def number_rows(rows: DataFrame, key_source: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with a column ``row_number`` from 0 without gaps, by bucket of ``key`` and then ``order``.

    ``key_source`` has the keys of the same rows.
    """
    counts = key_source.select(bucket_of(F.col("key"), buckets).alias("bucket")).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy(*order)
    return (
        rows.withColumn("bucket", bucket_of(F.col("key"), buckets))
        .withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("row_number", F.col("offset") + F.col("inside"))
    )


def assign_shards(
    docs: DataFrame, *, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, position."""
    n = docs.count()
    text_crc32 = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long")
    key = bucket_key(F.col(id_col), docs.select(id_col).schema[0].dataType, text_crc32)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        text_crc32.alias("text_crc32"),
        key.alias("key"),
    )
    numbered = number_rows(narrow, docs.select(key.alias("key")), ["doc_id", "text_crc32", "size"], buckets)
    return numbered.withColumn("position", permute(F.col("row_number"), n, seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "position",
    )


def _oracle() -> str:
    crc_table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        crc_table.append(c)
    x, y, mx, my = "p % a", "p // a", "a", "b"
    inner = f"SELECT doc_id, size, text_crc32, n, a, b, {x} AS x, {y} AS y FROM SOURCE"
    for i, key in enumerate(round_keys(SEED)):
        m = "a" if i % 2 == 0 else "b"
        f = f"(((y + {key}) * (y + {key})) % {PRIME}) * {MULTIPLIER} % {PRIME}"
        inner = f"SELECT doc_id, size, text_crc32, n, a, b, y AS x, (x + {f}) % {m} AS y FROM ({inner})"
    once = f"SELECT doc_id, size, text_crc32, n, a, b, x + y * a AS p FROM ({inner})"
    return rf"""
WITH RECURSIVE nibbles AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), ''),
                   lambda h: CAST(instr('0123456789ABCDEF', h) - 1 AS BIGINT)) AS nibble
  FROM documents),
crc AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN size = 8 THEN [] ELSE nibble END),
      lambda c, h: xor(c >> 4, ({crc_table}::BIGINT[])[(xor(c, h) & 15) + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32
  FROM nibbles),
dealt AS (
  SELECT *, (((coalesce(doc_id, text_crc32) % {PRIME} + {PRIME}) % {PRIME}) * {MULTIPLIER} % {PRIME}) % {BUCKETS} AS bucket,
         (SELECT count(*) FROM documents) AS n FROM crc),
sides AS (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a,
         row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS p FROM dealt),
numbered AS (SELECT doc_id, size, text_crc32, n, a, (n + a - 1) // a AS b, p FROM sides),
walk AS (
  {once.replace('SOURCE', 'numbered')}
  UNION ALL
  {once.replace('SOURCE', '(SELECT * FROM walk WHERE p >= n)')})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 24 AS INTEGER) AS shard, CAST(p // 24 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, CAST(p AS BIGINT) AS position
FROM walk WHERE p < n
"""


ORACLE = _oracle()
