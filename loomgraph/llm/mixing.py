"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but never more than ``max_epochs`` times
what it holds; what a clamped source cannot take goes to the others by weight. The result of
repeating that until nothing is above its cap is the level L with

    sum(least(cap, L * weight)) = share * all words

and L is the largest of ``(total - caps of the k sources clamped first) / weights of the rest``
over k, with the sources in order of cap / weight. So no driver loop is needed.

Sampling: a source's documents are put in a seeded order. Each is taken ``floor(target / size
of source)`` times, and the documents at the front of the order once more, until the rest of
the target is used up; the document on the boundary is rounded to the nearer side. A source
therefore misses its target by at most half a document, and reruns agree.

The running sums never gather a source in one task: the seeded order is cut into buckets, as many
as the rows ask for, words are summed by (source, bucket) before the shuffle, and only
sums are carried from bucket to bucket.

Defined results: a null text has size 0; the null source is a source of its own, last in
order; a source without words gets target 0; an empty table gives no rows; equal rows are each
counted and are interchangeable in the order; rows without an id are ordered by their text; a very
long text is one document like any other. Columns other than ``id_col``, ``text_col`` and
``source_col`` are ignored by :func:`plan_mix` and kept by :func:`mix`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, numbered, word_count

SEED = 20240517
#: Rows of a bucket of the seeded order, on average and at most if sources are few; there are never under 256 buckets a source.
BUCKET_ROWS = 1 << 16


def plan_mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_digits: int | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, and the columns ``carry``.

    ``weights`` go to the sources in order of their names, repeating. ``carry`` also orders rows of one id and size.
    """
    if bucket_digits is None:  # cuts the same order finer or coarser, for the same result
        bucket_digits = max(2, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    no_id = F.concat(F.lit("no id "), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    order_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), no_id)))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        order_key.alias("order_key"),
        *carry,
    ).select(
        "*",
        F.substring("order_key", 1, bucket_digits).alias("bucket"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.col("source").isNull().alias("no_source"),
    )
    keys = ["source_key", "no_source", "bucket"]
    sums = sized.groupBy(*keys).agg(F.sum("size").alias("bucket_size"))
    within = Window.partitionBy("source_key", "no_source")
    offsets = sums.select(
        *keys,
        F.coalesce(
            F.sum("bucket_size").over(within.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )

    # One row per source from here to `level`; the windows below run over that small table.
    by_name = Window.orderBy("no_source", "source_key")
    choice = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    sources = (
        sums.groupBy("source_key", "no_source")
        .agg(F.sum("bucket_size").alias("source_size"))
        .withColumn("weight", choice)
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source_key")
    every = Window.partitionBy()
    level = (
        sources.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("clamped")) / F.col("open_weight")).over(every))
        .withColumn(
            "target",
            F.when(F.sum("cap").over(every) <= F.col("total"), F.col("cap").cast("double")).otherwise(
                F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
            ),
        )
        .withColumn(
            "whole",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
        )
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source_key", "no_source", "source_size", "target", "whole", "part")
    )
    per_bucket = offsets.join(level, ["source_key", "no_source"])

    in_bucket = (
        Window.partitionBy(*keys)
        .orderBy("order_key", "doc_id", "size", *carry)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = sized.withColumn("upto", F.sum("size").over(in_bucket)).join(per_bucket, keys)
    middle = (F.col("before") + F.col("upto")) * 2 - F.col("size")
    copies = F.col("whole") + F.when((F.col("part") > 0) & (middle <= F.col("part") * 2), 1).otherwise(0)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *carry,
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan takes it, all columns kept.

    Each row has a plan of its own, also if its id repeats or is null: rows are numbered and the plan
    carries the number. Rows without an id are put in the seeded order by their text.
    """
    rows = numbered(docs)
    doc = F.col("doc")
    content = F.md5(F.coalesce(doc[text_col], F.lit("")))
    keyed = rows.select(doc[id_col].alias("id"), doc[text_col].alias("text"), doc[source_col].alias("source"), content.alias("content"), "row")
    plan = plan_mix(keyed, id_col="id", text_col="text", source_col="source", carry=("content", "row"), **options)
    taken = plan.filter("copies > 0").select("row", "copies")
    repeated = rows.join(taken, "row").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select("doc.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), 'no id ' || md5(coalesce(text, ''))))) AS order_key,
         CAST(coalesce(len(list_filter(regexp_split_to_array(text, '{SPACES}'), lambda w: w <> '')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, source_size * 2 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM capped WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (max(lev) OVER ()) * weight) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.doc_id, d.size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
counted AS (
  SELECT *, whole + CASE WHEN part > 0 AND upto * 2 - size <= part * 2 THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, source, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken
FROM counted
"""
