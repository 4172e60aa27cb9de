"""Exact deduplication: group by 128-bit content hash, compare bytes, keep the smallest id.

Texts are equal when identical after every run of ASCII white space becomes one space.

Grouping by (hash, normalised text) compares the bytes: rows meet in a group only if both the
hash and the whole text agree. Copies collapse before the shuffle, so a group that holds a
third of all rows reaches its task as one row per input partition. The class of a document is
then looked up by hash and SHA-256 over narrow rows, so that texts which share the 128-bit
hash alone keep classes of their own; a hot class is split by the adaptive skew join.

Defined results: a null text counts as the empty one; a row with a null id is kept only if no
row of its group has an id; rows equal in id and text are one group of that size, and all
rows with the smallest id are marked kept, where :func:`drop_copies` keeps one of them; an empty
table gives no rows. Extra columns are ignored by :func:`find_copies`, kept by :func:`drop_copies`,
whatever their names. Texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, numbered


def normalised(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, SPACES, " "), F.lit(""))


def content_hash(text: Column) -> Column:
    """128 bits of content."""
    return F.unhex(F.md5(text))


def find_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    read = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    classes = (
        read.groupBy(hashed(F.col("norm")).alias("hash"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    rows = read.select("doc_id", hashed(F.col("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    return rows.join(classes, ["hash", "sha"]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that of the smallest id, rows without an id last, any one of rows with an equal id."""
    rows = numbered(docs)
    read = rows.select("row", F.col("doc")[id_col].alias("id"), normalised(F.col("doc")[text_col]).alias("norm"))
    first = read.groupBy(content_hash(F.col("norm")).alias("hash"), "norm").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    )
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")


ORACLE = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
