"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document; the ledger keeps one bit per failed rule beside the
measurements. Policies are versioned sets of rules, that is masks: applying one, or comparing
two, reads only the ledger. :func:`ablations` tells for every rule of a policy, by bitwise
aggregation, how many documents it fails, fails alone and would be kept without it.

Everything is built from array and string functions within a row: no shuffle, no Python. The
words of repeated three-word windows are found by sorting a document's windows and comparing
neighbours.

Defined results: a null or wordless text has all measurements 0 and fails ``too_short``; equal
rows are judged each; a very long text is judged whole, within its row; an empty table gives no rows; rows with a null id
are judged like others.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, WORD

SYMBOLS = "#*$%&|<>"

#: name -> (bit, SQL condition under which a document fails). Integer arithmetic only.
RULES: dict[str, tuple[int, str]] = {
    "too_short": (0, "n_words < 50"),
    "repeats_itself": (1, "100 * n_repeat_words > 50 * n_words"),
    "repeats_often": (2, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (3, "10 * n_symbols > n_words"),
    "repeated_lines": (4, "100 * n_dup_lines > 40 * n_lines"),
    "shouts": (5, "100 * n_upper_words > 30 * n_words"),
    "exclaims": (6, "100 * n_exclamations > 20 * n_words"),
    "doubled_words": (7, "100 * n_doubled_words > 20 * n_words"),
    "short_words": (8, "word_chars < 2 * n_words"),
    "long_words": (9, "word_chars > 15 * n_words"),
}

BASE = ("too_short", "repeats_itself")
#: Policy version -> its rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[policy])


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its measurements."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclamations"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get("words", i)
    windows = read.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                starts,
                lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("window"), i.alias("at")),
            )
        ),
    )
    window = lambda i: F.get("windows", i)["window"]
    shared = windows.withColumn(
        "shared",
        F.array_sort(
            F.filter(
                F.transform(
                    "windows",
                    lambda w, i: F.when((w["window"] == window(i - 1)) | (w["window"] == window(i + 1)), w["at"]),
                ),
                lambda at: at.isNotNull(),
            )
        ),
    )
    # A shared window covers three words, fewer where the next one starts inside it.
    covered = F.aggregate(
        F.transform("shared", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("shared", i + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda total, k: total + k,
    )
    upper = lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    return shared.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", upper)).cast("long").alias("n_upper_words"),
        "n_exclamations",
        F.size(F.filter("words", lambda w, i: F.lower(w) == F.lower(word(i - 1)))).cast("long").alias("n_doubled_words"),
    )


def ledger(measured: DataFrame) -> DataFrame:
    """``measured`` with ``fail_bits``, one bit per failed rule."""
    bits = F.lit(0).cast("long")
    for bit, fails in RULES.values():
        bits = bits + F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits)


def judge(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Ledger entries with ``base_failed`` and ``kept`` under a policy."""
    failed = lambda name: F.col("fail_bits").bitwiseAND(F.lit(mask(name))) != 0
    return entries.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and the share kept with and without."""
    whole = mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(whole))
    by_bits = entries.groupBy(bits.alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << RULES[n][0]).cast("long").alias("bit")) for n in POLICIES[policy]])
    one = by_bits.withColumn("r", F.explode(rules))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))
    return one.groupBy("r.rule").agg(
        n(hit).alias("n_failed"),
        n(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        n(F.col("bits") == 0).alias("n_kept"),
        n(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def check_quality(docs: DataFrame, *, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(ledger(measure(docs, id_col=id_col, text_col=text_col)), policy)


def _oracle() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << bit} ELSE 0 END" for bit, fails in RULES.values())
    words = f"list_filter(regexp_split_to_array(t, '{SPACES}'), lambda w: w <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, {words} AS words,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
pos AS (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
dup AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win),
cov AS (SELECT k, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM dup WHERE n > 1) GROUP BY k),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_upper_words,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
    CAST(len(list_filter(range(2, len(words) + 1), lambda i: lower(words[i]) = lower(words[i - 1]))) AS BIGINT) AS n_doubled_words
  FROM w LEFT JOIN cov ON w.k = cov.k),
l AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & {mask('base')}) <> 0 AS base_failed,
       (fail_bits & {mask('base')}) = 0 AND (fail_bits & {mask('v2')}) = 0 AS kept
FROM l
"""


ORACLE = _oracle()
