"""Quality rules judged by host, in DataFrame functions only.

Each document is measured once: words, symbols, repeated lines and words in
repeated three-word windows. Rules on these figures fail or pass a document.
Failures are counted by host and rule; a host's rate is shrunk to a beta prior
whose two parameters come from the rates of all hosts by their mean and
variance, so a host with few documents is judged by what hosts are like. A host
with a shrunk rate above ``limit`` for any rule is rejected, and its documents
with it. The measures are written once and both sides of the join read them;
the host side is one row a host and comes from partial sums.

A window is known by its hash, which is compared within a document only.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; rows that repeat an id, or have none, are
documents each; very long texts are measured whole; extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, table

LEAST_WORDS, REPEAT_PERCENT, LIMIT, STRENGTH = 50, 50, 0.5, (1.0, 1e6)
SYMBOLS = r"[#*$%&|<>]"

#: Name and failure of each rule, on the measures' columns.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
BASE = ("few_words", "repeated_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words (an array) gone and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("*", F.filter(F.split(t, SPACE + "+"), lambda x: x != "").alias("_words"), with_word.alias("_lines"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    w = F.col("_words")
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    windows = F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)))
    out = out.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    ).drop("_words", "_lines")
    # In order of their hashes, equal windows are neighbours.
    s = F.col("_windows")
    twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.i))).drop("_windows")
    at = F.col("_at")
    new_words = F.transform(at, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(at, k - 1), x - 3)))
    repeated = F.aggregate(new_words, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0).cast("long"))).drop("_at")


def host_rates(measures: DataFrame, host: str) -> DataFrame:
    """(host, rule, n, failed, shrunk) of measures with a column host."""
    counts = measures.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(e)).alias(r) for r, e in RULES.items()))
    long = counts.unpivot(["host", "n"], list(RULES), "rule", "failed").withColumn("rate", F.col("failed") / F.col("n"))
    prior = long.groupBy("rule").agg(F.avg("rate").alias("mean"), F.var_samp("rate").alias("var"))
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.when(F.col("var") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1).otherwise(STRENGTH[1])))
    # One row a rule.
    long = long.join(F.broadcast(prior.select("rule", "mean", strength.alias("strength"))), "rule")
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return long.select("host", "rule", "n", "failed", shrunk.alias("shrunk"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """(doc_id, host, measures, base_failed, host_rejected, kept), one row for each row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text"))
    m = cut(measured(rows, "_text").drop("_text"), "measures")
    bad = host_rates(m, "host").groupBy("host").agg(F.max("shrunk").alias("worst")).where(F.col("worst") > limit).select(F.col("host").alias("_bad"), F.lit(True).alias("_r"))
    out = m.join(bad, F.col("host").eqNullSafe(F.col("_bad")), "left").withColumn("host_rejected", F.coalesce("_r", F.lit(False))).drop("_bad", "_r")
    failed = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS gram
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
q AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN q USING (r)),
f AS (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, count(*) AS n,
             unnest([count_if(n_words < 50), count_if(100 * n_repeat_words > 50 * n_words), count_if(10 * n_dup_lines > 3 * n_lines),
                     count_if(10 * n_symbols > n_words), count_if(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))]) AS failed
      FROM m GROUP BY source),
pr AS (SELECT rule, avg(failed / n) AS mean,
              greatest(1.0, least(1e6, CASE WHEN var_samp(failed / n) > 0 THEN avg(failed / n) * (1 - avg(failed / n)) / var_samp(failed / n) - 1 ELSE 1e6 END)) AS k
       FROM f GROUP BY rule),
bad AS (SELECT source FROM f JOIN pr USING (rule) GROUP BY source HAVING max((failed + mean * k) / (n + k)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM m.source) AS kept
FROM m
"""
