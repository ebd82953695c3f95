"""Host-level quality rules (native).

Per document: counts over the whole text and the base rules.  Per host (the
``source`` column): failures are summed, the rate is shrunk with a beta prior whose
two parameters are estimated from all hosts by the method of moments, and the
verdict goes back to the host's documents by an equi join that AQE broadcasts only
when the measured host table is small and splits where a host is hot.

Defined results: null or empty text has no words (fails ``n_words < 50``); null
hosts form one host of their own; repeated rows each count and are each returned;
an empty table gives no rows; further columns are ignored.
Two 3-word windows count as equal when their 64-bit hashes agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, body, staged, table

#: A host is dropped when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength (pseudo-documents).
PRIOR_MIN, PRIOR_MAX = 1.0, 10_000.0

_GRAMS = """
CASE WHEN size(words) >= 3
     THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))
     ELSE array() END"""

# (hash, position) in hash order; a position is repeated when a neighbour has its hash
_ORDERED = """
CASE WHEN size(array_distinct(grams)) < size(grams)
     THEN sort_array(transform(grams, (h, i) -> named_struct('h', h, 'i', i)))
     ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"""

_REPEATED = """
sort_array(transform(
  filter(ordered, (x, j) -> get(ordered, j - 1).h = x.h OR get(ordered, j + 1).h = x.h),
  x -> x.i))"""

# words inside any repeated window: consecutive starts overlap
_COVERED = """
aggregate(repeated, named_struct('n', 0L, 'last', -3),
          (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)"""


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each document; ``base_failed`` by the base rules."""
    text = body(docs)
    counted = (
        docs.select(
            docs["doc_id"],
            docs[host].alias("host"),
            F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        )
        .withColumn("grams", F.expr(_GRAMS))
        .withColumn("ordered", F.expr(_ORDERED))
        .withColumn("repeated", F.expr(_REPEATED))
    )
    return counted.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n, failed, shrunk rate, host_failed."""
    hosts = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    # one row of numbers: mean rate, variance between hosts beyond what sampling gives
    prior = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("failed").alias("failed"),
        F.avg(F.pow(F.col("failed") / F.col("n"), 2)).alias("sq"),
        F.avg(F.col("failed") / F.col("n")).alias("rate"),
        F.avg(1 / F.col("n")).alias("inv"),
    ).first()
    if not prior["n"]:
        a = b = 1.0
    else:
        mean = min(max(prior["failed"] / prior["n"], 1e-6), 1 - 1e-6)
        spread = prior["sq"] - prior["rate"] ** 2 - mean * (1 - mean) * prior["inv"]
        strength = mean * (1 - mean) / spread - 1 if spread > 0 else PRIOR_MAX
        strength = min(max(strength, PRIOR_MIN), PRIOR_MAX)
        a, b = mean * strength, (1 - mean) * strength
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate > limit)


def apply_host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    counts = staged(rule_counts(docs, host), "host-rules")
    verdicts = host_verdicts(counts, limit).select(F.col("host").alias("v_host"), "host_rate", "host_failed")
    joined = counts.join(verdicts, counts["host"].eqNullSafe(verdicts["v_host"]), "left")
    return joined.drop("v_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), c AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
), h AS (
  SELECT host, count(*) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS failed FROM f GROUP BY host
), p AS (
  SELECT least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) AS m,
         avg((failed / n) ** 2) - avg(failed / n) ** 2 AS sp, avg(1.0 / n) AS inv FROM h
), s AS (
  SELECT m, CASE WHEN sp - m * (1 - m) * inv > 0
                 THEN least(greatest(m * (1 - m) / (sp - m * (1 - m) * inv) - 1, 1), 10000) ELSE 10000 END AS k
  FROM p
), v AS (
  SELECT host, (failed + m * k) / (n + k) > 0.5 AS host_failed FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
