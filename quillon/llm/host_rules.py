"""Quality rules judged per document and per host.

Each document is tried against page-level rules. The failures are added up by host, each host's
failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of moments,
weighted by documents), and a host whose shrunk rate passes ``max_rate`` loses all its documents.

Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and
carriage return. Rules of a document (``base_failed``): fewer than ``min_words`` words, or more than
``max_repeat_pct`` per cent of its words inside three-word windows that occur at least twice.

Nulls: a null text has no words and fails; a null host is one host of its own; a null id stays null.
Repeated rows count and come back as often as they occur. Empty tables give empty results. Other columns may
have any names that don't begin with two underscores.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.storage import materialize, read_table

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: A host is rejected where most of its documents would fail even after shrinking.
MAX_RATE = 0.6

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
METRICS = T.StructType([T.StructField(x, T.LongType()) for x in NAMES])


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = -1
        for k, window in enumerate(windows):
            if seen[window] > 1:
                repeated += k + 2 - max(covered, k - 1)
                covered = k + 2
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


@F.arrow_udf(METRICS)
def text_metrics(texts: pa.Array) -> pa.Array:
    found = [measure(t.as_py()) for t in texts]
    columns = zip(*found, strict=True) if found else [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(NAMES))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


def host_verdicts(judged: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """From rows (host, failed): host, n_docs, n_failed, shrunk_rate, host_rejected; one row per host.

    The prior has the mean m of all documents and the strength s = m(1-m)/v - 1, with v the variance of
    hosts' rates beyond what chance alone gives; where there is no such variance, or one host, s is the
    mean number of documents per host, so that each host leans half on the corpus.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("x"), F.count("*").alias("k"),
        F.sum(rate * F.col("n_failed")).alias("xx"),
    )
    n, x, k = F.col("n"), F.col("x"), F.col("k")
    mean = x / n
    spread = F.greatest(F.col("xx") / n - mean * mean - mean * (1 - mean) * k / n, F.lit(0.0))
    strength = F.when((spread > 0) & (mean * (1 - mean) > spread), mean * (1 - mean) / spread - 1).otherwise(n / k)
    prior = moments.filter(n > 0).select((mean * strength).alias("a"), strength.alias("s"))
    # the prior is a single row
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("s"))).alias("shrunk_rate"),
    ).withColumn("host_rejected", F.col("shrunk_rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per input row: doc_id, host, the metrics, base_failed, shrunk_rate, kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_metrics(F.col(text_col)).alias("m"))
    judged = materialize(rows.select("doc_id", "host", "m.*", base_failed(F.col("m")).alias("base_failed")), "quality")
    hosts = host_verdicts(judged.select("host", F.col("base_failed").alias("failed")), max_rate)
    hosts = hosts.select(F.col("host").alias("its_host"), "shrunk_rate", "host_rejected")
    joined = judged.join(hosts, judged["host"].eqNullSafe(hosts["its_host"]), "left").drop("its_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host_rejected")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; rules run twice so that texts needn't be shuffled:
    rejected hosts are a table of their own, which Spark sends to the tasks if its size on disk allows it."""
    names = docs.columns
    failed = base_failed(text_metrics(F.col(text_col)))
    hosts = host_verdicts(docs.select(F.col(host_col).alias("host"), failed.alias("failed")), max_rate)
    hosts = materialize(hosts.filter("host_rejected").select(F.col("host").alias("__rejected_host")), "rejected-hosts")
    passed = docs.withColumn("__failed", failed).filter(~F.col("__failed"))
    left = passed.join(hosts, passed[host_col].eqNullSafe(hosts["__rejected_host"]), "left_anti")
    return left.select(*names)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", F.round("shrunk_rate", 6).alias("host_rate"))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), base AS (
  SELECT words.doc_id, source AS host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM judged GROUP BY host
), moments AS (
  SELECT sum(n) AS n, sum(x) AS x, count(*) AS k, sum(x / n * x) AS xx, sum(x) / sum(n) AS m FROM hosts
), spread AS (
  SELECT *, greatest(xx / n - m * m - m * (1 - m) * k / n, 0) AS v FROM moments
), prior AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE n / k END AS s FROM spread
), rates AS (
  SELECT host, (x + m * s) / (n + s) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.6 AS kept,
       judged.host, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.host IS NOT DISTINCT FROM rates.host
"""
