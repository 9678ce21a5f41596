"""Corpus pipeline over ``documents``: the stages in order, each working on all its predecessor kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Between the
stages the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import encode
from quillon.llm.decontaminate import keep_clean
from quillon.llm.host_rules import keep_good
from quillon.llm.simhash import keep_one
from quillon.llm.suffix_dedup import remove_repeats
from quillon.storage import materialize, read_table, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the page rules, or whose host is rejected, go."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar five-word shingles (0.8 or more) the one with the least id stays."""
    return keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has go; texts and lengths are what is left."""
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left (little-endian uint32), and the digest of the bytes they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(docs, ranks, pattern, decoded=True).select("doc_id", "n_tokens", "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level bpe", byte_level_bpe),
]

#: SQL can't express SimHash anchors, suffix order or byte-pair merges; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
            release(before)
    return docs
