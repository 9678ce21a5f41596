"""Audit logs: JSON lines whose entries are chained by digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["details", "event", "hash", "prev", "seq", "session", "time"]
SCHEMA = "details map<string,string>, event string, hash string, prev string, seq bigint, session string, time string"
#: Fixed value: what the first entry follows.
GENESIS = "0" * 64
#: Where the chain puts the digest before and the place.
_PREV, _SEQ = "prev", -1


def canonical(entry: Column) -> Column:
    """An entry as JSON with sorted keys and an empty hash; ``details`` has its keys in order."""
    details = F.map_from_entries(F.array_sort(F.map_entries(entry["details"])))
    return F.to_json(F.struct(*[(details if c == "details" else F.lit("") if c == "hash" else entry[c]).alias(c) for c in FIELDS]), {"ignoreNullFields": "false"})


def digest(entry: Column) -> Column:
    """R15."""
    return F.sha2(canonical(entry), 256)


def write_entries(rows: DataFrame, path: str, order: str) -> None:
    """Rows (session, time, event, details) chained inside each session in ``order``, as JSON lines in a folder for
    each session. Sessions are dealt to partitions and read row by row. The text of an entry is made by the same
    expression that ``verify`` digests, with room left for what only the chain knows: the digest before and the place."""
    entry = F.struct("details", "event", F.lit("").alias("hash"), F.lit(_PREV).alias("prev"), F.lit(_SEQ).alias("seq"), "session", "time")
    dealt = rows.select("session", canonical(entry).alias("body"), F.col(order).alias("o")).repartition("session").sortWithinPartitions("session", "o")

    def run(batches):
        last, seq, prev = None, 0, GENESIS
        for batch in batches:
            sessions, lines = batch.column("session").to_pylist(), []
            for session, text in zip(sessions, batch.column("body").to_pylist(), strict=True):
                if session != last:
                    last, seq, prev = session, 0, GENESIS
                seq += 1
                # the marks stand between keys that can't be in a string, where quotes are escaped
                head, rest = text.split(f'"hash":"","prev":"{_PREV}","seq":{_SEQ},', 1)
                filled = lambda own: f'{head}"hash":"{own}","prev":"{prev}","seq":{seq},{rest}'  # noqa: B023, E731
                digest_ = hashlib.sha256(filled("").encode()).hexdigest()
                lines.append(filled(digest_))
                prev = digest_
            yield pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()), pa.array(lines, pa.string())], names=["folder", "value"])

    dealt.mapInArrow(run, "folder string, value string").write.partitionBy("folder").text(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all logs below ``path``; a line that is no entry has a null seq."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(path)


def verify(log: DataFrame) -> DataFrame:
    """For each session how many entries there are, and where and why the chain breaks first (null: nowhere)."""
    w = Window.partitionBy("session").orderBy("seq")
    place = F.row_number().over(w).cast("bigint")
    entry = F.struct(*FIELDS)
    reason = (
        F.when(F.col("seq").isNull(), "unreadable line").when(F.col("seq") != F.col("place"), "sequence gap")
        .when(F.col("prev") != F.col("before"), "doesn't follow the previous entry").when(F.col("hash") != digest(entry), "contents changed")
    )
    rows = log.withColumn("place", place).withColumn("before", F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))).withColumn("why", reason)
    broken = F.min(F.when(F.col("why").isNotNull(), F.struct("place", F.col("seq").alias("at"), "why")))
    out = rows.groupBy("session").agg(F.count("*").alias("entries"), broken.alias("x"))
    at = F.when(F.col("x.why").isin("sequence gap", "unreadable line"), F.col("x.place")).otherwise(F.col("x.at"))
    return out.select("session", "entries", at.alias("broken_at"), F.col("x.why").alias("reason"))
