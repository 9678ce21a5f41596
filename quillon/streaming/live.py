"""Live views as Structured Streaming queries: sessions of activity, chunk totals, and appended segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.timeline import number_segments


def as_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def speech_sessions(df: DataFrame, key: str, at: str, pause: str, late: str) -> DataFrame:
    """T01's hangover as a session window: stretches of ``key`` whose rows are at most ``pause`` apart."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    out = rows.groupBy(key, F.session_window(at, pause)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def chunk_totals(df: DataFrame, key: str, at: str, length: str, value: str, late: str) -> DataFrame:
    """K10 as a tumbling window."""
    rows = df.withWatermark(at, late) if df.isStreaming else df
    out = rows.groupBy(key, F.window(at, length)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("window.start").alias("start"), "n", "total")


def segment_writer(path: str):
    """Writes a micro-batch to a folder of its own; one that is played again replaces it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def append_segments(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is appended to the partial transcript at ``path``."""
    return df.writeStream.foreachBatch(segment_writer(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "20 seconds"})).start()


def live_view(segments: DataFrame, session: str) -> DataFrame:
    """What has arrived so far, numbered in time order, worker first where times are equal."""
    return number_segments(segments, [session], ["start", F.when(F.col("speaker") == "worker", 0).otherwise(1), "text"])
