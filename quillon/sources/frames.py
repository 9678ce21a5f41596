"""Files of frames that begin with their length, as a crash may leave them: with a torn frame at the end."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_ranges(content: bytes) -> list[tuple[int, int]]:
    """(first byte, byte after the last) of each whole frame; lengths are four big-endian bytes."""
    out, at = [], 0
    while at + 4 <= len(content):
        length = int.from_bytes(content[at : at + 4], "big")
        if length == 0 or at + 4 + length > len(content):
            break
        out.append((at + 4, at + 4 + length))
        at += 4 + length
    return out


def read_frames(files: DataFrame, key: str, content: str) -> DataFrame:
    """Key, frame_no, frame, and valid_bytes, how far the file is whole. A file is one cell, so it has to fit
    into a task; null and empty files have no frames."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column(content)[k].as_py() or b""
                ranges = frame_ranges(raw)
                if ranges:
                    keys = pa.concat_arrays([batch.column(key).slice(k, 1)] * len(ranges))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(range(len(ranges)), pa.int64()), pa.array([raw[a:b] for a, b in ranges], pa.binary()), pa.array([ranges[-1][1]] * len(ranges), pa.int64())],
                        names=[key, "frame_no", "frame", "valid_bytes"],
                    )

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, frame_no bigint, frame binary, valid_bytes bigint")


def samples_between(chunks: DataFrame, low: float, high: float, rate: int) -> DataFrame:
    """Chunks (start, samples) cut to the samples between two times; chunks outside are left out."""
    n = F.size("samples")
    first = F.greatest(F.lit(0), F.floor((F.lit(low) - F.col("start")) * rate)).cast("int")
    last = F.least(n, F.ceil((F.lit(high) - F.col("start")) * rate).cast("int"))
    return chunks.filter(last > first).withColumn("samples", F.slice("samples", first + 1, last - first))
