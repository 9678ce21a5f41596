"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts of up to ``chunk_chars`` characters are one chunk and are encoded where they are read. Longer
texts are cut into chunks of ``chunk_chars`` with ``overlap`` more characters of the next chunk; the
chunks are pre-tokenised in parallel, neighbours are stitched at the first pre-token boundary that
both found inside their overlap (from a common boundary on, both see the same pre-tokens), and the
pieces between the stitches are encoded in parallel and put together in order. A text whose chunks
find no common boundary (one pre-token longer than the overlap) is encoded in one piece.

Nulls: a null text is an empty text and has no ids. A null id stays null. Repeated rows give repeated
results. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.unit_cache import UnitCache
from quillon.storage import read_table

CHUNK_CHARS, OVERLAP = 32_768, 1_024
#: A match that ends this close to a chunk's end may be cut short (contractions look ahead).
MARGIN = 8
#: Rows handed back to Spark at a time.
OUT_BYTES = 2_000_000


def load_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of each id; ids that the file leaves free have none."""
    ranks = load_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, UnitCache]:
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    one = enc.encode_ordinary
    return enc, UnitCache(
        lambda units: [np.array(one(f" {u}"), "<u4").tobytes() for u in units], lambda texts: [np.array(one(t), "<u4").tobytes() for t in texts], 32_000_000
    )


def _parts(batch: pa.RecordBatch, column: str, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 64
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1
        yield batch.slice(at, end - at)
        at = end


def _slices(batch: pa.RecordBatch, column: str, most: int = OUT_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of about ``most`` bytes of text each, with the column's values."""
    for part in _parts(batch, column, most):
        yield part, part.column(column).to_pylist()


def _raw(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode_rows(df: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``df`` has a string column ``text``; it is replaced by ``n_tokens`` and ``ids`` (little-endian uint32), and with
    ``decoded`` by the ``bytes`` that ``decode`` makes of them, in the same pass."""
    keys = [f for f in df.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["n_tokens bigint", "ids binary"] + ["bytes binary"] * decoded)

    def run(batches):
        (_, cache), table = encoding(ranks_path, pattern), token_bytes(ranks_path) if decoded else []
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                ids = cache.encode_many([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in keys] + [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())] + ([pa.array([_raw(x, table) for x in ids], pa.binary())] if decoded else []),
                    names=[f.name for f in keys] + ["n_tokens", "ids"] + ["bytes"] * decoded,
                )

    return df.mapInArrow(run, schema)


def chunked(df: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """Rows (doc_id, h, n_rows, text) to overlapping chunks (doc_id, h, n_rows, chunk, start, text)."""

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                rows = part.select(["doc_id", "h", "n_rows"]).to_pylist()
                for row, text in zip(rows, texts, strict=True):
                    for k, start in enumerate(range(0, len(text), chunk_chars)):
                        yield pa.RecordBatch.from_pylist(
                            [row | {"chunk": k, "start": start, "text": text[start : start + chunk_chars + overlap]}],
                            pa.schema([part.schema.field("doc_id"), ("h", pa.string()), ("n_rows", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("text", pa.string())]),
                        )

    return df.mapInArrow(run, "doc_id bigint, h string, n_rows bigint, chunk bigint, start bigint, text string")


def boundaries(df: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Adds the chunk's pre-token starts inside its first ``overlap`` characters (left) and the trusted
    ones inside its last ``overlap`` characters (right), both as positions in the whole text."""

    def run(batches):
        find = regex.compile(pattern).finditer
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                left, right = [], []
                for start, text in zip(part.column("start").to_pylist(), texts, strict=True):
                    at = np.fromiter((m.start() for m in find(text)), np.int64)
                    left.append(at[at < overlap] + start)
                    right.append(at[(at >= chunk_chars) & (at <= len(text) - MARGIN)] + start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                    names=[*part.schema.names, "left", "right"],
                )

    return df.mapInArrow(run, "doc_id bigint, h string, n_rows bigint, chunk bigint, start bigint, text string, left array<bigint>, right array<bigint>")


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (binary: little-endian uint32, in text order), and with ``decoded``
    the ``bytes`` that ``decode`` makes of them."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars
    short = encode_rows(rows.filter(~is_long), ranks_path, pattern, decoded)
    long = rows.filter(is_long).withColumn("h", F.sha2("text", 256))
    # equal long rows are encoded once and repeated at the end, so that (doc_id, h) names a text
    long = long.groupBy("doc_id", "h").agg(F.count("*").alias("n_rows"), F.first("text").alias("text"))
    parts = boundaries(chunked(long, chunk_chars, overlap).repartition("doc_id", "h", "chunk"), pattern, chunk_chars, overlap)
    order = Window.partitionBy("doc_id", "h").orderBy("chunk")
    whole = Window.partitionBy("doc_id", "h")
    met = F.array_min(F.array_intersect(F.lag("right").over(order), F.col("left")))
    parts = parts.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0).cast("bigint")).otherwise(met))
    parts = parts.withColumn("until", F.lead("cut").over(order)).withColumn("torn", F.max(F.col("cut").isNull()).over(whole))
    pieces = parts.filter(~F.col("torn")).select(
        "doc_id", "h", "n_rows", "chunk",
        F.expr("substring(text, int(cut - start + 1), int(coalesce(until, start + length(text)) - cut))").alias("text"),
    )
    # no common boundary in some overlap: the text is put together again and encoded in one piece
    torn = parts.filter("torn").groupBy("doc_id", "h", "n_rows").agg(
        F.array_sort(F.collect_list(F.struct("chunk", F.col("text").substr(1, chunk_chars).alias("text")))).alias("all")
    )
    torn = torn.select("doc_id", "h", "n_rows", F.lit(0).cast("bigint").alias("chunk"), F.expr("array_join(transform(all, x -> x.text), '')").alias("text"))
    spread = pieces.unionByName(torn).repartition("doc_id", "h", "chunk")
    done = encode_rows(spread, ranks_path, pattern).groupBy("doc_id", "h", "n_rows").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all")
    )
    done = done.select(
        F.explode(F.expr("array_repeat(doc_id, int(n_rows))")).alias("doc_id"), "n_tokens",
        F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
    )
    return short.unionByName(decode(done, ranks_path) if decoded else done)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``bytes``: the raw bytes of all ids, one after the other (they need not be valid UTF-8)."""
    names = [f.name for f in encoded.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["bytes binary"])

    def run(batches):
        table = token_bytes(ranks_path)
        for batch in batches:
            for part, ids in _slices(batch, "ids"):
                raw = [_raw(np.frombuffer(x or b"", "<u4"), table) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "bytes"])

    return encoded.mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = encode(docs, ranks, pattern, decoded=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
