"""Token ids as ORC files: run-length encoded ids, row indexes, and Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded in that order and written by Spark's ORC
writer: integer columns are run-length encoded in stripes, each stripe carries a row index (minimum,
maximum and positions for every ``INDEX_STRIDE`` rows) and a Bloom filter on ``doc_id``, so readers
split a file by stripes and a filter on ``doc_id`` skips stripes and row groups from metadata alone.

Strings of the vocabulary's added tokens are those tokens wherever the library, called on the whole text, says so.

Nulls: a null text has no ids but its end id. Null ids come first in the order. Rows with equal ids are
ordered by their text's hash and are documents of their own. Empty tables give empty files and results.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.byte_bpe import _slices
from quillon.llm.unit_cache import UNEVEN, cut
from quillon.storage import materialize, new_path, read_table

END_ID = 2
INDEX_STRIDE = 1_000
STRIPE_BYTES = 64 << 20
SCHEMA = "part int, seq bigint, doc_id bigint, n_tokens bigint, ids array<int>"
#: Units joined to one text for the library, and such texts in one call.
JOINED, AT_ONCE = 300, 40
#: Bytes of text encoded at a time.
SLICE_BYTES = 8_000_000
#: White space of any kind at the end.
ENDS_IN_SPACE = UNEVEN.removesuffix(" ") + r"\z"
#: Characters whose classes don't change with the version of Unicode; other units are cut by the library.
LATIN = re.compile("[\x00-\u024f]*")


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, others as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


SPELLED = byte_characters()


def load(tokenizer_path: str) -> Tokenizer:
    return Tokenizer.from_file(tokenizer_path)


class Encoder:
    """Ids of whole texts. Where the file has a byte-level pre-tokeniser and no normaliser, texts are cut into units, and
    each distinct unit is encoded by the library once, many of them joined to one text; texts that hold the string of an
    added token, and all texts of other files, are handed to the library as they are."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = load(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        self.cuttable = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.n_bytes = np.array([len(self.whole.id_to_token(i) or "") for i in range(self.whole.get_vocab_size())], np.int64)

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_spaced(self, units: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct units with a space put before each. Units that end in a non-space character are joined; the
        joined text is cut at the same places again, so its ids are the units' ids, and end where their bytes end."""
        alone = pc.or_(pc.equal(pc.binary_length(units), 0), pc.match_substring_regex(units, ENDS_IN_SPACE)).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        given, n, ids = units.take(pa.array(order)).to_pylist(), int((~alone).sum()), [np.zeros(0, "<u4")]
        texts = [" " + " ".join(given[at : min(at + JOINED, n)]) for at in range(0, n, JOINED)] + [f" {u}" for u in given[n:]]
        for at in range(0, len(texts), AT_ONCE):
            ids.append(np.fromiter(chain.from_iterable([e.ids for e in self.whole.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]), "<u4"))
        flat = np.concatenate(ids)
        sizes = pc.binary_length(units).to_numpy().astype(np.int64)[order] + 1
        ends = np.searchsorted(np.cumsum(self.n_bytes[flat]), np.cumsum(sizes)) + 1
        offsets = 4 * np.concatenate([[0], ends])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return found.take(pa.array(place))

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Texts without added tokens, as units: each distinct one is encoded once for all of them."""
        if not texts:
            return []
        units, begins = cut(texts)
        is_first = np.zeros(len(units), bool)
        is_first[begins] = True
        rest = pc.if_else(pa.array(is_first), pa.scalar(None, pa.string()), units).dictionary_encode()
        firsts = self.encode_whole(units.take(pa.array(begins)).to_pylist())  # no space stands before these
        pool = pa.concat_arrays([self.encode_spaced(rest.dictionary), pa.array(firsts, pa.large_binary())])
        code = rest.indices.fill_null(0).to_numpy().copy()
        code[begins] = len(rest.dictionary) + np.arange(len(texts), dtype=code.dtype)
        joined = pool.take(pa.array(code))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :] // 4
        flat = np.frombuffer(joined.buffers()[2] or b"", "<u4")
        ends = np.append(offsets[begins[1:]], offsets[len(joined)])
        return [flat[a:b] for a, b in zip([offsets[0], *ends[:-1]], ends, strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        array, special = pa.array(texts, pa.string()), np.full(len(texts), not self.cuttable)
        for content in self.added:
            special |= pc.match_substring(array, content).to_numpy(zero_copy_only=False)
        plain = iter(self.encode_plain([t for t, s in zip(texts, special, strict=True) if not s]))
        whole = iter(self.encode_whole([t for t, s in zip(texts, special, strict=True) if s]))
        return [np.frombuffer(next(whole), "<u4") if s else next(plain) for s in special]


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str) -> Encoder:
    return Encoder(tokenizer_path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes rows (part, seq, doc_id, n_tokens, ids), ascending by doc_id: part numbers the range of ids a
    file holds, seq the rows of a part."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    n_parts = max(rows.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def run(batches):
        cache, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece, texts in _slices(batch, "text", SLICE_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in cache.encode_many([t or "" for t in texts])]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(seq, seq + len(ids))), piece.column("doc_id"), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
                    ],
                    names=["part", "seq", "doc_id", "n_tokens", "ids"],
                )
                seq += len(ids)

    ranged.mapInArrow(run, SCHEMA).write.options(
        **{
            "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true",
            "orc.row.index.stride": str(INDEX_STRIDE), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(stored: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all rows before, in the order of the files."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each file of the store
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    numbered = stored.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return numbered.join(totals, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def checksums(stored: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            at = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "seq", "doc_id", "n_tokens")] + [pa.array(sums, pa.int64())], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "part int, seq bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-orc")
    write(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = materialize(checksums(read(spark, path)), "token-sums")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
