"""Benchmark decontamination by spaced seeds.

Words (runs of letters, digits and underscores, lower case) of documents and benchmark items are hashed
under fixed masks; the positions a mask leaves out may differ. Equal hashes give hits, a hit a diagonal
(where the item would start in the document), and along each diagonal the words are compared: an item
is found where some window of ``WINDOW`` words (the whole item if it is shorter) agrees in at least 80
per cent of its words. The masks hit every such window, wherever its differing words stand; items of
fewer than eight words have masks of their own, which are used only if there are such items.

The documents are read once for the hits: a Bloom filter of the items' hashes, of at most
``MOST_FILTER_BITS`` bits whatever the benchmark's size, lets through the few places worth joining
(more of them where the benchmark is too large for the filter, none too few). What passes is joined with
the items' hashes; texts with hits meet their items in a second join and are compared there. Texts
without hits aren't shuffled.

Nulls: a null text has no words; null ids of documents stay null, items without id or text are ignored.
Repeated documents give repeated rows, repeated items (one id and text) count once; of several texts with
one item id the best overlap counts. Empty tables give empty results. Other columns may have any names
that don't begin with two underscores.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import _slices
from quillon.storage import materialize, read_table

#: Fixed masks: 1 counts, 0 is ignored. The first are for items of eight words and more.
MASKS = ("11111", "111011", "11010011")
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("111",), 5: ("111", "1101"), 6: ("111", "1101"), 7: ("111", "1101")}
WINDOW, MAX_DIFFER_PCT = 13, 20
WORD = re.compile(r"\w+")
#: Bits of the filter for each hash, bits set by each hash, and the most bits of the filter (64 MB).
BITS_PER_SEED, PROBES, MOST_FILTER_BITS = 64, 4, 1 << 29
PAGE_BITS = 1 << 15


def masks_for(n_words: int) -> tuple[str, ...]:
    return SHORT_MASKS.get(n_words, MASKS) if n_words else ()


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _WordHashes(dict):
    """A 64-bit hash for each word; the words met last are remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 60_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return found


HASHES = _WordHashes()


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash at each position where the mask fits; masks have hashes of their own."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out ^= words[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def probe(seeds: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The ``k``-th place of the filter that each hash sets; ``bits`` is a power of two."""
    return seeds + (seeds >> np.uint64(32) | np.uint64(1)) * np.uint64(k) & np.uint64(bits - 1)


def passing(seeds: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter lets through."""
    at = np.arange(len(seeds))
    for k in range(PROBES):
        place = probe(seeds[at] if k else seeds, 8 * len(filter_), k)
        at = at[(filter_[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return at


def overlap(words: list[str], item: list[str], diagonals: list[int]) -> tuple[int, int, int] | None:
    """The best overlap on the diagonals: (its equal words, minus its first word in the document, its words)."""
    best = None
    for diagonal in diagonals:
        low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
        window = min(WINDOW, len(item))
        if high - low < window:
            continue
        equal = np.fromiter((a == b for a, b in zip(item[low:high], words[low + diagonal : high + diagonal], strict=True)), bool, high - low)
        sums = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero(100 * (window - (sums[window:] - sums[:-window])) <= MAX_DIFFER_PCT * window)
        if not len(good):
            continue
        covered = np.zeros(len(equal) + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + window, -1)
        inside = np.cumsum(covered)[:-1] > 0
        row = (int((equal & inside).sum()), -int(low + diagonal + good[0]), int(inside.sum()))
        best = row if best is None else max(best, row)
    return best


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items: item (a key), item_id, item_text."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("item_text")).filter("item_id is not null and item_text is not null")
    return items.distinct().withColumn("item", F.sha2(F.concat_ws(":", "item_id", "item_text"), 256))


def _item_seeds(items: DataFrame) -> DataFrame:
    """One row for each hash of each item: mask, seed, item, at."""

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, "item_text"):
                rows = []
                for item, text in zip(part.column("item").to_pylist(), texts, strict=True):
                    words = words_of(text)
                    hashes = word_hashes(words)
                    rows += [(mask, s, item, k) for mask in masks_for(len(words)) for k, s in enumerate(seed_hashes(hashes, mask).view(np.int64).tolist())]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["mask", "seed", "item", "at"])

    return items.mapInArrow(run, "mask string, seed bigint, item string, at bigint")


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter, put together from pages that Spark builds."""
    wanted = BITS_PER_SEED * seeds.select("seed").distinct().count()
    bits = min(MOST_FILTER_BITS, max(8 * PAGE_BITS, 1 << int(wanted).bit_length()))

    def run(batches):
        for batch in batches:
            places = np.concatenate([probe(batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64), bits, k) for k in range(PROBES)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places // PAGE_BITS), pa.array(places % PAGE_BITS)], names=["page", "bit"])

    pages = seeds.select("seed").mapInArrow(run, "page bigint, bit bigint").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for page, raw in pages.collect():
        out[page * PAGE_BITS // 8 : (page + 1) * PAGE_BITS // 8] = np.frombuffer(raw, np.uint8)
    return out


def _verified(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """From texts (text) to one row for each distinct text and item found in it: h (SHA-256 of the text, hex),
    item_id, n_equal, first_word, n_words."""
    spark = texts.sparkSession
    items = materialize(_items(benchmark, item_col, item_text_col), "items")
    seeds = materialize(_item_seeds(items), "item-seeds")
    masks = sorted(r.mask for r in seeds.select("mask").distinct().collect())  # of a fixed few
    shared = spark.sparkContext.broadcast(_filter_of(seeds))

    def candidates(batches):
        filter_, seen = shared.value, set()
        for batch in batches:
            for _, texts in _slices(batch, "text"):
                words = [words_of(t) for t in texts]
                ends = np.cumsum([len(w) for w in words])
                begins = ends - [len(w) for w in words]
                hashes, hits = word_hashes(chain.from_iterable(words)), {}
                for mask in masks:
                    own = seed_hashes(hashes, mask)
                    at = passing(own, filter_)
                    doc = np.searchsorted(ends, at, "right")
                    inside = at + len(mask) <= ends[doc]  # texts follow each other without a gap
                    doc, at = doc[inside], at[inside]
                    for d, s, p in zip(doc.tolist(), own[at].view(np.int64).tolist(), (at - begins[doc]).tolist(), strict=True):
                        hits.setdefault(d, []).append((s, p))
                rows = []
                for d, found in hits.items():
                    h = hashlib.sha256(texts[d].encode()).hexdigest()
                    if h not in seen:
                        seen.add(h)
                        rows.append((h, texts[d], [s for s, _ in found], [p for _, p in found]))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "text", "seeds", "at"])

    found = materialize(texts.select("text").mapInArrow(candidates, "h string, text string, seeds array<bigint>, at array<bigint>"), "candidates")
    hits = found.select("h", F.explode(F.arrays_zip("seeds", F.col("at").alias("place"))).alias("x")).select("h", F.col("x.seeds").alias("seed"), F.col("x.place").alias("place"))
    pairs = hits.join(seeds.select("seed", "item", "at"), "seed").groupBy("h", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("diagonals"))
    pairs = pairs.join(items, "item").join(found.select("h", "text").dropDuplicates(["h"]), "h")

    def compare(batches):
        last, words = None, []
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                h, item_id, item, diagonals = (part.column(c).to_pylist() for c in ("h", "item_id", "item_text", "diagonals"))
                rows = []
                for k, text in enumerate(texts):
                    if h[k] != last:
                        last, words = h[k], words_of(text)
                    best = overlap(words, words_of(item[k]), diagonals[k])
                    if best:
                        rows.append((h[k], item_id[k], best[0], -best[1], best[2]))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=["h", "item_id", "n_equal", "first_word", "n_words"])

    rows = pairs.select("h", "text", "item_id", "item_text", "diagonals").mapInArrow(compare, "h string, item_id bigint, n_equal bigint, first_word bigint, n_words bigint")
    best = rows.groupBy("h", "item_id").agg(F.max(F.struct("n_equal", (-F.col("first_word")).alias("minus_first"), "n_words")).alias("x"))
    return materialize(best.select("h", "item_id", "x.n_equal", (-F.col("x.minus_first")).alias("first_word"), "x.n_words"), "contaminated")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, first_word, n_words, n_equal."""
    found = _verified(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(text_col, 256).alias("h"))
    return rows.join(found, "h").select("doc_id", "item_id", "first_word", "n_words", "n_equal")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns."""
    found = _verified(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col)
    dirty = found.select(F.col("h").alias("__h")).distinct()
    return docs.withColumn("__text", F.sha2(text_col, 256)).join(dirty, F.col("__text") == F.col("__h"), "left_anti").drop("__text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, read_table(spark, sf_dir, "benchmark"))
