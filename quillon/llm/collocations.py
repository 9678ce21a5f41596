"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A phrase is a run of 2 to ``LONGEST`` words inside a piece of text (between marks and line ends). Its score is how often
it comes against how often its two parts come, at the cut where that is least.

1. Words are counted by language. Only words with ``least`` occurrences can be in a candidate; a Bloom filter of them
   lets all such words through, and few others.
2. Pairs of such words are counted by a 46-bit slot, each task's counts added up first. Slots can only gather more than
   one pair's occurrences, so the filter of slots with ``least`` occurrences misses no frequent pair.
3. Suffixes that begin with such a pair are routed by their first two words, cut where the next pair can't be frequent;
   equal ones of a task travel as one with a weight. Where they meet, pointers to them are sorted by multikey three-way
   quicksort: a pivot at the depth reached parts them into less, equal and greater, the equal ones go on at the next
   word, the size of an equal part is the phrase's count, and parts below ``least`` are abandoned. All parts of a bucket
   are split at once, a round at a time. Pairs that hold 1 / ``HOT_PAIRS`` of all words (there are at most so many)
   are routed by all of their words and their counts added up.
4. Counts of parts, longer candidates and words' texts are joined to the candidates; ranks are numbered in range
   partitions.

Words are named by 64-bit hashes of language and word. If a frequent word shares its name with any other word, all is
done again with another seed, so counts are exact. Scores are computed as decimals.

Nulls: a null text is empty, a null language is ``und``. Repeated rows count each time. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import _parts
from quillon.llm.decontaminate import _filter_of, passing
from quillon.llm.token_alignment import _merged, mixed
from quillon.storage import materialize, read_table, release

LEAST, LONGEST, TOP = 30, 4, 2000
#: A longer phrase with this many per cent of a candidate's occurrences takes its place.
COVERED_PCT = 80
HOT_PAIRS = 1000
#: Bytes of text split at a time, slots and suffixes a task holds before it hands them on, words of a bucket.
SLICE_BYTES, MOST_HELD, BUCKET_WORDS, LEAST_BUCKETS = 3_000_000, 1_000_000, 2_000_000, 128
SLOT_BITS = 40
#: Bytes: 0 is in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Words:
    """The words of some texts in order: ``coded`` (dictionary array), ``text`` (row of each), ``follows`` (whether the
    word before is in the same piece)."""

    def __init__(self, texts: pa.StringArray):
        array = pc.ascii_lower(pc.fill_null(texts, ""))
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KINDS[data]
        inside = kind == 0
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        before[offsets[offsets < len(data)]] = False
        after[offsets[offsets > 0] - 1] = False
        begins = np.flatnonzero(inside & ~before)
        sizes = np.flatnonzero(inside & ~after) + 1 - begins
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[inside].tobytes()))
        self.coded = words.dictionary_encode()
        self.text = np.searchsorted(offsets, begins, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), begins)
        self.follows = np.zeros(len(begins), bool)
        self.follows[1:] = (np.diff(piece) == 0) & (np.diff(self.text) == 0)


def _named(part: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray, np.ndarray, pa.StringArray]:
    """The words of a part (lang, text), the name of each, the language of each as a number, and the languages."""
    words = Words(part.column("text"))
    langs = part.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy()[words.text]
    of_lang = np.array([xxhash.xxh64_intdigest(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
    of_word = np.array([xxhash.xxh64_intdigest(x, seed) for x in words.coded.dictionary.to_pylist()], np.uint64)
    names = mixed(of_word[words.coded.indices.to_numpy()] ^ mixed(of_lang, 1)[lang], 2) if len(lang) else np.zeros(0, np.uint64)
    names[names == 0] = 1  # 0 stands for no word
    return words, names, lang, langs.dictionary


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, text) to a row for each word of a language: lang, word, name, n."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "text", SLICE_BYTES):
                words, names, lang, langs = _named(part, seed)
                width = max(1, len(words.coded.dictionary))
                key, first, n = np.unique(lang.astype(np.int64) * width + words.coded.indices.to_numpy(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(key // width)), words.coded.dictionary.take(pa.array(key % width)), pa.array(names[first].view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "word", "name", "n"],
                )

    counts = docs.mapInArrow(run, "lang string, word string, name bigint, n bigint")
    return counts.groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def pair_slots(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """A pair's slot: its bucket above ``SLOT_BITS`` bits."""
    h = mixed(mixed(first, 3) ^ second, 4)
    return (h >> np.uint64(SLOT_BITS)) % np.uint64(buckets) << np.uint64(SLOT_BITS) | h & np.uint64((1 << SLOT_BITS) - 1)


def _grouped(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]) if len(found) else [], strict=True)


def _pairs(names: np.ndarray, follows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Positions whose word and the next of the same piece both pass the filter of frequent words."""
    frequent = np.zeros(len(names), bool)
    frequent[passing(names, words)] = True
    return np.flatnonzero(frequent[:-1] & frequent[1:] & follows[1:])


def pair_counts(docs: DataFrame, seed: int, words, buckets: int, least: int) -> DataFrame:
    """(lang, text) to slots of pairs with at least ``least`` occurrences: slot, seed (what the filter knows it by), n."""
    low = np.uint64((1 << SLOT_BITS) - 1)

    def packed(slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = {"bucket": [], "low": [], "high": [], "n": []}
        for b, some in _grouped((slots >> np.uint64(SLOT_BITS)).astype(np.int64)):
            key = slots[some] & low
            rows["bucket"].append(b)
            rows["low"].append((key & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
            rows["high"].append((key >> np.uint64(32)).astype("u1").tobytes())
            rows["n"].append(n[some].astype("<i8").tobytes())
        return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("low", "high", "n")]]))

    def run(batches):
        held, size, filter_ = [], 0, words.value
        for batch in batches:
            for part in _parts(batch, "text", SLICE_BYTES):
                found, names, _, _ = _named(part, seed)
                at = _pairs(names, found.follows, filter_)
                held.append(np.unique(pair_slots(names[at], names[at + 1], buckets), return_counts=True))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    yield packed(*_merged(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield packed(*_merged(*map(np.concatenate, zip(*held, strict=True))))
        pa.default_memory_pool().release_unused()

    def add(table):
        joined = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
        key = joined("low", "<u4").astype(np.uint64) | joined("high", "u1").astype(np.uint64) << np.uint64(32)
        key, n = _merged(key, joined("n", "<i8"))
        key, n = key[n >= least] | np.uint64(table.column("bucket")[0].as_py() << SLOT_BITS), n[n >= least]
        return pa.Table.from_pydict({"slot": pa.array(key.view(np.int64)), "seed": pa.array(mixed(key, 0).view(np.int64)), "n": pa.array(n)})

    return docs.mapInArrow(run, "bucket bigint, low binary, high binary, n binary").groupBy("bucket").applyInArrow(add, "slot bigint, seed bigint, n bigint")


def multikey_counts(names: np.ndarray, weights: np.ndarray, least: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of suffixes (rows of word names, 0 where they end) the prefixes that weigh ``least[depth]`` at least: for each
    depth from 1 on the prefixes and their weights. Rounds of three-way partitions of pointers, all parts at once."""
    depth_most, out = names.shape[1], [([], []) for _ in range(names.shape[1])]
    order = np.arange(len(names))
    begins, depth = np.zeros(min(1, len(names)), np.int64), np.zeros(min(1, len(names)), np.int64)
    while len(begins):
        sizes = np.diff(np.append(begins, len(order)))
        part = np.repeat(np.arange(len(begins)), sizes)
        key = names[order, depth[part]]
        pivot = key[begins + sizes // 2]
        side = np.where(key < pivot[part], 0, np.where(key == pivot[part], 1, 2)) + 3 * part
        # where each of less, equal and greater begins, and each pointer's place there
        counts = np.bincount(side, minlength=3 * len(begins))
        at = np.cumsum(counts) - counts
        moved = np.empty_like(order)
        for k in range(3):
            mine = np.flatnonzero(side % 3 == k)
            run = np.arange(len(mine)) - np.searchsorted(side[mine], side[mine])
            moved[at[side[mine]] + run] = order[mine]
        weight = np.bincount(side, weights[order], minlength=3 * len(begins)).astype(np.int64)
        to = np.repeat(depth, 3) + np.tile([0, 1, 0], len(begins))
        equal = np.tile([False, True, False], len(begins))
        wanted = (counts > 0) & (weight >= np.array(least)[np.minimum(to + ~equal, depth_most) - 1])
        wanted &= ~(equal & (np.repeat(pivot, 3) == 0))
        for d in range(1, depth_most + 1):
            hit = np.flatnonzero(wanted & equal & (to == d))
            if len(hit):
                out[d - 1][0].append(names[moved[at[hit]], :d])
                out[d - 1][1].append(weight[hit])
        wanted &= to < depth_most
        kept = np.flatnonzero(wanted)
        order = moved[np.repeat(wanted, counts)]
        depth, begins = to[kept], np.cumsum(counts[kept]) - counts[kept]
    return [(np.concatenate(p) if p else np.zeros((0, d + 1), np.uint64), np.concatenate(w) if w else np.zeros(0, np.int64)) for d, (p, w) in enumerate(out)]


def phrase_counts(docs: DataFrame, seed: int, words, pairs, hot, buckets: int, slot_buckets: int, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, text) to phrases of two words and more with at least ``least`` occurrences: names (array), n."""
    columns = [f"c{k}" for k in range(longest)]

    def packed(rows: list[np.ndarray], weights: list[np.ndarray], hot_slots: np.ndarray) -> pa.RecordBatch:
        names, weight = np.concatenate(rows), np.concatenate(weights)
        slots = pair_slots(names[:, 0], names[:, 1], slot_buckets)
        is_hot = np.isin(slots, hot_slots)
        every = slots.copy()
        for k in range(2, longest):
            every = mixed(every ^ names[:, k], 5 + k)
        bucket = (mixed(np.where(is_hot, every, slots), 5) % np.uint64(buckets)).astype(np.int64)
        out = {"bucket": [], "hot": [], "names": [], "weights": []}
        for b, some in _grouped(2 * bucket + is_hot):
            out["bucket"].append(b // 2)
            out["hot"].append(bool(b % 2))
            out["names"].append(names[some].astype("<u8").T.tobytes())
            out["weights"].append(weight[some].astype("<i8").tobytes())
        return pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("hot", pa.bool_()), ("names", pa.binary()), ("weights", pa.binary())]))

    def run(batches):
        rows, weights, size, word_bits, pair_bits, hot_slots = [], [], 0, words.value, pairs.value, hot.value
        for batch in batches:
            for part in _parts(batch, "text", SLICE_BYTES):
                found, names, _, _ = _named(part, seed)
                at = _pairs(names, found.follows, word_bits)
                at = at[passing(mixed(pair_slots(names[at], names[at + 1], slot_buckets), 0), pair_bits)]
                begins = np.zeros(len(names) + longest, bool)
                begins[at] = True
                # equal suffixes become one: words are numbered in this slice, and numbers of two are one key
                number = np.unique(names, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
                number, name = np.append(number, np.zeros(longest, np.uint64)), np.append(names, np.zeros(longest, np.uint64))
                goes_on, keys, own = np.ones(len(at), bool), [], []
                for k in range(longest):
                    if k > 1:
                        goes_on &= begins[at + k - 1]
                    own.append(np.where(goes_on, name[at + k], 0))
                    keys.append(np.where(goes_on, number[at + k], 0))
                joined = [keys[k] << np.uint64(32) | (keys[k + 1] if k + 1 < longest else np.uint64(0)) for k in range(0, longest, 2)]
                order = np.lexsort(joined)
                new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in joined], axis=0)]) if len(order) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                rows.append(np.stack(own, 1)[order[first]])
                weights.append(np.diff(np.append(first, len(order))))
                size += len(first)
                if size > MOST_HELD // 2:
                    yield packed(rows, weights, hot_slots)
                    rows, weights, size = [], [], 0
        if size:
            yield packed(rows, weights, hot_slots)
        pa.default_memory_pool().release_unused()

    def sort(table):
        names = np.concatenate([np.frombuffer(x.as_py(), "<u8").reshape(longest, -1).T for x in table.column("names")])
        weights = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("weights")])
        # counts of hot pairs are of this bucket only, but for the longest phrases
        enough = [1] * (longest - 1) + [least] if table.column("hot")[0].as_py() else [least] * longest
        found = multikey_counts(names, weights, enough)[1:]
        padded = [np.pad(p, ((0, 0), (0, longest - p.shape[1]))) for p, _ in found]
        whole = np.concatenate(padded).view(np.int64)
        return pa.Table.from_arrays([*[pa.array(np.ascontiguousarray(whole[:, k])) for k in range(longest)], pa.array(np.concatenate([w for _, w in found]))], names=[*columns, "n"])

    schema = ", ".join([*[f"{c} bigint" for c in columns], "n bigint"])
    parts = docs.mapInArrow(run, "bucket bigint, hot boolean, names binary, weights binary").groupBy("bucket", "hot").applyInArrow(sort, schema)
    return parts.groupBy(*columns).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(F.filter(F.array(*columns), lambda x: x != 0).alias("names"), "n")


def ranked(rows: DataFrame, lang: str, order: list, top: int) -> DataFrame:
    """Adds ``rank`` (from 1 in each language) and keeps the first ``top``: rows are sorted in range partitions, whose
    sizes by language give the ranks before them."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = materialize(rows.repartitionByRange(n, F.col(lang), *order).sortWithinPartitions(F.col(lang), *order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    sizes = sorted_.groupBy(lang, part.alias("__part")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    # one row for each language and partition
    before = F.sum("__n").over(Window.partitionBy(lang).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < top)
    out = sorted_.withColumn("__part", part).join(sizes, [lang, "__part"])
    return out.withColumn("rank", F.col("__before") + F.col("__id") - F.col("__first") + 1).filter(F.col("rank") <= top).drop("__id", "__part", "__first", "__n", "__before")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, hot_pairs: int = HOT_PAIRS, seed: int = 1) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = materialize(word_counts(texts, seed), "words")
    # a frequent word must not share its name with another
    while words.groupBy("name").agg(F.count("*").alias("of"), F.max("n").alias("most")).filter((F.col("of") > 1) & (F.col("most") >= least)).limit(1).count():
        release(words)
        seed += 1
        words = materialize(word_counts(texts, seed), "words")
    frequent = materialize(words.filter(F.col("n") >= least), "frequent-words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    total = totals.agg(F.sum("total")).first()[0] or 0
    release(words)
    buckets = max(LEAST_BUCKETS, total // BUCKET_WORDS)
    shared_words = spark.sparkContext.broadcast(_filter_of(frequent.select(F.col("name").alias("seed"))))
    slots = materialize(pair_counts(texts, seed, shared_words, buckets, least), "pair-slots")

    shared_pairs = spark.sparkContext.broadcast(_filter_of(slots.select("seed")))
    hot = spark.sparkContext.broadcast(np.array([r["slot"] for r in slots.filter(F.col("n") * hot_pairs >= total).collect()], np.int64).view(np.uint64))
    phrases = materialize(phrase_counts(texts, seed, shared_words, shared_pairs, hot, buckets, buckets, least), "phrases")
    release(slots)
    counts = phrases.unionByName(frequent.select(F.array("name").alias("names"), "n"))
    cuts = F.expr("transform(sequence(1, size(names) - 1), k -> struct(k, slice(names, 1, k) as first, slice(names, k + 1, size(names) - k) as rest))")
    cut = phrases.select("names", F.col("n").alias("a"), F.explode(cuts).alias("x")).select("names", "a", F.col("x.k").alias("k"), F.col("x.first").alias("first"), F.col("x.rest").alias("rest"))
    cut = cut.join(counts.select(F.col("names").alias("first"), F.col("n").alias("l")), "first").join(counts.select(F.col("names").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr("cast(a as decimal(19, 0)) * cast(2000000 as decimal(7, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = cut.groupBy("names", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("names", "a", "x.l", "x.r", "x.score")
    inner = F.expr("flatten(transform(sequence(2, size(names) - 1), w -> transform(sequence(1, size(names) - w + 1), at -> slice(names, at, w))))")
    covers = phrases.filter(F.size("names") > 2).select(F.explode(inner).alias("names"), "n").groupBy("names").agg(F.max("n").alias("longer"))
    covered = F.coalesce(100 * F.col("longer") >= COVERED_PCT * F.col("a"), F.lit(False))
    left = materialize(scored.join(covers, "names", "left").filter(~covered).drop("longer"), "collocations")
    spelled = left.select("names", F.posexplode("names").alias("at", "name")).join(frequent.select("name", "word", "lang"), "name")
    spelled = spelled.groupBy("names").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.first("lang").alias("lang"))
    spelled = spelled.select("names", "lang", F.expr("array_join(transform(words, w -> w.word), ' ')").alias("phrase"))
    rows = left.join(spelled, "names").drop("names")
    out = ranked(rows, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))
