"""SimHash near-duplicates by covering anchors.

Fingerprint: for each bit, whether more than half of the hashes of the text's word shingles have it.
Two fingerprints are linked if they differ in at most ``threshold`` bits.

The anchors are the code words of a binary Golay code on the first 23 bits. A Golay code
is perfect: each 23-bit word has exactly one code word within 3 bits, so the covering radius is 3. A fingerprint's home
is its nearest anchor, at most the radius away; a fingerprint within the
threshold of it is then within radius + threshold of that home. So every fingerprint is copied to all
anchors within radius + threshold, and at each anchor the fingerprints at home there are compared with
all that came. Each linked pair meets at the home of either. An anchor that more than ``CROWDED`` fingerprints are at
home at is covered again by the same code on the next 23 bits: what comes there goes on to the pairs of anchors within
twice the radius + threshold in all. The result doesn't depend on which anchors are. There are 4096 anchors, whose counts
reach the driver.

Copies travel as packed arrays, one row for each bucket of anchors and block of fingerprints. Each anchor
hands on a spanning forest of its links, not all pairs.

Nulls and texts without words have the fingerprint zero, which is linked like any other. A null id joins
its class but names none; a class of null ids only has a null component. Repeated rows give repeated
results. An empty table gives an empty result. Other columns may have any names that don't begin with two underscores.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import _slices
from quillon.llm.connected import components
from quillon.storage import materialize, read_table, release

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Fingerprints at home at an anchor beyond which it is covered again.
CROWDED = 4_000
BITS, RADIUS = 23, 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    words = WORD.findall((text or "").translate(LOWER))
    joined, digest = " ".join, xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined(words), seed)] if words else [], np.uint64)
    return np.fromiter((digest(joined(w), seed) for w in zip(*[words[k:] for k in range(shingle)])), np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit words to one row: each bit is set if more than half of the rows have it."""
    rows = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)
    ones = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 255):  # 255 ones fit into a byte
        ones += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(rows), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    hashes = shingle_hashes(text, shingle, seed)
    return int(majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (the 64 bits as a long)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                found = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    left = words.astype(np.uint32)
    for bit in range(BITS - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


@lru_cache(maxsize=3)
def near_anchors(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the offsets to all anchors within ``reach``, nearest first: offsets[at[s]:at[s + 1]]
    with their distances. word XOR offset is the anchor."""
    words = np.arange(1 << BITS, dtype=np.uint32)
    weight = np.bitwise_count(words)
    offsets = words[weight <= reach]
    syndromes, weights = _syndrome(offsets), np.bitwise_count(offsets)
    order = np.lexsort((offsets, weights, syndromes))
    at = np.searchsorted(syndromes[order], np.arange(2049))
    return at, offsets[order], weights[order]


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 1): rows (0, 0, 2) and positions inside each row (0, 1, 0)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors_of(fps: np.ndarray, threshold: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, anchor, is home) within the covering radius plus threshold of each fingerprint; of anchors that are
    ``crowded`` instead the pairs of anchors within twice the radius plus threshold, the second one above the first."""
    reach = 2 * RADIUS + threshold if len(crowded) else RADIUS + threshold
    at, offsets, weights = near_anchors(reach)
    word = lambda k: (fps >> np.uint64(BITS * k) & np.uint64((1 << BITS) - 1)).astype(np.uint32)
    # number of anchors of each syndrome within each distance
    within = np.zeros((2048, reach + 1), np.int64)
    np.add.at(within, (np.repeat(np.arange(2048), np.diff(at)), weights), 1)
    within = within.cumsum(1)
    first, second = word(0), word(1)
    syndrome = _syndrome(first)
    row, nth = _ragged(within[syndrome, RADIUS + threshold])
    pick = at[syndrome[row]] + nth
    anchor, home = first[row] ^ offsets[pick], nth == 0
    again = np.isin(anchor, crowded)
    if not again.any():
        return row, anchor.astype(np.uint64), home
    split, left = np.flatnonzero(again), np.flatnonzero(~again)
    other = _syndrome(second)[row[split]]
    k, nth = _ragged(within[other, reach - weights[pick[split]]])
    above = second[row[split[k]]] ^ offsets[at[other[k]] + nth]
    key = anchor[split[k]].astype(np.uint64) | (above.astype(np.uint64) + np.uint64(1)) << np.uint64(BITS)
    return np.concatenate([row[left], row[split[k]]]), np.concatenate([anchor[left].astype(np.uint64), key]), np.concatenate([home[left], home[split[k]] & (nth == 0)])


def crowded_anchors(distinct: DataFrame, crowded: int = CROWDED) -> np.ndarray:
    """The anchors that more than ``crowded`` distinct fingerprints (fp) are at home at."""

    def run(batches):
        at, offsets, _ = near_anchors(RADIUS)
        total = {}
        for batch in batches:
            word = (batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << BITS) - 1)).astype(np.uint32)
            for a, n in zip(*np.unique(word ^ offsets[at[_syndrome(word)]], return_counts=True), strict=True):
                total[int(a)] = total.get(int(a), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    counts = distinct.select("fp").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.array([r["anchor"] for r in counts.filter(F.col("n") > crowded).collect()], np.uint32)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links each node to the least node of its component; fewer links with the same components."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label, done = new[label], np.array_equal(new[label], label)
        if done and np.array_equal(label[a], label[b]):
            break
    apart = label != np.arange(len(nodes))
    return nodes[label[apart]], nodes[apart]


def _links(home: np.ndarray, came: np.ndarray, threshold: int, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the threshold, a block of comparisons at a time."""
    u, v = [], []
    step = max(1, block // max(1, len(came)))
    for k in range(0, len(home), step):
        part = home[k : k + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ came[None, :]) <= threshold)
        apart = part[i] != came[j]
        if apart.any():
            a, b = _forest(part[i][apart], came[j][apart])
            u.append(a)
            v.append(b)
    if not u:
        return home[:0], home[:0]
    return _forest(np.concatenate(u), np.concatenate(v)) if len(u) > 1 else (u[0], v[0])


def near_links(distinct: DataFrame, threshold: int = 3, crowded: int = CROWDED, n_fps: int | None = None) -> DataFrame:
    """From distinct fingerprints (fp) to links (u, v) that connect all pairs within the threshold."""
    n_fps = distinct.count() if n_fps is None else n_fps
    full = crowded_anchors(distinct, crowded)
    blocks = max(1, n_fps // 50_000)
    buckets = max(64, n_fps // 2_000)
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)))

    def copies(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(all_fps), 2_500 if len(full) else 10_000):
                fps = all_fps[k : k + (2_500 if len(full) else 10_000)]
                rows, anchor, home = anchors_of(fps, threshold, full)
                # a multiplier spreads the anchors over the buckets
                bucket = ((anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                for b, part in zip(found, np.split(order, first[1:]), strict=True):
                    packed = (anchor[part] << np.uint64(1) | home[part]).astype("<u8").tobytes(), fps[rows[part]].astype("<u8").tobytes()
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b)], pa.int64()), "anchors": pa.array([packed[0]], pa.binary()), "fps": pa.array([packed[1]], pa.binary())})

    def compare(table):
        anchor = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("anchors")])
        fps = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("fps")])
        order = np.argsort(anchor >> np.uint64(1), kind="stable")
        anchor, fps = anchor[order], fps[order]
        first = np.unique(anchor >> np.uint64(1), return_index=True)[1]
        links = [(fps[:0], fps[:0])]
        for a, b in zip(first, np.append(first[1:], len(anchor)), strict=True):
            home = fps[a:b][(anchor[a:b] & np.uint64(1)).astype(bool)]
            if len(home) and b - a > 1:
                links.append(_links(home, fps[a:b], threshold))
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        return pa.Table.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    packed = placed.repartition("block").select("fp").mapInArrow(copies, "bucket bigint, anchors binary, fps binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the least doc_id of the documents that are linked, in any number of steps)."""
    rows = materialize(fingerprints(docs, shingle, 42, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(near_links(classes.select("fp"), threshold, crowded, classes.count()))
    found = found.select(F.col("node").alias("fp"), "component")
    classes = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(heads, "component").select("fp", "component_id"), "components")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Wide fingerprints: four words. Eleven blocks of 23 bits look for candidates, and eleven of the bits in another order.
WIDE_WORDS, WIDE_BLOCKS, BLOCK_DIFFER = 4, 22, 2
#: Standard deviations of the estimate by which candidates may differ more than the similarity stands for, in the first
#: turn and in those after it, which try other pairs of what the first has found to be close.
WIDE_DEVIATIONS, LATER_DEVIATIONS = 3, 1
#: Differing bits by which the order of candidates is shuffled after the first turn.
SHUFFLED = 12


def wide_limit(similarity: float, deviations: float = WIDE_DEVIATIONS) -> int:
    """Most differing bits of candidates: sets with that Jaccard similarity have a cosine of 2J / (1 + J)."""
    n, share = 64 * WIDE_WORDS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * share + deviations * np.sqrt(n * share * (1 - share)))


def wide_fingerprint(text: str | None, shingle: int) -> np.ndarray:
    """Of the set of shingles: one that repeats has no more weight than any other."""
    return wide_of_set(np.unique(shingle_hashes(text, shingle, 42)))


def wide_of_set(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WIDE_WORDS, np.uint64)
    wide = (hashes[:, None] ^ np.arange(WIDE_WORDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    wide ^= wide >> np.uint64(32)
    wide *= np.uint64(0xD6E8FEB86659FD93)
    return majority(wide ^ (wide >> np.uint64(32)))


def _node(hashes: np.ndarray) -> int:
    """A 64-bit name for a set of shingles (sorted hashes)."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)


def _wide_block(wide: np.ndarray, block: int) -> np.ndarray:
    if block >= WIDE_BLOCKS // 2:
        bits = np.unpackbits(np.ascontiguousarray(wide, "<u8").view(np.uint8), axis=1, bitorder="little")
        # an odd step visits all bits, and takes those of a block from different ones of the first eleven
        wide = np.ascontiguousarray(np.packbits(bits[:, np.arange(64 * WIDE_WORDS) * 97 % (64 * WIDE_WORDS)], axis=1, bitorder="little")).view("<u8")
    at, bit = divmod(block % (WIDE_BLOCKS // 2) * BITS, 64)
    out = wide[:, at] >> np.uint64(bit)
    if bit + BITS > 64:
        out = out | wide[:, at + 1] << np.uint64(64 - bit)
    return (out & np.uint64((1 << BITS) - 1)).astype(np.uint32)


def similar_links(classes: DataFrame, limit: int, n_fps: int, turn: int = 0) -> DataFrame:
    """From classes (node, label, w0, w1, ...) to candidate pairs (u, v) of nodes with different labels that
    differ in at most ``limit`` bits in all and at most BLOCK_DIFFER in one of the blocks. Two such words have a
    word halfway, whose anchor is within the covering radius plus half of BLOCK_DIFFER of either: both go there.
    Each anchor hands on as many such pairs as join the labels there, fewer than twice its labels, those with the
    fewest differing bits first; after the first ``turn`` in another order each time among pairs of about as many bits."""
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    reach = RADIUS + (BLOCK_DIFFER + 1) // 2
    shares, buckets = max(1, n_fps // 50_000), max(64, n_fps // 500)

    def copies(batches):
        at, offsets, _ = near_anchors(reach)
        for batch in batches:
            everything = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (*names, "node", "label")], 1)
            for k in range(0, len(everything), 2_500):  # each has some 117 copies
                part, rows, keys = everything[k : k + 2_500], [], []
                for block in range(WIDE_BLOCKS):
                    word = _wide_block(part[:, :WIDE_WORDS], block)
                    syndrome = _syndrome(word)
                    row, nth = _ragged(np.diff(at)[syndrome])
                    rows.append(row)
                    keys.append(word[row] ^ offsets[at[syndrome[row]] + nth] | np.uint32(block << BITS))
                row, key = np.concatenate(rows), np.concatenate(keys)
                bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                for b, some in zip(found, np.split(order, first[1:]), strict=True):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b)], pa.int64()), "anchors": pa.array([key[some].astype("<u4").tobytes()], pa.binary()), "fps": pa.array([part[row[some]].astype("<u8").tobytes()], pa.binary())})

    def compare(table):
        key = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("anchors")])
        rows = np.concatenate([np.frombuffer(x.as_py(), "<u8").reshape(-1, WIDE_WORDS + 2) for x in table.column("fps")])
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        wide, node, label, first = rows[:, :WIDE_WORDS], rows[:, WIDE_WORDS].view(np.int64), rows[:, WIDE_WORDS + 1], np.unique(key, return_index=True)[1]
        u, v = [node[:0]], [node[:0]]
        for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
            if b - a > 1:
                i, j = _similar_in(wide[a:b], label[a:b], _wide_block(wide[a:b], int(key[a] >> BITS)), limit, node[a:b].view(np.uint64), turn)
                u.append(np.minimum(node[a + i], node[a + j]))
                v.append(np.maximum(node[a + i], node[a + j]))
        return pa.Table.from_pydict({"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v))})

    placed = classes.withColumn("share", F.pmod(F.xxhash64("node"), F.lit(shares)))
    packed = placed.repartition("share").select(*names, "node", "label").mapInArrow(copies, "bucket bigint, anchors binary, fps binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u bigint, v bigint").distinct()


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of pairs (a, b) that connect all that the pairs connect; fewer than two for each node. Pairs that come
    first are preferred: each part takes the first that leads out of it, again and again."""
    at, picked = np.arange(max(a.max(), b.max()) + 1), []
    while True:
        low, high = at[a], at[b]
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return np.unique(np.concatenate(picked))
        some = apart[np.unique(np.stack([high[apart], low[apart]], 1).ravel(), return_index=True)[1] // 2]
        picked.append(some)
        least, node = _forest(low[some], high[some])
        to = np.arange(len(at))
        to[node] = least
        at = to[at]


def _preferred(differ: np.ndarray, u: np.ndarray, v: np.ndarray, turn: int) -> np.ndarray:
    """The order in which pairs are taken."""
    mix = ((u ^ v) * np.uint64(2 * turn + 1) + (np.minimum(u, v) >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.lexsort((mix, differ + (mix % np.uint64(SHUFFLED)).astype(np.int64) * (turn > 0)))


def _similar_in(wide: np.ndarray, label: np.ndarray, word: np.ndarray, limit: int, node: np.ndarray, turn: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs at one anchor, as many as join the labels, a block of comparisons at a time."""
    label = np.unique(label, return_inverse=True)[1]
    found, step = [], max(1, block // len(word))
    for k in range(0, len(word), step):
        i, j = np.nonzero(np.bitwise_count(word[k : k + step, None] ^ word[None, k:]) <= BLOCK_DIFFER)
        i, j = i[j > i] + k, j[j > i] + k
        near = label[i] != label[j]
        i, j = i[near], j[near]
        differ = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
        near = differ <= limit
        if near.any():
            found.append(_thinned(i[near], j[near], differ[near], label, node, turn))
            if sum(len(f[0]) for f in found) > 4 * len(word):
                found = [_thinned(*map(np.concatenate, zip(*found, strict=True)), label, node, turn)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _thinned(*map(np.concatenate, zip(*found, strict=True)), label, node, turn)[:2]


def _thinned(i: np.ndarray, j: np.ndarray, differ: np.ndarray, label: np.ndarray, node: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = _preferred(differ, node[i], node[j], turn)
    i, j, differ = i[order], j[order], differ[order]
    pick = _spanning(label[i], label[j])
    return i[pick], j[pick], differ[pick]


def _judge(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Candidate pairs (u, v) with ``similar``: whether the exact Jaccard similarity of their shingle sets is
    at least ``similarity``. Only texts that stand for a class in a pair are cut into shingles again."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(classes.select("node", "least").join(nodes, "node"), "wide-wanted")
    ids = wanted.select("least").distinct()

    def run(batches):
        for batch in batches:
            for _, texts in _slices(batch, "text"):
                sets = [np.unique(shingle_hashes(t, shingle, 42)) for t in texts]
                node = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["least"]), "left_semi").select("text")
    sets = texts.mapInArrow(run, "node bigint, shingles array<bigint>").join(wanted.select("node"), "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node"]), "wide-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (same / (F.size("a") + F.size("b") - same) >= similarity).alias("similar"))


def _exact_links(docs: DataFrame, classes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (u, v) that connect the candidate pairs of classes whose similarity is exact. Each anchor hands on only as
    many pairs as join its labels, nearest first, so that a large group of near copies isn't squared and few pairs turn
    out not to be similar. Where one does, other pairs are tried around it, with what is linked so far as labels, until
    a turn finds no link that joins anything."""
    n, now, good, bad, turn = classes.count(), classes.withColumn("label", F.col("node")), None, None, 0
    while True:
        pairs = similar_links(now, wide_limit(similarity, LATER_DEVIATIONS if turn else WIDE_DEVIATIONS), n, turn)
        pairs = materialize(pairs.join(bad, ["u", "v"], "left_anti") if bad is not None else pairs, "wide-pairs")
        judged = materialize(_judge(pairs, docs, classes, similarity, shingle), "wide-judged")
        release(pairs, now)
        yes, no = judged.filter("similar").select("u", "v"), judged.filter("not similar").select("u", "v")
        good, bad = (yes, no) if good is None else (good.unionByName(yes), bad.unionByName(no))
        n_yes, n_no = judged.agg(F.count_if("similar"), F.count_if(~F.col("similar"))).first()
        if not n_no or turn and not n_yes:
            return good
        # pairs that were left out lead out of what is linked so far only where a pair that was tried has failed
        linked = components(good)
        labels = classes.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        ends = no.select(F.col("u").alias("node")).distinct().unionByName(no.select(F.col("v").alias("node")).distinct()).distinct().join(linked, "node", "left")
        open_ = ends.select(F.coalesce("component", "node").alias("label")).distinct()
        now, turn = materialize(labels.join(open_, "label", "left_semi"), "wide-open"), turn + 1


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, component_id (the least doc_id of its class). Documents are linked where
    the Jaccard similarity of their sets of word shingles is at least ``similarity``. Wide fingerprints find
    the candidates (64-bit fingerprints within 3 bits would miss most pairs at 0.8, whose fingerprints differ
    in about 10 bits); shingles are told apart by 64-bit hashes."""
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, node bigint, " + ", ".join(f"{c} bigint" for c in names)

    def run(batches):
        for batch in batches:
            for part, some in _slices(batch, "text"):
                sets = [np.unique(shingle_hashes(t, shingle, 42)) for t in some]
                node = np.array([_node(x) for x in sets], np.uint64).view(np.int64)
                wide = np.array([wide_of_set(x) for x in sets], np.uint64).reshape(-1, WIDE_WORDS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(node), *[pa.array(np.ascontiguousarray(wide[:, k]).view(np.int64)) for k in range(WIDE_WORDS)]], names=["doc_id", "node", *names])

    rows = materialize(texts.mapInArrow(run, schema), "wide")
    classes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in names]), "wide-classes")
    found = components(_exact_links(texts, classes, similarity, shingle))
    classes = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(heads, "component").select("node", "component_id"), "wide-components")
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that come first in their class of similar documents, with all columns. Rows without an id stay."""
    found = similar_documents(docs, similarity, shingle, id_col, text_col)
    drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(drop, docs[id_col] == drop["__dropped"], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
