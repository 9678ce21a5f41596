"""Alignment of two tokenisers' ids, with counts of linked pairs looked up through a minimal perfect hash.

Each text, with a space before it, is tokenised by a byte-level BPE (A) and by pieces (B). Byte offsets where tokens of
both end cut them into groups; every A token of a group is linked to every B token of it. The count of a pair of ids is
the number of documents that hold it linked.

The first pass aligns the documents; each task hands on the distinct pairs it saw and in how many documents, split into
``BUCKETS`` by a hash. Teams of tasks are put together, each bucket gets a minimal perfect hash of its pairs (bit arrays
level by level: pairs alone at their bit are placed, the others go on), the teams' counts become dense vectors in the
order of that hash, and the vectors are summed. The second pass aligns the documents again and looks the counts up; the
pair kept at each place of the vector is compared with the one asked for.

Pairs are bounded by the vocabularies, not by the documents. What is broadcast are tables of whole buckets up to
``MOST_BYTES``; if there is more, the second pass is run once for each such table and adds up what it finds.

Both tokenisers never join a character to a space after it, so texts are cut there and each distinct unit of a slice is
aligned once. Offsets where units end are ends of both, so a text's groups are its units' groups.

Nulls: null and empty texts, and texts whose tokens' bytes of either side differ from the text, have no tokens: zeros
and an empty string. A null id stays null. Rows with equal ids are documents of their own. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.byte_bpe import _slices
from quillon.llm.simhash import _ragged
from quillon.llm.token_orc import SPELLED
from quillon.llm.unit_cache import UNEVEN, cut
from quillon.storage import materialize, read_table, release

BUCKETS, TEAM, MOST_BYTES = 256, 64, 64 << 20
#: Bytes of text aligned at a time, units joined to one text for the tokenisers and such texts in one call, pairs a task
#: holds before it hands some on.
SLICE_BYTES, JOINED, AT_ONCE, MOST_PAIRS = 7_000_000, 400, 40, 2_000_000
#: White space of any kind at the end.
ENDS_IN_SPACE = UNEVEN.removesuffix(" ") + r"\z"
#: A piece vocabulary writes spaces as this character.
MARK = "▁"
#: Bits for each pair that is left at a level of the hash, and the salt that deals pairs to buckets.
ROOM, DEAL = 1.6, 1 << 20


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers for each salt."""
    x = keys + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys, DEAL) % np.uint64(buckets)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct keys: bits of each level, and the bit arrays one after the other (64-bit words)."""
    sizes, words = [], []
    while len(keys):
        size = 64 * max(1, int(np.ceil(ROOM * len(keys) / 64)))
        at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        keys = keys[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64)


class PairTable:
    """The hashes of some buckets, with the keys and counts in their order: ``rows`` are (bucket, sizes, words, keys,
    counts), the last two in any order that the bucket's hash gives."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], buckets: int):
        self.buckets, levels = buckets, max((len(r[1]) for r in rows), default=0)
        self.row = np.full(buckets, -1, np.int64)
        self.size, self.base = np.zeros((len(rows), levels), np.int64), np.zeros((len(rows), levels), np.int64)
        before = 0
        for k, (bucket, sizes, words, _, _) in enumerate(rows):
            self.row[bucket] = k
            self.size[k, : len(sizes)] = sizes
            self.base[k, : len(sizes)] = before + np.cumsum(sizes) - sizes
            before += 64 * len(words)
        self.words = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.uint64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = ones - np.bitwise_count(self.words)
        self.keys = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.uint64)
        self.counts = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, below the number of keys that were hashed; -1 for some that weren't."""
        out, row = np.full(len(keys), -1, np.int64), self.row[bucket_of(keys, self.buckets)]
        left = np.flatnonzero(row >= 0)
        for level in range(self.size.shape[1]):
            size = self.size[row[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.base[row[left], level] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the table doesn't hold it."""
        at = self.places(keys)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        return np.where(known, self.counts[at] if len(self.counts) else 0, 0)


class Aligned:
    """The distinct units of a slice, aligned: ids and groups in the order of the units."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, unit_groups: np.ndarray, n_b: int):
        self.a, self.b, n = a, b, int(unit_groups[-1])
        #: Tokens before each group, and groups before each unit.
        self.a_at, self.b_at = np.searchsorted(a_group, np.arange(n + 1)), np.searchsorted(b_group, np.arange(n + 1))
        self.group_at = unit_groups
        width = np.diff(self.b_at)[a_group]
        row, nth = _ragged(width)
        self.link_key = a[row].astype(np.uint64) * np.uint64(n_b) + b[self.b_at[a_group[row]] + nth].astype(np.uint64)
        self.link_a = a[row]
        links_at = np.concatenate([[0], np.cumsum(np.diff(self.a_at) * np.diff(self.b_at))])
        self.link_at = links_at[unit_groups]

    def strings(self) -> pa.Array:
        """Each unit's groups as text."""

        def joined(ids: np.ndarray, at: np.ndarray) -> pa.Array:
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(ids).cast(pa.large_string())), pa.scalar(",", pa.large_string()))

        groups = pc.binary_join_element_wise(joined(self.a, self.a_at), joined(self.b, self.b_at), pa.scalar("|", pa.large_string()))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.group_at.astype(np.int64)), groups), pa.scalar(";", pa.large_string()))


def _bytes_of(array: pa.BinaryArray | pa.StringArray) -> pa.Buffer:
    """All values of an array one after the other."""
    if not len(array):
        return pa.py_buffer(b"")
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return (array.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is quicker here than hashing."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(a_path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in SPELLED.items()}
        a_bytes = [bytes(byte_of[c] for c in self.tokenizer.id_to_token(i) or "" if c in byte_of) for i in range(self.tokenizer.get_vocab_size())]
        sp = self.pieces
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.IsByte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.vocab_size())]
        self.n_b = len(b_bytes)
        self.bytes_of = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.lengths = np.array([len(x) for x in a_bytes], np.int64), np.array([len(x) for x in b_bytes], np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides of texts (B puts a space before each itself), one after the other."""
        a, b = [], []
        for at in range(0, len(texts), AT_ONCE):
            some = texts[at : at + AT_ONCE]
            found = self.tokenizer.encode_batch_fast([f" {t}" for t in some], add_special_tokens=False)
            a.append(np.fromiter(chain.from_iterable([e.ids for e in found]), np.int32))
            # B puts no space before an empty text
            found = [x or [self.pieces.piece_to_id(MARK)] for x in self.pieces.encode(some, num_threads=1)]
            b.append(np.fromiter(chain.from_iterable(found), np.int32))
        return np.concatenate([np.zeros(0, np.int32), *a]), np.concatenate([np.zeros(0, np.int32), *b])

    def _same(self, ids: tuple[np.ndarray, np.ndarray], raw: bytes) -> bool:
        given = np.frombuffer(raw, np.uint8)
        return all(np.array_equal(np.frombuffer(_bytes_of(table.take(pa.array(side))), np.uint8), given) for table, side in zip(self.bytes_of, ids, strict=True))

    def align(self, units: list[str]) -> tuple[Aligned, np.ndarray]:
        """Units with a space put before each; and which of them have tokens whose bytes are theirs. Others have none."""
        # a joined text has to be cut again at the spaces between its units, so what ends in white space stays alone
        array = pa.array(units, pa.string())
        marked = pc.match_substring(array, MARK).to_numpy(zero_copy_only=False)
        alone = pc.or_(pc.equal(pc.binary_length(array), 0), pc.match_substring_regex(array, ENDS_IN_SPACE)).to_numpy(zero_copy_only=False)
        joint, apart = np.flatnonzero(~marked & ~alone).tolist(), np.flatnonzero(~marked & alone).tolist()
        texts = [" ".join([units[k] for k in joint[at : at + JOINED]]) for at in range(0, len(joint), JOINED)]
        order, ids = joint + apart, self._ids(texts + [units[k] for k in apart])
        if not self._same(ids, "".join([f" {units[k]}" for k in order]).encode()):
            each = [self._ids([units[k]]) for k in order]
            good = [self._same(x, b" " + units[k].encode()) for k, x in zip(order, each, strict=True)]
            order = [k for k, g in zip(order, good, strict=True) if g]
            each = [x for x, g in zip(each, good, strict=True) if g]
            ids = tuple(np.concatenate([np.zeros(0, np.int32), *[x[side] for x in each]]) for side in (0, 1))
        a_end, b_end = (np.cumsum(n[i]) for n, i in zip(self.lengths, ids, strict=True))
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        unit_end = np.cumsum(pc.binary_length(array).to_numpy().astype(np.int64)[order] + 1)
        # groups are numbered along the stream; units are put back into their own order at the end
        found = Aligned(*ids, np.searchsorted(ends, a_end), np.searchsorted(ends, b_end), np.concatenate([[0], np.searchsorted(ends, unit_end) + 1]).astype(np.int64), self.n_b)
        place = np.full(len(units), -1, np.int64)
        place[order] = np.arange(len(order))
        return found, place


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _per_text(texts: list[str | None], by: Aligner) -> tuple[Aligned, np.ndarray, np.ndarray]:
    """The aligned units of a slice, the unit at each place of its texts, and where each text's units begin (one more
    than texts). Texts without tokens have no units."""
    given = [t or "" for t in texts]
    units, begins = cut(given, spaced=True)
    coded = units.dictionary_encode()
    found, place = by.align(coded.dictionary.to_pylist())
    at, text = place[coded.indices.to_numpy()], np.repeat(np.arange(len(given)), np.diff(np.append(begins, len(units))))
    bad = np.zeros(len(given), bool)
    bad[text[at < 0]] = True
    bad |= np.array([not t for t in given], bool)
    kept = ~bad[text]
    return found, at[kept], np.searchsorted(text[kept], np.arange(len(given) + 1))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(part: int, keys: np.ndarray, counts: np.ndarray, buckets: int):
    """Rows (bucket, part, keys, counts) of a task's pairs."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    rows = {"bucket": [], "part": [], "keys": [], "counts": []}
    for b, some in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        rows["bucket"].append(b)
        rows["part"].append(part)
        rows["keys"].append(keys[some].astype("<u8").tobytes())
        rows["counts"].append(counts[some].astype("<i8").tobytes())
    return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def pair_parts(docs: DataFrame, a_path: str, b_path: str, buckets: int = BUCKETS) -> DataFrame:
    """First pass over (doc_id, text): rows (bucket, part, keys, counts), in how many documents of a task a pair is."""

    def run(batches):
        by, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, texts in _slices(batch, "text", SLICE_BYTES):
                found, at, begins = _per_text(texts, by)
                text = np.repeat(np.arange(len(texts)), np.diff(begins))
                # a unit that a text repeats brings nothing new
                once = _distinct(text.astype(np.int64) * (len(found.link_at) or 1) + at)
                text, at = np.divmod(once, len(found.link_at) or 1)
                row, nth = _ragged(np.diff(found.link_at)[at])
                link = found.link_at[at[row]] + nth
                code, pair = np.unique(found.link_key, return_inverse=True)
                n = max(1, len(code))
                seen = _distinct(text[row] * n + pair[link]) % n
                held.append((code, np.bincount(seen, minlength=len(code))))
                if sum(len(k) for k, _ in held) > MOST_PAIRS:
                    held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > MOST_PAIRS // 2:
                        yield _packed(part, *held.pop(), buckets)
        if held:
            yield _packed(part, *_merged(*map(np.concatenate, zip(*held, strict=True))), buckets)

    return docs.select("text").mapInArrow(run, "bucket bigint, part bigint, keys binary, counts binary")


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")])
    return _merged(keys, np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("counts")]))


def pair_hashes(parts: DataFrame, buckets: int = BUCKETS, team: int = TEAM) -> DataFrame:
    """A row for each bucket with pairs: bucket, n, sizes, words, keys (in the order of the hash), counts (likewise)."""

    def merge(table):
        keys, counts = _together(table)
        return pa.Table.from_pydict({"bucket": table.column("bucket").slice(0, 1), "team": table.column("team").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})

    def build(table):
        keys = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")]))
        bucket, (sizes, words) = table.column("bucket")[0].as_py(), build_hash(keys)
        in_order = np.empty_like(keys)
        in_order[PairTable([(bucket, sizes, words, keys, keys)], buckets).places(keys)] = keys
        return pa.Table.from_pydict({"bucket": pa.array([bucket], pa.int64()), "n": pa.array([len(keys)], pa.int64()), "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()), "words": pa.array([words.astype("<u8").tobytes()], pa.binary()), "hashed": pa.array([in_order.tobytes()], pa.binary())})

    def dense(batches):
        """A team's counts as a vector over the hash of its bucket."""
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                keys, hashed = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["hashed"], "<u8")
                table = PairTable([(r["bucket"], np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["words"], "<u8"), hashed, hashed)], buckets)
                vector = np.zeros(r["n"], "<i8")
                vector[table.places(keys)] = np.frombuffer(r["counts"], "<i8")
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"]], pa.int64()), "vector": pa.array([vector.tobytes()], pa.binary())})

    def add(table):
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("vector"))
        return pa.Table.from_pydict({"bucket": table.column("bucket").slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    teams = parts.withColumn("team", F.expr(f"part div {team}"))
    teams = materialize(teams.groupBy("bucket", "team").applyInArrow(merge, "bucket bigint, team bigint, keys binary, counts binary"), "pair-teams")
    hashes = materialize(teams.groupBy("bucket").applyInArrow(build, "bucket bigint, n bigint, sizes binary, words binary, hashed binary"), "pair-hashes")
    vectors = teams.join(hashes, "bucket").mapInArrow(dense, "bucket bigint, vector binary")
    counts = vectors.groupBy("bucket").applyInArrow(add, "bucket bigint, counts binary")
    out = materialize(hashes.join(counts, "bucket").withColumnRenamed("hashed", "keys"), "pair-counts")
    release(teams, hashes)
    return out


def best_counts(hashes: DataFrame, n_b: int, n_a: int) -> np.ndarray:
    """The highest count of each A id; as many rows as that vocabulary has reach the driver."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                a, best = (np.frombuffer(keys, "<u8") // np.uint64(n_b)).astype(np.int64), np.zeros(n_a, np.int64)
                np.maximum.at(best, a, np.frombuffer(counts, "<i8"))
                some = np.unique(a)
                yield pa.RecordBatch.from_pydict({"a": pa.array(some), "best": pa.array(best[some])})

    out = np.zeros(n_a, np.int64)
    for row in hashes.select("keys", "counts").mapInArrow(run, "a bigint, best bigint").groupBy("a").agg(F.max("best").alias("best")).toLocalIterator():
        out[row["a"]] = row["best"]
    return out


def pair_tables(hashes: DataFrame, buckets: int, most_bytes: int) -> list[Callable[[], PairTable]]:
    """The counts as tables of whole buckets of about ``most_bytes`` each, broadcast one by one."""
    sizes = sorted((r["bucket"], 20 * r["n"]) for r in hashes.select("bucket", "n").collect())
    segments, room = [], 0
    for bucket, size in sizes:
        if not segments or size > room:
            segments.append([])
            room = most_bytes
        segments[-1].append(bucket)
        room -= size
    spark = hashes.sparkSession

    def shared(some: list[int]) -> Callable[[], PairTable]:
        rows = hashes.filter(F.col("bucket").between(some[0], some[-1])).collect()
        raw = spark.sparkContext.broadcast([(r["bucket"], bytes(r["sizes"]), bytes(r["words"]), bytes(r["keys"]), bytes(r["counts"])) for r in sorted(rows, key=lambda r: r["bucket"])])
        return lambda: PairTable([(b, *(np.frombuffer(x, t) for x, t in zip(rest, ("<i8", "<u8", "<u8", "<i8"), strict=True))) for b, *rest in raw.value], buckets)

    return [shared(some) for some in segments]


VALUES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def with_counts(docs: DataFrame, table: Callable[[], PairTable] | None, best, a_path: str, b_path: str, first: bool, last: bool) -> DataFrame:
    """Second pass over (doc_id, text): the values of each row as far as a table of pairs has them, added to those there
    are. The last pass gives the groups instead of the text."""
    names = ["doc_id", *VALUES] if last else ["doc_id", "text", *VALUES]
    schema = ", ".join(["doc_id bigint", *([] if last else ["text string"]), *[f"{v} bigint" for v in VALUES], *(["groups string"] if last else [])])

    def run(batches):
        by, pairs, highest = aligner(a_path, b_path), table() if table else PairTable([], 1), best.value
        for batch in batches:
            for part, texts in _slices(batch, "text", SLICE_BYTES):
                found, at, begins = _per_text(texts, by)
                count = pairs.look_up(found.link_key)
                sums = lambda x, where: np.concatenate([[0], np.cumsum(x)])[where]
                ends = [found.a_at[found.group_at], found.b_at[found.group_at], found.group_at, found.link_at, sums((count > 0) & (count == highest[found.link_a]), found.link_at), sums(count, found.link_at)]
                each = [np.concatenate([[0], np.cumsum(np.diff(e)[at])]) for e in ends]
                values = [x[begins[1:]] - x[begins[:-1]] for x in each]
                if not first:
                    values = [v if k < 4 else v + part.column(VALUES[k]).to_numpy() for k, v in enumerate(values)]
                columns = [part.column("doc_id"), *([] if last else [part.column("text")]), *[pa.array(v.astype(np.int64)) for v in values]]
                if last:
                    lists = pa.LargeListArray.from_arrays(pa.array(begins.astype(np.int64)), found.strings().take(pa.array(at)))
                    columns.append(pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(["groups"] if last else [])])

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, team: int = TEAM, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A
    id), count_sum, groups (``a1,a2|b1;a3|b2,b3``: ids in order, empty without tokens)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    spark, (n_a, n_b) = docs.sparkSession, sizes_of(a_path, b_path)
    parts = materialize(pair_parts(rows, a_path, b_path, buckets), "pair-parts")
    hashes = pair_hashes(parts, buckets, team)
    release(parts)
    best = spark.sparkContext.broadcast(best_counts(hashes, n_b, n_a))
    tables = pair_tables(hashes, buckets, most_bytes) or [None]
    release(hashes)
    for k, table in enumerate(tables):
        rows = with_counts(rows, table, best, a_path, b_path, k == 0, k + 1 == len(tables))
    return rows


def sizes_of(a_path: str, b_path: str) -> tuple[int, int]:
    by = aligner(a_path, b_path)
    return by.tokenizer.get_vocab_size(), by.n_b


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", *VALUES, digest.alias("groups_sha256"))
