"""Removal of repeated passages by longest-previous-factor arrays.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts in a document with a
smaller id. Each text position is a suffix; its longest previous factor is the longest prefix that it
shares with a suffix of a document with a smaller id. In suffix order that is shared with the previous
or the next position of a smaller id, so both are found, the prefixes shared with them are measured, and
the longer one is the factor. Where it reaches ``LENGTH`` bytes, those bytes go. Factors are measured up
to ``LENGTH``, which is all the rule asks.

Suffix order is needed only among suffixes that can share ``LENGTH`` bytes, so the work is split by
content. The minimiser of a window of ``LENGTH`` bytes (its leftmost ``GRAM``-byte string with the least
hash) depends on the window alone and is shared by a run of neighbouring windows; equal windows have
equal minimisers. The steps:

1. Texts are dealt into batches by their hash, equal texts once (copies of a whole text are settled by
   the least id of the text). Each batch sends its distinct minimisers, packed by bucket.
2. A bucket tells each batch which of its minimisers occur in two documents or more, and which of them
   in more than ``WIDESPREAD`` batches.
3. Each batch sends the bytes under the runs of those, each string once with the least id that has it.
   Strings of widespread minimisers take one step more: groups of batches put equal strings together, so
   that a bucket gets them once for each group.
4. A bucket puts equal strings together under their least id, and builds the longest-previous-factor
   array of all strings that share a minimiser with another. The answers go back the same way.
5. Each batch removes the bytes under all windows whose factor reaches ``LENGTH``.

All steps are one Spark plan in which the shuffled texts are written once and read three times; what
the buckets exchange are packed arrays. Matches never cross documents; lengths are judged on the input.

Nulls: a null text has no bytes; a null id counts as greater than all others. Rows with one id and one
text are one document; all of them come back. Empty tables give empty results. Columns of the input may
have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillon.llm.byte_bpe import _slices
from quillon.storage import read_table

LENGTH, GRAM = 50, 24
BATCH_BYTES, BUCKET_BYTES, SLICE_BYTES = 4_000_000, 4_000_000, 200_000
#: Windows put in suffix order at a time; equal windows are always in one such part.
SORTED_WINDOWS = 400_000
#: A minimiser in more batches than this is widespread; batches are then answered in groups of so many.
WIDESPREAD = 128
MOST_PARTITIONS = 50_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
LAST_KEY = 2**63 - 1
#: Low bits of a hash that are given up for the place of its gram.
PLACE = np.uint64((1 << 24) - 1)
#: Where the words lie that a window is compared by.
WORDS = (*range(0, LENGTH - 7, 8), LENGTH - 8)


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on; the buffer ends with seven bytes of padding."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def _gram_hashes(buffer: np.ndarray) -> np.ndarray:
    words = _words(buffer)
    n = len(words) - 16
    h = words[:n] * ODD[0]
    h += words[8 : n + 8] * ODD[1]
    h += words[16 : n + 16] * ODD[2]
    h ^= h >> np.uint64(32)
    h *= ODD[3]
    return h


def _least_of_next(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one minimiser: document, first window, number of windows, hash."""
    pieces = []  # (document, offset, length) with LENGTH - 1 bytes of overlap
    for d, t in enumerate(texts):
        pieces += [(d, o, min(len(t) - o, SLICE_BYTES + LENGTH - 1)) for o in range(0, max(0, len(t) - LENGTH + 1), SLICE_BYTES)]
    out, k, rest = [], 0, np.arange(1 - LENGTH, 0)
    while k < len(pieces):
        group, size = [], 0
        while k < len(pieces) and size < SLICE_BYTES:
            group.append(pieces[k])
            size += pieces[k][2]
            k += 1
        joined = b"".join([texts[d][o : o + n] for d, o, n in group]) + bytes(GRAM + LENGTH)
        h = _gram_hashes(np.frombuffer(joined, np.uint8))
        # the least hash, and of equal ones the leftmost: places take the low bits
        least = _least_of_next(h & ~PLACE | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1)
        owner, at, lengths = np.array(group).T
        ends = np.cumsum(lengths)
        begins = ends - lengths
        changes = np.empty(size, bool)
        changes[1:] = least[1:size] != least[: size - 1]
        changes[begins] = True
        changes[(ends[:, None] + rest).ravel()] = False  # no window starts there
        first = np.flatnonzero(changes)
        here = np.searchsorted(begins, first, "right") - 1
        windows = np.diff(np.append(first, size))
        windows[np.searchsorted(first, ends) - 1] -= LENGTH - 1
        mixed = h[least[first] & PLACE] * ODD[1]  # hashes of minimisers are small: mixed once more before they are dealt by value
        out.append((owner[here].astype(np.int32), (first - begins[here] + at[here]).astype(np.int32), windows.astype(np.int32), mixed ^ (mixed >> np.uint64(31))))
    if not out:
        none = np.zeros(0, np.int32)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def minimiser_ids(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 32 | 32 more bits of the hash; two minimisers that share it only cost a comparison."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _by_bucket(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted ids."""
    if not len(ids):
        return
    bucket = ids >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    yield from zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)


class Batch:
    """The distinct texts of a batch, each with its least key, and their runs."""

    def __init__(self, table: pa.Table, buckets: int):
        least: dict[bytes, tuple[int, bytes]] = {}
        for h, key, text in zip(table.column("h").to_pylist(), table.column("key").to_pylist(), table.column("text").to_pylist(), strict=True):
            if h not in least or key < least[h][0]:
                least[h] = (key, text)
        self.h = sorted(least)
        self.keys = np.array([least[h][0] for h in self.h], np.int64)
        self.texts = [least[h][1] for h in self.h]
        self.document, self.first, self.windows, hashes = window_runs(self.texts)
        self.run_ids = minimiser_ids(hashes, buckets)
        self.ids, place = np.unique(self.run_ids, return_inverse=True)
        self.place = place.astype(np.int32)

    def in_two_documents(self) -> np.ndarray:
        low, high = np.full(len(self.ids), len(self.h), np.int32), np.full(len(self.ids), -1, np.int32)
        np.minimum.at(low, self.place, self.document)
        np.maximum.at(high, self.place, self.document)
        return low < high

    def repeated(self, masks: dict[int, bytes]) -> None:
        """Keeps the runs whose minimiser is repeated, and finds the distinct byte strings under them, in
        the order of their minimisers."""
        alive = np.zeros(len(self.ids), bool)
        for bucket, a, b in _by_bucket(self.ids):
            if bucket in masks:
                alive[a:b] = _unpack(masks[bucket], b - a)
        runs = np.flatnonzero(alive[self.place])
        self.document, self.first, self.windows, self.run_ids = (x[runs] for x in (self.document, self.first, self.windows, self.run_ids))
        spans = zip(self.document.tolist(), self.first.tolist(), (self.first + (self.windows + LENGTH - 1)).tolist(), strict=True)
        number: dict[bytes, int] = {}
        string = np.array([number.setdefault(self.texts[d][s:e], len(number)) for d, s, e in spans], np.int64)
        ids = np.empty(len(number), np.uint64)
        ids[string] = self.run_ids
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.string, self.string_ids, found = place[string], ids[order], list(number)
        self.strings = [found[k] for k in order.tolist()]
        self.least = np.full(len(self.strings), LAST_KEY)
        np.minimum.at(self.least, self.string, self.keys[self.document])


def _nearest_smaller(owner: np.ndarray) -> np.ndarray:
    """For each position the nearest one before it with a smaller owner, or -1. All positions look at once: one
    whose candidate isn't smaller takes over the candidate of that, which skips no smaller one."""
    found = np.arange(-1, len(owner) - 1)
    open_ = np.arange(1, len(owner))
    while len(open_):
        open_ = open_[owner[found[open_]] >= owner[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def _shared(suffixes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that suffixes a and b share at their start, up to LENGTH; b may be -1 (none)."""
    out = np.zeros(len(a), np.uint8)
    left = np.flatnonzero(b >= 0)
    for word, place in zip(suffixes, WORDS, strict=True):
        apart = word[a[left]] ^ word[b[left]]
        differ = apart != 0
        at = left[differ]
        # the words are big-endian numbers: equal leading bytes are leading zeros
        out[at] = place + sum((apart[differ] >> np.uint64(8 * k) == 0).astype(np.uint8) for k in range(1, 8))
        left = left[~differ]
    out[left] = LENGTH
    return out


def longest_previous_factors(strings: list[bytes], keys: np.ndarray) -> np.ndarray:
    """For all windows of all strings, one after the other: how many bytes, up to LENGTH, a window shares with
    one of a string with a smaller key. 0 stands for less than LENGTH where no other window has the same hash."""
    n = np.fromiter((len(s) - LENGTH + 1 for s in strings), np.int64, len(strings))
    words = _words(np.frombuffer(b"".join(strings) + bytes(8), np.uint8))
    start = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (LENGTH - 1), n)
    h = np.zeros(len(start), np.uint64)
    for p in WORDS:
        h ^= words[start + p]
        h *= ODD[p // 8 % 4]
        h ^= h >> np.uint64(31)
    by_hash = np.argsort(h)
    h = h[by_hash]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    by_hash, h = by_hash[twice], h[twice]
    out, owner = np.zeros(len(start), np.uint8), np.repeat(keys, n)
    cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    a = 0
    while a < len(h):
        later = cuts[np.searchsorted(cuts, a + SORTED_WINDOWS) :]
        b = int(later[0]) if len(later) else len(h)
        some = by_hash[a:b]
        suffixes = np.stack([words[start[some] + p].byteswap() for p in WORDS])  # big-endian: numbers compare as bytes do
        order = np.lexsort(suffixes[::-1])
        suffixes, owners = suffixes[:, order], owner[some[order]]
        here = np.arange(len(some))
        following = _nearest_smaller(owners[::-1])[::-1]
        following = np.where(following < 0, -1, len(some) - 1 - following)
        out[some[order]] = np.maximum(_shared(suffixes, here, _nearest_smaller(owners)), _shared(suffixes, here, following))
        a = b
    return out


class Strings:
    """Packed strings of several senders as distinct strings, each with its minimiser and its least key.
    Strings are numbered as the senders, in their order, name them."""

    def __init__(self, table: pa.Table, sender: str = "batch"):
        self.table = table = table.sort_by(sender)
        number: dict[bytes, int] = {}
        places, keys, ids, n = [], [], [], []
        for i, k, lengths, raw in zip(*(table.column(c).to_pylist() for c in ("ids", "keys", "lengths", "bytes")), strict=True):
            n.append(np.frombuffer(lengths, np.uint8).astype(np.int64))
            ends = np.cumsum(n[-1]).tolist()
            places.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
            keys.append(np.frombuffer(k, "<i8"))
            ids.append(np.frombuffer(i, "<u4"))
        self.senders = [len(x) for x in places]
        self.place, self.keys, self.windows = np.concatenate(places), np.concatenate(keys), np.concatenate(n) - (LENGTH - 1)
        self.strings = list(number)
        self.ids = np.empty(len(number), np.uint32)
        self.ids[self.place] = np.concatenate(ids)
        self.least = np.full(len(number), LAST_KEY)
        np.minimum.at(self.least, self.place, self.keys)
        self.lengths = np.empty(len(number), np.int64)
        self.lengths[self.place] = self.windows

    def earlier(self) -> np.ndarray:
        """For all windows of the distinct strings: does a string with a smaller key have it?"""
        # a string whose minimiser no other distinct string has shares no window with any
        with_others = np.unique(self.ids, return_inverse=True, return_counts=True)
        some = np.flatnonzero(with_others[2][with_others[1]] > 1)
        out = np.zeros(self.lengths.sum(), bool)
        if len(some):
            factors = longest_previous_factors([self.strings[k] for k in some.tolist()], self.least[some])
            out[_expand(self.begins()[some], self.lengths[some])] = factors >= LENGTH
        return out

    def begins(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def answers(self, earlier: np.ndarray) -> list[bytes]:
        """For each sender the flags of its windows, packed."""
        flags = np.repeat(self.least[self.place] < self.keys, self.windows)
        flags |= earlier[_expand(self.begins()[self.place], self.windows)]
        ends = np.cumsum(self.windows)[np.cumsum(self.senders) - 1]
        return [_pack(f) for f in np.split(flags, ends[:-1])]


def _expand(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] of them), begins[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def _unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _schema(fields: str) -> tuple[str, pa.Schema]:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    return fields, pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


MINIMISERS = _schema("bucket bigint, batch bigint, ids binary, two binary")
MASKS = _schema("batch bigint, bucket bigint, mask binary, wide binary")
WINDOWS = _schema("bucket bigint, batch bigint, team bigint, mask binary, wide binary, ids binary, keys binary, lengths binary, bytes binary")
MERGED = _schema("bucket bigint, team bigint, ids binary, keys binary, lengths binary, bytes binary")
ANSWERS = _schema("batch bigint, bucket bigint, team bigint, mask binary, wide binary, flags binary")
FLAGS = _schema("bucket bigint, team bigint, flags binary")
KEPT = _schema("h binary, least_key bigint, n_removed bigint, n_spans bigint, kept binary")


def dedup_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct text: h (SHA-256), least_key (the least id), n_removed, n_spans, kept (bytes)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_KEY)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, buckets = max(16, size // BATCH_BYTES), max(16, size // BUCKET_BYTES)

    def deal(parts):
        seen: dict[bytes, int] = {}
        for batch in parts:
            for part, texts in _slices(batch, "text"):
                out = []
                for key, text in zip(part.column("key").to_pylist(), texts, strict=True):
                    raw = text.encode()
                    h = hashlib.sha256(raw).digest()
                    if key < seen.get(h, LAST_KEY + 1):
                        seen[h] = key
                        out.append((int.from_bytes(h[:6]) % batches, h, key, raw))
                number, h, key, raw = zip(*out, strict=True) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(h, pa.binary()), pa.array(key, pa.int64()), pa.array(raw, pa.binary())], names=["batch", "h", "key", "text"])

    texts = rows.mapInArrow(deal, "batch bigint, h binary, key bigint, text binary").repartition(min(batches, MOST_PARTITIONS), "batch")

    def send_minimisers(table):
        b, out = Batch(table, buckets), []
        two, batch = b.in_two_documents(), table.column("batch")[0].as_py()
        for bucket, i, j in _by_bucket(b.ids):
            out.append({"bucket": bucket, "batch": batch, "ids": b.ids[i:j].astype("<u4").tobytes(), "two": _pack(two[i:j])})
        return pa.Table.from_pylist(out, MINIMISERS[1])

    def find_repeated(table):
        parts = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
        two = [_unpack(x, len(p)) for x, p in zip(table.column("two").to_pylist(), parts, strict=True)]
        ids, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        alive = n > 1
        alive[place[np.concatenate(two)]] = True
        ends = np.cumsum([len(p) for p in parts])[:-1]
        masks = [pa.array([_pack(x) for x in np.split(flag[place], ends)], pa.binary()) for flag in (alive, n > WIDESPREAD)]
        return pa.Table.from_arrays([table.column("batch"), table.column("bucket"), *masks], schema=MASKS[1])

    def widespread(b: Batch, wide: dict[int, bytes]) -> np.ndarray:
        """Whether the strings of a batch have a widespread minimiser."""
        flags = np.concatenate([_unpack(wide[bucket], j - i) if bucket in wide else np.zeros(j - i, bool) for bucket, i, j in _by_bucket(b.ids)] or [np.zeros(0, bool)])
        return flags[np.searchsorted(b.ids, b.string_ids)]

    def messages(b: Batch, wide: dict[int, bytes]):
        """(bucket, is widespread, positions of strings) of all that a batch sends."""
        far = widespread(b, wide)
        for bucket, i, j in _by_bucket(b.string_ids):
            for is_wide in (False, True):
                some = i + np.flatnonzero(far[i:j] == is_wide)
                if len(some):
                    yield bucket, is_wide, some

    def send_windows(table, masks):
        if not len(table):
            return WINDOWS[1].empty_table()
        b, out = Batch(table, buckets), []
        batch, names = table.column("batch")[0].as_py(), masks.column("bucket").to_pylist()
        mask, wide = (dict(zip(names, masks.column(c).to_pylist(), strict=True)) for c in ("mask", "wide"))
        b.repeated(mask)
        for bucket, is_wide, some in messages(b, wide):
            own = [b.strings[k] for k in some.tolist()]
            out.append({
                "bucket": bucket, "batch": batch, "team": batch // WIDESPREAD if is_wide else -1, "mask": mask[bucket], "wide": wide[bucket],
                "ids": b.string_ids[some].astype("<u4").tobytes(), "keys": b.least[some].astype("<i8").tobytes(), "lengths": bytes(map(len, own)), "bytes": b"".join(own),
            })
        return pa.Table.from_pylist(out, WINDOWS[1])

    # near strings (team -1) and those of teams come in one exchange; each step takes its own
    def merge(table):
        if table.column("team")[0].as_py() < 0:
            return MERGED[1].empty_table()
        s = Strings(table)
        row = {"bucket": table.column("bucket")[0].as_py(), "team": table.column("team")[0].as_py(), "ids": s.ids.astype("<u4").tobytes(), "keys": s.least.astype("<i8").tobytes()}
        return pa.Table.from_pylist([row | {"lengths": bytes(map(len, s.strings)), "bytes": b"".join(s.strings)}], MERGED[1])

    def judge_merged(table):
        s = Strings(table, "team")
        return pa.Table.from_arrays([s.table.column("bucket"), s.table.column("team"), pa.array(s.answers(s.earlier()), pa.binary())], schema=FLAGS[1])

    def answers_to(s, flags):
        return pa.Table.from_arrays([*(s.table.column(c) for c in ("batch", "bucket", "team", "mask", "wide")), pa.array(flags, pa.binary())], schema=ANSWERS[1])

    def judge(table):
        if table.column("team")[0].as_py() >= 0:
            return ANSWERS[1].empty_table()
        s = Strings(table)
        return answers_to(s, s.answers(s.earlier()))

    def hand_on(table, flags):
        if not len(table) or not len(flags):
            return ANSWERS[1].empty_table()
        s = Strings(table)
        return answers_to(s, s.answers(_unpack(flags.column("flags")[0].as_py(), int(s.lengths.sum()))))

    def remove(table, answers):
        if not len(table):
            return KEPT[1].empty_table()
        b = Batch(table, buckets)
        names, is_wide = answers.column("bucket").to_pylist(), [t >= 0 for t in answers.column("team").to_pylist()]
        mask, wide = (dict(zip(names, answers.column(c).to_pylist(), strict=True)) for c in ("mask", "wide"))
        flags = dict(zip(zip(names, is_wide, strict=True), answers.column("flags").to_pylist(), strict=True))
        b.repeated(mask)
        n = np.fromiter((len(s) - LENGTH + 1 for s in b.strings), np.int64, len(b.strings))
        at = np.cumsum(n) - n
        earlier = np.zeros(n.sum(), bool)
        for bucket, far, some in messages(b, wide):
            earlier[_expand(at[some], n[some])] = _unpack(flags[bucket, far], int(n[some].sum()))
        hits = np.concatenate([[0], np.cumsum(earlier)])
        hits = (hits[at + n] - hits[at])[b.string]
        # a run is the string's first owner's, or else all its windows have a smaller owner in this batch
        whole = (b.keys[b.document] > b.least[b.string]) | (hits == b.windows)
        begins = np.cumsum([0, *map(len, b.texts)])
        start = begins[b.document] + b.first
        parts = np.flatnonzero(~whole & (hits > 0))
        single = _expand(start[parts], b.windows[parts])[earlier[_expand(at[b.string[parts]], b.windows[parts])]]
        change = np.zeros(begins[-1] + 1, np.int32)
        np.add.at(change, np.concatenate([start[whole], single]), 1)
        np.add.at(change, np.concatenate([start[whole] + b.windows[whole] - 1, single]) + LENGTH, -1)
        gone, out = np.cumsum(change, out=change) > 0, []
        for d, h in enumerate(b.h):
            g = gone[begins[d] : begins[d + 1]]
            removed = int(np.count_nonzero(g))
            kept = np.frombuffer(b.texts[d], np.uint8)[~g].tobytes() if removed else b.texts[d]
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0
            out.append({"h": h, "least_key": int(b.keys[d]), "n_removed": removed, "n_spans": spans, "kept": kept})
        return pa.Table.from_pylist(out, KEPT[1])

    sent = texts.groupBy("batch").applyInArrow(send_minimisers, MINIMISERS[0])
    masks = sent.groupBy("bucket").applyInArrow(find_repeated, MASKS[0])
    windows = texts.groupBy("batch").cogroup(masks.groupBy("batch")).applyInArrow(send_windows, WINDOWS[0])
    teams = windows.groupBy("bucket", "team")
    answers = teams.applyInArrow(judge, ANSWERS[0])
    flags = teams.applyInArrow(merge, MERGED[0]).groupBy("bucket").applyInArrow(judge_merged, FLAGS[0])
    handed = teams.cogroup(flags.groupBy("bucket", "team")).applyInArrow(hand_on, ANSWERS[0])
    return texts.groupBy("batch").cogroup(answers.unionByName(handed).groupBy("batch")).applyInArrow(remove, KEPT[0])


def _row_keys(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_KEY)).alias("__key"), F.unhex(F.sha2(text, 256)).alias("__h"),
        F.octet_length(text).cast("bigint").alias("__n"),
    ]


def _with_results(rows: DataFrame, results: DataFrame) -> DataFrame:
    """rows (__key, __h, __n) with what became of their text: __removed, __spans, and the other columns of
    ``results`` (names begin with two underscores); ``__copy`` is true for later copies of a whole text, which
    lose all of it."""
    joined = rows.join(results, "__h", "left").withColumn("__copy", (F.col("__key") > F.col("__least")) & (F.col("__n") >= LENGTH))
    return joined.withColumns({
        "__removed": F.when(F.col("__copy"), F.col("__n")).otherwise(F.col("__removed")),
        "__spans": F.when(F.col("__copy"), F.lit(1).cast("bigint")).otherwise(F.col("__spans")),
    })


def _results(docs: DataFrame, id_col: str, text_col: str, kept) -> DataFrame:
    found = dedup_texts(docs, id_col, text_col)
    return found.select(F.col("h").alias("__h"), F.col("least_key").alias("__least"), F.col("n_removed").alias("__removed"), F.col("n_spans").alias("__spans"), kept.alias("__kept"))


def spans_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    rows = docs.select(F.col(id_col).alias("__id"), *_row_keys(id_col, text_col))
    done = _with_results(rows, _results(docs, id_col, text_col, F.col("kept")))
    kept = F.when(~F.col("__copy"), F.col("__kept")).otherwise(F.lit("").cast("binary"))
    return done.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), kept.alias("kept"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with what is left of their texts (a character that is cut is left out) and its length in
    characters; a document of which nothing is left goes. A null text stays null. Columns whose names begin
    with two underscores may not be in ``docs``."""
    names = docs.columns
    others = docs.withColumn("__null", F.col(text_col).isNull()).select(*[c for c in names if c != text_col], "__null", *_row_keys(id_col, text_col))
    done = _with_results(others, _results(docs, id_col, text_col, F.col("kept")))
    done = done.filter("not __copy and (__removed = 0 or octet_length(__kept) > 0)")
    done = done.withColumn(text_col, F.when(~F.col("__null"), whole_characters(F.col("__kept"))))
    if length_col in names:
        kind = docs.schema[length_col].dataType
        done = done.withColumn(length_col, F.when(F.col("__removed") > 0, F.length(text_col)).otherwise(F.col(length_col)).cast(kind))
    return done.select(*names)


@F.arrow_udf(StringType())
def whole_characters(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in raw.to_pylist()], pa.string())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = _with_results(docs.select("doc_id", *_row_keys("doc_id", "text")), _results(docs, "doc_id", "text", F.sha2("kept", 256)))
    kept = F.when(~F.col("__copy"), F.col("__kept")).otherwise(F.sha2(F.lit("").cast("binary"), 256))
    return done.select("doc_id", F.col("__n").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), kept.alias("kept_sha256"))
