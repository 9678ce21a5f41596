"""Exact whole-text tokenisation by cached, self-contained units.

Byte-level pre-tokenisers of this family never let a match run from a non-space character into white
space, so a text may be cut wherever a non-space character is followed by a space: the ids of the
whole text are the ids of those units, one after the other. Each unit is encoded by the tokeniser
library itself, once per worker while the cache holds it; the texts are cut, their units numbered and
the ids put together as arrays.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a space: there a text can't simply be cut at every space.
UNEVEN = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
CUT = re.compile(r"(?<=\S) ")
#: About what a kept unit takes, with its ids.
UNIT_BYTES = 250
Encoder = Callable[[list[str]], list[bytes]]


def cut(texts: list[str], spaced: bool = False) -> tuple[pa.StringArray, np.ndarray]:
    """The units of all texts, one after the other, and where each text's units begin. Each text has one
    unit or more; all but its first have lost the space they start with. ``spaced``: the texts have lost one too."""
    array = pa.array(texts, pa.string())
    split = pc.split_pattern(array, " ")
    uneven = pc.match_substring_regex(array, UNEVEN)
    uneven = np.flatnonzero(pc.or_(uneven, pc.starts_with(array, " ")) if spaced else uneven).tolist()
    if uneven:
        lists = split.to_pylist()
        for k in uneven:
            lists[k] = CUT.split(texts[k])
        split = pa.array(lists, pa.list_(pa.string()))
    begins = split.offsets.to_numpy()
    return split.values, begins[:-1]


class UnitCache:
    """``encode_whole`` turns texts into id arrays (little-endian uint32 bytes), each on its own; ``encode_spaced``
    does so for units with a space put before them. Units of up to ``longest`` characters are kept in two
    generations of about ``most_bytes`` / 2 bytes each: when the young one is full it becomes the old
    one, and what is used again moves to the young one."""

    def __init__(self, encode_spaced: Encoder, encode_whole: Encoder, most_bytes: int = 100_000_000, longest: int = 48):
        self.encode_spaced, self.encode_whole = encode_spaced, encode_whole
        self.most, self.longest = most_bytes // 2 // UNIT_BYTES, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units with a space put before each."""
        found = list(map(self.young.get, units))
        holes = [k for k, ids in enumerate(found) if ids is None]
        absent = [units[k] for k in holes]
        ids = list(map(self.old.get, absent))
        fresh = iter(self.encode_spaced([u for u, x in zip(absent, ids, strict=True) if x is None]))
        ids = [next(fresh) if x is None else x for x in ids]
        for k, x in zip(holes, ids, strict=True):
            found[k] = x
        self.young.update((u, x) for u, x in zip(absent, ids, strict=True) if len(u) <= self.longest)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return found

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the whole texts as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        collecting = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and looking for some takes as long as the work
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        units, begins = cut(texts)
        is_first = np.zeros(len(units), bool)
        is_first[begins] = True
        rest = pc.if_else(pa.array(is_first), pa.scalar(None, pa.string()), units).dictionary_encode()
        ids = self.ids_of(rest.dictionary.to_pylist()) + self.encode_whole(units.take(pa.array(begins)).to_pylist())
        code = rest.indices.fill_null(0).to_numpy().copy()
        code[begins] = len(rest.dictionary) + np.arange(len(texts), dtype=code.dtype)
        joined = pa.array(ids, pa.large_binary()).take(pa.array(code))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :] // 4
        pool = np.frombuffer(joined.buffers()[2] or b"", "<u4")
        ends = np.append(offsets[begins[1:]], offsets[len(joined)])
        return [pool[a:b] for a, b in zip([offsets[0], *ends[:-1]], ends, strict=True)]
