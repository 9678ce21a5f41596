"""BPE encoding and decoding by a tokenisation automaton.

The automaton reads tokens. It starts as one state whose arcs lead back to it, one for each symbol, and each merge
(left, right) in turn changes it by a gadget: what ``left`` leads to is cloned without the arc ``right``, ``left`` leads
to the clone from now on, and wherever ``left`` may be read, the new token may, leading to where ``right`` led. In the
end a sequence of tokens has a path if and only if it is what the merges make of its symbols, so each word has one path.

All arcs of a token lead to one state, and a clone differs from its original by one arc. So a state is kept as the token
that leads to it and the number of merges that it has seen, and whether it has an arc follows from the merges: neither
the token nor what it was made from may be lost to the state.

Words are encoded by the same automaton made to read symbols: the arcs under way at a place of a word (how far along
its label, and from which state) are a row of the transition table, whose cells are filled where they are first taken.
At each place one path ends at most, so the table says which arc it ended with, and the tokens are read off backwards.

Words are cut by the tokeniser's own normaliser and pre-tokeniser (a shorter way for characters below U+0250, whose
classes don't change with the version of Unicode). No word has a space, so texts are cut at spaces and each distinct
unit is encoded once while a cache keeps it. Strings of added tokens are those tokens. Decoding looks up each id's arc
label and puts a space between labels, as the vocabulary has no decoder.

Nulls: a null text is an empty text and has no ids. A null id stays null. Repeated rows give repeated results. An empty
table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.byte_bpe import _slices
from quillon.llm.token_orc import LATIN, SPELLED
from quillon.llm.unit_cache import UnitCache
from quillon.storage import read_table

#: Fixed value: the pre-tokens of this family of vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Joins units that are cut together: white space that they don't hold.
BREAK, NOT_LATIN = "\u2028", "[^\\x{00}-\\x{24f}]"
WORDS_AND_BREAKS = regex.compile(BREAK + "|" + WORDS.pattern)
#: What a worker keeps: rows of the transition table, words of so many bytes at most, bytes of units.
MOST_ROWS, MOST_WORDS, LONGEST_KEPT, CACHE_BYTES = 120_000, 80_000, 48, 30_000_000
NEVER = 1 << 40


class Automaton:
    """From merges (pairs of ids) and the symbols of each id. ``symbols`` are numbers below ``n_symbols``."""

    def __init__(self, merges: list[tuple[int, int, int]], symbols: dict[int, list[int]], n_symbols: int):
        n = max(symbols) + 1
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.gone: dict[tuple[int, int], int] = {}
        #: States: the token that leads there and the number of merges seen; state 0 is where words begin.
        self.owner, self.seen = [-1], [0]
        self.target, self.length = [0] * n, [0] * n
        for at, (left, right, made) in enumerate(merges):
            self._merge(at, left, right, made)
        self.n_symbols, self.below, self.token = n_symbols, [{}], [-1]
        for token, spelled in symbols.items():
            self._spell(token, spelled)
        self._start()

    def _merge(self, at: int, left: int, right: int, made: int) -> None:
        """The gadget of one merge."""
        before = self.target[left]
        if not self._has(before, right):
            return  # no sequence has the two side by side any more
        self.left[made], self.right[made], self.born[made] = left, right, at
        self.target[made] = self.target[right]
        self.gone[left, right] = at
        self.owner.append(left)
        self.seen.append(at + 1)
        self.target[left] = len(self.owner) - 1

    def _has(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token: it was made where its left part still had one."""
        gone, right, born = self.gone, self.right, self.born
        owner, seen, parts = self.owner[state], self.seen[state], self._parts(token)
        while owner >= 0:
            for part, until in parts:
                at = gone.get((owner, part), NEVER)
                if at < seen and at <= until:
                    return False
            # the state was cloned from what the right part led to when the owner was made
            owner, seen = right[owner], born[owner]
        return True

    def _parts(self, token: int) -> list[tuple[int, int]]:
        """The token, its left part, the left part of that and so on, with when the one before was made of each."""
        out, until = [], NEVER
        while token >= 0:
            out.append((token, until))
            token, until = self.left[token], self.born[token]
        return out

    def _spell(self, token: int, spelled: list[int]) -> None:
        node = 0
        for symbol in spelled:
            if symbol not in self.below[node]:
                self.below[node][symbol] = len(self.token)
                self.token.append(-1)
                self.below.append({})
            node = self.below[node][symbol]
        self.token[node], self.length[token] = token, len(spelled)

    def _start(self) -> None:
        """An empty transition table. A row stands for the arcs that are under way at a place of a word: pairs of a
        node of the trie and the state that the arc leaves; row 0 is where words begin."""
        self.under_way = [((0, 0),)]
        self.row_of = {self.under_way[0]: 0}
        self.table: dict[int, int] = {}

    def _fill(self, row: int, symbol: int) -> int:
        """One cell of the table: the next row, and the token of the path that ends here (or none)."""
        ended, to, after = -1, 0, []
        for node, state in self.under_way[row]:
            node = self.below[node].get(symbol)
            if node is not None:
                token = self.token[node]
                if ended < 0 <= token and self._has(state, token):
                    ended, to = token, self.target[token]
                if self.below[node]:
                    after.append((node, state))
        if ended >= 0:
            after.append((0, to))
        key = tuple(after)
        if key not in self.row_of:
            self.row_of[key] = len(self.under_way)
            self.under_way.append(key)
        found = self.table[row * self.n_symbols + symbol] = self.row_of[key] << 32 | ended + 1
        return found

    def encode(self, spelled: list[int]) -> list[int]:
        """The tokens of a word given by its symbols: one transition for each, then back along the arcs that ended."""
        if len(self.under_way) > MOST_ROWS:
            self._start()
        table, n, row, ended = self.table, self.n_symbols, 0, []
        for symbol in spelled:
            cell = table.get(row * n + symbol) or self._fill(row, symbol)
            row = cell >> 32
            ended.append(cell & 0xFFFFFFFF)
        at, out = len(ended), []
        while at:
            token = ended[at - 1] - 1
            if token < 0:
                raise ValueError("a symbol of the word is not in the vocabulary")
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out


class WordEncoder:
    """Ids of units of text without spaces, by a tokeniser file's merges, its pre-tokeniser and its added tokens."""

    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        byte_of = {c: b for b, c in SPELLED.items()}

        def symbols(token: str) -> list[int]:
            last = bool(self.end) and token.endswith(self.end)
            out = [byte_of[c] for c in (token.removesuffix(self.end) if last else token)]
            return [*out[:-1], out[-1] + 256] if last else out

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(merges, {i: symbols(t) for t, i in vocab.items()}, 512)
        self.library = Tokenizer.from_file(tokenizer_path)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.known: dict[bytes, bytes] = {}
        self.cache = UnitCache(self.encode_units, self.encode_units, CACHE_BYTES)

    def words(self, text: str) -> list[bytes]:
        """The pre-tokens of a text without added tokens, as UTF-8 bytes."""
        if LATIN.fullmatch(text):  # composed already, so that only case and pre-tokens are left
            return [w.encode() for w in WORDS.findall(text.lower())]
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte_of = {c: b for b, c in SPELLED.items()}
        return [bytes(map(byte_of.__getitem__, w)) for w, _ in cut]

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, as bytes."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        out, known = list(map(self.known.get, words)), self.known
        for k, ids in enumerate(out):
            if ids is None:
                spelled = list(words[k])
                if self.end:
                    spelled[-1] += 256
                ids = out[k] = np.array(self.automaton.encode(spelled), "<u4").tobytes()
                if len(spelled) <= LONGEST_KEPT:
                    known[words[k]] = ids
        return out

    def encode_whole(self, text: str) -> bytes:
        """A text by itself: it may hold added tokens and any characters."""
        ids = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                ids.append(np.array([self.added[part]], "<u4").tobytes())
            elif part:
                ids += self.word_ids(self.words(part))
        return b"".join(ids)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Units with plain characters and without added tokens are cut into words together, the others one by one."""
        array = pa.array(units, pa.string())
        odd = pc.match_substring_regex(array, NOT_LATIN)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(array, content))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = [u for u, x in zip(units, odd, strict=True) if not x]
        words = pa.array(WORDS_AND_BREAKS.findall(BREAK.join(plain).lower()), pa.string())
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = self.word_ids([w.encode() for w in distinct if w != BREAK])
        if BREAK in distinct:
            ids.insert(distinct.index(BREAK), b"")
        joined = pa.array(ids, pa.binary()).cast(pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset + 1 :][: len(joined)]
        ends = np.append(ends[pc.equal(words, BREAK).to_numpy(zero_copy_only=False)], ends[-1:] if len(ends) else [0]).tolist()
        raw = (joined.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        found = iter([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return [self.encode_whole(u) if x else next(found) for u, x in zip(units, odd, strict=True)]


@lru_cache(maxsize=1)
def word_encoder(tokenizer_path: str) -> WordEncoder:
    return WordEncoder(tokenizer_path)


@lru_cache(maxsize=2)
def labels(tokenizer_path: str) -> pa.StringArray:
    """The arc label of each id, null where an id is free."""
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
    table = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = token
    return pa.array(table, pa.string())


def _list(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.concatenate(ids) if ids else np.zeros(0)).astype(np.int32)))


def _labelled(ids: pa.ListArray, table: pa.StringArray) -> pa.StringArray:
    starts = ids.offsets.to_numpy()
    found = table.take(ids.values.slice(starts[0], starts[-1] - starts[0]))
    lists = pa.LargeListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int64)), found.cast(pa.large_string()), mask=ids.is_null())
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array of int, in text order), and with ``decoded`` what ``decode``
    makes of the ids, in the same pass."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches):
        cache, table = word_encoder(tokenizer_path).cache, labels(tokenizer_path) if decoded else None
        for batch in batches:
            for part, texts in _slices(batch, "text"):
                ids = _list(cache.encode_many(texts))
                columns = [part.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns + [_labelled(ids, table)] if decoded else columns, names=names)

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded``: the labels of all ids with a space between them; null where ids are null."""
    names = [f.name for f in encoded.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["decoded string"])

    def run(batches):
        table = labels(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, _labelled(part.column("ids"), table)], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
