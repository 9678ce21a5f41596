import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe_automaton
from quillon.llm.bpe_automaton import Automaton, WordEncoder, decode, encode, op11_bpe_automaton

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\t\n\r ", "a", "don't WE'LL they're ' 's", "x" * 900, "word " * 700, "né à côté 漢字かな交じり文 🙂🙂 12345 ½ x² İ ΣΣ ẞ", "é ́x Å",
    "<|endoftext|>", "a<|startoftext|>b <|endoftext| ><|ENDOFTEXT|>", "\x1c\x1d a \x85 b c d", "'" * 50 + "ll" * 40, "".join(random.Random(1).choice("ab '\n\t12,.éß漢") for _ in range(5000)),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def naive(word: list[int], merges: list[tuple[int, int, int]]) -> list[int]:
    """Merges one after the other, each from left to right."""
    for left, right, made in merges:
        out, at = [], 0
        while at < len(word):
            if word[at : at + 2] == [left, right]:
                out.append(made)
                at += 2
            else:
                out.append(word[at])
                at += 1
        word = out
    return word


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_automaton_against_merging_in_order(data):
    """Any merges over two or three symbols, those of a token with itself and those that can't happen included."""
    spelled = {k: [k] for k in range(data.draw(st.integers(2, 3)))}
    symbols, merges = len(spelled), []
    for _ in range(data.draw(st.integers(0, 10))):
        left, right = data.draw(st.sampled_from(sorted(spelled))), data.draw(st.sampled_from(sorted(spelled)))
        if spelled[left] + spelled[right] not in spelled.values():
            made = len(spelled)
            # as in trained vocabularies, the two parts come side by side in what the merges so far make of some word
            if naive(spelled[left] + spelled[right], merges) == [left, right]:
                spelled[made] = spelled[left] + spelled[right]
                merges.append((left, right, made))
    automaton = Automaton(merges, spelled, symbols)
    for word in data.draw(st.lists(st.lists(st.integers(0, symbols - 1), max_size=14), max_size=20)):
        assert automaton.encode(word) == naive(word, merges)


def test_words_against_library(library):
    pick = random.Random(3)
    texts = ["".join(pick.choice("aeiountsrhl'") for _ in range(pick.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(pick.choice("!?.,-=*#<|>") for _ in range(pick.randint(1, 30))) for _ in range(1000)] + ["a" * n for n in range(60)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'{chr(c)}s" for c in [*range(0x3000), *range(0x1F000, 0x1F100)]]
    encoder = WordEncoder(PATH)
    for got, want in zip(encoder.cache.encode_many(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_a_full_table_is_started_again(library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MOST_ROWS", 40)
    monkeypatch.setattr(bpe_automaton, "MOST_WORDS", 5)
    encoder, texts = WordEncoder(PATH), ["some words of several kinds", "kinds of words", "unwordliness and others' kindnesses"]
    assert [x.tolist() for x in encoder.cache.encode_many(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip(spark, library):
    rows = [(i, t, "extra", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "again", 2), (None, "no id", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    got = decode(encode(docs, PATH), PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got) == sorted(want)
    at_once = encode(docs, PATH, decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, got))


def test_null_ids_decode_to_null(spark):
    got = decode(spark.createDataFrame([(1, None), (2, [320])], "doc_id bigint, ids array<int>"), PATH).collect()
    assert {r.doc_id: r.decoded for r in got} == {1: None, 2: "a</w>"}


def test_query_against_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_bpe_automaton(spark, sf).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_empty_table(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id bigint, text string"), PATH), PATH).count() == 0
