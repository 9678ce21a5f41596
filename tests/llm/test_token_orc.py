import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import token_orc
from quillon.storage import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(rows):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]


def test_round_trip(spark):
    texts = [None, "", "  a  b\n\n c", "don't 123 漢字 🙂 <|endoftext|>", "  x \t y", "long " * 5000, "same", "same"]
    rows = [(i * 3 - 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, part int")
    path = new_path(spark, "t")
    token_orc.write(docs.repartition(3), path, PATH)
    stored = token_orc.read(spark, path)
    got = sorted(token_orc.with_starts(stored).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (i, _), ids in zip(got, rows, reference(rows), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, at, len(ids), ids)
        at += len(ids)
    plan = stored.filter("doc_id = 4")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan and stored.filter("doc_id = 4").count() == 1


def test_added_tokens_are_those_of_the_library():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext |>", "plain text"]
    got = [x.tolist() for x in token_orc.Encoder(PATH).encode_many(texts)]
    assert got == [ids[:-1] for ids in reference(enumerate(texts))] and got[0] == [64, 220, 50256, 275]


def test_files_with_other_pre_tokenisers_get_whole_texts():
    """A vocabulary whose texts can't be cut like that is given to the library as it is."""
    path, texts = public_tokenizers.path("word_bpe_49k.json"), ["Some words  here", "", "<|endoftext|> É e\u0301"]
    encoder = token_orc.Encoder(path)
    assert not encoder.cuttable and token_orc.Encoder(PATH).cuttable
    assert [x.tolist() for x in encoder.encode_many(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_units_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(token_orc, "JOINED", 7)
    monkeypatch.setattr(token_orc, "AT_ONCE", 2)
    rng, parts = random.Random(2), ["we'll", "it's", "'S", "l'été", "naïve,", "x.\nY", "3.14", "a1b2", "\n\n", "\t", " ", "  ", "...", "?!", "漢字", "かな", "🙂", "ﬁ", "½", "\u00a0", "\u2028", "Ĳ", "Straße", "###", "don’t", "word"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    encoder = token_orc.Encoder(PATH)
    for k in range(0, 400, 50):
        assert [x.tolist() for x in encoder.encode_many(texts[k : k + 50])] == [ids[:-1] for ids in reference(enumerate(texts[k : k + 50]))]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, None)]
    path = new_path(spark, "t")
    token_orc.write(spark.createDataFrame(rows, "doc_id bigint, text string"), path, PATH)
    got = token_orc.with_starts(token_orc.read(spark, path)).collect()
    assert len(got) == 5 and sorted(r.start for r in got) == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    path = new_path(spark, "t")
    token_orc.write(spark.createDataFrame([], "doc_id bigint, text string"), path, PATH)
    assert token_orc.with_starts(token_orc.read(spark, path)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.op6_token_orc(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at, want = 0, {}
    for (i, _), ids in zip(rows, reference(rows), strict=True):
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
