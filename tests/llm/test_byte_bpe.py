import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from quillon.llm import byte_bpe
from quillon.llm.unit_cache import cut

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

TEXTS = [
    None, "", " ", "   ", "a", "\n\n a  b ", "don't we'll they're ' 's", "x" * 900, "word " * 700, " \u00a0\u2003 tab\t\ttab \r\n end  ",
    "né à côté 漢字かな交じり文 🙂🙂 12345 ½ x² <|endoftext|>", "a  \n" * 300, "'" * 50 + "ll" * 40, "\x1c\x1d a \x85 b",
    "".join(random.Random(1).choice("ab '\n\t12,.éß漢") for _ in range(5000)),
]


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (64, 32), (40, 12)])
def test_equals_whole_text_encoding(spark, chunk, overlap):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], "again"), (None, "no id", "x"), (None, "no id " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, chunk_chars=chunk, overlap=overlap)
    got = byte_bpe.decode(encoded, RANKS).collect()
    enc, _ = byte_bpe.encoding(RANKS, PATTERN)
    want = sorted((-1 if i is None else i, np.asarray(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    at_once = byte_bpe.encode(docs, RANKS, PATTERN, chunk_chars=chunk, overlap=overlap, decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, got))


def test_units_join_back():
    for t in TEXTS:
        units, begins = cut([t or "", "a b"])
        assert begins[0] == 0 and " ".join(units.to_pylist()[: begins[1]]) == (t or "")


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op10_byte_bpe(spark, sf).collect()}
    enc, _ = byte_bpe.encoding(RANKS, PATTERN)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.asarray(enc.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), RANKS, PATTERN).count() == 0
