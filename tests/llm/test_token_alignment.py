import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm.token_alignment import PairTable, align, bucket_of, build_hash, op13_alignment
from quillon.llm.token_orc import SPELLED

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", "\n\n a  b ", "a ", " a", "don't we'll they're ' 's", "x" * 900, "word " * 700, "    tab\t\ttab \r\n end  ", "né à côté 漢字かな交じり文 🙂🙂 12345 ½ x² <|endoftext|>",
    "a mark ▁ in it", "▁", "<s> </s> <unk> <0x41>", "a\x00b \x01", "\x1c\x1d a \x85 b", "it is the same text", "it is the same text", "".join(random.Random(1).choice("ab '\n\t12,.éß漢") for _ in range(3000)),
]


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte_of = {c: b for b, c in SPELLED.items()}
    docs, held = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a = [(x, bytes(byte_of[c] for c in tok.id_to_token(x))) for x in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.IsByte(x) else sp.id_to_piece(x).replace("▁", " ").encode()) for x in sp.encode(text)]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                common, sides = sorted(ends[0] & ends[1]), []
                for side in (a, b):
                    out, at, k = [[] for _ in common], 0, 0
                    for x, raw in side:
                        at += len(raw)
                        out[k].append(x)
                        k += at == common[k]
                    sides.append(out)
                groups = list(zip(*sides, strict=True))
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        docs.append((i, groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), text))
    return out


def plain(rows) -> list[tuple]:
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.mark.parametrize(("buckets", "most_bytes"), [(256, 1 << 26), (3, 1 << 26), (16, 400)])
def test_against_brute_force(spark, buckets, most_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(8, TEXTS[8]), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "extra", 7) for r in rows], "doc_id bigint, text string, groups string, n_a int").repartition(3)
    got = align(docs, A, B, buckets=buckets, team=2, most_bytes=most_bytes).collect()
    assert plain(got) == plain(brute(rows))


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n).astype(np.uint64))
        rows, buckets = [], 4
        for b in range(buckets):
            some = keys[bucket_of(keys, buckets) == b]
            if len(some):
                sizes, words = build_hash(some)
                hashed = np.empty_like(some)
                hashed[PairTable([(b, sizes, words, some, some)], buckets).places(some)] = some
                rows.append((b, sizes, words, hashed, (hashed % np.uint64(97)).astype(np.int64) + 1))
        table = PairTable(rows, buckets)
        assert sorted(table.places(keys)) == list(range(len(keys)))
        assert (table.look_up(keys) == keys % np.uint64(97) + np.uint64(1)).all()
        others = np.setdiff1d(np.arange(5000, dtype=np.uint64), keys)
        assert not table.look_up(others).any()  # the keys are verified


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_alignment(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert plain(got) == plain([(*r[:-1], digest(r[-1])) for r in brute(rows)])


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
