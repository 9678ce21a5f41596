import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import suffix_dedup as sd


def brute(rows):
    """rows (key, bytes): removed flags of each row."""
    least = {}
    for key, t in rows:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            least[w] = min(key, least.get(w, key))
    out = []
    for key, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        out.append(gone)
    return out


def result(t, gone):
    spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
    return len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "an", "er", "ß", "漢字", "x" * 30, "\n", "!!", " "]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    shared = [prose(k) for k in (5, 12, 13, 14, 40, 90)]
    texts = ["", "a" * 49, "a" * 50, "a" * 51, "a" * 500, "ab" * 100, shared[-1], shared[-1], None]
    for _ in range(n):
        parts = [rng.choice([rng.choice(shared), prose(rng.randrange(1, 60)), rng.choice(shared)[rng.randrange(20) :]]) for _ in range(rng.randrange(4))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("widespread", [128, 1])
def test_documents_against_brute_force(spark, monkeypatch, widespread):
    monkeypatch.setattr(sd, "SLICE_BYTES", 700)
    monkeypatch.setattr(sd, "WIDESPREAD", widespread)
    texts = sample(1, 120)
    rng = random.Random(9)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "x") for i, t in zip(ids, texts, strict=True)] + [(None, texts[20], "x"), (ids[30], texts[30], "x"), (ids[31], texts[40], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string").repartition(5)
    raw = [(sd.LAST_KEY if i is None else i, (t or "").encode()) for i, t, _ in rows]
    want = sorted((key, *result(t, g)) for (key, t), g in zip(raw, brute(raw), strict=True))
    got = sorted((sd.LAST_KEY if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.spans_removed(docs).collect())
    assert got == want
    assert sum(r[2] for r in want) > 5000


def shared(a, b):
    n = 0
    while n < min(len(a), len(b), sd.LENGTH) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("part", [400_000, 40])
def test_longest_previous_factors(monkeypatch, part):
    """Against the definition, for all windows that occur twice; others have less than LENGTH."""
    monkeypatch.setattr(sd, "SORTED_WINDOWS", part)
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(14)]
    strings += [s[k:] + b"tail" * 5 for k, s in enumerate(strings[:7])] + strings[:4]
    keys = np.array([rng.randrange(9) for _ in strings])
    windows = [(s[i:], s[i : i + 50], k) for s, k in zip(strings, keys.tolist(), strict=True) for i in range(len(s) - 49)]
    got = sd.longest_previous_factors(strings, keys).tolist()
    often = Counter(w for _, w, _ in windows)
    known = [(s, k) for s, w, k in windows if often[w] > 1]
    full = 0
    for g, (s, w, k) in zip(got, windows, strict=True):
        longest = max((shared(s, t) for t, j in known if j < k), default=0)
        assert (g == 50) == (longest == 50)
        full += g == 50
        assert g == 0 if often[w] == 1 else part < 1000 or g == longest
    assert full > 50


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60))
def test_nearest_smaller(owners):
    want = [max((j for j in range(i) if owners[j] < o), default=-1) for i, o in enumerate(owners)]
    assert sd._nearest_smaller(np.array(owners, np.int64)).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(60, 400))
def test_runs_cover_each_window_once(texts, slice_bytes):
    before, sd.SLICE_BYTES = sd.SLICE_BYTES, slice_bytes
    try:
        document, first, windows, hashes = sd.window_runs(texts)
    finally:
        sd.SLICE_BYTES = before
    seen = [(int(d), int(f) + k) for d, f, n in zip(document, first, windows, strict=True) for k in range(n)]
    assert sorted(seen) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    # the minimiser depends on the window alone
    for d, f, n, h in zip(document, first, windows, hashes, strict=True):
        for k in (0, n - 1):
            assert sd.window_runs([texts[d][f + k : f + k + 50]])[3][0] == h


def test_remaining_text_keeps_columns(spark):
    a, b = "é" * 60, "漢" + "word " * 30
    docs = spark.createDataFrame([(1, a, 60, "s"), (2, "x" + a[1:] + "tail", 64, "s"), (3, b, 151, "s"), (4, b, 151, "s"), (5, None, 0, None)], "doc_id bigint, text string, n_chars int, source string")
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.remove_repeats(docs).collect()}
    assert got == {1: (a, 60), 2: ("xtail", 5), 3: (b, 151), 5: (None, 0)}
    assert sd.remove_repeats(docs).columns == docs.columns


def test_clashing_names(spark):
    """Columns named like results and inner columns come back as they are."""
    text = "word " * 30
    names = ["kept", "n_removed", "n_spans", "its_key", "least_key", "h", "key", "batch", "bucket", "n_bytes"]
    docs = spark.createDataFrame([(i, text + tail, *range(10)) for i, tail in enumerate(("", "tail", "", ""))], ", ".join(["doc_id int", "text string", *(f"{c} int" for c in names)]))
    got = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {0: text, 1: "tail"} and [got[1][c] for c in names] == list(range(10))
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in sd.spans_removed(docs).collect()} == {(0, 150, 0, 0), (1, 154, 150, 1), (2, 150, 150, 1), (3, 150, 150, 1)}


def test_empty(spark):
    assert sd.spans_removed(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    for (i, t), gone in zip(docs, brute(docs), strict=True):
        n, removed, spans, kept = result(t, gone)
        want[i] = (n, removed, spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op2_suffix_dedup(spark, sf).collect()}
    assert got == want
