import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quillon.llm.byte_bpe import load_ranks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with null, empty, repeated and very long texts, repeated rows, null sources and ids."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    long_ = " ".join(f"own{i} words{i % 977} here{i % 13}" for i in range(20000))
    more = [(9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, first.text, "en", "src1", 5), (9004, long_, None, None, len(long_)), (9004, long_, None, None, len(long_)), (9005, long_[1:], "en", "src2", 7)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def fails(text):
    words = words_of(text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def shingles(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def holds(words, item):
    n = min(13, len(item))
    if not n or len(words) < n:
        return False
    equal = np.pad((words[:, None] == item).astype(np.int64), ((1, 0), (1, 0)))
    for x in range(1, len(words) + 1):
        equal[x, 1:] += equal[x - 1, :-1]
    return bool((5 * (n - (equal[n:, n:] - equal[:-n, :-n])) <= n).any())


def test_stages_against_brute_force(spark, folder):
    """Each decision of run() made again from the whole texts, by definitions of this file alone."""
    rows = [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    # quality rules: failing documents go, and all of hosts whose shrunk rate passes 0.6
    bad = [fails(t) for _, t, _ in rows]
    hosts = {s: (sum(x == s for _, _, x in rows), sum(b for b, (_, _, x) in zip(bad, rows, strict=True) if x == s)) for s in {s for _, _, s in rows}}
    n, x, k = len(rows), sum(bad), len(hosts)
    mean = x / n
    spread = max(sum(f / m * f for m, f in hosts.values()) / n - mean**2 - mean * (1 - mean) * k / n, 0)
    strength = mean * (1 - mean) / spread - 1 if 0 < spread < mean * (1 - mean) else n / k
    rejected = {s for s, (m, f) in hosts.items() if (f + mean * strength) / (m + strength) > 0.6}
    rows = [r for r, b in zip(rows, bad, strict=True) if not b and r[2] not in rejected]
    # near duplicates: classes linked by an exact similarity of 0.8 keep their least id
    texts = sorted({t for _, t, _ in rows})
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if c == high else c for c in label]
    group, least = dict(zip(texts, label, strict=True)), {}
    for i, t, _ in rows:
        least[group[t]] = min(i, least.get(group[t], i))
    rows = [r for r in rows if r[0] == least[group[r[1]]]]
    # passages that a smaller id has go
    first, kept = {}, []
    raw = [(i, t.encode()) for i, t, _ in rows]
    for i, t in raw:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        if left or not gone.any():
            kept.append((i, left.decode("utf-8", "ignore")))
    # documents that hold a benchmark item go
    number = {}
    numbers = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"\w+", t.lower())], np.int64)
    items = [numbers(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(holds(numbers(t), item) for item in items)]
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted((i, np.asarray(enc.encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept)
    got = sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and got == want and len(got) > 50 and sum(g[0] == 9004 for g in got) == 2


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
