import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash
from quillon.llm.connected import components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, fp) pairs."""
    parent = {f: f for _, f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in fps}


def unsigned(x):
    return x & (2**64 - 1)


def test_golay_is_perfect():
    syn = simhash._syndrome(np.arange(1 << 12, dtype=np.uint32))
    at, _, weights = simhash.near_anchors(6)
    assert len(np.unique(syn)) == 2048 and weights[at[:-1]].max() == 3
    assert [int((weights[at[s] : at[s + 1]] <= 3).sum()) for s in range(2048)] == [1] * 2048


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    for f in list(fps):
        for flips in (1, 2, 3, 4, 3):
            x = f
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    frame = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp bigint")
    want = brute_components(list(enumerate(fps)))
    for crowded in (simhash.CROWDED, 1, 0):
        found = {unsigned(r.node): unsigned(r.component) for r in components(simhash.near_links(frame, crowded=crowded)).collect()}
        groups, expected = {}, {}
        for i, f in enumerate(fps):
            groups.setdefault(found.get(f, f), set()).add(f)
            expected.setdefault(want[i, f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_documents(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(10)]
    texts = [None, "", " \n", "One Two", "one\ttwo", "a b c", "É one two three"] + base
    for b in base:
        for n in (1, 1, 2):
            w = b.split()
            for _ in range(n):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(" ".join(w).upper())
    rows = [(1000 - i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (None, base[0], "x"), (None, "only here without an id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t, _ in rows])
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(key((r.doc_id, unsigned(r.fp), r.component_id)) for r in got) == sorted(key((d, brute_fingerprint(t), want[d, brute_fingerprint(t)])) for d, t, _ in rows)


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_similar_documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(150, 500))) for _ in range(40)]
    rows, near = [(i, b, "x") for i, b in enumerate(base)], []
    for i, b in enumerate(base):
        for share in (0.005, 0.01, 0.01, 0.3):
            w = [x if rng.random() > share else "other" for x in b.split()]
            rows.append((1000 + len(rows), " ".join(w), "x"))
            near.append((i, rows[-1][0], jaccard(b, rows[-1][1])))
    rows += [(5000, base[0], "x"), (5001, None, "x"), (5002, "", "x"), (None, base[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    close = [(i, d) for i, d, s in near if s >= 0.85]
    assert len(close) > 60 and sum(got[d] == got[i] == i for i, d in close) >= 0.97 * len(close)
    assert all(got[d] == d for i, d, s in near if s < 0.5) and got[5000] == 0 and got[5002] == 5001
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c in got.values() if c is not None} | {None}


def test_a_repeated_line_links_nothing(spark):
    """Own words each, and one line that makes up 40 % of both texts."""
    rng = random.Random(4)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    line = " ".join(["one footer line of ten words stands on every page"] * 20)
    rows = [(i, f"{own()} {line}") for i in range(12)]
    assert max(jaccard(rows[0][1], t) for _, t in rows[1:]) < 0.05
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(12)]


def test_links_are_exact(spark):
    """Pairs of 0.70 to 0.79 are candidates as well, and groups hold both kinds: no false link, no lost group."""
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(300)]
        for _ in range(6):
            w = list(base)
            for k in rng.sample(range(300), rng.randrange(2, 8)):
                w[k] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    pairs = [(a, b, jaccard(s, t)) for a, s in rows for b, t in rows if a < b]
    assert sum(0.7 <= x < 0.8 for _, _, x in pairs) > 20 and sum(x >= 0.8 for _, _, x in pairs) > 30
    label = list(range(len(rows)))
    for a, b, x in pairs:
        if x >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if c == high else c for c in label]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(label[i] == label[c] for i, c in got.items())


def test_recall_just_above_the_similarity(spark):
    """Pairs at 0.80 to 0.85, of 60, 200 and 500 words, against brute force: at most 1 % are missed."""
    rng = random.Random(12)
    rows, pairs = [], []
    for g in range(600):
        n = (60, 200, 500)[g % 3]
        base = [f"g{g}w{k}" for k in range(n)]
        other = list(base)
        for k in rng.sample(range(n), rng.randrange(max(1, n * 15 // 1000), max(2, n * 24 // 1000))):
            other[k] = "changed"
        x = jaccard(" ".join(base), " ".join(other))
        if 0.8 <= x < 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"recall at 0.80 to 0.85: {found} of {len(pairs)}")
    assert len(pairs) > 150 and found >= 0.99 * len(pairs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_table_against_exact_similarity(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5, 42).tolist()) for r in docs.collect()}
    holders, links = {}, [(i, min(j for j, y in sets.items() if not y)) for i, x in sets.items() if not x]
    for i, x in sorted(sets.items()):
        shared = Counter(j for h in x for j in holders.get(h, ()))
        links += [(i, j) for j, n in shared.items() if 5 * n >= 4 * (len(x) + len(sets[j]) - n)]
        for h in x:
            holders.setdefault(h, []).append(i)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        low, high = sorted((root(i), root(j)))
        label[high] = low
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == {i: root(i) for i in sets}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(-3, 5), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: -3 for i in [-3, *range(5, 40)]}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in brute_components(fps).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, sf).collect()} == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
