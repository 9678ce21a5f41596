import itertools
import random
import re

import numpy as np

from quillon.llm import decontaminate as dc


def test_masks_hit_every_window():
    for n in range(1, dc.WINDOW + 1):
        for bad in itertools.combinations(range(n), n * dc.MAX_DIFFER_PCT // 100):
            hits = [o for m in dc.masks_for(n) for o in range(n - len(m) + 1) if not any(m[p - o] == "1" for p in bad if o <= p < o + len(m))]
            assert hits, (n, bad)


def brute(doc, item):
    d, i = (dc.WORD.findall((x or "").lower()) for x in (doc, item))
    w = min(dc.WINDOW, len(i))
    if not i:
        return False
    return any(5 * sum(d[a + k] != i[b + k] for k in range(w)) <= w for a in range(len(d) - w + 1) for b in range(len(i) - w + 1))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 6, 7, 8, 9, 11, 13, 20, 40]))) for i in range(25)] + [(90, None), (None, text(20)), (91, "?"), (92, "w3 w4"), (93, "only"), (24, text(9))]
    docs = []
    for k in range(150):
        words = text(rng.choice([0, 5, 30, 80])).split()
        planted = (items[rng.randrange(25)][1]).split()
        for _ in range(rng.randrange(5)):
            planted[rng.randrange(len(planted))] = "other"
        cut = planted[rng.randrange(3) :]
        docs.append((k, ", ".join(words[:10] + cut + words[10:]).upper(), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, items[7][1], "x"), (3, docs[3][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    want = sorted((str(d), i) for d, t, _ in docs for i, x in items if i is not None and brute(t, x))
    assert len(want) > 30
    for bits in (1 << 29, 8 * dc.PAGE_BITS):
        monkeypatch.setattr(dc, "MOST_FILTER_BITS", bits)
        monkeypatch.setattr(dc, "BITS_PER_SEED", 64 if bits > 1 << 20 else 4096)
        assert sorted((str(r.doc_id), r.item_id) for r in dc.find(frame, bench).collect()) == want
        clean = dc.keep_clean(frame, bench)
        assert clean.columns == frame.columns
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t, _ in docs if not any(brute(t, x) for i, x in items if i is not None))


def test_filter_lets_all_of_its_seeds_through():
    rng = np.random.default_rng(1)
    seeds, others = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    filter_ = np.zeros(1 << 16, np.uint8)
    for place in np.concatenate([dc.probe(seeds, 1 << 19, k) for k in range(dc.PROBES)]):
        filter_[place >> np.uint64(3)] |= 1 << int(place & np.uint64(7))
    assert dc.passing(seeds, filter_).tolist() == list(range(5000)) and len(dc.passing(others, filter_)) < 25


def test_query_against_brute_force(spark):
    """Each document with each item of sf0.001, all windows on all diagonals, from the whole texts."""
    sf = "/root/testdata/sf0.001"
    number = {}
    read = lambda name, key: [(r[key], np.array([number.setdefault(w, len(number)) for w in re.findall(r"\w+", (r.text or "").lower())], np.int64)) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    items, want = read("benchmark", "item_id"), set()
    for d, words in read("documents", "doc_id"):
        for i, item in items:
            n = min(dc.WINDOW, len(item))
            if n and len(words) >= n:
                equal = np.pad((words[:, None] == item).astype(np.int64), ((1, 0), (1, 0)))
                for x in range(1, len(words) + 1):
                    equal[x, 1:] += equal[x - 1, :-1]
                if (5 * (n - (equal[n:, n:] - equal[:-n, :-n])) <= n).any():
                    want.add((d, i))
    got = [(r.doc_id, r.item_id) for r in dc.op9_decontaminate(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert dc.find(docs, bench).count() == 0 and dc.keep_clean(docs, bench).count() == 1
    assert dc.find(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string")).count() == 0
