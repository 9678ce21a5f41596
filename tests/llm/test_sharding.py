import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from quillon.llm import sharding


def best_fit_decreasing(items, capacity):
    """Item by item: the tightest bin that holds it."""
    bins = []
    for size in sorted(items, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= size]
        if fits:
            bins[min(fits, key=lambda b: (bins[b], b))] -= size
        else:
            bins.append(max(capacity, size) - size)
    return sorted(bins)


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 80))
def test_histogram_packing_equals_item_by_item(items, capacity):
    cells = [(s, 0, n) for s, n in Counter(items).items()]
    runs = sharding.pack_fixed(cells, capacity)
    used, ranks = defaultdict(int), defaultdict(list)
    for size, _, first, last, b in runs:
        used[b] += size * (last - first + 1)
        ranks[size] += range(first, last + 1)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, _, n in cells}
    alone = [b for b in used if used[b] > capacity]
    want = best_fit_decreasing(items, capacity)
    assert len(used) == len(want) and all(used[b] in items for b in alone)
    assert sum(capacity - used[b] for b in used if b not in alone) == sum(want)


@given(st.lists(st.integers(1, 1000), max_size=80), st.integers(1, 8))
def test_fixed_number_of_bins(items, bins):
    cells = [(s, s % 2, n) for s, n in Counter(items).items()]
    runs = sharding.pack_into(cells, bins)
    ranks, used = defaultdict(list), Counter()
    for size, salt, first, last, b in runs:
        ranks[size, salt] += range(first, last + 1)
        used[b] += size * (last - first + 1)
        assert 0 <= b < bins
    assert {k: sorted(r) for k, r in ranks.items()} == {(s, t): list(range(n)) for s, t, n in cells}


def test_assign(spark):
    rng = random.Random(3)
    texts = [None, "", "é漢", "same" * 50] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = [(i, texts[i % len(texts)] if i < 400 else texts[3], "x") for i in range(500)] + [(None, None, "x"), (7, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = sharding.assign(docs, shards=16).collect()
    assert len(got) == len(rows)
    by_id = dict((r[0], r[1]) for r in rows)
    shards, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        text = by_id[r.doc_id] or ""  # null and empty texts are one group
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        shards[text].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    big = load[next(iter(shards[texts[3]]))]
    others = [n for n in load.values() if n != big]
    assert max(others) - min(others) <= 402


def test_query_against_its_rules(spark):
    """Every row of sf0.01 once, equal texts together, no gaps, sizes near equal, and the tree's packing of the query's items."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.op3_bin_packing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    shards, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        text = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        shards[text].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(len(x) == 1 for x in shards.values()) and set(load) == set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) <= 1.01 * min(load.values())


def test_bins_against_plain_packing_of_all_groups(spark):
    """The query's bins at sf0.1 are those of best-fit-decreasing over every group with its own size."""
    sf = "/root/testdata/sf0.1"
    load, sizes = Counter(), Counter()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in sharding.op3_bin_packing(spark, sf).select("doc_id", "shard", "size").collect():
        load[r.shard] += r.size
        sizes[texts[r.doc_id]] += r.size
    even = sum(sizes.values()) / 16
    assert max(sizes.values()) < even  # no group needs a bin alone, so one capacity holds for all
    capacity, step = -(-sum(sizes.values()) // 16), 1
    while len(want := best_fit_decreasing(sizes.values(), capacity)) > 16:
        capacity, step = capacity + step, 2 * step
    assert sorted(capacity - n for n in load.values()) == want


def test_parts_and_salts(spark, monkeypatch):
    """Few bins for each part and few groups for each salt: shards of all parts are numbered on."""
    monkeypatch.setattr(sharding, "RANKED", 3)
    monkeypatch.setattr(sharding, "PART_BINS", 2)
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(900)] + [(2000, "x" * 5000), (2001, None)]
    got = sharding.assign(spark.createDataFrame(docs, "doc_id bigint, text string"), capacity=2000).collect()
    load, seen = Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        seen[dict(docs)[r.doc_id] or ""].add(r.shard)
    assert len(got) == len(docs) and set(load) == set(range(len(load))) and all(len(x) == 1 for x in seen.values())
    assert sum(n > 2000 for n in load.values()) == 1 and len(load) <= sum(load.values()) / 2000 * 1.5 + 1


def test_fixed_capacity_and_empty(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 9 + 1) + str(i)) for i in range(100)], "doc_id bigint, text string")
    load = Counter()
    for r in sharding.assign(docs, capacity=60).collect():
        load[r.shard] += r.size
    total = sum(load.values())
    assert max(load.values()) <= 60 and len(load) <= total / 60 * 1.3 + 1
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string"), shards=16).count() == 0
