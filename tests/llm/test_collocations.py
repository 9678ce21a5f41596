import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import collocations as module
from quillon.llm.collocations import Words, collocations, multikey_counts, op12_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str | None) -> list[list[str]]:
    split = re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))
    return [w for p in split if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows: list[tuple[str | None, str | None]], least: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            f.update((lang, *words[k : k + w]) for w in (1, 2, 3, 4) for k in range(len(words) - w + 1))
    candidates = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    covered = set()
    for p, c in candidates.items():
        for w in range(2, len(p) - 1):
            for k in range(1, len(p) - w + 1):
                inner = (p[0], *p[k : k + w])
                if 100 * c >= 80 * f[inner]:
                    covered.add(inner)
    rows = []
    for p, a in candidates.items():
        if p not in covered:
            cuts = [(2_000_000 * a // ((l := f[p[: k + 1]]) + (r := f[p[0], *p[k + 1 :]])), k, l, r) for k in range(1, len(p) - 1)]
            score, _, l, r = min(cuts)  # noqa: E741
            rows.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def made(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    pick, words = random.Random(seed), "the of a to Be Ünder né 漢字 x1 _ in".split()
    fixed = ["the of a to be in", "A b, c d! THE OF\ta to\vBe x1 x1 x1 x1 x1", "x1 " * 30]
    text = lambda: "".join(pick.choice(words) + pick.choice([" "] * 9 + [". ", ",", "\n", "  ", "\t"]) for _ in range(pick.randint(0, 60)))
    return [(pick.choice(["en", "en", "en", "de", None, ""]), pick.choice([text(), text(), pick.choice(fixed), None, ""])) for _ in range(n)]


def test_words():
    import pyarrow as pa

    texts = ["A b.c  D\n", None, "", "e", "f\x0bg!", " \t", "ÀB x"]
    words = Words(pa.array(texts))
    assert words.coded.to_pylist() == ["a", "b", "c", "d", "e", "f", "g", "Àb", "x"]
    assert words.text.tolist() == [0, 0, 0, 0, 3, 4, 4, 6, 6]
    assert words.follows.tolist() == [False, True, False, True, False, False, False, False, True]


@pytest.mark.parametrize("least", [1, 3, 30])
def test_multikey_quicksort(least):
    pick = np.random.default_rng(least)
    names = pick.integers(1, 6, (3000, 4)).astype(np.uint64)
    names[pick.random(3000) < 0.2, 2:] = 0
    weights = pick.integers(1, 4, 3000)
    found = multikey_counts(names, weights, [least] * 4)
    for d in range(1, 5):
        want = Counter()
        for row, w in zip(names.tolist(), weights.tolist(), strict=True):
            if all(row[:d]):
                want[tuple(row[:d])] += w
        assert dict(zip(map(tuple, found[d - 1][0].tolist()), found[d - 1][1].tolist(), strict=True)) == {p: c for p, c in want.items() if c >= least}
    assert all(len(w) == 0 for _, w in multikey_counts(names[:0], weights[:0], [1] * 4))


@pytest.mark.parametrize(("least", "top", "hot"), [(5, 2000, 1000), (30, 7, 1), (3, 40, 20)])
def test_against_brute_force(spark, monkeypatch, least, top, hot):
    monkeypatch.setattr(module, "SLICE_BYTES", 4000)
    monkeypatch.setattr(module, "MOST_HELD", 500)
    rows = made(least, 600)
    docs = spark.createDataFrame([(*r, "extra", 3) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = collocations(docs, least=least, top=top, hot_pairs=hot).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, least, top))


def test_shared_names_are_done_again(spark, monkeypatch):
    real = module.mixed
    # with the first seed all words of a language have one name
    digest = module.xxhash.xxh64_intdigest
    monkeypatch.setattr(module.xxhash, "xxh64_intdigest", lambda x, seed=0: 7 if seed == 1 else digest(x, seed))
    assert module.mixed is real
    rows = made(11, 200)
    found = collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1), least=4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 4, 2000))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in op12_collocations(spark, sf).collect()) == sorted(brute(rows, 30, 2000))


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
