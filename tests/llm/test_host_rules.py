import re
from collections import Counter

from quillon.llm import host_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeated = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


TEXTS = [None, "", " \n\t", "a b c a b c", "a a a a a", "x\nx\n\nx \nx", "#*$%&|<> é 漢 \x0b", "w " * 3000, "one two three four one two three " * 3 + "z"]


def test_measure():
    for t in TEXTS:
        assert host_rules.measure(t) == brute(t)


def test_hosts_lose_all_documents_only_when_most_fail(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    rows = [(i, good, "clean", 1) for i in range(40)] + [(100 + i, bad, "farm", 1) for i in range(30)] + [(200, good, "farm", 1), (201, good, None, 1), (202, good, None, 1), (203, good, None, 1), (None, bad, None, 1)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id bigint, text string, source string, host int")
    got = host_rules.judge(docs).collect()
    assert len(got) == len(rows) + 1
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {*range(40), 201, 202, 203}
    assert {r.doc_id for r in got if not r.base_failed} - kept == {200}
    left = host_rules.keep_good(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept


def test_empty_and_single_host(spark):
    schema = "doc_id bigint, text string, source string"
    assert host_rules.judge(spark.createDataFrame([], schema)).count() == 0
    assert host_rules.keep_good(spark.createDataFrame([], schema)).count() == 0
    one = host_rules.judge(spark.createDataFrame([(1, "a", "s")], schema)).collect()
    assert [(r.base_failed, r.kept) for r in one] == [(True, False)]
