import random

import pytest
import regex
from pyspark.sql import functions as F

from quillon.functions import dynamic as D
from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import datasets, heads, placement, review, verifier
from quillon.plans import learned
from quillon.sources import audit, records
from quillon.streaming import stateful, voice

SF = "/root/testdata/sf0.001"


def test_typed_json(spark):
    texts = ["5", "5.5", '"7"', '"x"', "null", '[1, "a"]', '{"a": {"b": "q"}}', "true", "not json", "1e3", '""', "[]", '"+12"', '"1.5"', None, '{"a": 1, "a": 2}']
    v = D.parse(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.kind(v), D.string_value(v), D.double_value(v), D.int_value(v), D.strings(v), D.is_blank(v), D.string_value(D.at(v, "a", "b"))).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert got["5"] == ("int", None, 5.0, 5, [], False, None) and got["5.5"] == ("double", None, 5.5, None, [], False, None)
    assert got['"7"'] == ("string", "7", None, 7, ["7"], False, None) and got['"x"'][3] is None and got["1e3"][3] == 1000
    assert got['[1, "a"]'] == ("array", None, None, None, ["a"], False, None) and got['{"a": {"b": "q"}}'][0::6] == ("object", "q")
    assert all(got[t][5] for t in ("null", "not json", '""', "[]", None)) and not got["true"][5]
    assert got['"+12"'][3] == 12 and got['"1.5"'][3] is None and got["not json"][0] is None


def test_outputs_need_the_right_types(spark):
    texts = ['{"status":"filled","value":5,"count":"3","evidence":[{"segment":"s0001","quote":7}]}', '{"status":"filled","value":"5","count":3,"evidence":[{"segment":"s0001","quote":"q"}],"selections":{"value":"A"}}', "[]", "torn"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(verifier.output_of(F.col("t")).alias("o")).select("o.*").collect()
    assert (out[0].status, out[0].value, out[0]["count"], out[0].evidence[0].quote) == ("filled", None, None, None)
    assert (out[1].value, out[1]["count"], out[1].evidence[0].quote, out[1].selections) == ("5", 3.0, "q", None)
    assert all(o.status is None and o.evidence is None for o in out[2:])


def test_ordered_object(spark):
    rows = [({"b": "1", "a": '"x"', 'q"\\': "[1]"}, ["z", 'q"\\', "b", "b"]), ({}, None), ({"k": None}, [])]
    document = D.ordered_object(F.col("m"), F.col("o"))
    got = spark.createDataFrame(rows, "m map<string,string>, o array<string>").select(document.alias("d"), D.ordered_keys(document).alias("k")).collect()
    assert got[0].d == '{"q\\"\\\\":[1],"b":1,"a":"x"}' and len(got[0].k) == 3 and got[0].k[1:] == ["b", "a"]
    assert (got[1].d, got[2].d) == ("{}", '{"k":null}')


def test_learned_patterns(spark):
    rows = [
        ("Client: AB-114322 · REYES, Daniela", "Client: CD-000001 · Lee (x) ", ("CD-000001", "Lee (x)")), ("MRN 1234567", "MRN 7654321 | Sam", ("7654321", None)),
        ("QZ 99887 - Ann", "QZ\t11223 - Bo", ("QZ\t11223", "Bo")), ("x 12", "x 12", None), ("A.B 123456|Z", "A.B 999999|Y|W", ("999999", "Y|W")), (None, "MRN 1", None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "example string, banner string").withColumn("p", P.propose(F.col("example")))
    got = df.select(P.read_client(F.col("banner"), F.col("p.id"), F.col("p.name")).alias("c")).collect()
    assert [None if r.c is None else tuple(r.c) for r in got] == [r[2] for r in rows]


def test_scan_fails_closed(spark):
    texts = ["call ٢١٢-٥٥٥-٠١٤٢ now", "no data here", None, "", "a@b.org", "plain digits १२३४५६७", "000-00-0000 and 212-555-0142", "x" * 50_000 + " 12/12/2012"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.scrub_scan(F.col("t")).alias("h")).collect()]
    assert [[h.kind for h in hits] for hits in got] == [["phone"], [], [], [], ["email"], ["long_digit_run"], ["phone"], ["date"]]
    assert (got[0][0].start, got[0][0].end) == (5, 17) and got[7][0].start == 50_001


def test_scan_query_against_brute_force(spark):
    """The same patterns by another engine, the overlaps settled from scratch."""
    want = []
    patterns = [(kind, regex.compile(p, 0 if p.startswith(r"\b[A-Z]{2}") else regex.I)) for kind, p in T.SCRUB_PATTERNS]
    for doc in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        found = []
        for rank, (kind, pattern) in enumerate(patterns):
            found += [(rank, m.start(), m.end(), kind, m[0]) for m in pattern.finditer(doc.text or "")]
        taken = [False] * (len(doc.text or "") + 1)
        for _, start, end, kind, text in sorted(found):
            digits = {c for c in text if c in "0123456789"}
            if digits in ({"0"}, {"9"}) or kind == "email" and regex.search(T.RESERVED_EMAIL, text, regex.I) or any(taken[start:end]):
                continue
            taken[start:end] = [True] * (end - start)
            want.append((doc.doc_id, start, end, kind))
    got = learned.f14_hits(spark, SF).collect()
    assert want and sorted((r.doc_id, r.start, r.end, r.kind) for r in got) == sorted(want)


def test_chain_of_any_text(spark, tmp_path):
    """Control characters, quotes, slashes and marks of the chain itself are no changes; one that is made is found."""
    odd = ["\x1f\x00\t", 'say "hash":"","prev":"prev","seq":-1, \\', "</a> é 🙂  ", "plain", "", None]
    rows = [(f"s{k % 2}", f"2026-01-01T00:00:{k:02d}Z", f"event {x}", {"x": x, "b\n": "1"}, k) for k, x in enumerate(odd)]
    audit.write_entries(spark.createDataFrame(rows, "session string, time string, event string, details map<string,string>, k int"), f"{tmp_path}/log", "k")
    log = audit.entries(spark, f"{tmp_path}/log")
    assert sorted((r.session, r.entries, r.reason) for r in audit.verify(log).collect()) == [("s0", 3, None), ("s1", 3, None)]
    changed = log.withColumn("event", F.when(F.col("seq") == 2, "x").otherwise(F.col("event")))
    assert {r.broken_at for r in audit.verify(changed).collect()} == {2}


def test_placement_against_a_loop(spark):
    pick = random.Random(2)
    rows = [(k % 3, k, pick.choice([None, pick.randrange(-500, 20_000)]), pick.choice([0, 10, 900, None])) for k in range(200)]
    got = {(r.s, r.k): (r.start, r.end, r.gap_from) for r in placement.place(spark.createDataFrame(rows, "s int, k int, w bigint, n bigint"), ["s"], ["k"], "w", "n").collect()}
    last = {}
    for s, k, wanted, n in rows:
        start = max(wanted or 0, last.get(s, 0), 0)
        gap = last[s] if s in last and start - last[s] > placement.LEAST_GAP else None
        last[s] = start + (n or 0)
        assert got[s, k] == (start, last[s], gap)


def test_spans_cross_pieces(spark):
    utterances = spark.createDataFrame([(1, 0, 1000, 400), (1, 1, 5000, 600), (1, 2, 9000, 0), (1, 3, 9500, 500), (2, 0, 100, 50)], "s int, k int, start bigint, n bigint")
    pieces = placement.piece_map(utterances, ["s"], ["k"], "start", "n")
    spans = spark.createDataFrame([(1, 0, 100, 300), (1, 1, 300, 1200), (1, 2, 400, 1000), (1, 3, 1400, 9000), (1, 4, 5, 5), (2, 0, 0, 50), (3, 0, 0, 9)], "s int, span int, start bigint, end bigint")
    for bin_length in (7, 400, 100_000):
        got = sorted(tuple(r) for r in placement.to_session_spans(spans, pieces, ["s"], bin_length).collect())
        merged = {}
        for s, span, _, low, high in got:  # a short bin cuts a piece into several
            parts = merged.setdefault((s, span), [])
            if parts and parts[-1][1] == low:
                parts[-1][1] = high
            else:
                parts.append([low, high])
        assert merged == {(1, 0): [[1100, 1300]], (1, 1): [[1300, 1400], [5000, 5600], [9500, 9700]], (1, 2): [[5000, 5600]], (1, 3): [[9900, 10000]], (2, 0): [[100, 150]]}


def test_heads(spark):
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([([2.0, 2.0, -9.0],), ([-1.0, -1.0, 5.0],), ([-3.0, -2.0, -1.0],)], "s array<double>")
    one = [r.x for r in rows.select(heads.choose_one(F.col("s"), names[:2], 1.0, 0.2).alias("x")).collect()]
    assert [x.value for x in one] == ["a", None, None] and abs(one[0].confidence - 0.5) < 1e-4
    many = [r.x for r in rows.select(heads.choose_many(F.col("s"), names, ["a"]).alias("x")).collect()]
    assert [x["values"] for x in many] == [["b"], ["c"], None]
    labels = spark.createDataFrame([("b", ["c", "a"]), (None, None), ("z", ["z"])], "one string, many array<string>")
    got = labels.select(heads.target_one(F.col("one"), names), heads.target_many(F.col("many"), names)).collect()
    assert [tuple(r) for r in got] == [(1, [1, 0, 1]), (3, [0, 0, 0]), (None, [0, 0, 0])]
    with pytest.raises(ValueError):
        heads.option_vectors(spark.range(2000).select("id", F.array(F.lit(1.0)).alias("v")), "id", "v")


def test_policies_for_torn_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"k": 1}\n{"k": \n{"k": 3}\n')
    read = lambda policy: sorted((r.k, r.asDict().get("corrupt")) for r in records.read_records(spark, f"{tmp_path}/a", "k int", policy).filter("k is not null").collect())
    assert read(records.KEEP) == read(records.SKIP) == [(1, None), (3, None)]
    assert [r.corrupt for r in records.read_records(spark, f"{tmp_path}/a", "k int", records.KEEP).filter("k is null").collect()] == ['{"k": ']
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        records.read_records(spark, f"{tmp_path}/a", "k int", records.FAIL).collect()
    assert records.read_records(spark, f"{tmp_path}/none", "k int", missing_is_empty=True).count() == 0


def test_folders(spark, tmp_path):
    for name in ("one/client.wav", "one/worker.mp3", "one/reference.json", "two/client.txt", "two/reference.json", "three/client.FLAC", "four/deep/client.wav", "four/deep/reference.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = records.list_files(spark, str(tmp_path))
    got = records.sessions_of(files, F.lit(f"file:{tmp_path}")).collect()
    assert [(r.name, r.client.rsplit("/")[-1], r.worker.rsplit("/")[-1]) for r in got] == [("one", "client.wav", "worker.mp3")]
    assert {r.name for r in records.sessions_of(files).collect()} == {"one", "deep"}
    assert [r.name for r in records.sessions_of(files, F.lit(f"file:{tmp_path}/four/deep")).collect()] == ["deep"]


def test_carry_over_needs_a_line(spark):
    truths = spark.createDataFrame([(1, f, label, agree, "STATED") for f, label, agree in (("a", ["x", "y"], True), ("b", ["x"], True), ("c", ["x"], True), ("d", None, True), ("e", ["x"], False), ("f", ["x"], True))], "session int, field string, label array<string>, agree boolean, mode string")
    heard = spark.createDataFrame([(1, "a", ["y", "x"]), (1, "f", ["z"])], "session int, field string, value array<string>")
    checks = spark.createDataFrame([(1, "b", True, 2, 2), (1, "c", True, 3, 2), (1, "e", True, 1, 2), (1, "f", True, 1, 2)], "session int, field string, yes boolean, line int, n_lines int")
    out = datasets.carry_over(truths, heard, checks)
    assert {r.field: (r.agree, r.verified) for r in out.collect()} == {"a": (True, None), "b": (True, "targeted L2"), "c": (False, None), "d": (True, None), "e": (False, None), "f": (False, None)}
    assert tuple(datasets.kept_share(out).first()) == (1, 3, 5, 0.6)


def frames_of(seed: int, n: int) -> list[tuple[int, float]]:
    pick, out = random.Random(seed), []
    while len(out) < n:
        loud = pick.random() < 0.5
        out += [(-20.0 - pick.random() * 9 if loud else -75.0 - pick.random() * 9) for _ in range(pick.choice([1, 3, 20, 60, 900]))]
    return list(enumerate(out[:n]))


def segments_by_rule(frames: list[tuple[int, float]]) -> list[tuple[float, float]]:
    """Utterances by scanning forward from each onset, without a machine."""
    db, out, at, floor, held = [x for _, x in frames], [], 0, -90.0, 0
    onsets = 0
    while at < len(db):
        loud = db[at] > max(floor + 9, -50)
        floor = min(max(db[at] if db[at] < floor else floor + (db[at] - floor) * 0.02, -90), -30)
        held, onsets, at = min(held + 1, 15), onsets + 1 if loud else 0, at + 1
        if onsets < 2:
            continue
        first, begin, speech, quiet, last = at - held, at, 2, 0, at
        energies = [-90.0] * held
        while True:
            if at == len(db):
                if speech >= 10:
                    out.append((first, min(at, last + 10)))
                return [(round(a * 0.02, 4), round(b * 0.02, 4)) for a, b in out]
            loud = db[at] > max(floor + 9, -50)
            energies.append(db[at])
            at += 1
            speech, quiet, last = (speech + 1, 0, at) if loud else (speech, quiet + 1, last)
            if quiet >= 35:
                if speech >= 10:
                    out.append((first, min(at, last + 10)))
                break
            if at - first >= 1500:
                window = energies[-100:]
                cut = at - 100 + window.index(min(window)) + 1
                out.append((first, cut))
                energies = energies[cut - first :]
                first, speech, last = cut, sum(e > -50 for e in energies), at
        assert begin <= at
        held = onsets = 0
    return [(round(a * 0.02, 4), round(b * 0.02, 4)) for a, b in out]


def test_voice_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = [(f"k{s}", n, db) for s in range(3) for n, db in frames_of(s, 4000)]
    frames = spark.createDataFrame(rows, "key string, frame_no bigint, db double").withColumn("at", F.timestamp_millis(F.col("frame_no") * 20 + 1_700_000_000_000))
    want = sorted((f"k{s}", *span) for s in range(3) for span in segments_by_rule(frames_of(s, 4000)))
    batch = stateful.run_batch(frames.select("key", "frame_no", "db"), ["key"], "frame_no", stateful.VoiceSegments)
    assert want and sorted((r.key, r.start, r.end) for r in batch.collect()) == want

    def play(low: int, high: int, late: bool = False) -> None:
        some = frames.filter(F.col("frame_no").between(low, high - 1))
        if late:  # another key moves event time on, so that the others are ended by their timers
            some = some.unionByName(spark.createDataFrame([("end", 0, -80.0)], "key string, frame_no bigint, db double").withColumn("at", F.timestamp_millis(F.lit(1_700_010_000_000))))
        some.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = voice.voice_stream(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in"), ["key"])
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    play(0, 1777)
    play(1777, 3000)  # each call is a new query that goes on from the checkpoint
    play(3000, 4000, late=True)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.key, r.start, r.end) for r in out.filter("kind = 'utterance'").collect()) == want
    settled = out.filter("kind = 'settled' and key <> 'end'").groupBy("key").agg(F.count("*").alias("n"), F.max("start").alias("to")).collect()
    assert all((r.n, r.to) == (4, 80.0) for r in settled) and len(settled) == 3


def test_voice_query_against_the_rule(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    want, by = [], {}
    for e in events:
        db = -20.0 - e.event_id % 11 if e.event_type in ("click", "view") else -70.0 - e.event_id % 13
        by.setdefault(e.user_id, []).extend([db] * 10)
    for user, db in by.items():
        want += [(user, *span) for span in segments_by_rule(list(enumerate(db)))]
    assert want and sorted((r.user_id, r.start, r.end) for r in learned.t01_t03_voice(spark, SF).collect()) == sorted(want)


def test_probe_errors(spark):
    schema = "s int, speaker string, start double, end double, text string"
    lines = spark.createDataFrame([(1, "client", 0.0, 1.0, "one two three four"), (1, "client", 2.0, 3.0, "five six"), (1, "client", 9.0, 10.0, "too late"), (1, "worker", 0.0, 1.0, "hello"), (2, "client", 0.0, 1.0, "x")], schema)
    heard = spark.createDataFrame([(1, "client", 5.2, 6.0, "one two three"), (1, "client", 8.5, 9.0, "six"), (1, "worker", 20.0, 21.0, "hello")], schema)
    got = {(r.s, r.speaker): (round(r.wer, 4), r.missed) for r in review.probe_errors(lines, heard, "s", 5.0, 10.0).collect()}
    assert got == {(1, "client"): (0.3333, 1), (1, "worker"): (0.0, 1), (2, "client"): (1.0, 1)}


def test_verifier_broadcasts_no_text(spark):
    """Of its joins only that with the fields may go through the driver, whatever the files' size says."""
    s = spark.createDataFrame([(1, "s0001", 0, "client", "one two three four five six seven")], "session long, segment_id string, seq int, speaker string, text string")
    e = spark.createDataFrame([("a", 0, 1, 0, "two three four five six seven")], "answer_id string, ordinal int, session long, seq int, quote string")
    for out in (verifier.find_quotes(s, e), verifier.relocate_all(s, e), verifier.verify(s, spark.createDataFrame([("a", 1, "client", True, False)], "answer_id string, session long, wanted_speaker string, positive boolean, questionnaire boolean"), e.drop("session"))):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 1
