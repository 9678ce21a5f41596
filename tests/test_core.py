import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import values as V
from quillon.operators import forms, review, scoring, timeline, verifier
from quillon.plans import verification
from quillon.sources import transcripts
from quillon.streaming import live, stateful


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_word_error_rate():
    assert T.error_rate("the cat sat", "the bat sat") == pytest.approx(1 / 3)
    assert T.error_rate("the cat sat", "cat sat down") == pytest.approx(2 / 3)
    assert T.error_rate("I've been LOW.", "i've been low") == 0
    assert T.error_rate("", "") == 0 and T.error_rate("", "x") == 1


@pytest.mark.parametrize(("text", "negated", "affirmed"), [
    ("No. None of that.", True, False), ("Um, no", True, False), ("Yeah.", False, True), ("Yes. Yeah, that's fine.", False, True),
    ("Yes, that's it", False, True), ("Yes, Fairhaven.", False, False), ("nothing much to say about it all", False, False), ("", False, False), (None, False, False),
])
def test_short_answers(spark, text, negated, affirmed):
    assert bool(one(spark, T.is_negated_short_answer(F.col("t")), t=text)) == negated
    assert bool(one(spark, T.is_bare_affirmation(F.col("t")), t=text)) == affirmed


def test_text_functions(spark):
    assert one(spark, T.normalize(F.col("t")), t="Don’t  STOP—now!") == "dont stop now"
    assert one(spark, T.normalize(F.col("t")), t="Café ＡＢ e\u0301 Straße Ĳ") == "cafe ab e strasse ĳ"
    assert one(spark, T.contains_words(F.col("a"), F.col("b")), a="nothing at all", b="no") is False
    assert one(spark, T.spelled_numbers_as_digits(F.col("t")), t="twenty-one, four and seventy") == "21 4 and 70"
    assert one(spark, T.parse_date(F.col("t")), t="March 3rd, 1989") == "1989-03-03"
    assert one(spark, T.parse_date(F.col("t")), t="2/30/2020") is None
    assert one(spark, T.is_iso_date(F.col("t")), t="2023-02-29") is False
    assert one(spark, T.parse_clock(F.col("t")), t="1:02:03") == 3723.0 and one(spark, T.parse_clock(F.col("t")), t="1:75") is None
    assert one(spark, T.is_newer(F.col("a"), F.col("b")), a="1.10", b="1.9.5") is True
    assert one(spark, T.normalize_label(F.col("t")), t="  First  Name *: ") == "first name"
    assert one(spark, T.contains_token(F.col("a"), F.col("b")), a="id A12, x", b="A12") is True and one(spark, T.contains_token(F.col("a"), F.col("b")), a="xA12", b="A12") is False
    assert one(spark, T.is_negative_option(F.col("v"), F.col("l"), F.lit(None).cast("string")), v="x", l="Not at all") is True
    assert one(spark, F.size(T.pii_hits(F.col("t"))), t="call 212-555-0199 or 212-444-1234, a@b.co, x@mail.example.com") == 2
    assert [h[2] for h in T.scrub_hits("mail a@b.co or 123-45-6789 on 1/2/2020")] == ["email", "ssn", "date"]
    text = "MRN 1234567 at 12 Main Street, Springfield, IL 62704 born March 3rd, 1989"
    assert [(text[a:b], kind) for a, b, kind in T.scrub_hits(text)] == [("MRN 1234567", "record_number"), ("12 Main Street", "street_address"), ("IL 62704", "zip"), ("March 3rd, 1989", "date")]
    assert T.scrub_hits("000-00-0000, 99/99/9999, AB-000000, x@mail.example.com, y@host.test, PHQ-9 past 2 weeks") == []
    assert [k for _, _, k in T.scrub_hits("P.O. Box 12, zip code: 12345, (212) 555-0142, #48213, 3rd of May 1980")] == ["street_address", "zip", "phone", "record_number", "date"]
    ids = {"input-2024": False, "1stName": False, "deadbeef": False, "ext-gen42": True, "mat-input-7": True, ":r3:": True, "a12345": True, "first_name": False, "deadbeefdead": True}
    assert {i: one(spark, T.is_generated_id(F.col("t")), t=i) for i in ids} == ids


def test_forbidden_controls_and_attestations(spark):
    rows = [("button", None, True, None, False), ("button", None, False, None, False), ("button", "button", True, None, False), ("button", "submit", False, None, False), ("input", "image", True, None, False),
            ("input", "reset", True, None, False), ("a", None, False, "/next", False), ("a", None, False, None, False), ("div", None, True, None, True)]
    df = spark.createDataFrame(rows, "tag string, type string, in_form boolean, href string, bar boolean")
    got = [r[0] for r in df.select(V.is_forbidden_control(*map(F.col, df.columns))).collect()]
    assert got == [True, False, False, True, True, False, True, False, True]
    labels = spark.createDataFrame([("Name", ["a"]), ("I ATTEST that", []), ("Done", ["Electronically signed"]), ("I acknowledge", ["under penalty"])], "label string, options array<string>")
    assert [r[0] for r in labels.select(V.is_attestation(F.col("label"), F.col("options"))).collect()] == [False, True, True, False]


def test_normalise_proposal(spark):
    kinds = "intent string, mode string, evidence_speaker string, option_semantics map<string,string>, max_chars int"
    rows = [(("say", "narrative", "client", {"a": "x", "z": "y"}, 9000), "select", ["a"]), (("say", "narrative", "client", None, 0), "text", []), (("", "discrete", None, None, None), "text", []),
            (("say", "derived", None, None, None), "text", []), (("say", "skip", "client", {"a": "x"}, 5), "select", ["a"]), (("say", "discrete", "nobody", {"z": "y"}, 7), "radio_group", ["a"])]
    df = spark.createDataFrame(rows, f"p struct<{kinds.replace(' ', ':').replace(',:', ', ')}>, kind string, options array<string>")
    got = [r[0] and tuple(r[0]) for r in df.select(V.normalise_proposal(F.col("p"), F.col("kind"), F.col("options"))).collect()]
    assert got == [("say", "discrete", "client", {"a": "x"}, None), ("say", "narrative", "any", None, 1), None, None, ("say", "skip", "any", None, None), ("say", "discrete", "any", None, None)]


def test_overlaps_do_not_depend_on_row_order(spark):
    rows = [(i % 3, float(i), i + 0.4, None) for i in range(60)] + [(1, 7.0, 7.4, None)]
    left = spark.createDataFrame(rows, "k int, start double, `end` double, extra string").repartition(7)
    right = spark.createDataFrame([(1, 6.9, 7.1)], "k int, start double, `end` double")
    assert [(r.k, r.start) for r in timeline.overlapping(left, right, ["k"], 5.0).collect()] == [(1, 7.0)] * 2
    assert timeline.overlapping(left, right, ["k"], 5.0, how="left_anti").count() == 59


def test_bleed_and_numbering(spark):
    rows = [("client", 10.0, 14.0, "I have been feeling low all week"), ("worker", 10.5, 13.5, "I have been feeling low all week"), ("worker", 0.0, 3.0, "Can you hear me? Yes."), ("worker", 11.0, 12.0, "Sorry, go ahead.")]
    s = spark.createDataFrame([("s", *r) for r in rows], 'session string, speaker string, start double, "end" double, text string'.replace('"', "`"))
    kept = timeline.without_bleed(s, ["session"], "worker", "client")
    assert sorted(r.text for r in kept.collect() if r.speaker == "worker") == ["Can you hear me? Yes.", "Sorry, go ahead."]
    ids = timeline.number_segments(s, ["session"], ["start", F.when(F.col("speaker") == "worker", 0).otherwise(1)]).orderBy("seq").collect()
    assert [r.segment_id for r in ids] == ["s0001", "s0002", "s0003", "s0004"] and ids[0].speaker == "worker"


def test_session_time(spark):
    pieces = spark.createDataFrame([("s", 0.0, 5.0, 10.0), ("s", 10.0, 40.0, 5.0)], "session_id string, stream double, session double, length double")
    points = spark.createDataFrame([("s", 2.0), ("s", 10.0), ("s", 30.0), ("t", 1.0)], "session_id string, t double")
    got = {(r.session_id, r.t): r.session_time for r in timeline.to_session_time(points, pieces, ["session_id"], "t").collect()}
    assert got == {("s", 2.0): 7.0, ("s", 10.0): 40.0, ("s", 30.0): 45.0, ("t", 1.0): 1.0}


def test_queue_drops_the_oldest(spark):
    rows = [("c", i, "speech", i * 4.0, i * 4.0 + 4) for i in range(4)] + [("c", 4, "silence", None, 16.0), ("c", 5, "silence", None, 17.0)] + [("c", 6 + i, "take", None, None) for i in range(4)]
    df = spark.createDataFrame(rows, "speaker string, n int, kind string, start double, `end` double")
    machine = type("Small", (stateful.BoundedQueue,), {"capacity": 10.0})
    got = [(r.event, r.start if r.event != "silence" else r.end) for r in stateful.run_batch(df, ["speaker"], "n", machine).collect()]
    assert got == [("gap", 0.0), ("gap", 4.0), ("speech", 8.0), ("speech", 12.0), ("silence", 17.0)]


def test_pressure(spark):
    fills = [0.1, 0.6, 0.7, 0.96, 0.5, 0.2, 0.97, 0.1]
    df = spark.createDataFrame([("w", i, f) for i, f in enumerate(fills)], "speaker string, n int, fill double")
    assert [r.event for r in stateful.run_batch(df, ["speaker"], "n", stateful.Pressure).collect()] == ["degraded", "alert", "recovered", "degraded", "alert", "recovered"]


def _frames(seed=1):
    rng = np.random.default_rng(seed)
    loud = np.zeros(4000, bool)
    for a, b in ((100, 160), (300, 304), (500, 2600), (3000, 3100)):
        loud[a:b] = True
    return [("c", i, float(-20 + rng.normal() if x else -70 + rng.normal())) for i, x in enumerate(loud)]


def test_voice_segments_in_stream_and_batch(spark, tmp_path):
    schema = "speaker string, frame_no int, db double"
    frames = _frames()
    batch = stateful.run_batch(spark.createDataFrame(frames, schema), ["speaker"], "frame_no", stateful.VoiceSegments)
    want = sorted((r.start, r.end) for r in batch.collect())
    assert len(want) >= 3 and all(e - s <= 30.01 for s, e in want) and not any(5.9 < s < 6.2 for s, _ in want)
    for k in range(0, len(frames), 1000):
        spark.createDataFrame(frames[k : k + 1000], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.run_stream(stream, ["speaker"], "frame_no", stateful.VoiceSegments).writeStream.format("memory").queryName("voice").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start, r.end) for r in spark.table("voice").collect()) == want


def test_an_open_utterance_is_flushed(spark, tmp_path):
    schema = "speaker string, frame_no int, db double"
    frames = [(k, i, -20.0 if i >= 50 else -70.0) for k in "ab" for i in range(150 + 50)]
    df = spark.createDataFrame(frames, schema)
    want = [("a", 0.74, 4.0), ("b", 0.74, 4.0)]
    assert sorted(tuple(r) for r in stateful.run_batch(df.repartition(3), ["speaker"], "frame_no", stateful.VoiceSegments).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.run_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["speaker"], "frame_no", stateful.VoiceSegments, 1_000)
    q = stream.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("flushed").count() == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("flushed").collect()) == want


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    write = live.segment_writer(str(tmp_path / "out"))
    df = spark.createDataFrame([("s", 1.0)], "session string, start double")
    for epoch in (0, 1, 1):
        write(df, epoch)
    assert sorted(r.epoch for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# session_date: 2026-09-17\n[00:04] WORKER: Hi there\n\n[00:07] CLIENT: Yes: I can\n[1:00:00] worker: Bye\n")
    lines = transcripts.lines(spark, str(tmp_path))
    got = transcripts.parse_strict(lines).orderBy("seq").collect()
    assert [(r.segment_id, r.speaker, r.start, r.end, r.text) for r in got] == [("s0001", "worker", 4.0, 7.0, "Hi there"), ("s0002", "client", 7.0, 3600.0, "Yes: I can"), ("s0003", "worker", 3600.0, 3601.0, "Bye")]
    assert transcripts.headers(lines).first().headers == {"session_date": "2026-09-17"}
    for bad, message in (("[00:09] WORKER: a\n[00:03] CLIENT: b", "backwards"), ("[0x] WORKER: a", "bad timestamp"), ("[00:01] NURSE: a", "unknown speaker"), ("hello", "expected")):
        (tmp_path / "a.txt").write_text(bad)
        with pytest.raises(Exception, match=message):
            transcripts.parse_strict(transcripts.lines(spark, str(tmp_path))).collect()
    assert transcripts.parse_permissive(transcripts.lines(spark, str(tmp_path)), True).first().text == "hello"
    assert transcripts.parse_permissive(transcripts.lines(spark, str(tmp_path)), False).count() == 0


def test_dialogues_and_grids(spark):
    df = spark.createDataFrame([(1, "lost\n[doctor] Hello\nmore\n[patient] Hi")], "id int, dialogue string")
    got = transcripts.dialogue_turns(df, "id", "dialogue", r"^\s*\[(doctor|patient)\]\s*(.*)$").orderBy("turn").collect()
    assert [(r.speaker, r.text) for r in got] == [("doctor", "Hello more"), ("patient", "Hi")]
    grid = ["xmin = 0", 'text = ""', "xmin = 1.5", 'text = "so <UNSURE>we</UNSURE> <UNIN/> go"', 'text = "on"']
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(grid)], "session string, line_no int, line string")
    assert [(r.start, r.text) for r in transcripts.interval_grid(rows).orderBy("line_no").collect()] == [(1.5, "so we [inaudible] go"), (1.5, "on")]


def test_verifier(spark):
    talk = [("worker", "Any thoughts of harming yourself?"), ("client", "No. None of that."), ("worker", "Do you take sertraline every day?"), ("client", "Yeah."), ("client", "It helps me sleep"), ("client", "through the night, mostly")]
    segments = spark.createDataFrame([("s", i, who, t) for i, (who, t) in enumerate(talk)], "session string, seq int, speaker string, text string")
    cases = {
        "ok": ("client", True, [(4, "helps me sleep")], None), "empty": ("client", True, [], "quote_not_found"), "unknown": ("client", True, [(99, "x")], "segment_not_found"),
        "wrong": ("client", True, [(4, "helps me eat")], "quote_not_found"), "speaker": ("client", True, [(0, "any thoughts")], "speaker_mismatch"),
        "negated": ("client", True, [(0, "thoughts of harming"), (1, "No. None of that.")], "negated_answer"), "bare": ("client", True, [(3, "Yeah.")], "missing_question_context"),
        "bare_ok": ("either", True, [(2, "do you take sertraline"), (3, "Yeah.")], None), "run": ("client", True, [(4, "sleep through the night"), (5, "CLIENT: mostly")], None),
        "negative_ok": ("client", False, [(0, "harming yourself"), (1, "No.")], None), "negative": ("client", False, [(1, "No.")], "missing_question_context"),
    }
    answers = spark.createDataFrame([(k, "s", w, p, False) for k, (w, p, _, _) in cases.items()], "answer_id string, session string, wanted_speaker string, positive boolean, questionnaire boolean")
    evidence = spark.createDataFrame([(k, n, *e) for k, (_, _, es, _) in cases.items() for n, e in enumerate(es)], "answer_id string, ordinal int, seq int, quote string")
    got = {r.answer_id: r.reason for r in verifier.verify(segments, answers, evidence).collect()}
    assert got == {k: c[3] for k, c in cases.items()}
    moved = verifier.relocate(segments, spark.createDataFrame([("a", 0, "s", 1, "do you take sertraline every day"), ("b", 0, "s", 1, "none of that")], "answer_id string, ordinal int, session string, seq int, quote string"))
    assert {r.answer_id: r.seq for r in moved.collect()} == {"a": 2, "b": 1}
    items = verifier.question_answered(segments, [("phq9_9", "Thoughts of harming yourself"), ("med", "Take sertraline every day")])
    assert {r.seq: r.item for r in items.collect()} == {1: "phq9_9", 3: "med", 4: "med", 5: "med"}


def test_verify_outputs(spark):
    talk = [("worker", "Over the last weeks, little interest or pleasure in doing things?"), ("client", "Nearly every day, honestly."), ("worker", "Feeling down, depressed or hopeless?"), ("client", "No, never."),
            ("worker", "How often do you drink?"), ("client", "Two times a week, I would say."), ("worker", "Do you take anything?"), ("client", "Yeah."), ("client", "I take sertraline in the morning and trazodone at night")]
    segments = spark.createDataFrame([("s", f"s{i + 1:04d}", i, who, t) for i, (who, t) in enumerate(talk)], "session string, segment_id string, seq int, speaker string, text string")
    opts = lambda *v: [(x, x.replace("_", " ").lower()) for x in v]
    days = opts("NOT_AT_ALL", "NEARLY_EVERY_DAY")
    fields = [("phq1", "radio_group", "discrete", days, None, "client", None, None), ("phq2", "radio_group", "discrete", days, None, "client", None, None), ("drinks", "select", "discrete", opts("RARE", "OFTEN"), None, "client", None, {"RARE": [0.0, 4.0], "OFTEN": [4.1, 60.0]}),
              ("meds", "checkbox_group", "discrete", opts("NONE", "TRAZODONE", "SERTRALINE"), None, "client", None, None), ("note", "textarea", "narrative", [], None, "any", 30, None), ("since", "date", "discrete", [], None, "any", None, None), ("name", "text", "discrete", [], None, "any", None, None)]
    fields = spark.createDataFrame(fields, "key string, kind string, mode string, options array<struct<value:string,label:string>>, option_semantics map<string,string>, wanted_speaker string, max_chars int, bands map<string,array<double>>")
    ev = lambda *e: [{"segment": s, "quote": q} for s, q in e]
    day, take = ("s0002", "nearly every day"), ("s0009", "I take sertraline in the morning")
    filled = lambda key, **x: (key, json.dumps({"status": "filled"} | x))
    cases = {
        "ok": (filled("phq1", value=" NEARLY_EVERY_DAY ", evidence=ev(day)), ("filled", None, ["NEARLY_EVERY_DAY"])),
        "to_answer": (filled("phq1", value="NEARLY_EVERY_DAY", evidence=ev(("s0001", "nearly every day"))), ("filled", None, ["NEARLY_EVERY_DAY"])),
        "mismatch": (filled("phq2", value="NEARLY_EVERY_DAY", evidence=ev(day)), ("rejected", "question_mismatch", ["NEARLY_EVERY_DAY"])),
        "negated": (filled("phq2", value="NEARLY_EVERY_DAY", evidence=ev(("s0004", "No, never."))), ("rejected", "negated_answer", ["NEARLY_EVERY_DAY"])),
        "no": (filled("phq2", value="NOT_AT_ALL", evidence=ev(("s0004", "CLIENT: No, never."))), ("filled", None, ["NOT_AT_ALL"])),
        "option": (filled("phq1", value="SOMETIMES", evidence=ev(day)), ("rejected", "invalid_option", ["SOMETIMES"])),
        "no_value": (filled("phq1", evidence=ev(day)), ("rejected", "invalid_option", None)),
        "malformed": (("phq1", "{not json"), ("rejected", "malformed_output", None)),
        "no_evidence": (filled("name", value="Ann"), ("rejected", "quote_not_found", ["Ann"])),
        "half_evidence": (filled("name", value="Ann", evidence=[{"segment": "s0001"}]), ("rejected", "quote_not_found", ["Ann"])),
        "nothing": (("phq1", '{"status": "insufficient_evidence"}'), ("insufficient_evidence", None, None)),
        "blank": (filled("name", value="  ", evidence=ev(day)), ("insufficient_evidence", None, None)),
        "date": (filled("since", value="2023-02-29", evidence=ev(day)), ("rejected", "invalid_option", ["2023-02-29"])),
        "band": (filled("drinks", count=2, period="week", evidence=ev(("s0006", "two times a week"))), ("filled", None, ["OFTEN"])),
        "no_band": (filled("drinks", count=900, period="week", evidence=ev(("s0006", "two times a week"))), ("insufficient_evidence", "invalid_option", None)),
        "unknown": (filled("name", value="Ann", evidence=ev(("s0099", "who knows"))), ("rejected", "segment_not_found", ["Ann"])),
        "moved": (filled("name", value="Ann", evidence=ev(("s0003", "take sertraline in the morning and trazodone"))), ("filled", None, ["Ann"])),
        "moved_from_nowhere": (filled("name", value="Ann", evidence=ev(("s0077", "take sertraline in the morning and trazodone"))), ("filled", None, ["Ann"])),
        "boxes": (filled("meds", selections=[{"value": "SERTRALINE", "evidence": ev(take)}, {"value": "NONE", "evidence": ev(take)}, {"value": "X", "evidence": ev(take)}, {"value": "TRAZODONE", "evidence": ev(("s0009", "trazodone at night"))}, {"value": "SERTRALINE"}]), ("filled", "invalid_option", ["TRAZODONE", "SERTRALINE"])),
        "no_boxes": (filled("meds", selections=[{"value": "NONE", "evidence": ev(("s0001", "nobody said that"))}]), ("insufficient_evidence", "quote_not_found", None)),
        "prose": (filled("note", sentences=[{"text": "Takes pills.", "evidence": ev(take)}, {"text": "Lies.", "evidence": ev(("s0001", "not there"))}, {"text": "Drinks.", "evidence": ev(("s0006", "a week"))}, {"text": "Far too long to stay in here.", "evidence": ev(take)}, {"text": "Ok.", "evidence": ev(take)}]), ("filled", "quote_not_found", ["Takes pills. Drinks."])),
        "late_lie": (filled("note", sentences=[{"text": "Takes pills.", "evidence": ev(take)}, {"text": "Far too long to stay in here.", "evidence": ev(take)}, {"text": "Lies.", "evidence": ev(("s0001", "not there"))}]), ("filled", None, ["Takes pills."])),
        "not_discussed": (("name", json.dumps({"discussed": "no"})), ("insufficient_evidence", None, None)),
        "raised": (("meds", json.dumps({"discussed": "yes", "raised_at": ev(("s0007", "do you take anything"))[0], "status": "filled", "selections": [{"value": "SERTRALINE", "evidence": ev(("s0008", "Yeah."))}]})), ("filled", None, ["SERTRALINE"])),
        "not_raised": (("meds", json.dumps({"discussed": "yes", "raised_at": ev(("s0007", "never said"))[0], "status": "filled", "selections": []})), ("rejected", "quote_not_found", None)),
        "bare": (filled("meds", selections=[{"value": "SERTRALINE", "evidence": ev(("s0008", "Yeah."))}]), ("insufficient_evidence", "missing_question_context", None)),
    }
    outputs = spark.createDataFrame([(k, "s", *x) for k, (x, _) in cases.items()], "answer_id string, session string, key string, output string")
    questions = [("phq1", "Little interest or pleasure in doing things"), ("phq2", "Feeling down, depressed, or hopeless")]
    got = {r.answer_id: r for r in verifier.verify_outputs(segments, fields, outputs, questions).collect()}
    assert {k: (r.status, r.reason, r.value) for k, r in got.items()} == {k: c[1] for k, c in cases.items()}
    assert [tuple(e) for e in got["moved"].evidence] == [("s0009", "take sertraline in the morning and trazodone")] and [tuple(e) for e in got["to_answer"].evidence] == [day]
    assert [e.segment for e in got["raised"].evidence] == ["s0007", "s0008"] and [e.segment for e in got["boxes"].evidence] == ["s0009", "s0009"] and got["no_boxes"].evidence == []


def test_edits_against_the_whole_table():
    def table(r, h):
        row = list(range(len(h) + 1))
        for i, a in enumerate(r, 1):
            diagonal, row[0] = row[0], i
            for j, b in enumerate(h, 1):
                diagonal, row[j] = row[j], diagonal if a == b else 1 + min(diagonal, row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for k in range(3000):
        a = [rng.choice("abcdef"[: 1 + k % 6]) for _ in range(rng.randrange(90 if k % 10 == 0 else 12))]
        b = [w for w in a if rng.random() < 0.8] if k % 2 else [rng.choice("abcdef"[: 1 + k % 6]) for _ in range(rng.randrange(12))]
        b = [rng.choice("abxy") if rng.random() < 0.1 else w for w in b]
        assert T.edits(a, b) == table(a, b)


def test_edits_of_long_texts_take_no_whole_table():
    """16 million places of a table took over a second; bits of words take a few hundredths."""
    rng = random.Random(2)
    a = [str(rng.randrange(500)) for _ in range(4000)]
    began = time.process_time()
    assert T.edits(a, a[1::2] + a[::2]) > 1000
    assert time.process_time() - began < 0.5


def test_temper_of_long_arrays(spark):
    """Top and sum are worked out once; for each element anew, 1,500 of them took minutes."""
    p = [((i * 7919) % 1000) / 1000 for i in range(1500)]
    rows = spark.createDataFrame([(p,), ([],), (None,), ([0.0, 0.5],)], "p array<double>")
    began = time.monotonic()
    got = [r[0] for r in rows.select(scoring.temper(F.col("p"), 1.5)).collect()]
    assert time.monotonic() - began < 20
    z = np.log(np.maximum(p, 1e-12)) / 1.5
    e = np.exp(z - z.max())
    assert got[0] == pytest.approx(list(e / e.sum())) and got[1:3] == [[], None] and sum(got[3]) == pytest.approx(1)


def test_transcripts_share_files(spark, monkeypatch, tmp_path):
    """Each transcript had a folder and a file of its own."""
    monkeypatch.setattr(verification, "new_path", lambda *_: str(tmp_path / "out"))
    rows = [(n, t, "user" if t % 2 else "assistant", f"said\f by\n {n}  {t}") for n in [*range(60), None] for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = verification.s01_transcripts(spark, str(tmp_path)).collect()
    want = {(n, t + 1, hashlib.md5(f"said by {n} {t}".encode()).hexdigest()) for n, t, _, _ in rows}
    assert {(r.conv_id, r.seq, r.digest) for r in got} == want and len(got) == len(rows)
    assert len(list((tmp_path / "out").rglob("part-*"))) < 20


def relocation_case():
    """Quotes said once, twice, by a copy, only in part, and with first words that many texts share."""
    rng = random.Random(5)
    same = "you said the last time that we"
    texts = [f"{same} {' '.join(rng.choice('abcd') for _ in range(6))}" for _ in range(60)] + ["Über die Straße's end, we walked on and on", "short words only", "", None] * 2
    talk = [(n, i, "client", texts[(i * (n + 1)) % len(texts)]) for n in range(3) for i in range(70)] + [(9, 1, "client", "alone here are six words exactly"), (9, None, "client", "a place that has no number at all"), (None, 3, "client", "no session has this very text ever")]
    said = [(f"{n}-{i}", 0, n, i + 1, " ".join((t or "").split()[k % 4 : k % 4 + 6 + k % 6])) for k, (n, i, _, t) in enumerate(talk) if n is not None and i is not None]
    said += [("a", 0, 9, 4, "alone here are six words exactly"), ("a", 1, 9, 1, "alone here are six words exactly"), ("b", 0, 9, None, "alone here are six words exactly"), ("c", 0, 9, 4, "alone here are six words inexactly"), ("d", 0, 9, 4, None), ("e", 0, None, 4, "no session has this very text ever"),
             ("f", 0, 9, 4, "CLIENT: a place that has no number at all"), ("g", 0, 8, 4, "alone here are six words exactly"), ("h", 0, 9, 4, "are six words exactly")]
    return talk, said


def test_relocate_against_all_pairs(spark):
    talk, said = relocation_case()
    segments = spark.createDataFrame(talk, "session long, seq int, speaker string, text string")
    evidence = spark.createDataFrame(said, "answer_id string, ordinal int, session long, seq int, quote string")
    e = evidence.withColumn("needle", T.normalize(verifier.strip_line_prefix(F.col("quote")))).filter("size(split(needle, ' ')) >= 6")
    pairs = e.join(segments.select("session", F.col("seq").alias("at"), T.normalize(F.col("text")).alias("plain")), "session").filter(T.contains_words(F.col("plain"), F.col("needle")))
    hits = {}
    for r in pairs.collect():
        hits.setdefault((r.answer_id, r.ordinal), []).append(r.at)
    want = {(a, o): hits[a, o][0] if len(hits.get((a, o), [])) == 1 else at for a, o, _, at, _ in said}
    got = {(r.answer_id, r.ordinal): r.seq for r in verifier.relocate(segments, evidence).collect()}
    assert got == want and len({len(h) for h in hits.values()}) > 2 and sum(want[a, o] != at for a, o, _, at, _ in said) > 20


def test_relocation_sends_no_words_to_the_driver(spark):
    """Files of text are small beside their words, one row each; those of sf0.1 tripled didn't fit a broadcast."""
    plan = verification.j18_j19_relocation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_entities():
    text = "So Dr. Okafor saw Maria Lopez on March 3rd. She takes Zoloft, twenty mg, at the VA. I'm told It works."
    assert review.entities_of(text) == ["okafor", "maria", "lopez", "march", "3rd", "zoloft", "20", "va", "it"]
    assert review.entity_error(text, "so doctor okafor saw maria lopez in march") == pytest.approx(5 / 9)
    assert review.entity_error("On Monday, Monday!", "monday") == pytest.approx(0.5) and review.entity_error("nothing here", "") == 0


def test_score_items_and_derivations(spark):
    fields = spark.createDataFrame([("f", k) for k in ("gad7_10", "gad7_2", "gad7_1", "gad7_total", "gad7_band", "name")], "form string, key string")
    assert {r.score: r.inputs for r in scoring.score_items(fields, "form", "key").collect()} == {k: ["gad7_1", "gad7_2", "gad7_10"] for k in ("gad7_total", "gad7_band")}
    values = spark.createDataFrame([("s", "a", " 7 "), ("s", "b", "8"), ("t", "a", "x"), ("t", "b", "1")], "session string, key string, value string")
    derived = [("band", "phq9_band", ["total"]), ("total", "phq9_total", ["a", "b"]), ("loop", "phq9_total", ["loop"])]
    assert sorted(tuple(r) for r in scoring.derive_all(values, derived, ["session"]).collect()) == [("s", "band", "MODERATELY_SEVERE"), ("s", "total", "15")]


def test_sentence_prefix_and_bands(spark):
    rows = spark.createDataFrame([("a", 1, "12345"), ("a", 2, "123456789"), ("a", 3, "1")], "answer_id string, ordinal int, text string")
    assert [r.ordinal for r in verifier.keep_sentences(rows, 8).collect()] == [1]
    assert one(spark, scoring.band(F.lit(19), scoring.PHQ9), t="") == "MODERATELY_SEVERE" and one(spark, scoring.band(F.lit(22), scoring.GAD7), t="") is None


def test_chain(spark):
    rows = spark.createDataFrame([(k, i, f"e{i}") for k in (1, 2) for i in range(5)], "k int, i int, e string")
    chained = timeline.append_chain(rows, ["k"], ["i"], ["i", "e"])
    assert timeline.broken_chains(chained, ["k"], ["i", "e"]).count() == 0
    torn = chained.filter("not (k = 2 and seq = 3)")
    assert [(r.k, r.first_broken) for r in timeline.broken_chains(torn, ["k"], ["i", "e"]).collect()] == [(2, 4)]


def test_fill_and_undo(spark):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, forms.fill_outcome(c("a"), c("b"), c("d"), c("b"), F.lit(False), F.lit(True)), t="") == "conflict_skipped"
    assert one(spark, forms.fill_outcome(c("a"), c("d"), c("d"), c("x"), F.lit(False), F.lit(True)), t="") == "reverted"
    assert one(spark, forms.undo_outcome(c("a"), c("b"), c("p"), c("p"), F.lit(True)), t="") == "changed_since"


def test_whole_texts_and_tables(spark):
    """The queries named _whole and _sentences leave out no rows and no ends of texts."""
    from quillon.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    chars = table("conversations").selectExpr("sum(length(text))", "max(length(text))").first()
    assert chars[1] > 200 and QUERIES["f13_redact_whole"](spark, sf).selectExpr("sum(n)").first()[0] == chars[0]
    assert QUERIES["p11_p12_sentences"](spark, sf).count() > table("conversations").count()
    long_ = table("benchmark").filter("size(filter(split(text, ' '), w -> w <> '')) >= 5").count()
    assert QUERIES["p05_p07_labels_whole"](spark, sf).filter("questionnaire").count() == long_
    assert QUERIES["a17_a18_derivations_whole"](spark, sf).count() == table("lineitem").select("l_orderkey").distinct().count()
    assert QUERIES["j08_best_tab_whole"](spark, sf).count() == table("pages").selectExpr("regexp_replace(url, '[?#].*$', '')").distinct().count()
