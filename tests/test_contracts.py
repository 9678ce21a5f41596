import json

import pytest
from pyspark.sql import functions as F

from quillon.sources import contracts as C
from quillon.streaming import live


def test_transcripts_and_versions(spark, tmp_path):
    doc = {"schema": "transcript/1", "session_id": "s", "retention": "none", "segments": [{"id": "s0001", "speaker": "worker", "start": 0, "end": 1.5, "text": "Hi"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    rows = C.of_version(C.read_json(spark, str(tmp_path), C.TRANSCRIPT), "transcript/1")
    assert [(r.seq, r.segment_id, r.end, r.confidence) for r in C.segments(rows).collect()] == [(1, "s0001", 1.5, None)]
    with pytest.raises(Exception, match="expected schema transcript/2"):
        C.of_version(C.read_json(spark, str(tmp_path), C.TRANSCRIPT), "transcript/2").collect()
    (tmp_path / "t.json").write_text('{"schema": 1')
    with pytest.raises(Exception, match="(?i)malformed"):
        C.read_json(spark, str(tmp_path), C.TRANSCRIPT).collect()


def test_results_truth_and_forms(spark, tmp_path):
    results = [{"key": "a", "status": "filled", "value": "x"}, {"key": "b", "status": "filled", "value": ["p", "q"]}, {"key": "c", "status": "rejected", "value": "no"}]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "run1.json").write_text(json.dumps(results))
    got = {r.key: (r["values"], r.is_multi) for r in C.field_results(spark, str(tmp_path / "r")).collect()}
    assert got == {"a": (["x"], False), "b": (["p", "q"], True), "c": ([], False)}
    (tmp_path / "synth" / "s1").mkdir(parents=True)
    truth = {"id": "s1", "source": "gen", "labels": {"mood": {"label": "LOW", "agree": True}, "meds": {"label": ["A", "B"], "agree": False, "acceptable": ["A"]}}}
    (tmp_path / "synth" / "s1" / "truth.json").write_text(json.dumps(truth))
    (tmp_path / "synth" / "s1" / "other.json").write_text("{}")
    got = {r.field: (r.folder, r.label, r.agreed) for r in C.truth_labels(spark, str(tmp_path / "synth")).collect()}
    assert got == {"mood": ("s1", ["LOW"], True), "meds": ("s1", ["A", "B"], False)}
    fields = [{"key": "k1", "kind": "text", "label": "L", "computed": False}, {"key": "k2", "kind": "hidden", "label": "H"}, {"key": "k3", "kind": "text", "computed": True}]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.profile.json").write_text(json.dumps({"schema": "p/1", "fingerprint": "1", "fields": fields}))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.mapping.json").write_text(json.dumps({"schema": "m/1", "profile_fingerprint": "2", "name": "X", "fields": {"k1": {"mode": "narrative"}}}))
    forms = C.forms(C.read_json(spark, str(tmp_path / "f"), C.PROFILE), C.read_json(spark, str(tmp_path / "m"), C.MAPPING))
    assert forms.first().drifted is True
    rows = C.fields_with_mapping(forms)
    assert {r.key: r.mapping and r.mapping.mode for r in rows.collect()} == {"k1": "narrative", "k2": None, "k3": None}
    payload = C.egress_payload(rows)
    assert payload.columns == ["form", "ordinal", "key", "step", "kind", "label", "help", "required", "options"] and [r.key for r in payload.collect()] == ["k1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "filled", "x", "train"), ("b", "rejected", "x", "val")], "key string, status string, kind string, split string")
    assert {r.status: r.n for r in C.write_results(rows, str(tmp_path / "r")).collect()} == {"filled": 1, "rejected": 1}
    C.write_dataset(rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).filter("kind = 'x' and split = 'val'").count() == 1
    assert all(len(r.sha256) == 64 and r.bytes > 0 for r in C.manifest(spark, str(tmp_path / "d")).filter(F.col("name").endswith(".json")).collect())


def test_sessions_of_stream_and_batch_agree(spark, tmp_path):
    events = live.as_timestamp(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.speech_sessions(stream, "user_id", "ts", "30 minutes", "10 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = events.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    key = lambda r: (r.user_id, r.start, r.end, r.n)
    batch = sorted(map(key, live.speech_sessions(events, "user_id", "ts", "30 minutes", "10 minutes").filter(F.col("end") <= F.lit(last)).collect()))
    assert sorted(map(key, spark.table("sessions").collect())) == batch and batch


def test_append_segments(spark, tmp_path):
    rows = spark.createDataFrame([("s", "client", 4.2, "b"), ("s", "worker", 1.0, "a")], "session string, speaker string, start double, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.append_segments(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(60)
    view = live.live_view(spark.read.parquet(str(tmp_path / "out")), "session").orderBy("seq").collect()
    assert [(r.segment_id, r.speaker) for r in view] == [("s0001", "worker"), ("s0002", "client")]
