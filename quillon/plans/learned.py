"""Queries of dynamic JSON, learned patterns, timeline placement, scoring heads, record sources and dataset records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dynamic as D
from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.functions import values as V
from quillon.operators import datasets, heads, placement, review, store, verifier
from quillon.plans.verification import _segments
from quillon.sources import records
from quillon.storage import new_path, read_table
from quillon.streaming import stateful

# --- S13, R05: typed JSON -----------------------------------------------------------------------------------------------


def _typed_text():
    """An event as JSON whose ``value`` is a number, its text, a list, an object, a boolean or null by turns."""
    k, number = F.col("event_id") % 8, F.col("value").cast("string")
    value = (
        F.when(k == 0, number).when(k == 1, F.concat(F.lit('"'), number, F.lit('"'))).when(k == 2, F.concat(F.lit('["'), "event_type", F.lit('", "b", 3]'))).when(k == 3, F.lit('{"value": "inner"}'))
        .when(k == 4, F.lit("true")).when(k == 5, F.lit("null")).when(k == 6, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), "event_id", F.lit('"')))
    )
    return F.concat(F.lit('{"id": '), "event_id", F.lit(', "value": '), value, F.when(F.col("event_id") % 97 == 0, "").otherwise("}"))


def s13_typed_json(spark, sf):
    v = D.at(D.parse(_typed_text()), "value")
    rows = read_table(spark, sf, "events").select(
        "event_id", D.kind(v).alias("kind"), D.string_value(v).alias("text"), F.round(D.double_value(v), 6).alias("number"), D.int_value(v).alias("whole"),
        F.array_join(D.strings(v), "|").alias("strings"), D.is_blank(v).alias("blank"), D.string_value(D.at(v, "value")).alias("inner"),
    )
    return rows


def verify_types(spark, sf):
    """One answer for each turn and kind of field: counts with a period, gated answers, dates, options with meanings; by
    turns with values of a wrong type. Every quote is in the cited segment."""
    s = _segments(spark, sf).withColumn("quote", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 1000)).filter("length(quote) > 0")
    words = F.array_join(F.slice(F.split("quote", " "), 1, 8), " ")
    k, here = F.col("session") + F.col("seq"), T.segment_id(F.col("seq") + 1)
    evidence = F.to_json(F.array(F.struct(here.alias("segment"), words.alias("quote"))))
    count = F.when(k % 5 == 0, F.concat(F.lit('"'), k % 9, F.lit('"'))).otherwise((k % 9).cast("string"))
    period = F.get(F.array(*map(F.lit, ("day", "week", "month", "year", "hour"))), (k % 5 + 0).cast("int"))
    date = F.get(F.array(F.lit('"2026-02-28"'), F.lit('"2026-02-30"'), F.lit("20260228"), F.lit('" 2026-03-01 "')), (k % 4).cast("int"))
    option = F.get(F.array(F.lit('"A1"'), F.lit('"B2"'), F.lit('"C3"'), F.lit("1")), (k % 4).cast("int"))
    discussed = F.when(k % 3 == 0, "no").otherwise("yes")
    raised = F.when(k % 4 == 1, F.lit("7")).otherwise(F.to_json(F.struct(here.alias("segment"), words.alias("quote"))))
    output = {
        "often": F.concat(F.lit('{"status":"filled","count":'), count, F.lit(',"period":"'), period, F.lit('","evidence":'), evidence, F.lit("}")),
        "when": F.concat(F.lit('{"status":"filled","value":'), date, F.lit(',"evidence":'), evidence, F.lit("}")),
        "which": F.concat(F.lit('{"status":"filled","value":'), option, F.lit(',"evidence":'), evidence, F.lit("}")),
        "gated": F.concat(F.lit('{"discussed":"'), discussed, F.lit('","raised_at":'), raised, F.lit(',"status":"filled","value":"yes ","evidence":'), evidence, F.lit("}")),
    }
    each = F.array(*[F.struct(F.concat_ws("-", F.lit(key), "session", "seq").alias("answer_id"), "session", F.lit(key).alias("key"), text.alias("output")) for key, text in output.items()])
    options = [(x, f"Option {x}") for x in ("LOW", "MID", "HIGH")]
    fields = [
        ("often", "select", "discrete", options, None, "any", None, {"LOW": [0.0, 3.0], "MID": [3.5, 30.0], "HIGH": [30.0, 300.0]}),
        ("when", "date", "discrete", [], None, "any", None, None),
        ("which", "radio_group", "discrete", [("A1", "First"), ("B2", "Second")], {"B2": "none of these apply"}, "any", None, None),
        ("gated", "text", "discrete", [], None, "any", None, None),
    ]
    fields = spark.createDataFrame(fields, "key string, kind string, mode string, options array<struct<value:string,label:string>>, option_semantics map<string,string>, wanted_speaker string, max_chars int, bands map<string,array<double>>")
    out = verifier.verify_outputs(s.drop("quote"), fields, s.select(F.explode(each).alias("o")).select("o.*"))
    return out.select("answer_id", "status", "reason", F.array_join("value", "|").alias("value"))


# --- F14: personal data -------------------------------------------------------------------------------------------------


def f14_hits(spark, sf):
    """Where personal data stands in documents, of what kind, and what it looks like."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    hits = docs.select("doc_id", "text", F.explode(T.scrub_scan(F.col("text"))).alias("hit"))
    return hits.select("doc_id", F.col("hit.start").alias("start"), F.col("hit.end").alias("end"), F.col("hit.kind").alias("kind"), T.scrub_excerpt(F.col("text"), F.col("hit")).alias("looks"))


# --- F16: learned patterns ----------------------------------------------------------------------------------------------


def f16_patterns(spark, sf):
    """Banners of customers in three layouts; the pattern learned from the first of each nation reads all of them."""
    layout = F.col("c_nationkey") % 3
    number = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    banner = (
        F.when(layout == 0, F.concat(F.lit("Record: "), F.substring("c_mktsegment", 1, 2), F.lit("-"), number, F.lit(" · "), "c_name"))
        .when(layout == 1, F.concat(F.lit("Chart #"), number, F.lit(" | "), "c_name", F.lit(" ")))
        .otherwise(F.concat(F.substring("c_mktsegment", 1, 3), F.lit(" "), number, F.lit(" seen")))
    )
    rows = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", banner.alias("banner"))
    learned = rows.groupBy("c_nationkey").agg(P.propose(F.min_by("banner", "c_custkey")).alias("p"))
    rows = rows.join(learned, "c_nationkey")
    read = P.read_client(F.col("banner"), F.col("p.id"), F.col("p.name"))
    return rows.select("c_custkey", F.col("p.id").alias("id_pattern"), F.col("p.name").alias("name_pattern"), read["id"].alias("id"), read["name"].alias("name"))


# --- T09, T19: the timeline ---------------------------------------------------------------------------------------------


def t09_placement(spark, sf):
    """Events of a user as pieces that last up to two hours; many overlap what is there already."""
    rows = read_table(spark, sf, "events")
    rows = rows.select("event_id", "user_id", (F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000).alias("wanted"), (F.col("event_id") % 7200 * 1000).alias("length"))
    return placement.place(rows, ["user_id"], ["wanted", "event_id"], "wanted", "length").select("event_id", "start", "end", "gap_from")


def t19_pieces(spark, sf):
    """Clicks as utterances; spans of ten minutes of a user's stream, most of which cross several of them."""
    rows = read_table(spark, sf, "events").filter("event_type = 'click'")
    rows = rows.select("event_id", "user_id", (F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000).alias("start"), (F.col("event_id") % 300 * 1000).alias("length"))
    pieces = placement.piece_map(rows, ["user_id"], ["start", "event_id"], "start", "length")
    total = pieces.groupBy("user_id").agg(F.max("stream_to").alias("n"))
    spans = total.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 700_000))).alias("span"))
    spans = spans.select("user_id", "span", (F.col("span") * 700_000).alias("start"), (F.col("span") * 700_000 + 600_000).alias("end"))
    return placement.to_session_spans(spans, pieces, ["user_id"])


# --- T01-T03: voice segments --------------------------------------------------------------------------------------------


def t01_t03_voice(spark, sf):
    """Ten frames for each event of a user, loud for clicks and views; batches and streams run the same machine."""
    from pyspark.sql import Window

    rows = read_table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    loud = F.when(F.col("event_type").isin("click", "view"), -20 - F.col("event_id") % 11).otherwise(-70 - F.col("event_id") % 13)
    frames = rows.select("user_id", F.explode(F.sequence(F.col("n") * 10, F.col("n") * 10 + 9).cast("array<bigint>")).alias("frame_no"), loud.cast("double").alias("db"))
    return stateful.run_batch(frames, ["user_id"], "frame_no", stateful.VoiceSegments)


# --- R31: scoring heads -------------------------------------------------------------------------------------------------


def r31_heads(spark, sf):
    """The first vector of each label as an option; the best option, the several likely ones, and the targets."""
    rows = read_table(spark, sf, "embeddings")
    options = heads.option_vectors(rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")), "label", "v")
    names = [n for n, _ in options]
    scored = rows.select("vec_id", F.col("label").cast("string").alias("label"), heads.logits(F.col("embedding"), options, 4.0).alias("s"))
    one, many = heads.choose_one(F.col("s"), names, 1.0, 0.12), heads.choose_many(F.transform("s", lambda x: x - 0.5), names, names[:1])
    return scored.select(
        "vec_id", one["value"].alias("best"), F.round(one["confidence"], 5).alias("confidence"), F.array_join(many["values"], "|").alias("likely"), F.round(many["confidence"], 5).alias("least_certain"),
        heads.target_one(F.when(F.col("vec_id") % 7 > 0, F.col("label")), names).alias("target"), F.array_join(heads.target_many(F.array("label"), names).cast("array<string>"), "").alias("targets"),
    )


# --- S19, S20, S14, R13: record sources ---------------------------------------------------------------------------------


def s20_policies(spark, sf):
    """Registrations of customers as JSON lines, every ninth of them torn: kept with their text, left out, counted; where
    nothing may be guessed only the readable files of whole nations are read; a path that isn't there is empty."""
    rows = read_table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("line"))
    torn = (F.col("c_custkey") % 9 == 0) & (F.col("c_nationkey") % 2 == 0)
    lines = rows.select("c_nationkey", F.when(torn, F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line")).alias("value"))
    path = new_path(spark, "registrations")
    lines.write.partitionBy("c_nationkey").text(path)
    schema = "c_custkey bigint, c_name string, c_acctbal double"
    nation = F.regexp_extract("path_name", r"c_nationkey=(\d+)/", 1).cast("int").alias("nation")
    kept = records.read_records(spark, path, schema, records.KEEP)
    kept = kept.select(nation, F.when(F.col("corrupt").isNotNull(), "corrupt").otherwise("kept").alias("outcome"), F.coalesce("c_acctbal", F.lit(0.0)).alias("x"))
    skipped = records.read_records(spark, path, schema, records.SKIP).select(nation, F.lit("readable").alias("outcome"), F.col("c_acctbal").alias("x"))
    strict = records.read_records(spark, f"{path}/c_nationkey=[13579]", schema, records.FAIL).select(nation, F.lit("strict").alias("outcome"), F.col("c_acctbal").alias("x"))
    none = records.read_records(spark, f"{path}-none", schema, missing_is_empty=True).select(nation, F.lit("missing").alias("outcome"), F.col("c_acctbal").alias("x"))
    out = kept.unionByName(skipped).unionByName(strict).unionByName(none)
    return out.groupBy("nation", "outcome").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


def s19_folders(spark, sf):
    """Each supplier of a part as a file name in the part's folder: a folder is a session by what lies in it."""
    rows = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    name = F.get(F.array(*map(F.lit, ("client.wav", "worker.M4A", "reference.json", "client.txt", "notes.md", "client.flac", "Client.wav", "worker.mp3"))), (F.xxhash64("l_partkey") * 0 + F.col("l_suppkey") % 8).cast("int"))
    files = rows.select(F.concat(F.lit("/calls/"), "l_partkey", F.lit("/"), name).alias("path_name"))
    return records.sessions_of(files, F.lit("/calls")).select("name", F.regexp_extract("client", r"([^/]*)$", 1).alias("client"), F.regexp_extract("worker", r"([^/]*)$", 1).alias("worker"))


def s14_r13_library(spark, sf):
    """A form for each host of the pages, written as three kinds of files, some torn or missing; listed by name."""
    library = _library(spark, sf)
    return library.select("form", "name", "fingerprint", F.array_join("templates", "|").alias("templates"), records.template_of(F.col("templates"), F.lit("intake")).alias("intake"))


def _hosts(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("origin"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[a-z]+/)", 1).alias("folder"))
    return pages.filter("origin <> ''").groupBy("origin").agg(F.min("page_id").alias("form"), F.min("folder").alias("folder"))


def _library(spark, sf):
    f = _hosts(spark, sf)
    path = new_path(spark, "forms")
    each = {
        "mapping": F.to_json(F.struct("form", F.when(F.col("form") % 3 > 0, F.concat(F.lit("Form "), F.col("form") % 10)).alias("name"), F.concat(F.lit("fp"), F.col("form") % 50).alias("fingerprint"), "origin", F.concat("folder", F.lit("*")).alias("path_pattern"))),
        "profile": F.to_json(F.struct("form", "origin", F.lit("/*").alias("path_pattern"))),
        "templates": F.to_json(F.struct("form", F.when(F.col("form") % 5 > 0, F.array(F.lit("follow_up"), F.lit("intake"))).otherwise(F.array(F.lit("note"))).alias("ids"))),
    }
    for kind, text in each.items():
        torn = F.when(F.col("form") % 11 == 0, F.lit('{"form": ')).otherwise(text) if kind != "templates" else text
        rows = f.filter("form % 7 > 0") if kind == "profile" else f.filter("form % 2 = 0") if kind == "templates" else f
        rows.select(torn.alias("value")).write.text(f"{path}/{kind}")
    read = lambda kind, schema: records.read_records(spark, f"{path}/{kind}", schema).filter("form is not null")
    mappings = read("mapping", "form bigint, name string, fingerprint string, origin string, path_pattern string")
    return records.form_library(mappings, read("profile", "form bigint, origin string, path_pattern string"), read("templates", "form bigint, ids array<string>"))


def r13_lookup(spark, sf):
    """Pages by address, and by the fingerprint that a page of their number would have."""
    library = _library(spark, sf)
    pages = read_table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("fp"), F.col("page_id") % 60).alias("fingerprint"))
    by_print = records.form_by_fingerprint(pages, library).withColumnRenamed("form", "by_fingerprint")
    return records.form_by_address(pages, library).withColumnRenamed("form", "by_address").join(by_print, "page_id")


# --- R33, G11, K14: datasets --------------------------------------------------------------------------------------------


def _dataset(spark, sf):
    turns = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.col("role").alias("speaker"), "text")
    sessions = turns.groupBy("id").agg(F.count("*").alias("minutes")).select("id", F.when(F.col("id") % 3 == 0, "public").otherwise("synthetic").alias("kind"), F.lit("en").alias("language"), "minutes")
    truths = sessions.filter("id % 10 > 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("origin-"), F.col("id") % 20)).alias("origin"))
    said = turns.filter("id % 13 > 0 and turn > 0")
    labels = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("toxic"), F.lit("quality"), F.lit("other")), F.array(F.col("toxic"), F.col("quality"), F.lit(1)))).alias("field", "v"))
    labels = labels.select("id", "field", F.array(F.col("v").cast("string")).alias("value"), (F.col("v") == 1).alias("agreed"), F.when(F.col("id") % 2 == 0, "STATED").alias("mode"), F.when(F.col("v") == 1, F.array(F.lit("1"), F.lit(None))).alias("acceptable"))
    flagged = turns.filter("id % 17 = 5").select("id")
    return datasets.records(sessions, truths, said, labels, flagged, ["quality", "toxic"])


def r33_records(spark, sf):
    r = F.col("record")
    texts = F.md5(F.array_join(F.transform(r["transcript"], lambda t: F.concat(t["speaker"], F.lit(":"), t["text"])), "\n"))
    labels = F.array_join(F.transform(r["labels"], lambda x: F.concat_ws("/", x["field"], F.array_join(x["value"], ","), x["agreed"].cast("string"), x["mode"], F.array_join(x["acceptable"], ","))), ";")
    return _dataset(spark, sf).select("id", "reason", r["group"].alias("grp"), r["split"].alias("split"), r["minutes"].alias("minutes"), F.size(r["transcript"]).cast("bigint").alias("turns"), texts.alias("digest"), labels.alias("labels"))


def k06_manifest_counts(spark, sf):
    return datasets.record_counts(_dataset(spark, sf))


def g11_carry_over(spark, sf):
    """Turns and their restyled version, which loses the order of words of some and drops others: the words that each turn
    is known by are looked for again, and a check for what is missed names the line that has the turn's first words."""
    s = _segments(spark, sf)
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    known = F.array_distinct(F.slice(words, 1, 3))
    k = F.col("session") + F.col("seq")
    truths = s.select("session", F.col("seq").alias("field"), F.when(k % 7 > 0, known).alias("label"), (k % 5 > 0).alias("agree"), F.lit("STATED").alias("mode"))
    heard = s.filter(k % 4 < 3).select("session", F.col("seq").alias("field"), F.when(k % 4 == 0, F.slice(known, 1, 1)).when(k % 7 > 0, F.reverse(known)).alias("value"))
    checks = s.filter(k % 3 == 0).select("session", F.col("seq").alias("field"), (k % 2 == 0).alias("yes"), (F.col("seq") + 1).alias("line"), (k % 6 + 1).alias("n_lines"))
    out = datasets.carry_over(truths, heard, checks)
    share = datasets.kept_share(out).select("session", "kept", "candidates", F.round("share", 6).alias("share"))
    return out.join(share, "session").select("session", "field", "agree", "verified", "kept", "candidates", "share")


def k14_ordered_json(spark, sf):
    """The parts of an order as one JSON object, the keys of its dearest parts first; read back in the order they stand."""
    rows = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey")).groupBy("l_orderkey").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat(F.lit('p"'), F.col("l_linenumber")).alias("k"), F.to_json(F.struct(F.col("l_partkey").alias("part"), F.lit("é").alias("x"))).alias("v"))))).alias("m"),
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.struct((-F.col("l_linenumber")).alias("o"), F.concat(F.lit('p"'), F.col("l_linenumber")).alias("k"))))).alias("first"),
    )
    document = D.ordered_object(F.col("m"), F.concat(F.array(F.lit("absent")), F.transform("first", lambda x: x["k"])))
    rows = rows.select("l_orderkey", document.alias("document"))
    back = F.map_from_entries(F.transform(D.ordered_keys(F.col("document")), lambda k: F.struct(k.alias("k"), F.lit(1))))
    parts = F.from_json("document", "map<string,struct<part:bigint,x:string>>")
    return rows.select("l_orderkey", F.md5("document").alias("digest"), F.array_join(F.map_keys(back), "|").alias("keys"), F.array_join(F.transform(F.map_values(parts), lambda p: p["part"].cast("string")), "|").alias("parts"))


# --- R09, A29, R22, P27: smaller operators --------------------------------------------------------------------------------


def r09_probe(spark, sf):
    """Turns as lines of a reference file; heard two seconds later, every third one late and every third not at all: the missed lines."""
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "worker").otherwise("client").alias("speaker"), "text")
    lines = rows.select("conv_id", "speaker", (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 4).alias("end"), "text")
    late = F.when(F.col("turn") % 3 == 1, 60.0).otherwise(0.0)
    heard = rows.filter("turn % 3 < 2").select("conv_id", "speaker", (F.col("turn") * 5.0 + 2 + late).alias("start"), (F.col("turn") * 5.0 + 6 + late).alias("end"), "text")
    return review.probe_errors(lines, heard, "conv_id", 2.0, 40.0).select("conv_id", "speaker", "missed")


def a29_backlog(spark, sf):
    rows = read_table(spark, sf, "events").select("user_id", F.col("event_type").alias("lane"), F.lit(0).alias("start"), (F.col("event_id") % 30).alias("end"))
    return review.worst_backlog(rows, ["user_id"], "start", "end")


def r22_manifests(spark, sf):
    """Pages as models that users bring, by their address; some names can't be file names."""
    name = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/.."))).when(F.col("page_id") % 7 > 0, F.concat("url", F.lit("/m.gguf?x=1")))
    rows = read_table(spark, sf, "pages").select(name.alias("url"), F.sha2("url", 256).alias("sha256"), F.octet_length("html").alias("size"), F.concat(F.lit("Model "), "page_id").alias("display_name"), F.lit("gguf").alias("format"), F.when(F.col("page_id") % 2 == 0, F.lit(8)).alias("min_ram_gb"))
    return store.custom_manifests(rows).select("display_name", "id", "source", "path", "min_ram_gb")


def p27_topics(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.col("l_partkey") % 5).alias("topic"), (F.col("l_suppkey") % 3 > 0).alias("discussed"), (F.col("l_linenumber") % 4).alias("segment"))
    out = datasets.kept_topics(rows, ["l_orderkey"], 3)
    return out.select("l_orderkey", "segment", F.array_join("never", "|").alias("never"), F.array_join("later", "|").alias("later"))


QUERIES = {
    f.__name__: f
    for f in (
        s13_typed_json, verify_types, f14_hits, f16_patterns, t09_placement, t19_pieces, t01_t03_voice, r31_heads, s20_policies, s19_folders, s14_r13_library, r13_lookup, r33_records, k06_manifest_counts,
        g11_carry_over, k14_ordered_json, r09_probe, a29_backlog, r22_manifests, p27_topics,
    )
}
_BASE = "(epoch_us(ts) // 1000 - 1704067200000)"
_PLACED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {_BASE} AS wanted, event_id % 7200 * 1000 AS length, row_number() OVER (PARTITION BY user_id ORDER BY {_BASE}, event_id) AS rn FROM events),
p AS (SELECT e.*, greatest(wanted, 0) AS "start", greatest(wanted, 0) + length AS "end", NULL::BIGINT AS gap_from FROM e WHERE rn = 1
UNION ALL SELECT e.*, greatest(e.wanted, 0, p."end"), greatest(e.wanted, 0, p."end") + e.length, CASE WHEN greatest(e.wanted, 0, p."end") - p."end" > 50 THEN p."end" END FROM e JOIN p ON e.user_id = p.user_id AND e.rn = p.rn + 1)"""
_PIECES = f"""WITH u AS (SELECT event_id, user_id, {_BASE} AS st, event_id % 300 * 1000 AS length FROM events WHERE event_type = 'click'),
p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY st, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM u),
s AS (SELECT user_id, unnest(range(0, CAST(floor(max(f + length) / 700000) AS BIGINT) + 1)) AS span FROM p WHERE length > 0 GROUP BY user_id)"""
_FORMS = """WITH h AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, min(page_id) AS form, min(regexp_extract(url, '^[a-z]+://[^/?#]+(/[a-z]+/)', 1)) AS folder FROM pages GROUP BY 1 HAVING origin <> ''),
l AS (SELECT form, CASE WHEN form % 3 > 0 THEN 'Form ' || form % 10 ELSE origin || '/*' END AS name, 'fp' || form % 50 AS fingerprint, origin, folder,
CASE WHEN form % 2 > 0 THEN ['standard'] WHEN form % 5 > 0 THEN ['follow_up', 'intake'] ELSE ['note'] END AS templates FROM h WHERE form % 7 > 0 AND form % 11 > 0)"""
_RECORDS = """WITH s AS (SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'public' ELSE 'synthetic' END AS kind, count(*) AS minutes,
CASE WHEN conv_id % 4 = 0 THEN 'origin-' || conv_id % 20 ELSE CAST(conv_id AS VARCHAR) END AS grp FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id AS id, count(*) AS turns, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE conv_id % 13 > 0 AND turn > 0 GROUP BY conv_id),
f AS (SELECT doc_id AS id, field, v, place FROM (SELECT doc_id, unnest([{'field': 'quality', 'v': quality, 'place': 1}, {'field': 'toxic', 'v': toxic, 'place': 2}], recursive := true) FROM labels)),
l AS (SELECT id, count(*) AS n, string_agg(field || '/' || v || '/' || (v = 1) || '/' || CASE WHEN id % 2 = 0 THEN 'STATED' ELSE '' END || '/' || CASE WHEN v = 1 THEN '1,' ELSE '' END, ';' ORDER BY place) AS labels FROM f GROUP BY id),
r AS (SELECT s.id, CASE WHEN s.id % 10 = 0 THEN 'no truth' WHEN t.id IS NULL THEN 'no turns' WHEN s.id % 17 = 5 THEN 'flagged' END AS reason, kind, grp,
CASE WHEN CAST('0x' || substr(sha256(grp), 1, 8) AS BIGINT) % 1000 < 150 THEN 'validation' ELSE 'train' END AS split, minutes, turns, digest, coalesce(labels, '') AS labels, coalesce(n, 0) AS n FROM s LEFT JOIN t USING (id) LEFT JOIN l USING (id))"""
_WORDS = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
_TURNS = f"""WITH c AS (SELECT conv_id AS session, turn AS seq, conv_id + turn AS k, list_distinct({_WORDS}[1:3]) AS known, {_WORDS}[1:1] AS one FROM conversations),
t AS (SELECT *, CASE WHEN k % 7 > 0 THEN list_sort(known) END AS label, k % 5 > 0 AS was, CASE WHEN k % 4 < 3 THEN CASE WHEN k % 4 = 0 THEN one WHEN k % 7 > 0 THEN list_sort(known) END END AS heard FROM c),
a AS (SELECT *, label IS NOT DISTINCT FROM heard AS same, coalesce(was AND label IS NOT NULL AND heard IS NULL AND k % 3 = 0 AND k % 2 = 0 AND seq + 1 BETWEEN 1 AND k % 6 + 1, false) AS found FROM t)"""
_TOKEN = r"(?:([A-Za-z]+)[:#\s]+)?\b([A-Z]{1,4}[- ]?\d{4,}|\d{6,})\b"

ORACLE_SQL: dict[str, str] = {
    "s13_typed_json": """WITH t AS (SELECT event_id, '{"id": ' || event_id || ', "value": ' || CASE event_id % 8 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '"' || CAST(value AS VARCHAR) || '"'
WHEN 2 THEN '["' || event_type || '", "b", 3]' WHEN 3 THEN '{"value": "inner"}' WHEN 4 THEN 'true' WHEN 5 THEN 'null' WHEN 6 THEN CAST(event_id AS VARCHAR) ELSE '"' || event_id || '"' END || CASE WHEN event_id % 97 = 0 THEN '' ELSE '}' END AS text FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(text) THEN json_extract(text, '$.value') END AS v FROM t),
k AS (SELECT event_id, v, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN CASE WHEN CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN 'int' ELSE 'double' END ELSE CASE WHEN v IS NOT NULL THEN 'int' END END AS kind FROM v)
SELECT event_id, kind, CASE WHEN kind = 'string' THEN json_extract_string(v, '$') END AS text, CASE WHEN kind IN ('int', 'double') THEN round(CAST(v AS DOUBLE), 6) END AS number,
CASE WHEN kind = 'int' THEN CAST(CAST(v AS DOUBLE) AS BIGINT) WHEN kind = 'string' AND regexp_full_match(json_extract_string(v, '$'), '[+-]?[0-9]+') THEN CAST(json_extract_string(v, '$') AS BIGINT) END AS whole,
CASE WHEN kind = 'string' THEN json_extract_string(v, '$') WHEN kind = 'array' THEN json_extract_string(v, '$[0]') || '|b' ELSE '' END AS strings,
kind IS NULL OR kind = 'null' AS blank, CASE WHEN kind = 'object' THEN json_extract_string(v, '$.value') END AS inner FROM k""",
    "verify_types": r"""WITH s AS (SELECT conv_id, turn, conv_id + turn AS k FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0),
b AS (SELECT *, CASE k % 5 WHEN 1 THEN k % 9 * 4.345 WHEN 2 THEN k % 9 WHEN 3 THEN (k % 9) / 12 END AS monthly FROM s),
o AS (SELECT *, CASE WHEN monthly BETWEEN 30 AND 300 THEN 'HIGH' WHEN monthly BETWEEN 0 AND 3 THEN 'LOW' WHEN monthly BETWEEN 3.5 AND 30 THEN 'MID' END AS band FROM b)
SELECT 'often-' || conv_id || '-' || turn AS answer_id, CASE WHEN band IS NULL THEN 'insufficient_evidence' ELSE 'filled' END AS status, CASE WHEN band IS NULL THEN 'invalid_option' END AS reason, band AS value FROM o
UNION ALL SELECT 'when-' || conv_id || '-' || turn, CASE WHEN k % 4 IN (0, 3) THEN 'filled' ELSE 'rejected' END, CASE WHEN k % 4 IN (1, 2) THEN 'invalid_option' END, ['2026-02-28', '2026-02-30', NULL, '2026-03-01'][k % 4 + 1] FROM s
UNION ALL SELECT 'which-' || conv_id || '-' || turn, CASE WHEN k % 4 < 2 THEN 'filled' ELSE 'rejected' END, CASE WHEN k % 4 > 1 THEN 'invalid_option' END, ['A1', 'B2', 'C3', NULL][k % 4 + 1] FROM s
UNION ALL SELECT 'gated-' || conv_id || '-' || turn, CASE WHEN k % 3 = 0 THEN 'insufficient_evidence' WHEN k % 4 = 1 THEN 'rejected' ELSE 'filled' END, CASE WHEN k % 3 > 0 AND k % 4 = 1 THEN 'quote_not_found' END, CASE WHEN k % 3 > 0 AND k % 4 <> 1 THEN 'yes' END FROM s""",
    "f16_patterns": r"""WITH b AS (SELECT c_custkey, c_nationkey, CASE c_nationkey % 3 WHEN 0 THEN 'Record: ' || substr(c_mktsegment, 1, 2) || '-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' · ' || c_name
WHEN 1 THEN 'Chart #' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' | ' || c_name || ' ' ELSE substr(c_mktsegment, 1, 3) || ' ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' seen' END AS banner FROM customer),
e AS (SELECT c_nationkey, regexp_extract(arg_min(banner, c_custkey), '""" + _TOKEN + r"""', 1) AS word, regexp_extract(arg_min(banner, c_custkey), '""" + _TOKEN + r"""', 2) AS token FROM b GROUP BY c_nationkey),
p AS (SELECT c_nationkey, CASE WHEN word <> '' THEN word || '[:#\s]+' ELSE '' END || '(' || list_aggregate(list_transform(regexp_extract_all(token, '[A-Z]+|[0-9]+|[^A-Z0-9]'), lambda r: CASE WHEN r SIMILAR TO '[A-Z]+' THEN '[A-Z]{' || length(r) || '}' WHEN r SIMILAR TO '[0-9]+' THEN '\d{' || length(r) || '}' WHEN r = ' ' THEN '\s' ELSE r END), 'string_agg', '') || ')' AS id_pattern,
CASE c_nationkey % 3 WHEN 0 THEN '·\s*(.+)$' WHEN 1 THEN '\|\s*(.+)$' END AS name_pattern FROM e)
SELECT c_custkey, id_pattern, name_pattern, nullif(regexp_extract(banner, id_pattern, 1), '') AS id, CASE WHEN regexp_extract(banner, id_pattern, 1) <> '' AND name_pattern IS NOT NULL THEN trim(regexp_extract(banner, name_pattern, 1)) END AS name FROM b JOIN p USING (c_nationkey)""",
    "t09_placement": _PLACED + ' SELECT event_id, "start", "end", gap_from FROM p',
    "t19_pieces": _PIECES + """, h AS (SELECT s.user_id, span, greatest(span * 700000, f) AS low, least(span * 700000 + 600000, f + length) AS high, st - f AS shift FROM s JOIN p ON s.user_id = p.user_id AND length > 0 AND f < span * 700000 + 600000 AND f + length > span * 700000)
SELECT user_id, span, row_number() OVER (PARTITION BY user_id, span ORDER BY low) - 1 AS part, CAST(low + shift AS BIGINT) AS session_start, CAST(high + shift AS BIGINT) AS session_end FROM h""",
    "r31_heads": """WITH o AS (SELECT CAST(label AS VARCHAR) AS name, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label),
s AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, name, 4 * list_inner_product(CAST(embedding AS DOUBLE[]), v) AS x FROM embeddings, o),
p AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p, 1 / (1 + exp(0.5 - x)) AS q, row_number() OVER (PARTITION BY vec_id ORDER BY name) - 1 AS place FROM s WINDOW w AS (PARTITION BY vec_id)),
g AS (SELECT vec_id, min(label) AS label, CASE WHEN max(p) >= 0.12 THEN arg_max(name, p) END AS best, round(max(p), 5) AS confidence, count_if(q > 0.5) AS n, string_agg(name, '|' ORDER BY name) FILTER (q > 0.5) AS likely, string_agg(name, '|' ORDER BY name) FILTER (q > 0.5 AND place > 0) AS others,
round(min(greatest(q, 1 - q)), 5) AS least_certain, max(CASE WHEN name = label THEN place END) AS place, count(*) AS options, string_agg(CASE WHEN name = label THEN '1' ELSE '0' END, '' ORDER BY name) AS targets FROM p GROUP BY vec_id)
SELECT vec_id, best, confidence, CASE WHEN n > 1 THEN others ELSE likely END AS likely, least_certain, CAST(CASE WHEN vec_id % 7 > 0 THEN place ELSE options END AS INT) AS target, targets FROM g""",
    "s20_policies": """WITH c AS (SELECT c_nationkey AS nation, c_acctbal AS x, c_custkey % 9 = 0 AND c_nationkey % 2 = 0 AS torn FROM customer),
o AS (SELECT nation, CASE WHEN torn THEN 'corrupt' ELSE 'kept' END AS outcome, CASE WHEN torn THEN 0 ELSE x END AS x FROM c UNION ALL SELECT nation, 'readable', x FROM c WHERE NOT torn UNION ALL SELECT nation, 'strict', x FROM c WHERE nation IN (1, 3, 5, 7, 9))
SELECT nation, outcome, count(*) AS n, round(sum(x), 2) AS total FROM o GROUP BY ALL""",
    "s19_folders": """WITH f AS (SELECT DISTINCT l_partkey AS p, ['client.wav', 'worker.M4A', 'reference.json', 'client.txt', 'notes.md', 'client.flac', 'Client.wav', 'worker.mp3'][l_suppkey % 8 + 1] AS name FROM lineitem)
SELECT CAST(p AS VARCHAR) AS name, min(name) FILTER (name IN ('client.wav', 'client.flac')) AS client, min(name) FILTER (name IN ('worker.M4A', 'worker.mp3')) AS worker FROM f GROUP BY p HAVING count_if(name IN ('client.wav', 'client.flac')) > 0 AND count_if(name = 'reference.json') > 0""",
    "s14_r13_library": _FORMS + " SELECT form, name, fingerprint, array_to_string(templates, '|') AS templates, CASE WHEN list_contains(templates, 'intake') THEN 'intake' ELSE templates[1] END AS intake FROM l",
    "r13_lookup": _FORMS + r""", a AS (SELECT page_id, arg_min(form, {'name': name, 'form': form}) AS by_address FROM pages JOIN l ON regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) = origin AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), folder) GROUP BY page_id),
b AS (SELECT page_id, arg_min(form, {'name': name, 'form': form}) AS by_fingerprint FROM pages JOIN l ON fingerprint = 'fp' || page_id % 60 GROUP BY page_id) SELECT page_id, by_address, by_fingerprint FROM pages LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)""",
    "r33_records": _RECORDS + " SELECT id, reason, CASE WHEN reason IS NULL THEN grp END AS grp, CASE WHEN reason IS NULL THEN split END AS split, CASE WHEN reason IS NULL THEN minutes END AS minutes, CASE WHEN reason IS NULL THEN turns END AS turns, CASE WHEN reason IS NULL THEN digest END AS digest, CASE WHEN reason IS NULL THEN labels END AS labels FROM r",
    "k06_manifest_counts": _RECORDS + " SELECT CASE WHEN reason IS NULL THEN kind END AS kind, CASE WHEN reason IS NULL THEN split END AS split, reason, count(*) AS n, sum(CASE WHEN reason IS NULL THEN minutes END) AS minutes, sum(CASE WHEN reason IS NULL THEN n END) AS labels FROM r GROUP BY 1, 2, 3",
    "g11_carry_over": _TURNS + """, s AS (SELECT session, count_if(was AND same OR found) AS kept, count_if(was) AS candidates FROM a GROUP BY session)
SELECT a.session, seq AS field, was AND same OR found AS agree, CASE WHEN found THEN 'targeted L' || (seq + 1) END AS verified, kept, candidates, CASE WHEN candidates > 0 THEN round(kept / candidates, 6) END AS share FROM a JOIN s USING (session)""",
    "k14_ordered_json": """WITH l AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS part FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN n % 2 = 0 THEN -n ELSE n END AS place FROM l)
SELECT l_orderkey, md5('{' || string_agg('"p\\"' || n || '":{"part":' || part || ',"x":"é"}', ',' ORDER BY place) || '}') AS digest, string_agg('p"' || n, '|' ORDER BY place) AS keys, string_agg(CAST(part AS VARCHAR), '|' ORDER BY place) AS parts FROM o GROUP BY l_orderkey""",
    "r09_probe": r"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'worker' ELSE 'client' END AS speaker, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}'']'), lambda x: x <> '')) AS n FROM conversations),
l AS (SELECT *, turn * 5.0 + 2 AS st, turn * 5.0 + 6 AS en FROM t WHERE turn * 5 + 4 < 40), h AS (SELECT *, turn * 5.0 + 2 + CASE WHEN turn % 3 = 1 THEN 60 ELSE 0 END AS st, turn * 5.0 + 6 + CASE WHEN turn % 3 = 1 THEN 60 ELSE 0 END AS en FROM t WHERE turn % 3 < 2)
SELECT conv_id, speaker, count_if(NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = l.conv_id AND h.speaker = l.speaker AND h.st < l.en + 0.5 AND h.en > l.st - 0.5)) AS missed FROM l GROUP BY ALL""",
    "a29_backlog": "SELECT user_id, max(n)::BIGINT AS backlog FROM (SELECT user_id, event_type, sum(event_id % 30) AS n FROM events GROUP BY ALL) GROUP BY user_id",
    "r22_manifests": r"""WITH m AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '/..' WHEN page_id % 7 > 0 THEN url || '/m.gguf?x=1' END AS u, url FROM pages)
SELECT 'Model ' || page_id AS display_name, 'custom-' || substr(sha256(url), 1, 16) AS id, regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1) AS source,
CASE WHEN regexp_matches(regexp_extract(u, '([^/?#]*)(?:[?#].*)?$', 1), '^[A-Za-z0-9._-]+$') AND regexp_extract(u, '([^/?#]*)(?:[?#].*)?$', 1) NOT IN ('.', '..') THEN regexp_extract(u, '([^/?#]*)(?:[?#].*)?$', 1) ELSE 'model.gguf' END AS path, CASE WHEN page_id % 2 = 0 THEN 8 ELSE 0 END AS min_ram_gb FROM m WHERE u IS NOT NULL""",
    "p27_topics": """WITH f AS (SELECT l_orderkey, l_returnflag || l_partkey % 5 AS topic, l_suppkey % 3 > 0 AS discussed, l_linenumber % 4 AS segment FROM lineitem), o AS (SELECT DISTINCT l_orderkey, s.segment FROM f, (VALUES (0), (1), (2)) s(segment))
SELECT l_orderkey, o.segment, coalesce(string_agg(DISTINCT topic, '|' ORDER BY topic) FILTER (NOT discussed), '') AS never, coalesce(string_agg(DISTINCT topic, '|' ORDER BY topic) FILTER (discussed AND f.segment > o.segment), '') AS later FROM o JOIN f USING (l_orderkey) GROUP BY ALL""",
}
