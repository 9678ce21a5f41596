"""Queries of the verifier, the egress scan, sources that are written and read back, and functions on small values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import review as R
from quillon.functions import text as T
from quillon.functions import values as V
from quillon.operators import evaluation, forms, review, scoring, store, timeline, verifier
from quillon.sources import audit, frames, transcripts
from quillon.storage import new_path, read_table

KEY = b"quillon example key"
ITEMS = [("item_a", "That with than this thing"), ("item_b", "From that ered were have tion"), ("item_c", "Nobody ever asks")]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()


def _pick(values, number):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _segments(spark, sf):
    """Conversations as segments: assistants are workers, all others clients."""
    rows = read_table(spark, sf, "conversations")
    return rows.select(
        F.col("conv_id").alias("session"), T.segment_id(F.col("turn") + 1).alias("segment_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "worker").otherwise("client").alias("speaker"), "text",
    )


def f01_fold(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


def f02_contains(spark, sf):
    plain = T.normalize(F.col("text"))
    return read_table(spark, sf, "conversations").select("conv_id", "turn", T.contains_words(plain, F.lit("and")).alias("has_and"), T.contains_words(plain, F.lit("")).alias("has_empty"), T.contains_words(plain, F.lit("that was")).alias("has_two"))


def f03_line_prefix(spark, sf):
    said = F.concat(_pick(["[01:02] s0001 CLIENT: ", "worker:", " [1:02:03] Client : ", "nurse: ", "s001 client: "], F.col("turn")), "text")
    return read_table(spark, sf, "conversations").select("conv_id", "turn", F.md5(verifier.strip_line_prefix(said)).alias("digest"))


def f08_spelled(spark, sf):
    n = F.col("p_size")
    ones = F.element_at(F.array(*map(F.lit, SMALL)), (F.when(n < 20, n).otherwise(n % 10) + 1).cast("int"))
    tens = F.element_at(F.array(*map(F.lit, TENS)), (F.floor(n / 10) + 1).cast("int"))
    words = F.when(n < 20, ones).when(n % 10 == 0, tens).otherwise(F.concat(tens, _pick(["-", " "], F.col("p_partkey")), ones))
    return read_table(spark, sf, "part").select("p_partkey", T.spelled_numbers_as_digits(F.concat(F.lit("Size "), words, F.lit(", say"))).alias("digits"))


def f09_by_mode(spark, sf):
    mode = _pick(["digits", "date", "case_insensitive"], F.col("o_orderkey"))
    text = F.when(mode == "digits", F.concat(F.lit("No. "), "o_orderkey")).when(mode == "date", F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.col("o_orderpriority"))
    return read_table(spark, sf, "orders").select("o_orderkey", R.normalize_by_mode(text, mode).alias("value"))


def f10_word_errors(spark, sf):
    rows = read_table(spark, sf, "part")
    words = F.split("p_name", " ")
    heard = F.array_join(F.when(F.col("p_partkey") % 4 == 0, words).when(F.col("p_partkey") % 4 == 1, F.slice(words, F.lit(2), F.size(words))).when(F.col("p_partkey") % 4 == 2, F.concat(words, F.array(F.lit("extra"))))
                         .otherwise(F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.lit("other")))), " ")
    return rows.select("p_partkey", F.round(T.word_error_rate("p_name", F.upper(heard)), 6).alias("wer"))


def f20_validation(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", T.in_validation(F.col("c_name")).alias("is_val"))


def f21_client_tag(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", V.client_tag(KEY, F.concat(F.lit(" "), F.lower("c_name"), F.lit(" "))).alias("tag"))


def f22_energy(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(T.energy_db(F.col("embedding")), 4).alias("db"))


def f28_to_f44_values(spark, sf):
    """Small functions on the names and numbers of parts."""
    n, parts = F.col("p_size"), F.split("p_name", " ")
    return read_table(spark, sf, "part").select(
        "p_partkey",
        R.answer_agrees(_pick(["", "x", "y"], n), F.array(F.lit(None).cast("string"), F.lit("x"))).alias("agrees"),
        T.normalize_label(F.concat(F.lit("  *"), "p_name", F.lit(" :* "))).alias("label"),
        T.contains_token(F.col("p_name"), F.when(n % 3 == 0, F.concat(parts[1], F.lit("q"))).when(n % 3 == 1, F.upper(parts[1])).otherwise(parts[1])).alias("has_token"), T.contains_token(F.col("p_name"), F.substring(parts[1], 2, 3)).alias("has_part"),
        T.same_values(parts, F.when(n % 2 == 0, F.reverse(parts)).otherwise(F.slice(parts, 1, 1))).alias("same"), T.schema_name(F.concat_ws(".", "p_brand", "p_type")).alias("schema_name"),
        V.json_object_in(F.concat(F.lit("```json "), F.when(n % 4 > 0, F.concat(F.lit("{\"a\": {\"b\": "), n, F.lit("}}"))).otherwise("none"), F.lit(" ```"))).alias("json"),
        T.is_newer(F.concat_ws(".", n, F.col("p_partkey") % 7), F.concat_ws(".", F.lit("25"), F.lit("3"), F.lit("0"))).alias("newer"),
        V.same_address(F.concat("p_brand", F.when(n % 3 == 0, "/").when(n % 3 == 1, "?").otherwise("")), F.col("p_brand")).alias("same_address"), V.same_address(F.concat("p_brand", F.lit("//")), F.col("p_brand")).alias("other_address"),
        R.step_title(F.concat(F.lit("step-"), F.lower(F.element_at(parts, 1)), F.lit("_"), F.lower(F.element_at(parts, 2)))).alias("title"),
        R.low_confidence(F.when(n % 5 > 0, n / 60)).alias("unsure"),
    )


def p07_attestations(spark, sf):
    label = _pick(["I attest that", "Signature of", "Full name", "Sign here", "I acknowledge", "Designation", "Date"], F.col("p_size"))
    options = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Yes"), F.lit("Electronically signed"))).otherwise(F.array(F.col("p_brand")))
    rows = read_table(spark, sf, "part").select("p_partkey", V.is_attestation(label, options).alias("attests"), V.is_attestation(label).alias("label_attests"))
    return rows


def p10_negative_options(spark, sf):
    value = _pick(["NONE", "NO_PAIN", "YES", "PAIN_NONE", "NOTABLE", "not_now", "X"], F.col("p_partkey"))
    label = _pick(["Not at all", "Never", "No pain, really", "Always", "Nothing", "Notable"], F.col("p_size"))
    semantics = F.when(F.col("p_partkey") % 11 == 0, "Negative: rules it out").when(F.col("p_partkey") % 11 == 1, "positive")
    return read_table(spark, sf, "part").select("p_partkey", T.is_negative_option(value, label, semantics).alias("negative"))


def p13_generated_ids(spark, sf):
    k = F.col("p_partkey").cast("string")
    ids = F.array(F.concat(F.lit("input-"), k), F.concat(F.lit(":r"), k, F.lit(":")), F.concat(F.lit("mat-input-"), k), F.concat(F.lit("Ext-Gen"), k), F.substring(F.md5(k), 1, 14), F.col("p_type"), F.concat(F.lit("1st"), k), F.concat(F.lit("p-drop_"), k))
    rows = read_table(spark, sf, "part").select("p_partkey", F.posexplode(ids).alias("n", "id"))
    return rows.select("p_partkey", "n", T.is_generated_id(F.col("id")).alias("generated"))


def p23_forbidden(spark, sf):
    tag, kind = _pick(["button", "input", "a", "BUTTON", "div"], F.col("p_partkey")), _pick(["submit", "", "Image", "button"], F.col("p_size"))
    kind = F.when(F.col("p_partkey") % 7 > 0, kind)
    return read_table(spark, sf, "part").select("p_partkey", V.is_forbidden_control(tag, kind, F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, F.lit("/x")), F.col("p_size") % 17 == 0).alias("forbidden"))


def p24_r19_paths(spark, sf):
    path = F.concat_ws("/", _pick(["a", "..", ".hidden", "a b", "weights-1.bin", "", "x_y"], F.col("p_partkey")), _pick(["b", "c.d", "..", "-x"], F.col("p_size")))
    digest = F.substring(F.sha2("p_name", 256), 1, F.lit(64) - F.col("p_size").cast("int") % 2)
    return read_table(spark, sf, "part").select("p_partkey", V.is_safe_path(path).alias("safe"), V.is_sha256(digest).alias("is_digest"))


def f14_scan(spark, sf):
    """Whether anything in a text looks like personal data, and how many addresses nobody reserved."""
    hits = T.scrub_scan(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", (F.size(hits) > 0).alias("any_hit"), F.size(F.filter(hits, lambda h: h["kind"] == "email")).cast("bigint").alias("n_email"))


def p31_payload_scan(spark, sf):
    """Hits by field and part of a payload whose allowlists differ by part."""
    key = _pick(["f_0123456789", "f_01234567", "name"], F.col("p_partkey"))
    value = _pick(["12", "LINE_988", "AB_123456", "Mary Smith", "00000", "X4", "555-12-3456"], F.col("p_size"))
    label = _pick(["MRN 1234567", "Format: AB-000000", "Call (212) 555-0142", "PHQ-9, past 2 weeks", "me@example.com"], F.col("p_partkey"))
    options = F.array(F.struct(value.alias("value"), label.alias("label")))
    fields = read_table(spark, sf, "part").select(F.col("p_partkey").alias("field_no"), key.alias("key"), F.lit("step 1").alias("step"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 25, label).alias("help"), options.alias("options"))
    return forms.scan_payload(fields, "field_no").select("field_no", "part", "kind", "excerpt")


def p32_gate(spark, sf):
    fields = read_table(spark, sf, "part").select("p_brand", F.col("p_size") == 7, F.col("p_size") == 8).toDF("form", "hit", "withheld")
    return forms.egress_gate(fields, ["form"], "hit", "withheld", F.col("form").endswith("1"), F.col("form").endswith("2"))


def k08_r15_chain(spark, sf):
    rows = timeline.append_chain(read_table(spark, sf, "conversations"), ["conv_id"], ["turn"], ["turn", "role", "text"])
    return rows.select("conv_id", "turn", "seq", "prev", "hash")


def j17_questions(spark, sf):
    return verifier.question_answered(_segments(spark, sf), ITEMS, least=0.3)


def j18_j19_relocation(spark, sf):
    """Each turn's words 3 to 10, cited under its own segment, the next one, or an unknown one."""
    s = _segments(spark, sf)
    quote = F.array_join(F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 3, 8), " ")
    e = s.select(F.concat_ws("-", "session", "seq").alias("answer_id"), F.lit(0).alias("ordinal"), "session", (F.col("seq") + F.col("seq") % 3).alias("seq"), quote.alias("quote"))
    return verifier.relocate(s, e).select("answer_id", F.col("seq").cast("bigint").alias("seq"))


def w12_sentences(spark, sf):
    rows = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("ordinal"), "text")
    return verifier.keep_sentences(rows, 900).select("answer_id", "ordinal")


def w10_runs(spark, sf):
    s = _segments(spark, sf).withColumn("speaker", F.when(F.col("seq") % 5 < 2, "client").otherwise("worker"))
    e = s.filter("seq <> 3").select(F.col("session").alias("answer_id"), "seq", "speaker", T.normalize(F.col("text")).alias("plain"))
    return verifier.cited_runs(e).select("answer_id", F.col("seq").cast("bigint").alias("seq"), F.md5("run_text").alias("digest"))


def verify_outputs(spark, sf):
    """The whole verifier on outputs made from the conversations: an answer, three checkboxes and a narrative for each turn."""
    s = _segments(spark, sf)
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    cite = lambda low, n, seq: F.array(F.struct(T.segment_id(seq + 1).alias("segment"), F.array_join(F.slice(words, low, n), " ").alias("quote")))
    here, k = F.col("seq"), F.col("session") + F.col("seq")
    value = _pick(["YES", "NO", "MAYBE"], k)
    one = F.to_json(F.struct(_pick(["filled", "filled", "filled", "insufficient_evidence", "other"], k).alias("status"), value.alias("value"), cite(2, 7, F.when(k % 4 == 0, here + 1).otherwise(here)).alias("evidence")))
    boxes = F.array(*[F.struct(F.lit(v).alias("value"), cite(n, m, at).alias("evidence")) for v, n, m, at in (("B", 2, 7, here), ("NONE", 1, 4, here), ("Z", 1, 3, here), ("A", 3, 5, here + 50))])
    prose = F.array(*[F.struct(F.array_join(F.slice(words, n, 5), " ").alias("text"), cite(n, 4, at).alias("evidence")) for n, at in ((1, here), (2, here + 60), (3, here), (4, here))])
    outputs = s.select(F.explode(F.array(
        F.struct(F.concat_ws("-", F.lit("one"), "session", "seq").alias("answer_id"), "session", F.lit("one").alias("key"), one.alias("output")),
        F.struct(F.concat_ws("-", F.lit("many"), "session", "seq").alias("answer_id"), "session", F.lit("many").alias("key"), F.to_json(F.struct(F.lit("filled").alias("status"), boxes.alias("selections"))).alias("output")),
        F.struct(F.concat_ws("-", F.lit("prose"), "session", "seq").alias("answer_id"), "session", F.lit("prose").alias("key"), F.to_json(F.struct(F.lit("filled").alias("status"), prose.alias("sentences"))).alias("output")),
    )).alias("o")).select("o.*")
    options = lambda *v: [(x, x.lower()) for x in v]
    fields = [("one", "radio_group", "discrete", options("YES", "NO"), None, "client", None, None), ("many", "checkbox_group", "discrete", options("NONE", "A", "B"), None, "any", None, None), ("prose", "textarea", "narrative", [], None, "any", 60, None)]
    fields = spark.createDataFrame(fields, "key string, kind string, mode string, options array<struct<value:string,label:string>>, option_semantics map<string,string>, wanted_speaker string, max_chars int, bands map<string,array<double>>")
    out = verifier.verify_outputs(s, fields, outputs)
    return out.select("answer_id", "status", "reason", F.array_join("value", "|").alias("value"), F.size("evidence").cast("bigint").alias("n_evidence"))


def s01_transcripts(spark, sf):
    """Conversations written as transcript files and parsed again; a file holds many transcripts, so that files grow with
    the partitions and not with the conversations."""
    rows = read_table(spark, sf, "conversations").filter("role <> 'system'")
    line = F.concat(F.lit("["), T.format_clock(F.col("turn") * 40), F.lit("] "), F.when(F.col("role") == "user", "CLIENT").otherwise("Worker"), F.lit(": "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    text = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))  # one block is one transcript
    session = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    text = text.select(F.concat(F.lit("# session: "), session, F.lit("\n# session_date: 2026-01-02\n\n"), F.array_join(F.transform("x", lambda l: l["line"]), "\n")).alias("value"))
    path = new_path(spark, "transcripts")
    text.write.option("lineSep", transcripts.BETWEEN).text(path)
    lines = transcripts.many_lines(spark, path)
    return transcripts.parse_strict(lines).select(F.col("session").cast("bigint").alias("conv_id"), "seq", "segment_id", "speaker", "start", F.round("end", 4).alias("end"), F.md5("text").alias("digest"))


def s09_dialogues(spark, sf):
    rows = read_table(spark, sf, "conversations")
    cell = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("said")))).alias("x"))
    cell = cell.select("conv_id", F.array_join(F.transform("x", lambda t: t["said"]), "\n").alias("dialogue"))
    return transcripts.dialogue_turns(cell, "conv_id", "dialogue", r"^\[(user|assistant|system)\] (.*)$").select("conv_id", "turn", "speaker", F.md5("text").alias("digest"))


def s11_grid(spark, sf):
    rows = read_table(spark, sf, "conversations")
    each = F.array(F.concat(F.lit("  xmin = "), F.col("turn") * 1.5), F.lit("  xmax = 9"), F.concat(F.lit('  text = "'), F.when(F.col("turn") % 3 == 2, "").otherwise(F.concat(F.regexp_replace("text", r"\s+", " "), F.lit(" <UNIN/> <UNSURE>so</UNSURE> <x>"))), F.lit('"')))
    lines = rows.select(F.col("conv_id").alias("session"), "turn", F.posexplode(each).alias("n", "line")).withColumn("line_no", F.col("turn") * 3 + F.col("n"))
    return transcripts.interval_grid(lines).select(F.col("session").alias("conv_id"), "line_no", "start", F.md5("text").alias("digest"))


def s15_audit(spark, sf):
    """Hash chains written as JSON lines, some of them tampered with, and verified after reading."""
    path = new_path(spark, "audit")
    rows = read_table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session"), "turn", F.col("role").alias("event"), F.create_map(F.lit("n"), F.length("text").cast("string")).alias("details"))
    audit.write_entries(rows.withColumn("time", F.format_string("2026-01-01T00:00:%02dZ", "turn")), path, "turn")
    read = audit.entries(spark, path)
    torn = read.filter("not (session like '%3' and seq = 1)").withColumn("event", F.when(F.col("session").endswith("5") & (F.col("seq") == 2), "forged").otherwise(F.col("event")))
    return audit.verify(torn).select(F.col("session").cast("bigint").alias("conv_id"), "entries", "broken_at", "reason")


def s16_frames(spark, sf):
    """Turns as length-prefixed frames of one file for each conversation, with a torn frame at its end."""
    rows = read_table(spark, sf, "conversations")
    frame = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0")), F.col("text").cast("binary"))
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", frame.alias("frame")))).alias("x"))
    torn = F.unhex(F.lit("000000FF6162"))
    files = files.select("conv_id", F.concat(F.aggregate("x", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["frame"])), torn).alias("content"))
    return frames.read_frames(files, "conv_id", "content").select("conv_id", "frame_no", F.octet_length("frame").cast("bigint").alias("n"), F.md5("frame").alias("digest"), "valid_bytes")


def j21_a11_u03_evaluation(spark, sf):
    """Labels against a rule on the text's length, with accepted alternatives for one language."""
    labels = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    truth = labels.select("doc_id", F.lit("quality").alias("field"), F.array(F.col("quality").cast("string")).alias("label"))
    truth = truth.unionByName(labels.select("doc_id", F.lit("toxic").alias("field"), F.when(F.col("toxic") == 1, F.array(F.lit("1"))).alias("label")))
    said = docs.filter("source <> 'src1'").select("doc_id", F.lit("quality").alias("field"), F.when(F.col("n_chars") > 300, F.array(F.lit("1"))).when(F.col("n_chars") > 100, F.array(F.lit("0"))).alias("value"))
    said = said.unionByName(docs.filter("source <> 'src1'").select("doc_id", F.lit("toxic").alias("field"), F.lit(None).cast("array<string>").alias("value")))
    accepted = docs.filter("lang = 'de'").select("doc_id", F.lit("quality").alias("field"), F.array(F.array(F.lit("0")), F.array(F.lit("1"))).alias("acceptable"))
    checks = evaluation.judge(truth, said, accepted, ["doc_id"], "field")
    rates = evaluation.rates(checks.withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "stated").otherwise("implied")), "mode")
    return rates.select("mode", F.round("ok", 6).alias("ok"), F.round("unsafe", 6).alias("unsafe"), F.round("blank", 6).alias("blank"), "good", "n")


def a19_fixpoint(spark, sf):
    """Totals, bands of totals, and a band of a band, which never comes about."""
    values = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.concat(F.lit("phq9_"), "l_linenumber").alias("key"), F.when(F.col("l_quantity") < 40, F.floor(F.col("l_quantity") / 6).cast("string")).otherwise("n/a").alias("value"))
    derived = [("phq9_total", "phq9_total", ["phq9_1", "phq9_2"]), ("phq9_band", "phq9_band", ["phq9_total"]), ("grand", "phq9_total", ["phq9_total", "phq9_3"]), ("never", "gad7_band", ["phq9_band"])]
    return scoring.derive_all(values, derived, ["session"])


def f11_entities(spark, sf):
    title = F.concat(F.lit("So Dr. "), F.split("p_name", " ")[0], F.lit(" saw "), F.initcap("p_name"), F.lit(" on March "), "p_size", F.lit("! Twenty ZINC, I'm told. It's "), "p_brand")
    return read_table(spark, sf, "part").select("p_partkey", F.array_join(review.entities(title), "|").alias("entities"))


def f19_f43_fingerprints(spark, sf):
    rows = read_table(spark, sf, "part").select(F.col("p_brand").alias("form"), F.concat_ws("_", F.lit("k"), "p_partkey").alias("key"), F.col("p_type").alias("kind"), F.split("p_type", " ").alias("options"))
    return forms.fingerprints(rows, "form", "key", "kind", "options")


def f23_rounding(spark, sf):
    x = (F.col("l_partkey") - 1000) / 8
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.round_away(x, 2).alias("hundredths"), V.round_away(x, 1).alias("tenths"))


def r12_lookup(spark, sf):
    """Addresses of pages against registered forms: by exact address, by pattern, several, none, no address."""
    pages = read_table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 13 > 0, F.col("url")).alias("url"))
    pages = pages.withColumn("url", F.when(F.col("page_id") % 17 == 0, F.concat(F.lit(" ftp"), F.ltrim("url"))).otherwise(F.col("url")))
    known = [("en", r".*\.example\.com", "/en/*"), ("any_com", r".*\.example\.com", "/*/1*"), ("net", r".*\.example\.net", "*")]
    tabs = pages.filter("page_id % 2 = 0 and url is not null").select("url", F.col("page_id").alias("tab"), F.col("page_id").alias("place"))
    clients = tabs.filter("tab % 3 > 0").select("tab", F.concat(F.lit("c"), "tab").alias("client"))
    return forms.lookup(pages, known, tabs, clients).select("page_id", "outcome", "form", "tab", "client")


def a02_status_reasons(spark, sf):
    return review.status_histogram(verify_outputs(spark, sf))


def a20_error_rates(spark, sf):
    """Turns against what two engines heard: one drops every seventh word, the other all of some turns."""
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    kept = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 7 != 3), " ")
    heard = rows.withColumn("engine", F.lit("drops")).withColumn("text", kept).unionByName(rows.filter("turn <> 2").withColumn("engine", F.lit("misses")).select("conv_id", "turn", "text", "engine"))
    return review.transcript_errors(rows, heard, ["conv_id", "turn"], "engine", "text").select("conv_id", "turn", "engine", F.round("wer", 6).alias("wer"))


def u02_live_digests(spark, sf):
    rows = read_table(spark, sf, "part").select(F.sha2("p_brand", 256).alias("sha256"), "p_size")
    return store.live_digests(rows.filter("p_size < 20"), rows.filter("p_size > 15"))


QUERIES = {f.__name__: f for f in (
    f01_fold, f02_contains, f03_line_prefix, f08_spelled, f09_by_mode, f10_word_errors, f20_validation, f21_client_tag, f22_energy, f28_to_f44_values,
    p07_attestations, p10_negative_options, p13_generated_ids, p23_forbidden, p24_r19_paths, f14_scan, p31_payload_scan, p32_gate, k08_r15_chain, j17_questions,
    j18_j19_relocation, w12_sentences, w10_runs, verify_outputs, s01_transcripts, s09_dialogues, s11_grid, s15_audit, s16_frames, j21_a11_u03_evaluation,
    a19_fixpoint, f11_entities, f19_f43_fingerprints, f23_rounding, r12_lookup, a02_status_reasons, a20_error_rates, u02_live_digests,
)}


def _norm(x: str) -> str:
    folded = f"replace(strip_accents(lower({x})), 'ß', 'ss')"
    return rf"trim(regexp_replace(regexp_replace({folded}, '[''‘’ʼ`´]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _in(haystack: str, needle: str) -> str:
    return f"({needle} <> '' AND contains(' ' || {haystack} || ' ', ' ' || {needle} || ' '))"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _blob(raw: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in raw) + "'::BLOB"


_SEG = f"""s AS (SELECT conv_id AS session, 's' || lpad((turn + 1)::VARCHAR, 4, '0') AS segment_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'worker' ELSE 'client' END AS speaker, text,
{_norm("text")} AS plain, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM conversations)"""
_PLACEHOLDER = "regexp_matches(regexp_replace({0}, '[^0-9]', '', 'g'), '^(0+|9+)$')"
_M = T._MONTHS
#: The patterns without look-around: what stands beside a match is part of the match, and the match is the first group.
_SCANS = [
    r"(?i)([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})", r"(?:^|\D)(\d{3}[- ]\d{2}[- ]\d{4})(?:\D|$)",
    r"(?:^|[^\d+])((?:\+?1[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4})(?:\D|$)", r"(\+\d{1,3}[\s.\-]?\d{2,4}[\s.\-]?\d{3,4}[\s.\-]?\d{3,4})(?:\D|$)",
    r"(?:^|\D)(\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2}))(?:\D|$)", r"(?:^|\D)(\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2})(?:\D|$)",
    rf"(?i)(\b{_M}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?:,?\s+\d{{4}})?)", rf"(?i)(\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_M}\b\.?(?:,?\s+\d{{4}})?)", rf"(?i)(\b{_M}\.?,?\s+\d{{4}}\b)",
    rf"(?i)(?:^|[^\d.])(\d{{1,6}}[A-Z]?\s+(?:[NSEW]\.?\s+)?(?:[A-Z0-9][A-Z0-9.'\-]*\s+){{1,4}}{T._STREETS}\b\.?)", r"(?i)(\bP\.?\s?O\.?\s+Box\s+\d+)",
    r"(\b[A-Z]{2}\s+\d{5}(?:-\d{4})?)(?:\D|$)", r"(?:^|\D)(\d{5}-\d{4})(?:\D|$)", r"(?i)(\bzip(?:\s*code)?\s*[:#]?\s*\d{5})(?:\D|$)", r"(,\s*\d{5}(?:-\d{4})?)(?:\D|$)",
    r"(?i)(?:^|[^A-Z0-9])([A-Z]{1,4}[-_ #:]{0,2}\d{5,})(?:\D|$)", r"(#\s?\d{4,})(?:\D|$)", r"(?:^|\D)(\d{6,})(?:\D|$)",
]


def _hits(pattern: str, email: bool) -> str:
    quoted = pattern.replace("'", "''")
    free = f" AND NOT regexp_matches(x, '(?i){T.RESERVED_EMAIL}')" if email else ""
    return f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{quoted}', 1), lambda x: NOT {_PLACEHOLDER.format('x')}{free}))"


_KEYS = [bytes(b ^ pad for b in KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_PAYLOAD = """WITH p AS (SELECT p_partkey AS field_no, p_size, ['f_0123456789', 'f_01234567', 'name'][p_partkey % 3 + 1] AS key, ['12', 'LINE_988', 'AB_123456', 'Mary Smith', '00000', 'X4', '555-12-3456'][p_size % 7 + 1] AS v,
['MRN 1234567', 'Format: AB-000000', 'Call (212) 555-0142', 'PHQ-9, past 2 weeks', 'me@example.com'][p_partkey % 5 + 1] AS l FROM part)
SELECT field_no, 'key' AS part, 'record_number' AS kind, 'x_########' AS excerpt FROM p WHERE key = 'f_01234567'
UNION ALL SELECT field_no, 'option.value', 'record_number', 'xx_######' FROM p WHERE v = 'AB_123456' UNION ALL SELECT field_no, 'option.value', 'ssn', '###-##-####' FROM p WHERE v = '555-12-3456'
UNION ALL SELECT field_no, x.part, CASE WHEN l LIKE 'MRN%' THEN 'record_number' ELSE 'phone' END, CASE WHEN l LIKE 'MRN%' THEN 'xxx #######' ELSE '(###) ###-####' END
FROM p, (VALUES ('help'), ('option.label')) x(part) WHERE (l LIKE 'MRN%' OR l LIKE 'Call%') AND (x.part = 'option.label' OR p_size > 25)"""

ORACLE_SQL = {
    "f01_fold": f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents",
    "f02_contains": f"SELECT conv_id, turn, {_in('n', chr(39) + 'and' + chr(39))} AS has_and, false AS has_empty, {_in('n', chr(39) + 'that was' + chr(39))} AS has_two FROM (SELECT conv_id, turn, {_norm('text')} AS n FROM conversations)",
    "f03_line_prefix": r"""SELECT conv_id, turn, md5(regexp_replace(['[01:02] s0001 CLIENT: ', 'worker:', ' [1:02:03] Client : ', 'nurse: ', 's001 client: '][turn % 5 + 1] || text,
'(?i)^\s*(\[[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?\]\s*)?(s[0-9]{4}\s+)?(WORKER|CLIENT)\s*:\s*', '')) AS digest FROM conversations""",
    "f08_spelled": "SELECT p_partkey, 'size ' || p_size || ' say' AS digits FROM part",
    "f09_by_mode": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) END AS value FROM orders",
    "f10_word_errors": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE round(1.0 / len(string_split(p_name, ' ')), 6) END AS wer FROM part",
    "f20_validation": "SELECT c_custkey, ('0x' || substring(sha256(c_name), 1, 8))::BIGINT % 1000 < 150 AS is_val FROM customer",
    "f21_client_tag": f"SELECT c_custkey, 'ct:' || substring(sha256({_blob(_KEYS[1])} || unhex(sha256({_blob(_KEYS[0])} || encode(upper(trim(c_name)))))), 1, 32) AS tag FROM customer",
    "f22_energy": "SELECT vec_id, round(greatest(10 * log10(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)) / len(embedding)), -90), 4) AS db FROM embeddings",
    "f28_to_f44_values": r"""SELECT p_partkey, p_size % 3 <> 2 AS agrees, regexp_replace(lower(p_name), '\s+', ' ', 'g') AS label, p_size % 3 = 2 AS has_token,
regexp_matches(p_name, '(^|[^\p{L}\p{N}])' || substring(t[2], 2, 3) || '([^\p{L}\p{N}]|$)') AS has_part, p_size % 2 = 0 AS same, regexp_replace(p_brand || '.' || p_type, '[^A-Za-z0-9_-]', '_', 'g') AS schema_name, CASE WHEN p_size % 4 > 0 THEN '{"a": {"b": ' || p_size || '}}' END AS json,
p_size > 25 OR (p_size = 25 AND p_partkey % 7 > 3) AS newer, p_size % 3 <> 1 AS same_address, false AS other_address,
upper(t[1][1]) || lower(t[1][2:]) || ' ' || upper(t[2][1]) || lower(t[2][2:]) AS title, p_size % 5 > 0 AND p_size < 30 AS unsure FROM (SELECT *, string_split(p_name, ' ') AS t FROM part)""",
    "p07_attestations": """SELECT p_partkey, regexp_matches(lower(l || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'Yes Electronically signed' ELSE p_brand END), 'attest|signature|sign here|i certify|e-sign|esign|electronically sign') AS attests,
regexp_matches(lower(l), 'attest|signature|sign here|i certify|e-sign|esign|electronically sign') AS label_attests
FROM (SELECT *, ['I attest that', 'Signature of', 'Full name', 'Sign here', 'I acknowledge', 'Designation', 'Date'][p_size % 7 + 1] AS l FROM part)""",
    "p10_negative_options": """SELECT p_partkey, upper(v) IN ('NONE', 'NO', 'NEVER', 'DECLINED', 'NOT_AT_ALL', 'NOTHING') OR regexp_matches(upper(v), '^(NONE|NO|NOT)_') OR ends_with(upper(v), '_NONE')
OR n IN ('none', 'no', 'never', 'not at all', 'declined', 'nothing') OR regexp_matches(n, '^(none|not|no) ') OR p_partkey % 11 = 0 AS negative
FROM (SELECT *, ['NONE', 'NO_PAIN', 'YES', 'PAIN_NONE', 'NOTABLE', 'not_now', 'X'][p_partkey % 7 + 1] AS v, ['not at all', 'never', 'no pain really', 'always', 'nothing', 'notable'][p_size % 6 + 1] AS n FROM part)""",
    "p13_generated_ids": r"""WITH i AS (SELECT p_partkey, unnest(range(8)) AS n, unnest(['input-' || p_partkey, ':r' || p_partkey || ':', 'mat-input-' || p_partkey, 'Ext-Gen' || p_partkey, substring(md5(p_partkey::VARCHAR), 1, 14), p_type, '1st' || p_partkey, 'p-drop_' || p_partkey]) AS id FROM part)
SELECT p_partkey, n, regexp_matches(id, '(?i)^:r[0-9a-z]+:$') OR regexp_matches(id, '(?i)^(mui|ember|ext-gen|react-select|headlessui|radix|downshift|rc_select|cdk|mat-[a-z-]+|p-[a-z]+)[-_:]?\w*\d+')
OR regexp_matches(id, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}') OR regexp_matches(id, '(?i)[0-9a-f]{12,}') OR regexp_matches(id, '\d{5,}') AS generated FROM i""",
    "p23_forbidden": """WITH c AS (SELECT *, lower(['button', 'input', 'a', 'BUTTON', 'div'][p_partkey % 5 + 1]) AS tag, CASE WHEN p_partkey % 7 > 0 THEN lower(['submit', '', 'Image', 'button'][p_size % 4 + 1]) ELSE '' END AS kind FROM part)
SELECT p_partkey, (tag = 'button' AND (kind = 'submit' OR (kind = '' AND p_size % 3 = 0))) OR (tag = 'input' AND kind IN ('submit', 'image')) OR (tag = 'a' AND p_size % 2 = 0) OR p_size % 17 = 0 AS forbidden FROM c""",
    "p24_r19_paths": """SELECT p_partkey, regexp_matches(a, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND regexp_matches(b, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS safe, p_size % 2 = 0 AS is_digest
FROM (SELECT *, ['a', '..', '.hidden', 'a b', 'weights-1.bin', '', 'x_y'][p_partkey % 7 + 1] AS a, ['b', 'c.d', '..', '-x'][p_size % 4 + 1] AS b FROM part)""",
    "f14_scan": f"SELECT doc_id, {' OR '.join(f'{_hits(x, k == 0)} > 0' for k, x in enumerate(_SCANS))} AS any_hit, {_hits(_SCANS[0], True)} AS n_email FROM documents",
    "p31_payload_scan": _PAYLOAD,
    "p32_gate": """SELECT p_brand AS form, count_if(p_size = 7) AS n_hits, count_if(p_size = 8) AS n_withheld,
(CASE WHEN count_if(p_size = 7) > 0 THEN 1 WHEN NOT ends_with(p_brand, '1') AND NOT ends_with(p_brand, '2') THEN 2 ELSE 0 END)::INT AS exit_code FROM part GROUP BY p_brand""",
    "k08_r15_chain": """WITH RECURSIVE r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, turn || '|' || role || '|' || text AS e FROM conversations),
c AS (SELECT conv_id, turn, seq, '' AS prev, sha256(e || '|') AS hash FROM r WHERE seq = 1 UNION ALL SELECT r.conv_id, r.turn, r.seq, c.hash, sha256(r.e || '|' || c.hash) FROM r JOIN c ON r.conv_id = c.conv_id AND r.seq = c.seq + 1)
SELECT conv_id, turn, seq, prev, hash FROM c""",
    "j17_questions": f"""WITH {_SEG}, q AS (SELECT item, list_distinct(list_filter(string_split({_norm('question')}, ' '), lambda x: length(x) >= 4)) AS q FROM (VALUES {', '.join(str(x) for x in ITEMS)}) v(item, question)),
n AS (SELECT *, count_if(speaker = 'worker') OVER (PARTITION BY session ORDER BY seq) AS n_worker FROM s),
h AS (SELECT session, seq, n_worker, item, len(list_intersect(q, list_filter(string_split(plain, ' '), lambda x: length(x) >= 4))) / len(q) AS share FROM n, q WHERE speaker = 'worker'),
b AS (SELECT session, seq, n_worker, item FROM h WHERE share >= 0.3 QUALIFY row_number() OVER (PARTITION BY session, seq ORDER BY share DESC, item) = 1),
l AS (SELECT n.session, n.seq, n.n_worker, b.item, b.n_worker AS read_at, row_number() OVER (PARTITION BY n.session, n.seq ORDER BY b.seq DESC NULLS LAST) AS k
FROM n LEFT JOIN b ON b.session = n.session AND b.seq < n.seq WHERE n.speaker = 'client')
SELECT session, seq, CASE WHEN n_worker - read_at < 4 THEN item END AS item FROM l WHERE k = 1""",
    "j18_j19_relocation": f"""WITH {_SEG}, e AS (SELECT session, seq, seq + seq % 3 AS cited, {_norm("array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[3:10], ' ')")} AS q FROM s),
h AS (SELECT e.session, e.seq, count(*) AS n, min(s.seq) AS place, bool_or(s.seq = e.cited) AS there FROM e JOIN s ON s.session = e.session AND {_in('s.plain', 'e.q')} GROUP BY ALL)
SELECT e.session || '-' || e.seq AS answer_id, (CASE WHEN len(string_split(q, ' ')) >= 6 AND n = 1 AND NOT there THEN place ELSE cited END)::BIGINT AS seq FROM e LEFT JOIN h USING (session, seq)""",
    "w12_sentences": "SELECT conv_id AS answer_id, turn AS ordinal FROM conversations QUALIFY sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 <= 900",
    "w10_runs": f"""WITH r AS (SELECT conv_id, turn, turn % 5 < 2 AS c, {_norm('text')} AS plain FROM conversations WHERE turn <> 3),
g AS (SELECT *, coalesce(turn = lag(turn) OVER w + 1 AND c = lag(c) OVER w, false) AS goes_on FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, count_if(NOT goes_on) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g)
SELECT conv_id AS answer_id, turn AS seq, md5(string_agg(plain, ' ') OVER (PARTITION BY conv_id, run ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS digest FROM n""",
    "verify_outputs": f"""WITH {_SEG}, p AS (SELECT 'one' AS kind, 0 AS ordinal, ['YES', 'NO', 'MAYBE'][(session + seq) % 3 + 1] AS part, session, seq, CASE WHEN (session + seq) % 4 = 0 THEN seq + 1 ELSE seq END AS cited, w[2:8] AS q FROM s
UNION ALL SELECT 'many', k, ['B', 'NONE', 'Z', 'A'][k + 1], session, seq, CASE WHEN k = 3 THEN seq + 50 ELSE seq END, CASE k WHEN 0 THEN w[2:8] WHEN 1 THEN w[1:4] WHEN 2 THEN w[1:3] ELSE w[3:7] END FROM s, range(4) r(k)
UNION ALL SELECT 'prose', k, array_to_string(w[k + 1:k + 5], ' '), session, seq, CASE WHEN k = 1 THEN seq + 60 ELSE seq END, w[k + 1:k + 4] FROM s, range(4) r(k) WHERE len(w) > k),
e AS (SELECT kind, ordinal, part, session, seq, cited, {_norm("array_to_string(q, ' ')")} AS q FROM p),
here AS (SELECT e.*, c.speaker AS c_speaker, coalesce({_in('c.plain', 'e.q')}, false) AS there, coalesce(c.speaker = 'worker' AND n.speaker = 'client' AND {_in('n.plain', 'e.q')}, false) AS after, n.speaker AS n_speaker
FROM e LEFT JOIN s c ON c.session = e.session AND c.seq = e.cited LEFT JOIN s n ON n.session = e.session AND n.seq = e.cited + 1),
hits AS (SELECT e.kind, e.ordinal, e.session, e.seq, count(*) AS n, min(s.speaker) AS speaker FROM e JOIN s ON s.session = e.session AND {_in('s.plain', 'e.q')} WHERE len(string_split(e.q, ' ')) >= 6 GROUP BY ALL),
found AS (SELECT h.*, CASE WHEN there THEN c_speaker WHEN after THEN n_speaker WHEN n = 1 THEN x.speaker END AS speaker FROM here h LEFT JOIN hits x USING (kind, ordinal, session, seq)),
judged AS (SELECT *, CASE WHEN (kind = 'one' AND part = 'MAYBE') OR (kind = 'many' AND part = 'Z') THEN 'invalid_option' WHEN speaker IS NULL AND c_speaker IS NULL THEN 'segment_not_found' WHEN speaker IS NULL THEN 'quote_not_found'
WHEN kind = 'one' AND speaker <> 'client' THEN 'speaker_mismatch' END AS reason FROM found),
summed AS (SELECT *, sum(CASE WHEN reason IS NULL THEN length(part) + 1 ELSE 0 END) OVER (PARTITION BY kind, session, seq ORDER BY ordinal) - 1 AS so_far, bool_or(reason IS NULL AND part IN ('A', 'B')) OVER (PARTITION BY kind, session, seq) AS has_some FROM judged),
cut AS (SELECT *, bool_or(kind = 'prose' AND reason IS NULL AND so_far > 60) OVER (PARTITION BY kind, session, seq ORDER BY ordinal) AS is_over FROM summed),
kept AS (SELECT *, reason IS NULL AND (kind <> 'many' OR part <> 'NONE' OR NOT has_some) AS stays FROM cut WHERE NOT is_over),
per AS (SELECT kind, session, seq, bool_or(stays) AS any_stays, min_by(reason, ordinal) FILTER (reason IS NOT NULL) AS reason, count_if(stays) AS n_stays,
CASE kind WHEN 'prose' THEN string_agg(part, ' ' ORDER BY ordinal) FILTER (stays) WHEN 'many' THEN string_agg(part, '|' ORDER BY part = 'B', part = 'A') FILTER (stays) ELSE any_value(part) END AS value FROM kept GROUP BY kind, session, seq),
every AS (SELECT kind, session, seq, CASE WHEN kind = 'one' THEN ['filled', 'filled', 'filled', 'insufficient_evidence', 'other'][(session + seq) % 5 + 1] ELSE 'filled' END AS said FROM s, (VALUES ('one'), ('many'), ('prose')) v(kind))
SELECT kind || '-' || session || '-' || seq AS answer_id, CASE WHEN said = 'other' THEN 'rejected' WHEN said <> 'filled' THEN said WHEN any_stays THEN 'filled' WHEN kind = 'one' THEN 'rejected' ELSE 'insufficient_evidence' END AS status,
CASE WHEN said = 'other' THEN 'malformed_output' WHEN said = 'filled' THEN reason END AS reason, CASE WHEN said = 'filled' THEN value END AS value,
(CASE WHEN said <> 'filled' THEN 0 WHEN kind = 'one' THEN (value <> 'MAYBE')::INT ELSE coalesce(n_stays, 0) END)::BIGINT AS n_evidence FROM every LEFT JOIN per USING (kind, session, seq)""",
    "s01_transcripts": r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE role <> 'system'), n AS (SELECT *, row_number() OVER w AS seq, lead(turn) OVER w AS following FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, seq, 's' || lpad(seq::VARCHAR, 4, '0') AS segment_id, CASE WHEN role = 'user' THEN 'client' ELSE 'worker' END AS speaker, turn * 40.0 AS start,
round(coalesce(following * 40.0, turn * 40.0 + greatest(1.0, len(string_split(text, ' ')) * 0.4)), 4) AS end, md5(text) AS digest FROM n""",
    "s09_dialogues": r"""WITH l AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') AS x FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role AS speaker, md5(array_to_string(x, ' ')) AS digest FROM l""",
    "s11_grid": r"""SELECT conv_id, (turn * 3 + 2)::INT AS line_no, turn * 1.5 AS start, md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')) || ' [inaudible] so', '^\s+', '')) AS digest FROM conversations WHERE turn % 3 <> 2""",
    "s15_audit": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, n - CASE WHEN conv_id % 10 = 3 THEN 1 ELSE 0 END AS entries, CASE WHEN conv_id % 10 = 3 THEN 1 WHEN conv_id % 10 = 5 AND n >= 2 THEN 2 END AS broken_at,
CASE WHEN conv_id % 10 = 3 THEN 'sequence gap' WHEN conv_id % 10 = 5 AND n >= 2 THEN 'contents changed' END AS reason FROM n WHERE n > CASE WHEN conv_id % 10 = 3 THEN 1 ELSE 0 END""",
    "s16_frames": "SELECT conv_id, row_number() OVER w - 1 AS frame_no, strlen(text) AS n, md5(text) AS digest, (sum(strlen(text) + 4) OVER (PARTITION BY conv_id))::BIGINT AS valid_bytes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "j21_a11_u03_evaluation": """WITH d AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE source <> 'src1'),
c AS (SELECT doc_id, CASE WHEN lang = 'de' AND n_chars > 100 THEN 'ok' WHEN n_chars > 300 THEN CASE WHEN quality = 1 THEN 'ok' ELSE 'unsafe' END WHEN n_chars > 100 THEN CASE WHEN quality = 0 THEN 'ok' ELSE 'unsafe' END ELSE 'blank' END AS o FROM d
UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'blank' ELSE 'ok' END FROM d)
SELECT CASE WHEN doc_id % 2 = 0 THEN 'stated' ELSE 'implied' END AS mode, round(avg((o = 'ok')::INT), 6) AS ok, round(avg((o = 'unsafe')::INT), 6) AS unsafe, round(avg((o = 'blank')::INT), 6) AS blank, count_if(o = 'ok') AS good, count(*) AS n FROM c GROUP BY 1""",
    "a19_fixpoint": """WITH v AS (SELECT l_orderkey, l_linenumber, min(CASE WHEN l_quantity < 40 THEN floor(l_quantity / 6)::BIGINT::VARCHAR ELSE 'n/a' END) AS v FROM lineitem GROUP BY ALL),
w AS (SELECT l_orderkey, max(try_cast(v AS BIGINT)) FILTER (l_linenumber = 1) AS a, max(try_cast(v AS BIGINT)) FILTER (l_linenumber = 2) AS b, max(try_cast(v AS BIGINT)) FILTER (l_linenumber = 3) AS c FROM v GROUP BY 1)
SELECT l_orderkey AS session, 'phq9_total' AS key, (a + b)::VARCHAR AS value FROM w WHERE a + b IS NOT NULL UNION ALL SELECT l_orderkey, 'grand', (a + b + c)::VARCHAR FROM w WHERE a + b + c IS NOT NULL
UNION ALL SELECT l_orderkey, 'phq9_band', CASE WHEN a + b <= 4 THEN 'MINIMAL' WHEN a + b <= 9 THEN 'MILD' ELSE 'MODERATE' END FROM w WHERE a + b <= 14""",
    "f11_entities": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: lower(x)) || ['march', p_size::VARCHAR, '20', 'zinc', lower(p_brand)], '|') AS entities FROM part",
    "f19_f43_fingerprints": """SELECT p_brand AS form, 'sha256:' || sha256('[' || string_agg('["k_' || p_partkey || '","' || p_type || '",' || to_json(string_split(p_type, ' '))::VARCHAR || ']', ',' ORDER BY 'k_' || p_partkey) || ']') AS fingerprint FROM part GROUP BY 1""",
    "f23_rounding": "WITH x AS (SELECT *, (l_partkey - 1000) / 8.0::DOUBLE AS x FROM lineitem) SELECT l_orderkey, l_linenumber, sign(x) * floor(abs(x) * 100 + 0.5) / 100 AS hundredths, sign(x) * floor(abs(x) * 10 + 0.5) / 10 AS tenths FROM x",
    "r12_lookup": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN ' ftp' ELSE '' END || CASE WHEN page_id % 13 > 0 THEN url END AS given, CASE WHEN page_id % 13 > 0 THEN url END AS url FROM pages),
k AS (SELECT page_id, trim(given) AS u, page_id % 17 > 0 AND coalesce(regexp_matches(given, '(?i)^https?://[^/?#]+'), false) AS valid, lower(regexp_extract(given, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(given, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM p),
f AS (SELECT *, CASE WHEN valid THEN CASE WHEN regexp_matches(host, '^.*\.example\.com$') AND starts_with(path, '/en/') THEN 'en' WHEN regexp_matches(host, '^.*\.example\.com$') AND regexp_matches(path, '^/.*/1.*$') THEN 'any_com' WHEN regexp_matches(host, '^.*\.example\.net$') THEN 'net' END END AS form FROM k),
t AS (SELECT trim(given) AS tab_url, page_id AS tab FROM p WHERE page_id % 2 = 0 AND given IS NOT NULL),
m AS (SELECT u, tab FROM (SELECT DISTINCT u FROM f WHERE form IS NOT NULL) JOIN t ON regexp_replace(u, '[?#].*$', '') = regexp_replace(tab_url, '[?#].*$', '')
QUALIFY row_number() OVER (PARTITION BY u ORDER BY CASE WHEN u = tab_url THEN 0 WHEN regexp_replace(u, '#.*$', '') = regexp_replace(tab_url, '#.*$', '') THEN 1 ELSE 2 END, tab) = 1)
SELECT page_id, CASE WHEN NOT valid THEN 'not_an_address' WHEN form IS NULL THEN 'not_learned' WHEN tab IS NULL THEN 'not_open' WHEN tab % 3 = 0 THEN 'no_client' ELSE 'found' END AS outcome, form, tab, CASE WHEN tab % 3 > 0 THEN 'c' || tab END AS client FROM f LEFT JOIN m USING (u)""",
}
_TOKENS = "len(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}'']'), lambda x: x <> ''))"
_DROPPED = "array_to_string(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 7 <> 3), ' ')"
ORACLE_SQL |= {
    "a02_status_reasons": f"SELECT status, reason, count(*) AS n FROM ({ORACLE_SQL['verify_outputs']}) GROUP BY ALL",
    "a20_error_rates": f"""SELECT conv_id, turn, 'drops' AS engine, round(1 - {_TOKENS.format(_DROPPED)} / {_TOKENS.format('text')}, 6) AS wer FROM conversations
UNION ALL SELECT conv_id, turn, 'misses', CASE WHEN turn <> 2 THEN 0.0 END FROM conversations""",
    "u02_live_digests": "SELECT DISTINCT sha256(p_brand) AS sha256 FROM part WHERE p_size < 20 OR p_size > 15",
}
