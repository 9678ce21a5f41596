"""Verification of cited evidence: does a quote appear where it is said to, and can it support the answer?

``verify_outputs`` judges whole model outputs (JSON) for fields; the functions before it are its rules, and
can be used alone. Inputs of ``verify``: segments (session, seq, speaker, text), answers (answer_id, session, wanted_speaker, positive,
questionnaire) and evidence (answer_id, ordinal, seq, quote). The first failing rule names the reason:
no evidence, unknown segment, quote not found, speaker, negated answer, missing question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import dynamic
from quillon.functions.text import contains_words, is_bare_affirmation, is_iso_date, is_negated_short_answer, is_negative_option, normalize, words_of
from quillon.functions.values import frequency_band
from quillon.storage import materialize, release

#: Fixed value: what a transcript line begins with.
LINE_PREFIX = r"(?i)^\s*(\[[0-9]{1,3}:[0-9]{2}(:[0-9]{2})?\]\s*)?(s[0-9]{4}\s+)?(WORKER|CLIENT)\s*:\s*"
REASONS = ["segment_not_found", "quote_not_found", "speaker_mismatch", "negated_answer", "missing_question_context"]


def strip_line_prefix(quote):
    """a transcript line's own prefix isn't part of the quote."""
    return F.regexp_replace(quote, LINE_PREFIX, "")


def prepared_segments(segments: DataFrame) -> DataFrame:
    """Adds the normalised text and the seq of the nearest worker segment before."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("session", "seq", "speaker", normalize(F.col("text")).alias("plain")).withColumn(
        "question_seq", F.last(F.when(F.col("speaker") == "worker", F.col("seq")), ignorenulls=True).over(before)
    )


def cited_runs(evidence: DataFrame) -> DataFrame:
    """Cited segments of an answer that follow each other and have one speaker, with their joined text."""
    w = Window.partitionBy("answer_id").orderBy("seq")
    rows = evidence.filter("speaker is not null").select("answer_id", "seq", "speaker", "plain").distinct()
    follows = (F.col("seq") == F.lag("seq").over(w) + 1) & (F.col("speaker") == F.lag("speaker").over(w))
    rows = rows.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("__new").over(w))
    text = rows.groupBy("answer_id", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "plain"))).alias("x"))
    text = text.select("answer_id", F.array_join(F.transform("x", lambda s: s["plain"]), " ").alias("run_text"), F.explode(F.transform("x", lambda s: s["seq"])).alias("seq"))
    return text


def verify(segments: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, status (filled or rejected), reason (null where filled)."""
    s = prepared_segments(segments)
    e = evidence.join(answers.select("answer_id", "session").hint("merge"), "answer_id").join(s.hint("merge"), ["session", "seq"], "left")
    e = e.withColumn("quote", strip_line_prefix(F.col("quote"))).withColumn("needle", normalize(F.col("quote")))
    e = e.join(cited_runs(e).hint("merge"), ["answer_id", "seq"], "left")
    e = e.withColumn("found", contains_words(F.col("plain"), F.col("needle")) | contains_words(F.coalesce("run_text", F.lit("")), F.col("needle")))
    client = F.col("speaker") == "client"
    per = e.groupBy("answer_id").agg(
        F.bool_or(F.col("speaker").isNull()).alias("unknown"), F.bool_and(F.coalesce("found", F.lit(False))).alias("found"),
        F.count_if(client).alias("n_client"), F.count_if(F.col("speaker") == "worker").alias("n_worker"),
        F.count_if(client & is_negated_short_answer(F.col("quote"))).alias("n_negated"), F.count_if(client & is_bare_affirmation(F.col("quote"))).alias("n_bare"),
        F.collect_set("seq").alias("cited"), F.collect_set(F.when(client, F.coalesce("question_seq", F.lit(-1)))).alias("needed"),
    )
    a = answers.join(per.hint("merge"), "answer_id", "left")
    all_negated = (F.col("n_negated") == F.col("n_client")) & (F.col("n_client") > 0)
    short = ((F.col("n_bare") == F.col("n_client")) & (F.col("n_client") > 0)) | (~F.col("questionnaire") & all_negated)
    reason = (
        F.when(F.col("cited").isNull(), "quote_not_found").when(F.col("unknown"), "segment_not_found").when(~F.col("found"), "quote_not_found")
        .when((F.col("wanted_speaker") == "client") & (F.col("n_client") == 0), "speaker_mismatch")
        .when((F.col("wanted_speaker") == "worker") & (F.col("n_worker") == 0), "speaker_mismatch")
        .when(F.col("positive") & all_negated, "negated_answer")
        .when(short & (F.size(F.array_except("needed", "cited")) > 0), "missing_question_context")
    )
    return a.select("answer_id", F.when(reason.isNull(), "filled").otherwise("rejected").alias("status"), reason.alias("reason"))


def _runs_of_words(size, words):
    """Hashes of all runs of ``size`` words, each once."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(F.size(words) >= size, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def _counted(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """``wanted`` (session, hash, ...) with how many of ``runs`` (session, at, hash) are equal, and the first place."""
    places = runs.groupBy("session", "hash").agg(F.count("*").alias("n"), F.min("at").alias("to"))
    return wanted.join(places.hint("merge"), ["session", "hash"])  # files are many times smaller than their runs of words, so no broadcast


def relocate(segments: DataFrame, evidence: DataFrame, least_words: int = 6) -> DataFrame:
    """A quote of ``least_words`` or more that isn't where it is cited moves to the only segment of its
    session that has it. evidence (answer_id, ordinal, session, seq, quote). Hashes of runs of ``least_words`` words
    are counted by session before they meet the quotes' first words; only quotes that go on after first words said
    more than once are looked up by runs of their own length. So rows grow with words, not with pairs or copies of
    texts, and where one place is left the words themselves are compared."""
    s = segments.filter("session is not null").select("session", F.col("seq").alias("at"), normalize(F.col("text")).alias("plain"))
    s = materialize(s, "plain").withColumn("words", words_of(F.col("plain")))
    e = evidence.withColumn("needle", normalize(strip_line_prefix(F.col("quote"))))
    wanted = e.filter(F.size(words_of(F.col("needle"))) >= least_words)
    each = wanted.select("session", "needle").distinct().withColumn("words", words_of(F.col("needle")))
    each = each.select("session", "needle", F.size("words").alias("n_words"), F.xxhash64(F.array_join(F.slice("words", 1, least_words), " ")).alias("hash"))
    short = materialize(_counted(each, s.select("session", "at", F.explode(_runs_of_words(F.lit(least_words), F.col("words"))).alias("hash"))), "first-words")
    again = (F.col("n") > 1) & (F.col("n_words") > least_words)
    longer = short.filter(again).select("session", "needle", "n_words", F.xxhash64("needle").alias("hash"))
    sizes = longer.groupBy("session").agg(F.collect_set("n_words").alias("sizes"))
    runs = s.join(sizes.hint("merge"), "session").select("session", "at", F.explode("sizes").alias("size"), "words")
    runs = runs.select("session", "at", F.explode(_runs_of_words(F.col("size"), F.col("words"))).alias("hash"))
    found = short.filter(~again).unionByName(_counted(longer, runs)).select("session", "needle", "n", "to")
    same = (F.col("f.session") == F.col("s.session")) & F.col("f.to").eqNullSafe(F.col("s.at"))
    single = found.filter("n = 1").alias("f").join(s.hint("merge").alias("s"), same).filter(contains_words(F.col("s.plain"), F.col("f.needle"))).select("f.*")
    hits = wanted.join(single.unionByName(found.filter("n > 1")).hint("merge"), ["session", "needle"])
    only = hits.groupBy("answer_id", "ordinal").agg(F.sum("n").alias("n"), F.min("to").alias("to"), F.bool_or(F.col("to").eqNullSafe(F.col("seq"))).alias("there"))
    out = e.join(only.hint("merge"), ["answer_id", "ordinal"], "left")
    moved = F.when(~F.col("there") & (F.col("n") == 1), F.col("to")).otherwise(F.col("seq"))
    return out.select("answer_id", "ordinal", "session", moved.alias("seq"), "quote")


def question_answered(segments: DataFrame, questions: list[tuple[str, str]], lookback: int = 4, least: float = 0.6) -> DataFrame:
    """For each client segment the questionnaire item that the worker read last, at most ``lookback`` worker
    segments back; the nearest segment that fits wins, then the best share of words, then the least key."""
    content = lambda t: F.array_distinct(F.filter(words_of(normalize(t)), lambda w: F.length(w) >= 4))
    q = segments.sparkSession.createDataFrame(questions, "item string, question string").select("item", content(F.col("question")).alias("q"))
    q = q.select("item", F.size("q").alias("n_words"), F.explode("q").alias("word"))
    said = segments.filter("speaker = 'worker'").select("session", "seq", F.explode(content(F.col("text"))).alias("word"))
    share = F.count("*") / F.first("n_words")
    read = said.join(q, "word").groupBy("session", "seq", "item").agg(share.alias("share")).filter(F.col("share") >= least)
    read = read.groupBy("session", "seq").agg(F.min_by("item", F.struct(-F.col("share"), F.col("item"))).alias("item"))
    n_worker = F.count(F.when(F.col("speaker") == "worker", 1)).over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = segments.select("session", "seq", "speaker").join(read, ["session", "seq"], "left").withColumn("n_worker", n_worker)
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last(F.when(F.col("item").isNotNull(), F.struct("item", "n_worker")), ignorenulls=True).over(before))
    near = F.col("n_worker") - F.col("last.n_worker") < lookback
    return rows.filter("speaker = 'client'").select("session", "seq", F.when(near, F.col("last.item")).alias("item"))


def keep_sentences(sentences: DataFrame, max_chars: int) -> DataFrame:
    """Sentences (answer_id, ordinal, text) in order while their joined length fits; the first that doesn't ends it."""
    w = Window.partitionBy("answer_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("__length", F.sum(F.length("text") + 1).over(w) - 1).filter(F.col("__length") <= max_chars).drop("__length")


_EVIDENCE = "array<struct<segment:string,quote:string>>"
#: Fixed value: characters of a narrative where the field sets none.
NARRATIVE_CHARS = 900
CHOICES = ("select", "radio_group", "combobox")


def output_of(text):
    """An output's members, each only if it has the type that it must have: a number isn't a value, a string no count.
    What isn't JSON has no status."""
    v = dynamic.parse(text)
    word = lambda x, *path: dynamic.string_value(dynamic.at(x, *path))
    piece = lambda x: F.struct(word(x, "segment").alias("segment"), word(x, "quote").alias("quote"))
    evidence = lambda x: F.transform(dynamic.items(dynamic.at(x, "evidence")), piece)
    return F.struct(
        word(v, "discussed").alias("discussed"), piece(dynamic.at(v, "raised_at")).alias("raised_at"), word(v, "status").alias("status"), word(v, "value").alias("value"),
        dynamic.double_value(dynamic.at(v, "count")).alias("count"), word(v, "period").alias("period"), evidence(v).alias("evidence"),
        F.transform(dynamic.items(dynamic.at(v, "selections")), lambda x: F.struct(word(x, "value").alias("value"), evidence(x).alias("evidence"))).alias("selections"),
        F.transform(dynamic.items(dynamic.at(v, "sentences")), lambda x: F.struct(word(x, "text").alias("text"), evidence(x).alias("evidence"))).alias("sentences"),
    )


def _cite(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence (answer_id, ordinal, session, segment, quote) with seq, null where the segment is unknown."""
    ids = segments.select("session", F.col("segment_id").alias("segment"), "seq")
    return evidence.join(ids.hint("merge"), ["session", "segment"], "left").select("answer_id", "ordinal", "session", "segment", "seq", "quote")


def find_quotes(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (answer_id, ordinal, session, seq, quote) with ``found``: the quote is in its segment, or in
    the run of neighbouring cited segments of one speaker that its segment is in."""
    e = evidence.join(prepared_segments(segments).hint("merge"), ["session", "seq"], "left").withColumn("needle", normalize(strip_line_prefix(F.col("quote"))))
    e = e.join(cited_runs(e).hint("merge"), ["answer_id", "seq"], "left")
    found = contains_words(F.col("plain"), F.col("needle")) | contains_words(F.coalesce("run_text", F.lit("")), F.col("needle"))
    return e.withColumn("found", F.coalesce(found, F.lit(False))).select(*evidence.columns, "found")


def relocate_all(segments: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence as for ``find_quotes``; a quote that isn't found where it is cited moves to the client segment right
    after the cited worker segment if that has it, else to the only segment of the session that has it, if it is
    long and no bare answer (J19)."""
    e = materialize(find_quotes(segments, evidence), "quotes")
    plain = segments.select("session", "seq", "speaker", normalize(F.col("text")).alias("plain"))
    here = plain.select("session", "seq", F.col("speaker").alias("here"))
    following = plain.select("session", (F.col("seq") - 1).alias("seq"), F.col("speaker").alias("next"), F.col("plain").alias("next_plain"))
    e = e.join(here.hint("merge"), ["session", "seq"], "left").join(following.hint("merge"), ["session", "seq"], "left")
    answers = (F.col("here") == "worker") & (F.col("next") == "client") & contains_words(F.col("next_plain"), normalize(strip_line_prefix(F.col("quote"))))
    e = e.withColumn("answers", F.coalesce(answers, F.lit(False)))
    lost = e.filter(~F.col("found") & ~F.col("answers") & ~F.coalesce(is_negated_short_answer(strip_line_prefix(F.col("quote"))) | is_bare_affirmation(strip_line_prefix(F.col("quote"))), F.lit(False)))
    moved = relocate(segments, lost.select("answer_id", "ordinal", "session", "seq", "quote")).select("answer_id", "ordinal", F.col("seq").alias("to"))
    e = e.join(moved.hint("merge"), ["answer_id", "ordinal"], "left")
    seq = F.when(F.col("found"), F.col("seq")).when(F.col("answers"), F.col("seq") + 1).otherwise(F.coalesce("to", "seq"))
    return e.select("answer_id", "ordinal", "session", seq.alias("seq"), "quote")


def _malformed(evidence):
    """One malformed piece spoils all."""
    return evidence.isNull() | F.exists(evidence, lambda e: e["segment"].isNull() | e["quote"].isNull())


def _gate(segments: DataFrame, a: DataFrame) -> DataFrame:
    """Outputs of gated fields: ``gate`` says how one fails, ``raised`` is the cited place where it was discussed."""
    raised = a.filter("out.discussed = 'yes'").select("answer_id", F.lit(0).alias("ordinal"), "session", F.col("out.raised_at.segment").alias("segment"), F.col("out.raised_at.quote").alias("quote"))
    found = find_quotes(segments, relocate_all(segments, _cite(segments, raised.filter("segment is not null and quote is not null")).drop("segment")))
    found = found.filter("found").join(segments.select("session", "seq", "segment_id").hint("merge"), ["session", "seq"])
    found = found.select("answer_id", F.struct(F.col("segment_id").alias("segment"), strip_line_prefix(F.col("quote")).alias("quote")).alias("raised"))
    gate = F.when(F.col("out.discussed") != "yes", "insufficient_evidence").when((F.col("out.discussed") == "yes") & F.col("raised").isNull(), "quote_not_found")
    return a.join(found.hint("merge"), "answer_id", "left").withColumn("gate", gate)


def _groups(a: DataFrame) -> DataFrame:
    """One row for each value, selection or sentence: answer_id, ordinal, group, part, evidence, positive, early (a reason
    that needs no transcript) and skip (it says nothing)."""
    with_raised = lambda e: F.when(F.col("raised").isNull() | F.array_contains(e, F.col("raised")), e).otherwise(F.concat(F.array("raised"), F.coalesce(e, F.array().cast(_EVIDENCE))))
    known = lambda v: F.exists("options", lambda o: o["value"] == v)
    label = lambda v: F.get(F.filter("options", lambda o: o["value"] == v), F.lit(0))["label"]
    semantics = lambda v: F.when(F.col("option_semantics").isNotNull(), F.try_element_at("option_semantics", v))
    positive = lambda v: ~F.coalesce(is_negative_option(v, label(v), semantics(v)), F.lit(False))
    part = F.trim(F.col("value"))
    choice = F.col("kind").isin(*CHOICES)
    one = a.filter("shape = 'discrete'").withColumn("part", part).select(
        "answer_id", F.lit(0).alias("ordinal"), "part", with_raised(F.col("out.evidence")).alias("evidence"), F.coalesce(choice & positive(F.col("part")), F.lit(False)).alias("positive"),
        F.when(F.col("part").isNull() | (choice & ~known(F.col("part"))) | ((F.col("kind") == "date") & ~is_iso_date(F.col("part"))), "invalid_option").alias("early"),
        (~choice & (F.col("kind") != "date") & (F.col("part") == "")).alias("skip"),
    )
    many = a.filter("shape = 'checkbox'").select("*", F.posexplode("out.selections").alias("ordinal", "x")).withColumn("part", F.col("x.value"))
    again = F.row_number().over(Window.partitionBy("answer_id", "part").orderBy("ordinal")) > 1
    bad = F.col("part").isNull() | ~known(F.col("part"))
    many = many.select(
        "answer_id", "ordinal", "part", with_raised(F.col("x.evidence")).alias("evidence"), F.coalesce(positive(F.col("part")), F.lit(True)).alias("positive"),
        F.when(bad, "invalid_option").alias("early"), (~bad & again).alias("skip"),
    )
    prose = a.filter("shape = 'narrative'").select("*", F.posexplode("out.sentences").alias("ordinal", "x")).withColumn("part", F.trim(F.coalesce("x.text", F.lit(""))))
    prose = prose.select("answer_id", "ordinal", "part", F.col("x.evidence").alias("evidence"), F.lit(False).alias("positive"), F.lit(None).cast("string").alias("early"), (F.col("part") == "").alias("skip"))
    rows = one.unionByName(many).unionByName(prose)
    early = F.coalesce("early", F.when(_malformed(F.col("evidence")) & ~F.col("skip"), "quote_not_found"))
    return rows.withColumn("early", early).withColumn("group", F.concat_ws("/", "answer_id", "ordinal"))


def verify_outputs(segments: DataFrame, fields: DataFrame, outputs: DataFrame, questions: list[tuple[str, str]] | None = None) -> DataFrame:
    """The whole verifier. segments (session, segment_id, seq, speaker, text); fields (key, kind, mode, options
    array<struct<value,label>>, option_semantics map<string,string>, wanted_speaker, max_chars int, bands
    map<string,array<double>>); outputs (answer_id, session, key, output), the output being JSON. ``questions`` are
    questionnaire items by field key; an answer to one has to follow that question.

    Returns answer_id, key, status (filled, rejected, insufficient_evidence), reason, value (array) and evidence. The first
    rule that fails names the reason. Of checkboxes and narratives, parts that fail are left out, and the first
    reason is kept; "none" options go once a positive one stays; a narrative ends before the first sentence that
    would make it too long. Steps that are read more than once are written to the shared folder. Only ``fields`` may
    be broadcast: files of text are many times smaller than their rows, so the other joins are merges."""
    a = outputs.select("answer_id", "session", "key", output_of(F.col("output")).alias("out")).join(fields, "key")
    a = _gate(segments, a)
    band = F.when(F.col("bands").isNotNull() & (F.col("out.status") == "filled"), F.coalesce(frequency_band(F.col("out.count"), F.col("out.period"), F.col("bands")), F.lit("")))
    a = a.withColumn("band", band).withColumn("value", F.coalesce("band", "out.value"))
    known_status = F.coalesce(F.col("out.status").isin("filled", "insufficient_evidence"), F.lit(False))
    a = a.withColumn("early_status", F.when(F.col("gate") == "quote_not_found", "rejected").when(F.col("gate").isNotNull() | (F.col("band") == ""), "insufficient_evidence")
                     .when(~known_status, "rejected").when(F.col("out.status") == "insufficient_evidence", "insufficient_evidence"))
    a = a.withColumn("early_reason", F.when(F.col("gate") == "quote_not_found", "quote_not_found").when(F.col("gate").isNotNull(), F.lit(None)).when(F.col("band") == "", "invalid_option").when(~known_status, "malformed_output"))
    a = a.withColumn("shape", F.when(F.col("early_status").isNotNull(), "none").when(F.col("mode") == "narrative", "narrative").when(F.col("kind") == "checkbox_group", "checkbox").otherwise("discrete"))
    a = materialize(a.withColumn("questionnaire", (F.col("shape") == "discrete") & F.col("key").isin([k for k, _ in questions or []])), "outputs")
    groups = _groups(a).filter(~F.col("skip")).join(a.select("answer_id", "session", "key", "wanted_speaker", "questionnaire").hint("merge"), "answer_id")
    groups = materialize(groups, "output-parts")
    held = [groups]
    # pieces of evidence, one row each, under their group
    pieces = groups.filter("early is null").select(F.col("group").alias("answer_id"), "session", F.posexplode("evidence").alias("ordinal", "x"))
    pieces = pieces.select("answer_id", "ordinal", "session", F.col("x.segment").alias("segment"), strip_line_prefix(F.col("x.quote")).alias("quote"))
    cited = materialize(_cite(segments, pieces), "cited")
    moved = materialize(relocate_all(segments, cited.drop("segment")), "moved")
    judged = verify(segments, groups.filter("early is null").select(F.col("group").alias("answer_id"), "session", "wanted_speaker", "positive", "questionnaire"), moved.drop("session"))
    found = judged.select(F.col("answer_id").alias("group"), F.col("reason").alias("late"))
    if questions:
        asked = question_answered(segments, questions).withColumnRenamed("item", "asked")
        near = moved.join(asked.hint("merge"), ["session", "seq"]).join(groups.select(F.col("group").alias("answer_id"), "key").hint("merge"), "answer_id")
        near = near.groupBy(F.col("answer_id").alias("group")).agg(F.bool_or(F.coalesce(F.col("asked") == F.col("key"), F.lit(False))).alias("same"), F.count("asked").alias("n_asked"))
        found = found.join(near.hint("merge"), "group", "left")
        wrong = F.when(F.col("same"), F.lit(None)).when(F.coalesce("n_asked", F.lit(0)) == 0, "question_not_asked").otherwise("question_mismatch")
    else:
        wrong = F.lit(None).cast("string")
    groups = groups.join(found.withColumn("wrong", wrong).hint("merge"), "group", "left")
    groups = materialize(groups.withColumn("reason", F.coalesce("early", "late", F.when(F.col("questionnaire"), F.col("wrong")))), "judged-parts")
    quoted = moved.join(segments.select("session", "seq", "segment_id").hint("merge"), ["session", "seq"], "left").join(cited.select("answer_id", "ordinal", "segment").hint("merge"), ["answer_id", "ordinal"])
    quoted = quoted.groupBy(F.col("answer_id").alias("group")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("segment_id", "segment").alias("segment"), "quote"))).alias("q"))
    groups = groups.join(quoted.hint("merge"), "group", "left").withColumn("q", F.coalesce(F.transform("q", lambda x: F.struct(x["segment"].alias("segment"), x["quote"].alias("quote"))), F.array().cast(_EVIDENCE)))
    # a narrative's sentences while they fit; what comes after the first that doesn't isn't looked at
    so_far = Window.partitionBy("answer_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    shape = a.select("answer_id", "shape", F.coalesce("max_chars", F.lit(NARRATIVE_CHARS)).alias("most"), "options")
    groups = groups.join(shape.hint("merge"), "answer_id").withColumn("ok", F.col("reason").isNull())
    length = F.sum(F.when(F.col("ok"), F.length("part") + 1).otherwise(0)).over(so_far) - 1
    groups = groups.withColumn("over", F.max(F.when(F.col("ok") & (length > F.col("most")), 1).otherwise(0)).over(so_far)).filter("shape <> 'narrative' or over = 0")
    some_positive = F.max(F.when(F.col("ok") & F.col("positive"), 1).otherwise(0)).over(Window.partitionBy("answer_id")) == 1
    groups = groups.withColumn("stays", F.col("ok") & ((F.col("shape") != "checkbox") | F.col("positive") | ~some_positive))
    place = F.when(F.col("shape") == "checkbox", F.array_position(F.transform("options", lambda o: o["value"]), F.col("part"))).otherwise(F.col("ordinal").cast("bigint"))
    kept = F.array_sort(F.collect_list(F.when(F.col("stays") | (F.col("shape") == "discrete"), F.struct(place.alias("place"), "part", "q"))))
    per = groups.groupBy("answer_id").agg(kept.alias("kept"), F.min_by("reason", F.when(~F.col("ok"), F.col("ordinal"))).alias("first_reason"), F.bool_or("stays").alias("any_stays"))
    out = a.join(per.hint("merge"), "answer_id", "left")
    stays = F.coalesce("any_stays", F.lit(False))
    status = F.coalesce("early_status", F.when(stays, "filled").when((F.col("shape") == "discrete") & F.col("first_reason").isNotNull(), "rejected").otherwise("insufficient_evidence"))
    parts = F.filter(F.transform("kept", lambda k: k["part"]), lambda p: p.isNotNull())
    value = F.when(F.size(parts) == 0, F.lit(None)).when(F.col("shape") == "narrative", F.array(F.array_join(parts, " "))).otherwise(parts)
    result = out.select(
        "answer_id", "key", status.alias("status"), F.coalesce("early_reason", "first_reason").alias("reason"),
        value.alias("value"), F.coalesce(F.flatten(F.transform("kept", lambda k: k["q"])), F.array().cast(_EVIDENCE)).alias("evidence"),
    )
    result = materialize(result, "verified")
    release(a, groups, cited, moved, *held)
    return result
