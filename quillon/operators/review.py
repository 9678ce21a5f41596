"""Reviews of filled forms, charts, sessions and transcripts against references.

Unless said otherwise a null key joins nothing, repeated rows count as often as they occur, and empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quillon.functions.text import NUMBER_WORDS, word_error_rate
from quillon.operators.timeline import overlapping


def review_rows(results: DataFrame, reports: DataFrame, fields: DataFrame, keys: list[str], field_key: str) -> DataFrame:
    """Each result with the report on it and its field, either of which may be missing."""
    return results.join(reports, keys, "left").join(fields, field_key, "left")


def only_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key no other row has."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")


def unconfirmed(sessions: DataFrame, keys: DataFrame, key: str, confirmed: str, stage: str | None = None) -> DataFrame:
    """Sessions that aren't confirmed and whose key is still there; given ``stage``, only those past arming."""
    out = sessions.filter(F.col(confirmed).isNull()).join(keys.select(key), key, "left_semi")
    return out if stage is None else out.filter(F.col(stage).isNotNull() & (F.col(stage) != "armed"))


def gates(checks: DataFrame, least_accuracy: float) -> DataFrame:
    """One row from checks (bucket, pass, risk, ms, cache_miss): four gates and the total time. What
    wasn't measured hasn't passed."""
    is_blank = F.col("bucket") == "must_leave_blank"
    out = checks.agg(
        F.count_if(is_blank & ~F.col("pass")).alias("violations"), F.count_if(F.col("risk") & ~F.col("pass")).alias("risk_errors"),
        F.avg(F.when(~is_blank, F.col("pass").cast("double"))).alias("accuracy"), F.bool_or("cache_miss").alias("missed"),
        F.coalesce(F.sum("ms"), F.lit(0).cast("bigint")).alias("total_ms"),
    )
    return out.select(
        (F.col("violations") == 0).alias("blank_gate"), (F.col("risk_errors") == 0).alias("risk_gate"),
        F.coalesce(F.col("accuracy") >= least_accuracy, F.lit(False)).alias("accuracy_gate"), F.coalesce(~F.col("missed"), F.lit(False)).alias("cache_gate"), "total_ms",
    )


def review_load(needs_review: DataFrame, filled: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Fields to review that are filled and passed their check."""
    return needs_review.join(filled.select(key), key, "left_semi").join(checks.filter("pass").select(key), key, "left_semi")


def established(answers: DataFrame, session: str, outcome: str, want: str, risk: str, seconds: str) -> DataFrame:
    """Totals of judged answers; how many with an answer to be found were right; mean seconds a session."""
    ok, unsafe, some = F.col(outcome) == "ok", F.col(outcome) == "unsafe", F.size(F.coalesce(F.col(want), F.array())) > 0
    per = answers.groupBy(session).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(unsafe).alias("unsafe"), F.count_if(unsafe & F.col(risk)).alias("risk_unsafe"),
        F.count_if(some).alias("some"), F.count_if(some & ok).alias("some_ok"), F.first(seconds).alias("s"),
    )
    return per.agg(
        F.count("*").alias("sessions"), F.sum("n").alias("answers"), (F.sum("ok") / F.sum("n")).alias("accuracy"), F.sum("unsafe").alias("unsafe"),
        F.sum("risk_unsafe").alias("risk_unsafe"), F.sum("some_ok").alias("established_ok"), F.sum("some").alias("established"), F.avg("s").alias("mean_seconds"),
    )


def missing_share(reference: DataFrame, hypothesis: DataFrame, keys: list[str], word: str) -> DataFrame:
    """by key the share of the reference's words that the hypothesis lacks; what is said twice is needed twice."""
    wanted = reference.groupBy(*keys, word).agg(F.count("*").alias("wanted"))
    given = hypothesis.groupBy(*keys, word).agg(F.count("*").alias("given"))
    rows = wanted.join(given, [*keys, word], "left")
    lacking = F.greatest(F.col("wanted") - F.coalesce("given", F.lit(0)), F.lit(0))
    return rows.groupBy(*keys).agg((F.sum(lacking) / F.sum("wanted")).alias("missing"))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Each row's place in an order inside its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def call_source_order(in_call: Column, is_call_app: Column, playing: Column, name: Column) -> list[Column]:
    """In a call first, then call apps, then what plays, then by name."""
    return [F.desc(in_call), F.desc(is_call_app), F.desc(playing), F.lower(name), name]


def stamp(lines: DataFrame, keys: list[str], order: str, text: str, words_a_minute: float) -> DataFrame:
    """``start`` in seconds for lines spoken one after the other at a steady rate."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    before = F.sum(words).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0)) * (60.0 / words_a_minute))


def two_teachers(a: DataFrame, b: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """The label is what both say, a blank included; where they differ it is null and ``agree`` false."""
    joined = a.withColumnRenamed(answer, "teacher_a").join(b.withColumnRenamed(answer, "teacher_b"), keys, "full")
    agree = F.col("teacher_a").eqNullSafe(F.col("teacher_b"))
    return joined.select(*keys, "teacher_a", "teacher_b", agree.alias("agree"), F.when(agree, F.col("teacher_a")).alias("label"))


def questions(fields: DataFrame, key: str, options: str, is_multi: str) -> DataFrame:
    """A question for each field, or for each option of a multiple choice, with its letters (Z: none)."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXY")
    one = fields.filter(~F.col(is_multi)).select(F.col(key).alias("qid"), F.col(key).alias("field"), F.concat(F.substring(letters, F.lit(1), F.size(options)), F.lit("Z")).alias("letters"))
    many = fields.filter(F.col(is_multi)).select(key, F.explode(options).alias("o")).select(F.concat_ws(":", key, "o").alias("qid"), F.col(key).alias("field"), F.lit("AB").alias("letters"))
    return one.unionByName(many)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """A25."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def mean_by(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Means by key that leave out what is missing."""
    return df.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])


#: Titles whose full stop ends no sentence, words that are numbers or dates, and capitals that name nobody.
TITLES = ["Dr.", "Mr.", "Mrs.", "Ms.", "St.", "Jr.", "Sr."]
ORDINALS = {"first": "1", "second": "2", "third": "3"}
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split()
NOT_NAMES = ["i", "i'm", "i've", "i'll", "i'd", "okay", "ok", "yeah", "um", "uh", "mm", "oh", "dr", "mr", "mrs", "ms", "st", "jr", "sr"]
_NUMBERS = {w: str(n) for w, n in NUMBER_WORDS.items()} | ORDINALS
_EDGES = re.compile(r"^[^\w'/:-]+|[^\w'/:-]+$")


def heard_word(word: str) -> str:
    """A word as entities are compared: numbers as digits, no hyphens, slashes, colons and commas."""
    word = word.lower().replace("’", "'")
    return _NUMBERS.get(word) or re.sub("[-/:,]", "", word)


def entities_of(text: str | None) -> list[str]:
    text, out = text or "", []
    for title in TITLES:
        text = text.replace(title, title[:-1])
    for sentence in re.split("[.?!]", text):
        for place, token in enumerate(sentence.split()):
            word = _EDGES.sub("", token.replace("_", " ").strip()) if "_" in token else _EDGES.sub("", token)
            if not word:
                continue
            plain = heard_word(word)
            has_number = any(c.isnumeric() for c in word) or word.lower() in _NUMBERS or word.lower() in CALENDAR
            acronym = len(word) >= 2 and word == word.upper() and any(c.isalpha() for c in word)
            if has_number or acronym or (place and word[0].isupper() and plain not in NOT_NAMES):
                out.append(plain)
    return out


@F.arrow_udf(ArrayType(StringType()))
def entities(text: pa.Array) -> pa.Array:
    """the words a note depends on: numbers, dates, acronyms and capitals inside a sentence."""
    return pa.array([entities_of(t) for t in text.to_pylist()], pa.list_(pa.string()))


def entity_error(reference: str | None, heard: str | None) -> float:
    wanted = entities_of(reference)
    given, missing = Counter(filter(None, (heard_word(_EDGES.sub("", w)) for w in (heard or "").split()))), 0
    for word in wanted:
        missing += given[word] == 0
        given[word] = max(0, given[word] - 1)
    return missing / len(wanted) if wanted else 0.0


@F.arrow_udf(DoubleType())
def entity_error_rate(reference: pa.Array, heard: pa.Array) -> pa.Array:
    """share of the reference's entities that weren't heard; what is said twice has to be heard twice."""
    return pa.array([entity_error(a, b) for a, b in zip(reference.to_pylist(), heard.to_pylist(), strict=True)], pa.float64())


#: Engines that are compared at once.
MOST_ENGINES = 100


def transcript_errors(reference: DataFrame, heard: DataFrame, keys: list[str], engine: str, text: str, engines: list[str] | None = None) -> DataFrame:
    """Word and entity error rates of each engine's text for each key; a key that an engine lacks has null rates.
    ``engines`` are those that were heard if none are given, MOST_ENGINES at most."""
    if engines is None:
        engines = [r[0] for r in heard.select(engine).filter(F.col(engine).isNotNull()).distinct().limit(MOST_ENGINES + 1).collect()]
    if len(engines) > MOST_ENGINES:
        raise ValueError(f"more than {MOST_ENGINES} engines")
    each = F.explode(F.array(*[F.lit(e) for e in engines]).cast("array<string>")).alias(engine)
    rows = reference.select(*keys, F.col(text).alias("__reference"), each).join(heard.select(*keys, engine, F.col(text).alias("__heard")).hint("merge"), [*keys, engine], "left")
    missing = F.col("__heard").isNull()
    rates = F.when(~missing, word_error_rate("__reference", "__heard")).alias("wer"), F.when(~missing, entity_error_rate("__reference", "__heard")).alias("entity_error")
    return rows.select(*keys, engine, *rates)


def probe_errors(reference: DataFrame, heard: DataFrame, session: str, shift: float, seconds: float, slack: float = 0.5) -> DataFrame:
    """Reference lines and heard segments (session, speaker, start, end, text) to word error rate and missed lines of
    each speaker. Reference times are those of a file: lines that end by ``seconds`` count, ``shift`` later on the session's
    clock. A line is missed if nothing of its speaker was heard within ``slack`` of it."""
    keys = [session, "speaker"]
    lines = reference.filter(F.col("end") < seconds).withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)
    strictly = (F.col("r.start") < F.col("l.end") + slack) & (F.col("r.end") > F.col("l.start") - slack)
    lost = overlapping(lines, heard, keys, 60.0, slack, "left_anti", strictly).groupBy(*keys).agg(F.count("*").alias("missed"))
    joined = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("x")).select(*keys, F.array_join(F.transform("x", lambda s: s["text"]), " ").alias(name))
    rows = joined(lines, "__wanted").join(joined(heard, "__heard"), keys, "left").join(lost, keys, "left")
    return rows.select(*keys, word_error_rate("__wanted", F.coalesce("__heard", F.lit(""))).alias("wer"), F.coalesce("missed", F.lit(0)).alias("missed"))


def worst_backlog(lanes: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Seconds that wait in the lane where most do; no lane is nothing waiting."""
    each = lanes.groupBy(*keys, "lane").agg(F.sum(F.col(end) - F.col(start)).alias("__waiting"))
    return each.groupBy(*keys).agg(F.coalesce(F.max("__waiting"), F.lit(0)).alias("backlog"))


def status_histogram(results: DataFrame) -> DataFrame:
    """Results by status and reason, every row counted."""
    return results.groupBy("status", "reason").agg(F.count("*").alias("n"))


def without_placeholders(mapping: DataFrame, intent: str, placeholder: str) -> DataFrame:
    """Fields whose intent somebody has written."""
    return mapping.filter(~F.col(intent).eqNullSafe(F.lit(placeholder)))
