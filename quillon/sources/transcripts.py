"""Transcript sources: text lines, tables of dialogues, and interval grids, each as one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import parse_clock, segment_id
from quillon.operators.timeline import segment_ends

LINE = r"^\[([^\]]*)\]\s*([^:]*):\s*(.*)$"

#: Parts transcripts that share a file: a form feed, which is white space to S01's lines.
BETWEEN = "\f"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """session (file name without its ending), line_no, line of all text files below ``path``."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return files.select(name.alias("session"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def many_lines(spark: SparkSession, path: str) -> DataFrame:
    """session, line_no, line of files that hold many transcripts, each of which begins with ``# session: name``."""
    files = spark.read.option("lineSep", BETWEEN).text(path)
    name = F.nullif(F.regexp_extract("value", r"^# session: ([^\n]*)", 1), F.lit(""))
    return files.select(name.alias("session"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def parse_strict(text_lines: DataFrame, speakers: tuple[str, ...] = ("worker", "client")) -> DataFrame:
    """Session, seq, segment_id, speaker, start, end, text. Bad timestamps, unknown speakers and times that
    go backwards raise an error that names the line; ``#`` headers and blank lines are left out."""
    rows = text_lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    clock, who, said = (F.regexp_extract("line", LINE, k) for k in (1, 2, 3))
    rows = rows.withColumns({"start": parse_clock(clock), "speaker": F.lower(who), "text": F.trim(said)})
    w = Window.partitionBy("session").orderBy("line_no")
    rows = rows.withColumn("__before", F.lag("start").over(w))
    at = F.concat(F.col("session"), F.lit(" line "), (F.col("line_no") + 1).cast("string"), F.lit(": "))
    problem = (
        F.when(~F.col("line").rlike(r"^\[[^\]]*\]"), "expected [mm:ss]").when(F.col("start").isNull(), "bad timestamp")
        .when(~F.col("line").rlike(LINE), "expected SPEAKER:").when(~F.col("speaker").isin(*speakers), "unknown speaker")
        .when(F.col("start") < F.col("__before"), "timestamp goes backwards")
    )
    rows = rows.withColumn("start", F.when(problem.isNull(), F.col("start")).otherwise(F.raise_error(F.concat(at, problem)).cast("double")))
    rows = rows.withColumn("seq", F.row_number().over(w)).withColumn("segment_id", segment_id(F.col("seq")))
    return segment_ends(rows, ["session"], ["seq"], "start", "text").select("session", "seq", "segment_id", "speaker", "start", "end", "text")


def headers(text_lines: DataFrame) -> DataFrame:
    """Session and a map of its ``# key: value`` lines, the last of a key winning."""
    rows = text_lines.withColumn("line", F.trim("line")).filter(F.col("line").rlike("^#[^:]*:"))
    key, value = (F.trim(F.regexp_extract("line", r"^#\s*([^:]*):(.*)$", k)) for k in (1, 2))
    last = rows.groupBy("session", key.alias("key")).agg(F.max_by(value, "line_no").alias("value"))
    return last.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("headers"))


def parse_permissive(text_lines: DataFrame, keep_unmatched: bool) -> DataFrame:
    """S03 keeps lines that don't parse as they are; S04 drops them and keeps times."""
    rows = text_lines.withColumn("line", F.trim("line")).filter("line <> '' and not startswith(line, '#')")
    ok = F.col("line").rlike(LINE)
    out = rows.select(
        "session", "line_no", F.when(ok, F.trim(F.regexp_extract("line", LINE, 2))).alias("speaker"), F.when(ok, parse_clock(F.regexp_extract("line", LINE, 1))).alias("start"),
        F.when(ok, F.trim(F.regexp_extract("line", LINE, 3))).otherwise(F.col("line")).alias("text"), ok.alias("matched"),
    )
    return out if keep_unmatched else out.filter("matched").drop("matched")


def dialogue_turns(df: DataFrame, key: str, dialogue: str, speaker_pattern: str) -> DataFrame:
    """A cell of many lines to turns; a line without a speaker goes on with the turn before."""
    rows = df.select(key, F.posexplode(F.split(dialogue, r"\r?\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    rows = rows.withColumns({"speaker": F.nullif(F.regexp_extract("line", speaker_pattern, 1), F.lit("")), "said": F.trim(F.regexp_extract("line", speaker_pattern, 2))})
    rows = rows.withColumn("said", F.when(F.col("speaker").isNull(), F.trim("line")).otherwise(F.col("said")))
    turn = F.count("speaker").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("turn", turn).filter("turn > 0").groupBy(key, "turn").agg(F.min_by("speaker", "line_no").alias("speaker"), F.array_sort(F.collect_list(F.struct("line_no", "said"))).alias("x"))
    return grouped.select(key, "turn", "speaker", F.array_join(F.transform("x", lambda s: s["said"]), " ").alias("text"))


def interval_grid(text_lines: DataFrame) -> DataFrame:
    """Each ``text =`` line with the last ``xmin =`` before it; markup is cleaned, empty texts are left out."""
    rows = text_lines.withColumn("line", F.trim("line"))
    xmin = F.regexp_extract("line", r"^xmin =\s*(.*)$", 1).try_cast("double")
    before = Window.partitionBy("session").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.last(xmin, ignorenulls=True).over(before)).filter("startswith(line, 'text =') and start is not null")
    text = F.regexp_replace(F.trim(F.regexp_extract("line", r"^text =\s*(.*)$", 1)), '^"|"$', "")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<UNIN/>", "[inaudible]"), "</?UNSURE>", ""), "<[^>]+>", ""))
    return rows.select("session", "line_no", "start", text.alias("text")).filter("text <> ''")


def two_tracks(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("WORKER", "CLIENT")) -> DataFrame:
    """Two tracks of one session in time order."""
    both = first.withColumn("speaker", F.lit(names[0])).unionByName(second.withColumn("speaker", F.lit(names[1])))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("start", "speaker", "text")))


def densify(reviews: DataFrame, scope: DataFrame, item: str, field: str, value: str) -> DataFrame:
    """Every reviewed item with every field of the scope, fields without a decision being empty lists."""
    items = reviews.select(item).distinct().withColumn("__fields", F.lit(None))
    fields = scope.agg(F.collect_set(field).alias("all"))  # the scope is one short list of fields
    grid = items.drop("__fields").join(F.broadcast(fields)).select(item, F.explode("all").alias(field))
    given = reviews.groupBy(item, field).agg(F.first(value, ignorenulls=True).alias(value))
    return grid.join(given, [item, field], "left").withColumn(value, F.coalesce(value, F.array().cast("array<string>")))
