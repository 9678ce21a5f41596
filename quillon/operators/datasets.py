"""Splitting, sampling and bookkeeping of labelled datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import in_validation


def split_by_group(df: DataFrame, group: str, excluded: DataFrame | None = None) -> DataFrame:
    """``split`` is train or val, the same for all rows of a group; excluded groups go."""
    if excluded is not None:
        df = df.join(excluded.select(group).distinct(), group, "left_anti")
    return df.withColumn("split", F.when(in_validation(F.col(group).cast("string")), "val").otherwise("train"))


def leaks(split: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split; none if it was made by group."""
    return split.groupBy(group).agg(F.count_distinct("split").alias("sides")).filter("sides > 1").select(group)


def epoch_sample(df: DataFrame, group: str, variant: str, row: str, seed: str, share: float) -> DataFrame:
    """All originals (variant null), and for a ``share`` of the groups one of their variants. The draw is a
    hash of seed and id, so it is the same on every run and needs no random state."""
    draw = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")), 256)
    originals = df.filter(F.col(variant).isNull())
    per_mille = F.conv(F.substring(draw(group), 1, 8), 16, 10).cast("bigint") % 1000
    others = df.filter(F.col(variant).isNotNull()).filter(per_mille < int(share * 1000))
    first = F.row_number().over(Window.partitionBy(group).orderBy(draw(row)))
    return originals.unionByName(others.withColumn("__rank", first).filter("__rank = 1").drop("__rank"))


def export_counts(df: DataFrame, by: list[str], minutes: str) -> DataFrame:
    """A26, K06."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum(minutes), 3).alias("minutes"))


def agreement(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of rows on which two labels agree, null being a label."""
    return df.groupBy(*by).agg(F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")), 3).alias("agreement"), F.count("*").alias("n"))


def without_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """A whole record goes if any of its rows is flagged."""
    return df.join(flagged.select(key).distinct(), key, "left_anti")


def unreferenced(stored: DataFrame, referenced: DataFrame, key: str, size: str) -> DataFrame:
    """Stored blobs that nothing refers to, and the bytes they hold."""
    gone = stored.join(referenced.select(key).distinct(), key, "left_anti")
    return gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_freed"))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def batches(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Rows of each key in batches of ``size``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.floor((rank - 1) / size).cast("bigint"))


#: Reasons why a session isn't in a dataset, the first that holds.
NO_TRUTH, NO_TURNS, FLAGGED = "no truth", "no turns", "flagged"


def records(sessions: DataFrame, truths: DataFrame, turns: DataFrame, labels: DataFrame, flagged: DataFrame, scope: list[str]) -> DataFrame:
    """One row for each session: id, reason (null for those in the dataset) and the record (null for others).

    sessions (id, kind, language, minutes), truths (id, origin), turns (id, turn, speaker, text), labels (id, field,
    value array, agreed, mode, acceptable array) and flagged (id). A record's group is its origin, else itself, and names
    its split; its turns are in order; its labels are those of ``scope``, in that order, nulls among what is accepted
    being empty strings."""
    said = turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said"))
    said = said.select("id", F.transform("said", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias("transcript"))
    place = F.array_position(F.array(*[F.lit(f) for f in scope]), F.col("field"))
    accepted = F.transform(F.coalesce("acceptable", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    own = labels.filter(F.col("field").isin(scope)).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "field", F.coalesce("value", F.array().cast("array<string>")).alias("value"), F.coalesce("agreed", F.lit(False)).alias("agreed"), F.coalesce("mode", F.lit("")).alias("mode"), accepted.alias("acceptable")))).alias("own")
    )
    own = own.select("id", F.transform("own", lambda x: x.dropFields("place")).alias("labels"))
    rows = sessions.join(truths.select("id", "origin", F.lit(True).alias("__truth")), "id", "left").join(said, "id", "left").join(own, "id", "left")
    rows = rows.join(flagged.select("id").distinct().withColumn("__flagged", F.lit(True)), "id", "left")
    reason = F.when(F.col("__truth").isNull(), NO_TRUTH).when(F.col("transcript").isNull(), NO_TURNS).when(F.col("__flagged"), FLAGGED)
    group = F.coalesce("origin", F.col("id").cast("string"))
    split = F.when(in_validation(group), "validation").otherwise("train")
    none = F.array().cast(own.schema["labels"].dataType)
    record = F.struct("id", group.alias("group"), "kind", split.alias("split"), "language", F.coalesce("minutes", F.lit(0)).alias("minutes"), "transcript", F.coalesce("labels", none).alias("labels"))
    return rows.select("id", reason.alias("reason"), F.when(reason.isNull(), record).alias("record"))


def record_counts(rows: DataFrame) -> DataFrame:
    """How many records there are by kind and split, and how many sessions were left out for which reason."""
    return rows.groupBy("record.kind", "record.split", "reason").agg(F.count("*").alias("n"), F.sum("record.minutes").alias("minutes"), F.sum(F.size("record.labels")).alias("labels"))


def carry_over(truths: DataFrame, heard: DataFrame, checks: DataFrame) -> DataFrame:
    """Labels of a session carried over to its restyled version: session, field, label, mode, origin_mode, heard, agree,
    verified.

    truths (session, field, label array or null, agree, mode), heard (session, field, value array or null): what a blind
    reader found in the new version, and checks (session, field, yes, line, n_lines). A label still agrees if the reader
    found the same; one that was only missed agrees if a check names a line of the new version for it. Arrays are compared
    in order of their values, empty ones are nothing."""
    plain = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    rows = truths.select("session", "field", plain(F.col("label")).alias("label"), F.coalesce("agree", F.lit(False)).alias("was"), F.col("mode").alias("origin_mode"))
    rows = rows.join(heard.select("session", "field", plain(F.col("value")).alias("heard")), ["session", "field"], "left").join(checks, ["session", "field"], "left")
    same, missed = F.col("label").eqNullSafe(F.col("heard")), F.col("was") & F.col("label").isNotNull() & F.col("heard").isNull()
    found = missed & F.coalesce(F.col("yes") & F.col("line").between(1, F.col("n_lines")), F.lit(False))
    verified = F.when(found, F.concat(F.lit("targeted L"), F.col("line").cast("string")))
    return rows.select("session", "field", "label", F.lit("RESTYLED").alias("mode"), "origin_mode", "heard", ((F.col("was") & same) | found).alias("agree"), verified.alias("verified"), "was")


def kept_share(carried: DataFrame) -> DataFrame:
    """Session, kept, candidates (labels that agreed before) and their share."""
    out = carried.groupBy("session").agg(F.count_if("agree").alias("kept"), F.count_if("was").alias("candidates"))
    return out.withColumn("share", F.when(F.col("candidates") > 0, F.col("kept") / F.col("candidates")))


def kept_topics(facts: DataFrame, keys: list[str], segments: int) -> DataFrame:
    """Facts (keys, topic, discussed, segment from 0) to what each of a session's segments must not bring up: keys,
    segment, never (topics that aren't discussed at all) and later (those of the segments after it), each topic once."""
    per = facts.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(~F.col("discussed"), F.col("topic")))).alias("never"), F.collect_set(F.when(F.col("discussed"), F.struct("segment", "topic"))).alias("said")
    )
    rows = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"))
    later = F.array_sort(F.array_distinct(F.transform(F.filter("said", lambda x: x["segment"] > F.col("segment")), lambda x: x["topic"])))
    return rows.select(*keys, "segment", "never", later.alias("later"))
