"""Joins of truth, predictions and accepted alternatives, and the rates that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(truth: DataFrame, predictions: DataFrame, accepted: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Truth (keys, field, label array) with ``outcome`` ok, blank or unsafe, from predictions (value array) and
    accepted (acceptable array of arrays, which takes the label's place). Sessions without any prediction aren't
    judged; a field that wasn't predicted is empty. Empty and null answers are one; lists fit in any order."""
    none = F.array().cast("array<string>")
    rows = truth.join(predictions.select(*keys).distinct(), keys, "left_semi")
    rows = rows.join(predictions.select(*keys, field, "value"), [*keys, field], "left").join(accepted.select(*keys, field, "acceptable"), [*keys, field], "left")
    value = F.array_sort(F.coalesce("value", none))
    good = F.exists(F.coalesce("acceptable", F.array("label")), lambda a: F.array_sort(F.coalesce(a, none)) == value)
    return rows.withColumn("outcome", F.when(good, "ok").when(F.size(value) == 0, "blank").otherwise("unsafe"))


def rates(checks: DataFrame, *by: str) -> DataFrame:
    """Shares of ok, unsafe and blank, and how many of how many are good."""
    share = lambda name: F.avg((F.col("outcome") == name).cast("double")).alias(name)
    return checks.groupBy(*by).agg(share("ok"), share("unsafe"), share("blank"), F.count_if(F.col("outcome") == "ok").alias("good"), F.count("*").alias("n"))


def bag_union(*checks: DataFrame) -> DataFrame:
    """All checks, repeated ones as often as they occur."""
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def pair_files(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Rows of two sources whose files are in one folder; columns but ``path`` keep their names."""
    folder = lambda df: df.withColumn("folder", F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).drop(path)
    return folder(left).join(folder(right), "folder")
