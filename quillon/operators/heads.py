"""Scoring heads over vectors: options against queries, the choice of one or several, and targets to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Options reach every task as literals, so there may be so many at most.
MOST_OPTIONS = 1_000


def option_vectors(options: DataFrame, name: str, vector: str) -> list[tuple[str, list[float]]]:
    """Options in the order of their names. More than MOST_OPTIONS are an error."""
    rows = options.select(F.col(name).cast("string").alias("name"), F.col(vector).cast("array<double>").alias("vector")).orderBy("name").limit(MOST_OPTIONS + 1).collect()
    if len(rows) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options")
    return [(r["name"], r["vector"]) for r in rows]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def logits(vector: Column, options: list[tuple[str, list[float]]], scale: float = 1.0) -> Column:
    """The score of each option, in their order."""
    return F.array(*[dot(vector, F.lit(v)) * scale for _, v in options])


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(scores)
    parts = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))


def choose_one(scores: Column, options: list[str], temperature: float = 1.0, least: float = 0.0) -> Column:
    """struct(value, confidence): the option with the best score (the first of equals), null if its probability is
    below ``least`` or if a last score without an option, that of saying nothing, is the best."""
    p = softmax(scores, temperature)
    confidence = F.array_max(p)
    value = F.get(F.array(*[F.lit(o) for o in options]), (F.array_position(p, confidence) - 1).cast("int"))
    return F.struct(F.when(confidence >= least, value).alias("value"), confidence.alias("confidence"))


def choose_many(scores: Column, options: list[str], exclusive: list[str] | None = None, temperature: float = 1.0, least: float = 0.0) -> Column:
    """struct(values, confidence): options with a probability above one half, by name; those that stand alone go if
    others are chosen. The confidence is that of the least certain option, chosen or not; below ``least`` nothing is."""
    p = F.transform(scores, lambda x: 1 / (1 + F.exp(-x / temperature)))
    confidence = F.array_min(F.transform(p, lambda x: F.greatest(x, 1 - x)))
    named = F.arrays_zip(F.array(*[F.lit(o) for o in options]).alias("o"), p.alias("p"))
    chosen = F.array_sort(F.transform(F.filter(named, lambda x: x["p"] > 0.5), lambda x: x["o"]))
    alone = F.array(*[F.lit(o) for o in exclusive or []]).cast("array<string>")
    chosen = F.when(F.size(chosen) > 1, F.array_except(chosen, alone)).otherwise(chosen)
    return F.struct(F.when((confidence >= least) & (F.size(chosen) > 0), chosen).alias("values"), confidence.alias("confidence"))


def target_one(label: Column, options: list[str]) -> Column:
    """The place of the label; one past the last for no label, null for one that is no option."""
    place = F.array_position(F.array(*[F.lit(o) for o in options]), label) - 1
    return F.when(label.isNull(), F.lit(len(options))).when(place >= 0, place).cast("int")


def target_many(labels: Column, options: list[str]) -> Column:
    """One for each option that is among the labels, else zero."""
    held = F.coalesce(labels, F.array().cast("array<string>"))
    return F.array(*[F.array_contains(held, o).cast("int") for o in options])
