"""Scoring of field answers. Three scorers stay apart because they judge partly filled answers differently.

Answers are ``values array<string>`` with ``is_multi boolean``; an empty string is blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first result of a key counts."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last report of a key counts."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("x"))
    return best.select(*keys, "x.*")


def must_fill(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Single values must be equal, lists equal as sets. expected (want array<string>, want_multi)."""
    joined = expected.join(results, keys, "left")
    blank = F.col("values").isNull() | (F.size("values") == 0)
    single = ~F.col("want_multi") & ~F.coalesce("is_multi", F.lit(False)) & (F.col("values")[0] == F.col("want")[0])
    multi = F.col("want_multi") & (F.array_sort(F.array_distinct("values")) == F.array_sort(F.array_distinct("want")))
    return joined.select(*keys, F.lit("must_fill").alias("bucket"), (~blank & F.coalesce(single | multi, F.lit(False))).alias("pass"))


def left_blank(keys_df: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    joined = keys_df.join(results, keys, "left")
    return joined.select(*keys, F.lit("must_leave_blank").alias("bucket"), (F.col("values").isNull() | (F.size("values") == 0)).alias("pass"))


def acceptable(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Any of ``options`` (null: blank is fine), as a single value."""
    joined = expected.join(results, keys, "left")
    blank = F.col("values").isNull() | (F.size("values") == 0)
    hit = F.exists("options", lambda o: F.when(o.isNull(), blank).otherwise(~blank & ~F.coalesce("is_multi", F.lit(False)) & (F.col("values")[0] == o)))
    return joined.select(*keys, F.lit("acceptable").alias("bucket"), F.coalesce(hit, F.lit(False)).alias("pass"))


def accuracy(checks: DataFrame, by: list[str]) -> DataFrame:
    """Passed, total and their ratio (0 without checks)."""
    out = checks.groupBy(*by).agg(F.count_if("pass").alias("passed"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0))


def trap_status(traps: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Traps (id and ``key``, a row for each field): fail if any check of its fields fails, pass if any was
    checked, else manual."""
    each = traps.select("id", key).join(checks.groupBy(key).agg(F.bool_and("pass").alias("ok")), key, "left")
    out = each.groupBy("id").agg(F.count_if(~F.col("ok")).alias("failed"), F.count("ok").alias("checked"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "fail").when(F.col("checked") > 0, "pass").otherwise("manual"))


def cache_check(df: DataFrame, keys: list[str], order: list, prefill: str, slots: int = 1, fraction: float = 0.5) -> DataFrame:
    """Requests after the first ``slots`` that process more than ``fraction`` of the first are misses."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.col(prefill).isNotNull()).withColumns({"__rn": F.row_number().over(w), "__first": F.first(prefill).over(w)})
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.first("__first").alias("first_prefill"), F.sum(prefill).alias("total"),
        F.count_if((F.col("__rn") > slots) & (F.col(prefill) > fraction * F.col("__first"))).alias("misses"),
    )
    ratio = F.when((F.col("requests") > 1) & (F.col("first_prefill") > 0), (F.col("total") - F.col("first_prefill")) / (F.col("first_prefill") * (F.col("requests") - 1)))
    return out.withColumn("rest_ratio", ratio).withColumn("pass", F.col("misses") == 0)


def three_way(got: Column, want: Column) -> Column:
    """Ok, blank or unsafe; an empty answer is blank even where it is expected to be filled."""
    return F.when((F.size(got) > 0) & (F.array_sort(got) == F.array_sort(want)), "ok").when(F.size(got) == 0, "blank").otherwise("unsafe")


def multi_outcome(got: Column, want: Column) -> Column:
    """Anything extra is unsafe, anything missing is blank."""
    return F.when(F.size(F.array_except(got, want)) > 0, "unsafe").when(F.size(F.array_except(want, got)) == 0, "ok").otherwise("blank")


def single_outcome(got: Column, want: Column) -> Column:
    """A15 for one value; both null-safe, null being blank."""
    return F.when(got.isNull(), F.when(want.isNull(), "ok").otherwise("blank")).when(got.eqNullSafe(want), "ok").otherwise("unsafe")


def summary(checks: DataFrame, by: str, outcome: str = "outcome", risk: str = "risk") -> DataFrame:
    """Totals by ``by`` and over all (``by`` null), from one pass."""
    o = F.col(outcome)
    out = checks.rollup(by).agg(
        F.count("*").alias("checks"), F.count_if(o == "ok").alias("ok"), F.count_if(o == "unsafe").alias("unsafe"),
        F.count_if((o == "unsafe") & F.col(risk)).alias("unsafe_risk"), F.count_if(o == "blank").alias("safe_blank"),
    )
    return out.withColumn("accuracy", F.when(F.col("checks") > 0, F.col("ok") / F.col("checks")).otherwise(0.0))


def negative_log_likelihood(probs: DataFrame, accepted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean of -log of the summed probability of the accepted options (floor 1e-9)."""
    hit = probs.join(accepted, [*keys, "option"], "left_semi").groupBy(*keys).agg(F.sum("prob").alias("p"))
    rows = accepted.select(*keys, *by).distinct().join(hit, keys, "left")
    return rows.groupBy(*by).agg(F.avg(-F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-9)))).alias("nll"))


def invariance(df: DataFrame, group: str, field: str, answer: str, version: str) -> DataFrame:
    """Of groups with two versions or more, fields that have one answer in all of them."""
    each = df.groupBy(group, field).agg(F.count_distinct(F.coalesce(F.col(answer).cast("string"), F.lit("\0"))).alias("answers"), F.count_distinct(version).alias("versions"))
    out = each.filter("versions >= 2").agg(F.count_if(F.col("answers") == 1).alias("same"), F.count("*").alias("total"), F.count_distinct(group).alias("groups"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("same") / F.col("total")))


def best_threshold(df: DataFrame, score: str, truth: str, grid: list[float], share: float = 0.95) -> DataFrame:
    """Among thresholds with at least ``share`` of the best accuracy the one with least unsafe; the first wins ties."""
    rows = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    said = F.col(score) >= F.col("threshold")
    per = rows.groupBy("threshold").agg(F.avg((said == F.col(truth)).cast("double")).alias("accuracy"), F.avg((said & ~F.col(truth)).cast("double")).alias("unsafe"))
    best = per.agg(F.max("accuracy").alias("best"))
    kept = per.join(F.broadcast(best), F.col("accuracy") >= share * F.col("best"))  # one row
    return kept.agg(F.min_by("threshold", F.struct("unsafe", "threshold")).alias("threshold"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once: what a function of an array's elements refers to outside is worked
    out again for each element, unless it is an element itself."""
    return F.transform(F.array(value), then)[0]


def temper(probs: Column, t: float) -> Column:
    """array of probabilities after a softmax at temperature ``t``."""
    z = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))) / t)
    e = once(z, lambda z: once(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
    return once(e, lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total)))


def decide_options(options: Column, threshold: float, exclusive: list[str]) -> Column:
    """options (name, prob) of a multiple choice: above 0.5 and the threshold; exclusive ones go if others stay."""
    chosen = F.transform(F.filter(options, lambda o: o["prob"] >= max(0.5, threshold)), lambda o: o["name"])
    return F.array_sort(F.when(F.size(chosen) > 1, F.array_except(chosen, F.array(*[F.lit(x) for x in exclusive]))).otherwise(chosen))


def strict_sum(df: DataFrame, keys: list[str], value: str, n_inputs: Column) -> DataFrame:
    """A total only if every one of the ``n_inputs`` inputs is a whole number of at least 0."""
    number = F.trim(value).try_cast("bigint")
    ok = F.trim(value).rlike(r"^\+?\d+$") & (number >= 0)
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("__valid"), F.first(n_inputs).alias("__n"), F.sum(F.when(ok, number)).alias("total"))
    return out.withColumn("total", F.when(F.col("__valid") == F.col("__n"), F.col("total"))).drop("__valid", "__n")


def band(total: Column, bands: list[tuple[int, int, str]]) -> Column:
    """The name of the range that holds ``total``, else null."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        out = F.when(total.between(low, high), name).otherwise(out)
    return out


#: Ranges of two questionnaire scores.
PHQ9 = [(0, 4, "MINIMAL"), (5, 9, "MILD"), (10, 14, "MODERATE"), (15, 19, "MODERATELY_SEVERE"), (20, 27, "SEVERE")]
GAD7 = [(0, 4, "MINIMAL"), (5, 9, "MILD"), (10, 14, "MODERATE"), (15, 21, "SEVERE")]


def erle(df: DataFrame, keys: list[str], energy_in: str, energy_out: str, least: int = 50) -> DataFrame:
    """Level difference in dB, null for up to ``least`` frames."""
    out = df.groupBy(*keys).agg(F.count("*").alias("frames"), (10 * F.log10(F.sum(energy_in) / F.sum(energy_out))).alias("erle"))
    return out.withColumn("erle", F.when(F.col("frames") > least, F.col("erle")))


def main_speaker(df: DataFrame, keys: list[str], speaker: str, length: str) -> DataFrame:
    """Who talks most; of equals the least name."""
    talk = df.groupBy(*keys, speaker).agg(F.sum(length).alias("talk"))
    return talk.groupBy(*keys).agg(F.min_by(F.struct(speaker, "talk"), F.struct(-F.col("talk"), F.col(speaker))).alias("x")).select(*keys, "x.*")


def derive_all(values: DataFrame, derived: list[tuple[str, str, list[str]]], keys: list[str]) -> DataFrame:
    """Derived fields (key, function, inputs) of each session, from given values (key, value) and from each other,
    in any order; what lacks an input has no row. The list of derivations is short, so it is put in order here and
    becomes expressions on one row for each session."""
    left, ready, order = {k: (f, i) for k, f, i in derived}, set(), []
    while True:
        now = [k for k, (_, inputs) in left.items() if not any(i in left and i not in ready for i in inputs)]
        if not now:
            break  # what is left waits for itself
        order += [(k, *left.pop(k)) for k in now]
        ready.update(now)
    wanted = sorted({i for _, _, inputs in order for i in inputs} - ready)
    given = values.filter(F.col("key").isin(wanted)).groupBy(*keys, "key").agg(F.min("value").alias("value"))
    rows = given.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    found = {}
    for key, function, inputs in order:
        texts = [found.get(i, F.element_at("m", i)) for i in inputs]
        numbers = [F.when(F.trim(t).rlike(r"^\+?\d+$"), F.trim(t).try_cast("bigint")) for t in texts]
        total = sum(numbers[1:], numbers[0])
        bands = {"phq9_band": PHQ9, "gad7_band": GAD7}.get(function)
        found[key] = band(total, bands) if bands else total.cast("string") if function in ("phq9_total", "gad7_total") else F.lit(None).cast("string")
    out = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()])).alias("x"))
    return out.select(*keys, "x.*").filter("value is not null")


def score_items(fields: DataFrame, form: str, key: str) -> DataFrame:
    """The items ``<family>_<n>`` of each score field ``<family>_total`` or ``<family>_band``, in the order of n."""
    scores = fields.select(form, F.col(key).alias("score"), F.regexp_extract(key, "^(.*)_(?:total|band)$", 1).alias("family")).filter("family <> ''")
    items = fields.select(form, F.regexp_extract(key, r"^(.*)_\d+$", 1).alias("family"), F.struct(F.regexp_extract(key, r"_(\d+)$", 1).try_cast("int").alias("n"), F.col(key).alias("k")).alias("item"))
    both = scores.join(items.filter("family <> ''"), [form, "family"])
    return both.groupBy(form, "score").agg(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["k"]).alias("inputs"))
