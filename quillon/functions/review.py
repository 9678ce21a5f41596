"""Functions on reviewed fields, labels, names and transcribed words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import normalize, parse_date, spelled_numbers_as_digits

#: Kinds of fields with options, and review states that need a look.
OPTION_KINDS = ["select", "radio_group", "combobox", "checkbox_group"]
LEFT_EMPTY = ["insufficient_evidence", "needs_judgement", "write_failed"]


def is_gated(mode: Column, kind: Column, in_questionnaire: Column) -> Column:
    """Choices outside questionnaires."""
    return (mode == "discrete") & ~in_questionnaire & kind.isin(*OPTION_KINDS)


def is_placeholder(text: Column) -> Column:
    """The digits are all 0 or all 9."""
    return F.regexp_replace(text, "[^0-9]", "").rlike("^(?:0+|9+)$")


def first_label(sources: list[tuple[str, Column]]) -> Column:
    """The first source that isn't empty, as struct(text, source); null if all are."""
    filled = [F.when(F.coalesce(c, F.lit("")) != "", F.struct(c.alias("text"), F.lit(name).alias("source"))) for name, c in sources]
    return F.coalesce(*filled)


def review_status(status: Column, outcome: Column, edited: Column, updatable: Column) -> Column:
    """What a reviewer sees for a result and the outcome of filling it in (null: none)."""
    filled = F.when(outcome.isin("ok", "computed_verified"), "filled").when(outcome == "conflict_skipped", F.when(updatable, "proposed_change").otherwise("conflict_skipped")).otherwise("write_failed")
    return (
        F.when(edited, "edited").when(status == "clinician_only", "needs_judgement").when(status.isin("insufficient_evidence", "rejected"), "insufficient_evidence")
        .when(status == "derived", F.when(outcome == "computed_mismatch", "write_failed").otherwise("calculated")).when(status == "filled", filled)
    )


def required_blank(review: Column, required: Column, kind: Column, computed: Column, edited: Column) -> Column:
    """Required, visible, not computed, not edited, and still empty."""
    return required & (kind != "hidden") & ~computed & ~edited & review.isin(*LEFT_EMPTY)


def in_review_list(name: Column, review: Column, blank: Column, kind: Column, needs_attention: list[str]) -> Column:
    """P20: the lists attention, all, filled and blank."""
    return (
        F.when(name == "attention", review.isin(*needs_attention) | blank).when(name == "all", kind != "hidden")
        .when(name == "filled", review.isin("filled", "edited", "calculated")).when(name == "blank", review == "insufficient_evidence").otherwise(False)
    )


def low_confidence(confidence: Column) -> Column:
    """P25."""
    return F.coalesce(confidence < 0.5, F.lit(False))


def normalize_by_mode(text: Column, mode: Column) -> Column:
    """digits (numbers in words included), an ISO date, or the words."""
    return F.when(mode == "digits", F.regexp_replace(spelled_numbers_as_digits(text), "[^0-9]", "")).when(mode == "date", parse_date(text)).otherwise(normalize(text))


def detokenize(text: Column) -> Column:
    """no blanks before marks and apostrophes, single ones elsewhere."""
    text = F.regexp_replace(F.regexp_replace(text, r"\s+([,.?!;:])", "$1"), r"\s+'", "'")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_answer(answer: Column, options: Column, blankish: Column) -> Column:
    """an answer that is no option, or stands for none, is null."""
    return F.when(F.array_contains(options, answer) & ~F.array_contains(blankish, answer), answer)


def answer_agrees(answer: Column, accepted: Column) -> Column:
    """one value against the accepted ones, of which a null fits an empty answer."""
    given = F.nullif(answer, F.lit(""))
    return F.exists(accepted, lambda a: a.eqNullSafe(given))


def short_name(name: Column, client_id: Column) -> Column:
    """``LAST, First`` and ``First Last`` become ``First L.``; without a name the id stands."""
    parts, words = F.split(name, r"\s*,\s*"), F.filter(F.split(name, " "), lambda w: w != "")
    turned = F.concat(F.split(F.trim(parts[1]), " ")[0], F.lit(" "), F.substring(F.trim(parts[0]), 1, 1), F.lit("."))
    plain = F.concat(F.get(words, F.lit(0)), F.lit(" "), F.substring(F.get(words, F.size(words) - 1), 1, 1), F.lit("."))
    return F.when(name.isNull(), client_id).when((F.size(parts) == 2) & (F.trim(parts[0]) != ""), turned).when(F.size(words) >= 2, plain).otherwise(name)


def step_title(step: Column) -> Column:
    """F44."""
    return F.initcap(F.replace(F.replace(step, F.lit("step-"), F.lit("")), F.lit("_"), F.lit(" ")))


def content_words(text: Column) -> Column:
    """Distinct normalised words of four letters or more."""
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda w: F.length(w) >= 4))


def iso_time(at: Column) -> Column:
    """R11."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def set_relation(a: Column, b: Column) -> Column:
    """Equal, subset, superset, overlap or apart, as sets."""
    more, less = F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0
    return F.when(~more & ~less, "equal").when(~more, "subset").when(~less, "superset").when(F.arrays_overlap(a, b), "overlap").otherwise("apart")


def in_option_order(values: Column, options: Column) -> Column:
    """Distinct values in the order of the options; others go."""
    return F.filter(F.array_distinct(options), lambda o: F.array_contains(values, o))


def window_features(scores: Column, top: int = 3) -> Column:
    """Mean, maximum and the mean of the ``top`` largest of an array of numbers."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    scores = F.transform(scores, lambda x: x.cast("double"))
    best = F.slice(F.sort_array(scores, False), 1, top)
    return F.when(F.size(scores) > 0, F.struct(mean(scores).alias("mean"), F.array_max(scores).alias("max"), mean(best).alias("top_mean")))
