"""Dynamic JSON: values whose type is part of what they say, as VARIANT, and documents whose keys keep an order.

A number isn't a string here and a string isn't a number, as a fixed schema would have it; what has another type than the
one asked for is null. Text that is no JSON is null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What VARIANT calls the kinds of numbers.
NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def parse(text: Column) -> Column:
    """S13."""
    return F.try_parse_json(text)


def at(value: Column, *path: str) -> Column:
    """The member of objects inside each other, or null."""
    return F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in path), "variant")


def kind(value: Column) -> Column:
    """Null, boolean, int, double, string, array or object."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = name.rlike("INT") | (name.startswith("DECIMAL") & name.endswith(",0)"))
    return (
        F.when(name == "VOID", "null").when(name == "BOOLEAN", "boolean").when(name == "STRING", "string").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
        .when(name.rlike(NUMBERS) & number.isNotNull(), F.when(whole, "int").otherwise("double"))
    )


def string_value(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def double_value(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike(NUMBERS), F.try_variant_get(value, "$", "double"))


def int_value(value: Column) -> Column:
    """Whole numbers, doubles without a fraction below 10^15, and strings that spell a whole number."""
    number, text = double_value(value), string_value(value)
    exact = F.try_variant_get(value, "$", "bigint")
    whole = F.when(kind(value) == "int", exact).when((F.rint(number) == number) & (F.abs(number) < 1e15), number.cast("bigint"))
    spelled = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(number.isNotNull(), whole).otherwise(spelled)


def items(value: Column) -> Column:
    """The members of an array as VARIANTs, null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def strings(value: Column) -> Column:
    """A string or an array of strings as an array; others are empty."""
    many = F.filter(F.transform(items(value), string_value), lambda s: s.isNotNull())
    return F.coalesce(many, F.when(string_value(value).isNotNull(), F.array(string_value(value))), F.array().cast("array<string>"))


def is_blank(value: Column) -> Column:
    """Nothing, null, an empty string, an empty array."""
    return value.isNull() | (kind(value) == "null") | F.coalesce(string_value(value) == "", F.lit(False)) | F.coalesce(F.size(items(value)) == 0, F.lit(False))


def ordered_object(entries: Column, order: Column) -> Column:
    """One JSON object from a map<string, string> of keys and JSON texts; the keys of ``order`` that it has come
    first, in that order, and all others after them by name."""
    keys = F.array_distinct(F.concat(F.array_intersect(F.coalesce(order, F.array().cast("array<string>")), F.map_keys(entries)), F.array_sort(F.map_keys(entries))))
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(F.element_at(entries, k), F.lit("null")))), ","), F.lit("}"))


def ordered_keys(document: Column) -> Column:
    """The keys of a JSON object as they stand in the text."""
    return F.json_object_keys(document)
