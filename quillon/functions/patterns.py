"""Regular expressions learned from an example and applied to other rows, in column expressions.

The example's first token that looks like a record number is generalised by runs of letters and digits, the word before
it leads the pattern, and the name is what follows a separator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a record number looks like, and what may part it from a name.
TOKEN = r"[A-Z]{1,4}[- ]?\d{4,}|\d{6,}"
LEAD = r"[:#\s]+"
SEPARATORS = ["·", "|", "–", "—", " - "]
_FOUND = rf"(?:([A-Za-z]+){LEAD})?\b({TOKEN})\b"


def escaped(text: Column) -> Column:
    """Text as a pattern that matches it."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def shape(token: Column) -> Column:
    """F16: runs of letters and digits by their lengths; other characters stand for themselves, a space for any."""
    runs = F.regexp_extract_all(token, F.lit(r"(\p{L}+|\p{N}+|[^\p{L}\p{N}])"), 1)
    length = lambda r: F.length(r).cast("string")
    one = lambda r: (
        F.when(r.rlike(r"^\p{L}"), F.concat(F.lit("[A-Z]{"), length(r), F.lit("}")))
        .when(r.rlike(r"^\p{N}"), F.concat(F.lit(r"\d{"), length(r), F.lit("}")))
        .when(r == " ", F.lit(r"\s")).otherwise(escaped(r))
    )
    return F.array_join(F.transform(runs, one), "")


def propose(text: Column) -> Column:
    """F16: struct(id, name) of patterns with one group each; null where nothing looks like a record number."""
    token = F.regexp_extract(text, _FOUND, 2)
    word = F.regexp_extract(text, _FOUND, 1)
    whole = F.regexp_extract(text, _FOUND, 0)
    after = F.substring(text, F.instr(text, whole) + F.length(whole), F.length(text))
    lead = F.when(word != "", F.concat(escaped(word), F.lit(LEAD))).otherwise("")
    name = F.lit(None).cast("string")
    for separator in reversed(SEPARATORS):
        name = F.when(after.contains(separator), F.concat(escaped(F.lit(separator.strip())), F.lit(r"\s*(.+)$"))).otherwise(name)
    return F.when(token != "", F.struct(F.concat(lead, F.lit("("), shape(token), F.lit(")")).alias("id"), name.alias("name")))


def read_client(text: Column, id_pattern: Column, name_pattern: Column) -> Column:
    """F16: struct(id, name) of a banner by learned patterns; null without an id, name null where there is none."""
    first = lambda pattern: F.when(F.regexp_like(text, pattern), F.regexp_replace(F.call_function("regexp_extract", text, pattern, F.lit(1)), r"^\s+|\s+$", ""))
    return F.when(F.coalesce(first(id_pattern) != "", F.lit(False)), F.struct(first(id_pattern).alias("id"), first(name_pattern).alias("name")))
