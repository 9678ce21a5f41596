"""Text functions on string columns. There are several normalisers on purpose: each caller's rules differ."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Word lists of the answer rules.
FILLERS = ["um", "uh", "uhm", "erm", "oh", "well", "so", "hmm", "hm", "mm", "ah"]
NEGATIONS = [
    "none of that", "none of those", "not at all", "not really", "not anymore", "not any", "no way", "no thanks", "no thank you",
    "i dont", "i do not", "i havent", "i have not", "i never", "no", "nope", "never", "none", "nah", "nothing",
]
AFFIRMATIONS = [
    "mm hmm", "mm hm", "mhm", "mmhmm", "uh huh", "thats right", "thats it", "thats correct", "yes", "yeah", "yep", "yup", "yea",
    "right", "correct", "sure", "exactly", "okay", "ok",
]
AFFIRMATION_WORDS = [
    "yes", "yeah", "yep", "yup", "yea", "right", "correct", "sure", "exactly", "okay", "ok", "mm", "hmm", "hm", "mhm", "mmhmm", "uh",
    "huh", "um", "thats", "that", "it", "is", "fine", "true", "i", "do", "did", "am", "have", "so", "oh", "absolutely", "definitely",
]
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: Characters that join, and the date formats, in the order they are tried.
APOSTROPHES = "'‘’ʼ`´"
DATE_FORMATS = ["M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "yyyy/MM/dd"]


def _folds() -> dict[str, str]:
    """Letters with accents to the plain letter, and wide characters to narrow ones, by their decompositions."""
    found = {}
    for code in range(0x80, 0x3000):
        plain = unicodedata.normalize("NFD", chr(code))
        if len(plain) > 1 and all(unicodedata.category(c) == "Mn" for c in plain[1:]):
            found[chr(code)] = plain[0]
    found.update({chr(code): unicodedata.normalize("NFKC", chr(code)).lower() for code in range(0xFF01, 0xFF5F)})
    return found


FOLDS = _folds()


def fold_accents(text: Column) -> Column:
    """Accents and widths folded; marks that stand for themselves go."""
    return F.regexp_replace(F.translate(text, "".join(FOLDS), "".join(FOLDS.values())), r"\p{Mn}", "")


def normalize(text: Column) -> Column:
    """lower case, accents and widths folded, apostrophes join, everything but letters and digits parts words."""
    folded = F.replace(fold_accents(F.lower(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, f"[{APOSTROPHES}]", ""), r"[^\p{L}\p{N}]+", " "))


def contains_words(haystack: Column, needle: Column) -> Column:
    """normalised ``needle`` as whole words of normalised ``haystack``; an empty needle is in nothing."""
    return (needle != "") & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def words_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def _opens_with(phrases: list[str]) -> str:
    fillers = "|".join(FILLERS)
    return rf"^(?:(?:{fillers}) )*(?:{'|'.join(phrases)})(?: |$)"


def is_negated_short_answer(text: Column, max_words: int = 5) -> Column:
    """Few words that open with a negation, fillers aside."""
    plain = normalize(text)
    return F.size(words_of(plain)).between(1, max_words) & plain.rlike(_opens_with(NEGATIONS))


def is_bare_affirmation(text: Column, max_words: int = 4) -> Column:
    """Few words, all of affirmation, that open with one, fillers aside."""
    plain = normalize(text)
    known = F.forall(words_of(plain), lambda w: w.isin(AFFIRMATION_WORDS))
    return F.size(words_of(plain)).between(1, max_words) & plain.rlike(_opens_with(AFFIRMATIONS)) & known


def is_negative_option(value: Column, label: Column, semantics: Column) -> Column:
    """P10: an option that reads as the negative answer."""
    v, plain = F.upper(value), F.coalesce(normalize(label), F.lit(""))
    by_value = v.isin("NONE", "NO", "NEVER", "DECLINED", "NOT_AT_ALL", "NOTHING") | v.rlike("^(NONE|NO|NOT)_") | v.endswith("_NONE")
    by_label = plain.isin("none", "no", "never", "not at all", "declined", "nothing") | plain.rlike("^(none|not|no) ")
    return by_value | by_label | F.coalesce(normalize(semantics).startswith("negative"), F.lit(False))


def parse_clock(text: Column) -> Column:
    """mm:ss or h:mm:ss to seconds; null for anything else or later parts of 60 and more."""
    parts = F.transform(F.split(text, ":"), lambda p: p.cast("int"))
    total = F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p)
    return F.when(text.rlike(r"^\d+(:[0-5]?\d){1,2}$"), total.cast("double"))


def format_clock(seconds: Column) -> Column:
    """whole seconds as mm:ss, minutes without bound."""
    total = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("int"), total % 60)


def segment_id(n: Column) -> Column:
    """s0001; numbers of more than four digits are kept whole."""
    return F.concat(F.lit("s"), F.when(F.length(n.cast("string")) >= 4, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0")))


def is_iso_date(text: Column) -> Column:
    """F04."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def parse_date(text: Column) -> Column:
    """ISO dates, else the first format that fits; as yyyy-MM-dd or null."""
    plain = F.regexp_replace(F.trim(text), r"(\d)(st|nd|rd|th)\b", "$1")
    found = [F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS]
    return F.when(is_iso_date(F.trim(text)), F.trim(text)).otherwise(F.date_format(F.coalesce(*found), "yyyy-MM-dd"))


def redact(text: Column) -> Column:
    """letters to x, digits to #."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}", "x"), r"\p{N}", "#")


def normalize_label(text: Column) -> Column:
    """labels of form fields; stars, colons and blanks at the ends go, white space collapses."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("*"), F.lit("")), r"^[\s:]+|[\s:]+$", "")), r"\s+", " ")


def contains_token(text: Column, token: Column) -> Column:
    """``token`` between non-letters and non-digits."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), token, F.lit(r"\E(?![\p{L}\p{N}])"))
    return (token != "") & F.regexp_like(text, pattern)


def same_values(a: Column, b: Column) -> Column:
    """F32: equal arrays in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def schema_name(key: Column) -> Column:
    """F33."""
    return F.regexp_replace(key, "[^A-Za-z0-9_-]", "_")


def version_parts(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def is_newer(a: Column, b: Column) -> Column:
    """dotted versions; missing parts count as 0."""
    pad = lambda v: F.slice(F.concat(version_parts(v), F.array_repeat(F.lit(0), 8)), 1, 8)
    return pad(a) > pad(b)


def in_validation(group: Column) -> Column:
    """15 per cent of the groups, by their hash."""
    return (F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint") % 1000) < 150


def generalize_path(path: Column) -> Column:
    """path parts that look like identifiers become *."""
    part = lambda p: F.when(p.rlike(r"^\d+$") | p.rlike(r"^[0-9a-fA-F-]{16,}$") | (p.rlike(r"\d") & (F.length(p) >= 12)), F.lit("*")).otherwise(p)
    return F.array_join(F.transform(F.split(path, "/"), part), "/")


#: What ids that a framework makes look like.
GENERATED_IDS = [
    "^:r[0-9a-z]+:$",
    r"^(mui|ember|ext-gen|react-select|headlessui|radix|downshift|rc_select|cdk|mat-[a-z-]+|p-[a-z]+)[-_:]?\w*\d+",
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}",
    "[0-9a-f]{12,}",
    r"\d{5,}",
]


def is_generated_id(name: Column) -> Column:
    """Ids that a framework makes anew for each page."""
    return name.rlike("(?i)" + "|".join(GENERATED_IDS))


PII = r"\b\d{3}[-. ]\d{2}[-. ]\d{4}\b|\b(?:\+?1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def pii_hits(text: Column) -> Column:
    """Numbers and addresses of people; reserved 555-01xx numbers and example domains don't count."""
    found = F.regexp_extract_all(text, F.lit(PII), F.lit(0))
    return F.filter(found, lambda x: ~x.rlike(r"555[-. ]01\d\d$") & ~F.lower(x).rlike(r"@([a-z0-9-]+\.)*example\.(com|org|net)$"))


def energy_db(samples: Column) -> Column:
    """level of samples in -1..1 in dB, -90 at least."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples)
    return F.when(mean > 0, F.greatest(10 * F.log10(mean), F.lit(-90.0))).otherwise(F.lit(-90.0))


def error_rate(reference: str | None, hypothesis: str | None) -> float:
    """word edits by words of the reference."""
    if reference == hypothesis:
        return 0.0
    r, h = ([w for w in re.split(r"[^\w']|_", (t or "").lower().replace("’", "'")) if w] for t in (reference, hypothesis))
    if not r:
        return 0.0 if not h else 1.0
    return edits(r, h) / len(r)


def edits(a: list[str], b: list[str]) -> int:
    """Least number of words put in, left out or exchanged. What both begin and end with costs nothing; a row of the
    table is two whole numbers with a bit for each word of ``a``, set where the count goes up or down by one (Myers)."""
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, top, count = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for word in b:
        equal = places.get(word, 0)
        zero = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = (down | ~(zero | up)) & full, up & zero
        count += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(zero | right)) & full, right & zero
    return count


@F.arrow_udf(DoubleType())
def word_error_rate(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return pa.array([error_rate(a, b) for a, b in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True)], pa.float64())


def _spelled(text: str) -> str:
    words, out, i = text.lower().replace("-", " ").split(" "), [], 0
    bare = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in words]
    while i < len(words):
        n = NUMBER_WORDS.get(bare[i])
        following = NUMBER_WORDS.get(bare[i + 1]) if i + 1 < len(words) else None
        if n is not None and n >= 20 and following is not None and following < 10:
            out.append(str(n + following))
            i += 1
        else:
            out.append(words[i] if n is None else str(n))
        i += 1
    return " ".join(out)


@F.arrow_udf(StringType())
def spelled_numbers_as_digits(text: pa.Array) -> pa.Array:
    """numbers in words up to 99."""
    return pa.array([None if t is None else _spelled(t) for t in text.to_pylist()], pa.string())


#: Kinds of personal data; the earlier ones win where matches overlap. All but the first zip ignore case.
_MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_STREETS = "(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|way|place|pl|terrace|ter|circle|cir|highway|hwy|parkway|pkwy|square|sq|trail|trl|apt|suite|ste|unit)"
SCRUB_PATTERNS = [
    ("email", r"[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"),
    ("ssn", r"(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)"),
    ("phone", r"(?<![\d+])(?:\+?1[\s.\-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.\-])\d{3}[\s.\-]\d{4}(?!\d)"),
    ("phone", r"\+\d{1,3}[\s.\-]?\d{2,4}[\s.\-]?\d{3,4}[\s.\-]?\d{3,4}(?!\d)"),
    ("date", r"(?<!\d)\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2})(?!\d)"),
    ("date", r"(?<!\d)\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}(?!\d)"),
    ("date", rf"\b{_MONTHS}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?:,?\s+\d{{4}})?"),
    ("date", rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTHS}\b\.?(?:,?\s+\d{{4}})?"),
    ("date", rf"\b{_MONTHS}\.?,?\s+\d{{4}}\b"),
    ("street_address", rf"(?<![\d.])\d{{1,6}}[A-Z]?\s+(?:[NSEW]\.?\s+)?(?:[A-Z0-9][A-Z0-9.'\-]*\s+){{1,4}}{_STREETS}\b\.?"),
    ("street_address", r"\bP\.?\s?O\.?\s+Box\s+\d+"),
    ("zip", r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?(?!\d)"),
    ("zip", r"(?<!\d)\d{5}-\d{4}(?!\d)"),
    ("zip", r"\bzip(?:\s*code)?\s*[:#]?\s*\d{5}(?!\d)"),
    ("zip", r",\s*\d{5}(?:-\d{4})?(?!\d)"),
    ("record_number", r"(?<![A-Z0-9])[A-Z]{1,4}[-_ #:]{0,2}\d{5,}(?!\d)"),
    ("record_number", r"#\s?\d{4,}(?!\d)"),
    ("long_digit_run", r"(?<!\d)\d{6,}(?!\d)"),
]
#: Addresses that nobody has, keys made by hashing, and values that are codes.
RESERVED_EMAIL = r"@(?:[A-Z0-9\-]+\.)*(?:example\.(?:com|net|org)|[A-Z0-9\-]+\.(?:example|test|invalid))$"
HASH_KEY = "^f_[0-9a-f]{10}$"
ENUM_CODE = "^(?:[0-9]{1,3}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)$"

_SCRUB = [(kind, re.compile(pattern, 0 if pattern.startswith(r"\b[A-Z]{2}") else re.I)) for kind, pattern in SCRUB_PATTERNS]
_RESERVED = re.compile(RESERVED_EMAIL, re.I)
HITS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())]))


def scrub_hits(text: str | None) -> list[tuple[int, int, str]]:
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _SCRUB:
        for m in pattern.finditer(text or ""):
            digits = {c for c in m[0] if c in "0123456789"}
            if digits in ({"0"}, {"9"}) or kind == "email" and _RESERVED.search(m[0]):
                continue  # a format example, or an address that nobody has
            if not any(m.start() < b and a < m.end() for a, b, _ in taken):
                taken.append((m.start(), m.end(), kind))
    return sorted(taken)


@F.arrow_udf(HITS)
def _scrub_scan(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    return pa.array([None if t is None else [dict(zip(("start", "end", "kind"), h, strict=True)) for h in scrub_hits(t)] for t in text.to_pylist()], kind)


def scrub_scan(text: Column) -> Column:
    """(start, end, kind) of personal data, in text order. All patterns hold a digit of any script or an @; of texts
    without either only a null is handed to Python."""
    hits = _scrub_scan(F.when(text.rlike(r"(?U)[\d@]"), text))
    return F.coalesce(hits, F.array().cast(HITS))


def is_enum_code(value: Column) -> Column:
    """Short numbers and upper-case names are codes, unless they hold five digits in a row."""
    return value.rlike(ENUM_CODE) & ~value.rlike("[0-9]{5}")


def scrub_excerpt(text: Column, hit: Column) -> Column:
    """What a hit looks like: ASCII digits as #, letters as x."""
    return F.regexp_replace(F.regexp_replace(F.substring(text, hit["start"] + 1, hit["end"] - hit["start"]), "[0-9]", "#"), r"\p{L}", "x")
