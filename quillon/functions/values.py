"""Functions on field values, addresses, options and sealed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What labels of attestations hold.
ATTESTATIONS = ["attest", "signature", "sign here", "i certify", "e-sign", "esign", "electronically sign"]
SAFE_PART = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def frequency_band(count: Column, period: Column, bands: Column) -> Column:
    """bands map<name, [low, high]>; occasions a month, then the first band by name that holds them."""
    monthly = F.when(period == "day", count * 30.4).when(period == "week", count * 4.345).when(period == "month", count).when(period == "year", count / 12)
    hits = F.filter(F.array_sort(F.map_entries(bands)), lambda e: (monthly >= e["value"][0]) & (monthly <= e["value"][1]) & (F.size(e["value"]) == 2))
    return F.when((count >= 0) & (F.size(hits) > 0), F.get(hits, F.lit(0))["key"])


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from the hash alone. ``key`` has at most 64 bytes."""
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def client_tag(key: bytes, name: Column) -> Column:
    """``ct:`` and 128 bits of the HMAC of the trimmed, upper-case name."""
    return F.concat(F.lit("ct:"), F.substring(hmac_sha256(key, F.upper(F.trim(name))), 1, 32))


def same_address(a: Column, b: Column) -> Column:
    """equal addresses but for one slash at the end."""
    return F.regexp_replace(a, "/$", "") == F.regexp_replace(b, "/$", "")


def weekday(date: Column) -> Column:
    """F34."""
    return F.date_format(date, "EEEE")


def label_match(value: Column, accepted: Column) -> Column:
    """arrays; an empty or null value fits an empty or null accepted one, lists fit in any order."""
    none = F.array().cast("array<string>")
    return F.exists(accepted, lambda a: F.array_sort(F.coalesce(value, none)) == F.array_sort(F.coalesce(a, none)))


def meter(rms: Column) -> Column:
    """level 0 to 1 of 60 dB."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (20 * F.log10(F.greatest(rms, F.lit(1e-9))) + 60) / 60))


def says_something(text: Column) -> Column:
    """any letter or digit."""
    return text.rlike(r"[\p{L}\p{N}]")


def json_object_in(text: Column) -> Column:
    """from the first opening to the last closing brace, code fences aside."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def is_attestation(label: Column, option_labels: Column | None = None) -> Column:
    """The label, or a label of the options, speaks of signing."""
    whole = label if option_labels is None else F.concat_ws(" ", label, option_labels)
    return F.lower(whole).rlike("|".join(ATTESTATIONS))


def is_questionnaire(kind: Column, label: Column) -> Column:
    """A radio group whose label has five words or more."""
    return (kind == "radio_group") & (F.size(F.filter(F.split(label, " "), lambda w: w != "")) >= 5)


def without_options(options: Column, excluded: Column) -> Column:
    """P06."""
    return F.filter(options, lambda o: ~F.array_contains(excluded, o["value"]))


def normalise_proposal(proposal: Column, kind: Column, options: Column) -> Column:
    """A proposal (intent, mode, evidence_speaker, option_semantics map, max_chars) for a field, cleaned; null if it
    lacks an intent or a known mode. Prose into a field of options is a choice; prose needs no speaker; semantics of
    unknown options go; only fields of free text have a length."""
    free = kind.isin("text", "textarea")
    mode = F.when((proposal["mode"] == "narrative") & ~free, "discrete").otherwise(proposal["mode"])
    speaker = F.when((mode == "narrative") | mode.isin("clinician_only", "skip"), "any").when(proposal["evidence_speaker"].isin("client", "worker", "any"), proposal["evidence_speaker"]).otherwise("any")
    kept = F.map_filter(proposal["option_semantics"], lambda value, _: F.array_contains(options, value))
    semantics = F.when((F.size(options) > 0) & ~mode.isin("clinician_only", "skip") & (F.size(kept) > 0), kept)
    length = F.when(free & ~mode.isin("clinician_only", "skip"), clamp_chars(proposal["max_chars"]))
    valid = (proposal["intent"] != "") & proposal["mode"].isin("discrete", "narrative", "clinician_only", "skip")
    return F.when(valid, F.struct(proposal["intent"].alias("intent"), mode.alias("mode"), speaker.alias("evidence_speaker"), semantics.alias("option_semantics"), length.alias("max_chars")))


def clean_mode(mode: Column, kind: Column) -> Column:
    """Known modes only; prose into a field of options is a choice after all."""
    known = F.when(mode.isin("discrete", "narrative", "derived", "clinician_only"), mode).otherwise("discrete")
    return F.when((known == "narrative") & ~kind.isin("text", "textarea"), "discrete").otherwise(known)


def clamp_chars(n: Column) -> Column:
    """P08."""
    return F.least(F.greatest(n, F.lit(1)), F.lit(4000))


def is_safe_path(path: Column) -> Column:
    """Relative, no empty or dotted parts."""
    parts = F.split(path, "/")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(SAFE_PART) & ~p.isin(".", ".."))


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def is_forbidden_control(tag: Column, kind: Column, in_form: Column, href: Column, in_actions: Column) -> Column:
    """Controls that may submit a form or leave the page: submitting buttons (one without a type submits the
    form it is in), links with an address, and all that is in a bar of form actions."""
    tag, kind = F.lower(tag), F.lower(F.coalesce(kind, F.lit("")))
    button = (tag == "button") & ((kind == "submit") | ((kind == "") & F.coalesce(in_form, F.lit(False))))
    link = (tag == "a") & (F.coalesce(href, F.lit("")) != "")
    return button | ((tag == "input") & kind.isin("submit", "image")) | link | F.coalesce(in_actions, F.lit(False))


def seal(payload: Column, key: Column, aad: Column) -> Column:
    """AES-GCM with the id of what is sealed as additional data."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(box: Column, key: Column, aad: Column) -> Column:
    """Null if it was altered, or sealed for another id or with another key."""
    return F.try_aes_decrypt(box, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def first_channel(samples: Column, channels: int) -> Column:
    """R18."""
    return F.filter(samples, lambda x, i: i % channels == 0)


def middle_cut(tokens: Column, budget: int) -> Column:
    """The head and the tail of a token list, the middle left out."""
    head = budget // 2
    return F.when(F.size(tokens) <= budget, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(budget - head), budget - head)))


def round_away(x: Column, places: int) -> Column:
    """halves go away from zero."""
    scale = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
