"""Operators that join form definitions, mappings, results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import HASH_KEY, is_enum_code, scrub_excerpt, scrub_scan


def plan_field(kind: Column, mode: Column, computed: Column, derive: Column) -> Column:
    """How a field gets its value."""
    return (
        F.when(computed | (kind == "hidden") | mode.isNull(), "omit").when(mode == "clinician_only", "clinician_only")
        .when((mode == "derived") & derive.isNotNull(), "derived").when(mode == "derived", "omit").otherwise("request")
    )


def override(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``changes`` where given; keys that ``base`` doesn't have are ignored."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def volatile_options(first: DataFrame, second: DataFrame, key: str, options: str) -> DataFrame:
    """Keys in both loads whose options differ as sets."""
    a, b = (df.select(key, F.array_sort(F.array_distinct(options)).alias(name)) for df, name in ((first, "__a"), (second, "__b")))
    return a.join(b, key).filter("__a <> __b").select(key)


def rematch(old: DataFrame, new: DataFrame, form: str, key: str, exact: list[str], fuzzy: list[str]) -> DataFrame:
    """Old keys to new keys of a form: equal key and ``exact`` columns first; of the rest equal ``fuzzy``
    columns, one to one in key order; what is left was added (old null) or removed (new null)."""
    o, n = (df.select(form, F.col(key).alias(f"{side}_key"), *exact, *[c for c in fuzzy if c not in exact]) for df, side in ((old, "old"), (new, "new")))
    same = o.join(n.select(form, F.col("new_key"), *exact), [form, *exact]).filter("old_key = new_key").select(form, "old_key", "new_key", F.lit("same").alias("status"))
    o_left = o.join(same.select(form, "old_key"), [form, "old_key"], "left_anti")
    n_left = n.join(same.select(form, "new_key"), [form, "new_key"], "left_anti")
    rank = lambda side: F.row_number().over(Window.partitionBy(form, *fuzzy).orderBy(f"{side}_key"))
    o_rank, n_rank = o_left.withColumn("__rank", rank("old")), n_left.withColumn("__rank", rank("new"))
    moved = o_rank.select(form, *fuzzy, "__rank", "old_key").join(n_rank.select(form, *fuzzy, "__rank", "new_key"), [form, *fuzzy, "__rank"], "full")
    status = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").otherwise("moved")
    return same.unionByName(moved.select(form, "old_key", "new_key", status.alias("status")))


def fill_outcome(intended: Column, prior: Column, default: Column, read_back: Column, computed: Column, found: Column) -> Column:
    """What became of a value that was to be written; a value that someone else put there isn't replaced."""
    return (
        F.when(~found, "not_found")
        .when(computed, F.when(intended.eqNullSafe(read_back), "computed_verified").otherwise("computed_mismatch"))
        .when(prior.isNotNull() & (prior != "") & ~prior.eqNullSafe(default) & ~prior.eqNullSafe(intended), "conflict_skipped")
        .when(read_back.eqNullSafe(intended), "ok").otherwise("reverted")
    )


def undo_outcome(written: Column, now: Column, prior: Column, after: Column, found: Column) -> Column:
    """A value is put back only if it is still the one that was written."""
    return (
        F.when(~found, "not_found").when(~now.eqNullSafe(written), "changed_since").when(prior.isNull(), "unrestorable")
        .when(after.eqNullSafe(prior), "restored").otherwise("failed")
    )


def precedence(base: DataFrame, proposals: DataFrame, key: str, column: str) -> DataFrame:
    """What the base says stands; proposals fill the rest; ``origin`` tells which."""
    b, p = base.select(key, F.col(column).alias("__b")), proposals.select(key, F.col(column).alias("__p"))
    out = b.join(p, key, "full")
    origin = F.when(F.col("__b").isNotNull(), "base").otherwise("proposal")
    return out.select(key, F.coalesce("__b", "__p").alias(column), origin.alias("origin")).filter(F.col(column).isNotNull())


def resolve(choices: DataFrame, defaults: DataFrame, key: str, column: str) -> DataFrame:
    """The user's choice, else the default; ``status`` tells which, or that none is known."""
    out = defaults.select(key, F.col(column).alias("__d")).join(choices.select(key, F.col(column).alias("__c")), key, "left")
    status = F.when(F.col("__c").isNotNull(), "chosen").when(F.col("__d").isNotNull(), "default").otherwise("missing")
    return out.select(key, F.coalesce("__c", "__d").alias(column), status.alias("status"))


def url_patterns_match(urls: DataFrame, patterns: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """The first of the learned patterns (name, host regex, path glob) that fits a url; the list of
    learned forms is small and part of the plan, so no row is paired with all patterns."""
    host, path = F.lower(F.parse_url(url, F.lit("HOST"))), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(None).cast("string")
    for name, host_pattern, glob in reversed(patterns):
        path_pattern = "^" + ".*".join(_quoted(p) for p in glob.split("*")) + "$"
        out = F.when(host.rlike(f"^(?:{host_pattern})$") & path.rlike(path_pattern), name).otherwise(out)
    return urls.withColumn("form", out)


def path_matches(path: Column, glob: Column) -> Column:
    """Whether a path fits a pattern of its row, in which * stands for anything."""
    pattern = F.regexp_replace(glob, r"([^A-Za-z0-9/_*-])", r"\\$1")
    return F.regexp_like(path, F.concat(F.lit("^"), F.regexp_replace(pattern, r"\*", ".*"), F.lit("$")))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def best_url_match(wanted: DataFrame, tabs: DataFrame, url: str, tab: str, order: str) -> DataFrame:
    """Equal addresses first, then equal but for the fragment, then but for the query; the front tab wins."""
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    stem = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    w = wanted.select(url, stem(F.col(url)).alias("__stem"))
    t = tabs.select(F.col(url).alias("__tab_url"), F.col(tab).alias("tab"), F.col(order).alias("__order"), stem(F.col(url)).alias("__stem"))
    rank = F.when(F.col(url) == F.col("__tab_url"), 0).when(bare(F.col(url)) == bare(F.col("__tab_url")), 1).otherwise(2)
    both = w.join(t, "__stem").withColumn("rank", rank)
    return both.groupBy(url).agg(F.min_by(F.struct("tab", "rank"), F.struct("rank", "__order", "tab")).alias("x")).select(url, "x.*")


def illegal_transitions(events: DataFrame, legal: list[tuple[str, str]], keys: list[str], order: list, state: str) -> DataFrame:
    """Steps between states that no transition allows."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    steps = events.withColumn("from_state", before).filter("from_state is not null").withColumnRenamed(state, "to_state")
    allowed = steps.sparkSession.createDataFrame(legal, "from_state string, to_state string")
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")  # as long as the list of states


def audio_due(created: Column, confirmed: Column, retention: Column, now: Column) -> Column:
    """Whether a session's audio is to go: at confirmation, or some days after the session."""
    days = F.regexp_extract(retention, r"^days:(\d+)$", 1).try_cast("int")
    by_date = F.coalesce(F.date_add(created.cast("date"), days) <= now.cast("date"), F.lit(False))
    return F.when(retention == "until_confirm", confirmed.isNotNull()).when(days.isNotNull(), by_date).otherwise(F.lit(False))


def purge_reason(created: Column, confirmed: Column, purge_after: Column, stage: Column, now: Column, unreviewed_days: int | None) -> Column:
    """Why a session is to be purged, the first reason that holds, or null."""
    out = F.when(purge_after <= now, "retention").when((stage == "armed") & confirmed.isNull() & (created < now - F.expr("interval 1 hour")), "never_started")
    if unreviewed_days is not None:
        out = out.when(confirmed.isNull() & (created + F.make_dt_interval(F.lit(unreviewed_days)) <= now), "unreviewed")
    return out


def scan_payload(fields: DataFrame, key: str) -> DataFrame:
    """Personal data in all that a payload says of its fields (key, step, label, help, options): one row for each hit,
    with its part, kind and redacted excerpt. Keys made from a hash and option values that are codes aren't scanned."""
    text = lambda part, value: F.struct(F.lit(part).alias("part"), value.alias("text"))
    plain = F.array(text("key", F.when(~F.col("key").rlike(HASH_KEY), F.col("key"))), *[text(c, F.col(c)) for c in ("step", "label", "help")])
    values = F.transform("options", lambda o: text("option.value", F.when(~is_enum_code(o["value"]), o["value"])))
    labels = F.transform("options", lambda o: text("option.label", o["label"]))
    rows = fields.select(F.col(key).alias("__key"), F.explode(F.concat(plain, values, labels)).alias("x")).select("__key", "x.*").filter("text is not null")
    hits = rows.select("__key", "part", "text", F.explode(scrub_scan(F.col("text"))).alias("hit"))
    return hits.select(F.col("__key").alias(key), "part", F.col("hit.kind").alias("kind"), F.col("hit.start").alias("start"), scrub_excerpt(F.col("text"), F.col("hit")).alias("excerpt"))


def egress_gate(fields: DataFrame, form: list[str], hit: str, withheld: str, dry_run: Column, confirmed: Column) -> DataFrame:
    """By form the exit code of sending it: 1 where anything was hit, 2 where nobody confirmed, else 0."""
    out = fields.groupBy(*form).agg(F.count_if(hit).alias("n_hits"), F.count_if(withheld).alias("n_withheld"))
    return out.withColumn("exit_code", F.when(F.col("n_hits") > 0, 1).when(~dry_run & ~confirmed, 2).otherwise(0))


def _json_text(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def fingerprints(fields: DataFrame, form: str, key: str, kind: str, options: str) -> DataFrame:
    """SHA-256 over the compact JSON [[key, kind, [option values]], ...] of a form's fields in key order."""
    one = F.concat(F.lit("["), _json_text(F.col(key)), F.lit(","), _json_text(F.col(kind)), F.lit(","), F.to_json(options), F.lit("]"))
    rows = fields.groupBy(form).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("j")))).alias("x"))  # a form's fields
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda f: f["j"]), ","), F.lit("]"))
    return rows.select(form, F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("fingerprint"))


def lookup(urls: DataFrame, patterns: list[tuple[str, str, str]], tabs: DataFrame, clients: DataFrame, url: str = "url") -> DataFrame:
    """What becomes of a given address: not_an_address, not_learned (no pattern fits), not_open (no tab shows it),
    no_client (the tab's banner names none), or found. tabs (url, tab, place), clients (tab, client)."""
    distinct = url_patterns_match(urls.select(F.trim(url).alias(url)).distinct(), patterns, url)
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.try_parse_url(url, F.lit("HOST"))
    valid = F.coalesce(scheme.isin("http", "https") & host.isNotNull(), F.lit(False))
    shown = best_url_match(distinct.filter(valid & F.col("form").isNotNull()).select(url), tabs, url, "tab", "place").join(clients.select("tab", "client"), "tab", "left")
    out = distinct.withColumn("valid", valid).join(shown.select(url, "tab", "client"), url, "left")
    outcome = F.when(~F.col("valid"), "not_an_address").when(F.col("form").isNull(), "not_learned").when(F.col("tab").isNull(), "not_open").when(F.col("client").isNull(), "no_client").otherwise("found")
    found = out.select(F.col(url).alias("__url"), outcome.alias("outcome"), F.when(F.col("valid"), F.col("form")).alias("form"), "tab", "client")
    rows = urls.join(found, F.trim(url) == F.col("__url"), "left").drop("__url")
    return rows.withColumn("outcome", F.coalesce("outcome", F.lit("not_an_address")))


def fill_commands(results: DataFrame) -> DataFrame:
    """What a page is told: key, status and value of results to be filled in or derived, never the evidence."""
    return results.filter(F.col("status").isin("filled", "derived")).select("key", "status", "value")
