"""Queries of the scoring, form and dataset operators over documents, labels, pages, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import datasets, forms, scoring
from quillon.storage import read_table

CHART_FORMS = [("shop", r".*\.example\.com", "/en/*"), ("wiki", r".*\.example\.org", "/*/1*"), ("any_net", r".*\.example\.net", "*")]


def _answers(spark, sf):
    """Expected quality (labels) and what a rule on the text's length says."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rows = labels.join(docs, "doc_id")
    return rows.withColumns({
        "want": F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array(F.lit("poor"))),
        "values": F.when(F.col("n_chars") < 200, F.array().cast("array<string>")).when(F.col("n_chars") > 1500, F.array(F.lit("good"))).otherwise(F.array(F.lit("poor"))),
        "risk": F.col("toxic") == 1,
    })


def a01_must_fill(spark, sf):
    rows = _answers(spark, sf)
    expected = rows.select("doc_id", "want", F.lit(False).alias("want_multi"))
    results = rows.select("doc_id", "values", F.lit(False).alias("is_multi"))
    checks = scoring.must_fill(expected, results, ["doc_id"]).unionByName(scoring.left_blank(rows.filter("toxic = 1").select("doc_id"), results, ["doc_id"]))
    out = scoring.accuracy(checks, ["bucket"])
    return out.select("bucket", "passed", "total", F.round("accuracy", 6).alias("accuracy"))


def a08_a09_three_way(spark, sf):
    rows = _answers(spark, sf).withColumn("outcome", scoring.three_way(F.col("values"), F.col("want")))
    out = scoring.summary(rows, "lang")
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "checks", "ok", "unsafe", "unsafe_risk", "safe_blank", F.round("accuracy", 6).alias("accuracy"))


def a03_traps(spark, sf):
    rows = _answers(spark, sf)
    checks = rows.select(F.col("doc_id").alias("key"), (F.col("values") == F.col("want")).alias("pass"))
    traps = read_table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang").alias("id"), F.col("doc_id").alias("key"))
    return scoring.trap_status(traps, checks, "key")


def a13_invariance(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    out = scoring.invariance(rows, "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")
    return out.select("same", "total", "groups", F.round("share", 6).alias("share"))


def a15_multi_select(spark, sf):
    words = read_table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("got"), F.split("p_type", " ").alias("want"))
    return words.select("p_partkey", scoring.multi_outcome(F.col("got"), F.slice(F.array_union("got", "want"), 1, 2)).alias("outcome"))


def a16_threshold(spark, sf):
    rows = _answers(spark, sf).select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("truth"))
    return scoring.best_threshold(rows, "score", "truth", [100.0, 300.0, 600.0, 1000.0, 2000.0, 4000.0])


def a12_nll(spark, sf):
    rows = _answers(spark, sf).withColumn("p", F.lit(1.0) / (1 + F.exp(-(F.col("n_chars") - 1000) / 1000.0)))
    probs = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("good").alias("option"), F.col("p").alias("prob")), F.struct(F.lit("poor").alias("option"), (1 - F.col("p")).alias("prob")))).alias("x")).select("doc_id", "x.*")
    accepted = rows.select("doc_id", "lang", F.explode("want").alias("option"))
    return scoring.negative_log_likelihood(probs, accepted, ["doc_id"], ["lang"]).select("lang", F.round("nll", 6).alias("nll"))


def f24_f25_temper_decide(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.01).alias("p"))
    z = scoring.temper(F.col("p"), 1.5)
    options = F.transform("p", lambda p, i: F.struct(F.concat(F.lit("o"), i).alias("name"), (p * 3).alias("prob")))
    chosen = F.array_join(scoring.decide_options(options, 0.6, ["o0", "o1"]), "|")
    top = scoring.once(z, lambda z: scoring.once(F.array_max(z), lambda top: F.struct(top.alias("top"), F.array_position(z, top).alias("option"))))
    return e.select("vec_id", top.alias("x"), chosen.alias("chosen")).select("vec_id", F.round("x.top", 6).alias("top"), "x.option", "chosen")


def o06_top_similar(spark, sf):
    """The three vectors of each label most like the label's first vector."""
    e = read_table(spark, sf, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))  # one row for each label
    dot = F.aggregate(F.zip_with("embedding", "head", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    rows = e.join(heads, "label").withColumn("similarity", F.round(dot, 5))
    return datasets.top_per_group(rows, ["label"], [F.desc("similarity"), F.col("vec_id")], 3).select("label", "vec_id", "rank", "similarity")


def a17_a18_derivations(spark, sf):
    return _derivations(read_table(spark, sf, "lineitem"))


def a17_a18_derivations_whole(spark, sf):
    return _derivations(read_table(spark, sf, "lineitem"))


def _derivations(rows):
    rows = rows.withColumn("item", F.when(F.col("l_quantity") > 45, "n/a").otherwise(F.floor(F.col("l_quantity") / 4).cast("int").cast("string")))
    n = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = scoring.strict_sum(rows.join(n, "l_orderkey"), ["l_orderkey"], F.col("item"), F.col("n"))
    return out.select("l_orderkey", "total", scoring.band(F.col("total"), scoring.PHQ9).alias("phq9"), scoring.band(F.col("total"), scoring.GAD7).alias("gad7"))


def j02_first_result(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return scoring.first_per_key(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


def j25_last_report(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return scoring.last_per_key(rows, ["o_custkey"], "o_orderkey")


def j04_override(spark, sf):
    base = read_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    changes = base.filter("p_partkey % 7 = 0").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(10_000_000)).alias("p_partkey"), F.lit("own").alias("p_brand"), F.lit(None).cast("int").alias("p_size"))
    return forms.override(base, changes, "p_partkey", ["p_brand", "p_size"])


def j05_volatile_options(spark, sf):
    rows = read_table(spark, sf, "lineitem").groupBy("l_suppkey")
    a = rows.agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("options"))
    b = rows.agg(F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("l_linestatus"))).alias("options"))
    return forms.volatile_options(a, b, "l_suppkey", "options")


def j06_rematch(spark, sf):
    """Each supplier nation is a form; half of the keys change, and the labels of some."""
    old = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("form"), F.col("s_name").alias("key"), (F.col("s_suppkey") % 4).alias("kind"), (F.col("s_suppkey") % 3).alias("label"))
    renamed = F.when(F.col("kind") % 2 == 0, F.concat(F.lit("new "), "key")).otherwise(F.col("key"))
    new = old.select("form", renamed.alias("key"), "kind", F.when(F.col("label") == 2, 9).otherwise(F.col("label")).alias("label"))
    return forms.rematch(old, new, "form", "key", ["kind"], ["kind", "label"])


def j07_chart_forms(spark, sf):
    return forms.url_patterns_match(read_table(spark, sf, "pages").select("page_id", "url"), CHART_FORMS).groupBy("form").agg(F.count("*").alias("n"))


def j08_best_tab(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    wanted = pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("url")).distinct()
    return forms.best_url_match(wanted, pages, "url", "page_id", "page_id")


def j08_best_tab_whole(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    wanted = pages.select(F.regexp_replace("url", r"[?#].*$", "").alias("url")).distinct()
    return forms.best_url_match(wanted, pages, "url", "page_id", "page_id")


def j14_fill_outcomes(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("intended"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("F")).alias("prior"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("F")).alias("dflt"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("read_back"), (F.col("o_orderkey") % 13 == 0).alias("computed"), (F.col("o_orderkey") % 17 != 0).alias("found"),
    )
    c = F.col
    outcome = forms.fill_outcome(c("intended"), c("prior"), c("dflt"), c("read_back"), c("computed"), c("found"))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def j20_precedence(spark, sf):
    c = read_table(spark, sf, "customer")
    base = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("mode"))
    proposals = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lower("c_mktsegment").alias("mode"))
    return forms.precedence(base, proposals, "c_custkey", "mode")


def j22_resolver(spark, sf):
    c = read_table(spark, sf, "customer")
    choices = c.filter("c_acctbal < 0").select("c_custkey", F.lit("own").alias("model"))
    defaults = c.select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("model"))
    return forms.resolve(choices, defaults, "c_custkey", "model").groupBy("status").agg(F.count("*").alias("n"))


def p01_plan(spark, sf):
    p = read_table(spark, sf, "part")
    kind = F.when(F.col("p_size") % 10 == 0, "hidden").otherwise("text")
    mode = F.element_at(F.array(F.lit("narrative"), F.lit("clinician_only"), F.lit("derived"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    derive = F.when(F.col("p_size") > 25, "sum")
    return p.groupBy(forms.plan_field(kind, mode, F.col("p_size") == 7, derive).alias("plan")).agg(F.count("*").alias("n"))


def p21_p22_pii(spark, sf):
    """Sources by number of documents with personal data, and of documents without."""
    docs = read_table(spark, sf, "documents").select("doc_id", "source", F.size(T.pii_hits(F.col("text"))).alias("hits"))
    return docs.groupBy("source").agg(F.count_if(F.col("hits") > 0).alias("flagged"), F.sum("hits").cast("bigint").alias("hits"))


def g09_split(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    labels = read_table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("key"))
    return datasets.split_by_group(docs, "key", labels).select("doc_id", "split")


def g08_epoch(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("variant"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row"))
    return datasets.epoch_sample(rows, "l_orderkey", "variant", "row", "epoch-1", 0.4).select("l_orderkey", "l_linenumber", "row")


def a26_export_counts(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("minutes", F.col("n_chars") / 900.0)
    return datasets.export_counts(docs, ["lang", "source"], "minutes")


def a27_agreement(spark, sf):
    rows = _answers(spark, sf).withColumns({"a": F.col("want")[0], "b": F.get("values", F.lit(0))})
    return datasets.agreement(rows, ["lang"], "a", "b")


def a30_unreferenced(spark, sf):
    stored = read_table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"))
    used = read_table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return datasets.unreferenced(stored, used, "p_partkey", "size")


def o11_batches(spark, sf):
    return datasets.batches(read_table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 15)


def f15_generalize_path(spark, sf):
    path = F.parse_url("url", F.lit("PATH"))
    return read_table(spark, sf, "pages").groupBy(F.coalesce(T.generalize_path(path), F.lit("")).alias("path")).agg(F.count("*").alias("n"))


def f07_f04_dates(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("spelled"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    return rows.select("o_orderkey", T.parse_date(F.col("spelled")).alias("parsed"), T.is_iso_date(F.col("iso")).alias("is_iso"))


def f05_f06_clock(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", T.format_clock(F.col("o_orderkey") % 10000).alias("clock"))
    return rows.withColumn("seconds", T.parse_clock(F.col("clock")))


def u05_except(spark, sf):
    """Customers without an urgent order."""
    c = read_table(spark, sf, "customer").select("c_custkey")
    return c.exceptAll(read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct())


def a32_fingerprint(spark, sf):
    return read_table(spark, sf, "benchmark").select("item_id", F.substring(F.sha2(F.concat_ws("\n", F.col("item_id").cast("string"), "text"), 256), 1, 12).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (
    a01_must_fill, a08_a09_three_way, a03_traps, a13_invariance, a15_multi_select, a16_threshold, a12_nll, f24_f25_temper_decide, o06_top_similar,
    a17_a18_derivations, a17_a18_derivations_whole, j08_best_tab_whole, j02_first_result, j25_last_report, j04_override, j05_volatile_options, j06_rematch, j07_chart_forms, j08_best_tab,
    j14_fill_outcomes, j20_precedence, j22_resolver, p01_plan, p21_p22_pii, g09_split, g08_epoch, a26_export_counts, a27_agreement,
    a30_unreferenced, o11_batches, f15_generalize_path, f07_f04_dates, f05_f06_clock, u05_except, a32_fingerprint,
)}

_A = """a AS (SELECT l.doc_id, lang, source, n_chars, quality, toxic, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS want,
CASE WHEN n_chars < 200 THEN NULL WHEN n_chars > 1500 THEN 'good' ELSE 'poor' END AS got FROM labels l JOIN documents d USING (doc_id))"""
_DRAW = "('0x' || substring(sha256({0}), 1, 8))::BIGINT % 1000"
_PII_OK = r"len(list_filter(regexp_extract_all(text, '\b\d{3}[-. ]\d{2}[-. ]\d{4}\b|\b(?:\+?1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: NOT regexp_matches(x, '555[-. ]01\d\d$') AND NOT regexp_matches(lower(x), '@([a-z0-9-]+\.)*example\.(com|org|net)$')))"

ORACLE_SQL = {
    "a01_must_fill": f"""WITH {_A}, c AS (SELECT 'must_fill' AS bucket, coalesce(got = want, false) AS p FROM a UNION ALL SELECT 'must_leave_blank', got IS NULL FROM a WHERE toxic = 1)
SELECT bucket, count(*) FILTER (p) AS passed, count(*) AS total, round(count(*) FILTER (p) / count(*), 6) AS accuracy FROM c GROUP BY bucket""",
    "a08_a09_three_way": f"""WITH {_A}, o AS (SELECT lang, toxic = 1 AS risk, CASE WHEN got IS NULL THEN 'blank' WHEN got = want THEN 'ok' ELSE 'unsafe' END AS o FROM a)
SELECT coalesce(lang, 'all') AS lang, count(*) AS checks, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'unsafe') AS unsafe, count(*) FILTER (o = 'unsafe' AND risk) AS unsafe_risk,
count(*) FILTER (o = 'blank') AS safe_blank, round(count(*) FILTER (o = 'ok') / count(*), 6) AS accuracy FROM o GROUP BY ROLLUP (lang)""",
    "a03_traps": f"""WITH {_A}, c AS (SELECT doc_id, coalesce(got = want, false) AS p FROM a)
SELECT source || '/' || lang AS id, count(*) FILTER (NOT p) AS failed, count(p) AS checked, CASE WHEN count(*) FILTER (NOT p) > 0 THEN 'fail' WHEN count(p) > 0 THEN 'pass' ELSE 'manual' END AS status
FROM documents LEFT JOIN c USING (doc_id) GROUP BY source, lang""",
    "a13_invariance": """WITH e AS (SELECT l_orderkey, l_returnflag, count(DISTINCT coalesce(l_linestatus, chr(1))) AS a, count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY ALL)
SELECT count(*) FILTER (a = 1) AS same, count(*) AS total, count(DISTINCT l_orderkey) AS groups, round(count(*) FILTER (a = 1) / count(*), 6) AS share FROM e WHERE v >= 2""",
    "a15_multi_select": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS got, string_split(p_type, ' ') AS t FROM part),
u AS (SELECT p_partkey, got, list_concat(list_filter(got, lambda x, i: list_position(got, x) = i), list_filter(t, lambda x, i: NOT list_contains(got, x) AND list_position(t, x) = i))[1:2] AS want FROM w)
SELECT p_partkey, CASE WHEN len(list_filter(got, lambda x: NOT list_contains(want, x))) > 0 THEN 'unsafe' WHEN len(list_filter(want, lambda x: NOT list_contains(got, x))) = 0 THEN 'ok' ELSE 'blank' END AS outcome FROM u""",
    "a16_threshold": f"""WITH {_A}, g AS (SELECT t, avg((n_chars >= t) = (quality = 1)) AS acc, avg(n_chars >= t AND quality <> 1) AS uns FROM a, (SELECT unnest([100.0, 300.0, 600.0, 1000.0, 2000.0, 4000.0])::DOUBLE AS t) GROUP BY t)
SELECT t AS threshold FROM g WHERE acc >= 0.95 * (SELECT max(acc) FROM g) ORDER BY uns, t LIMIT 1""".replace("avg((n_chars >= t) = (quality = 1))", "avg(CASE WHEN (n_chars >= t) = (quality = 1) THEN 1.0 ELSE 0 END)").replace("avg(n_chars >= t AND quality <> 1)", "avg(CASE WHEN n_chars >= t AND quality <> 1 THEN 1.0 ELSE 0 END)"),
    "a12_nll": f"""WITH {_A}, p AS (SELECT lang, CASE WHEN want = 'good' THEN 1.0 / (1 + exp(-(n_chars - 1000) / 1000.0)) ELSE 1 - 1.0 / (1 + exp(-(n_chars - 1000) / 1000.0)) END AS p FROM a)
SELECT lang, round(avg(-ln(greatest(p, 1e-9))), 6) AS nll FROM p GROUP BY lang""",
    "f24_f25_temper_decide": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: ln(abs(x::DOUBLE) + 0.01) / 1.5) AS z,
list_transform(list_filter(range(len(embedding)), lambda i: (abs(embedding[i + 1]::DOUBLE) + 0.01) * 3 >= 0.6), lambda i: 'o' || i) AS c FROM embeddings),
e AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e, list_sort(CASE WHEN len(c) > 1 THEN list_filter(c, lambda x: x NOT IN ('o0', 'o1')) ELSE c END) AS c FROM p)
SELECT vec_id, round(1 / list_sum(e), 6) AS top, list_position(e, list_max(e))::BIGINT AS option, array_to_string(c, '|') AS chosen FROM e""",
    "o06_top_similar": """WITH h AS (SELECT label, arg_min(embedding, vec_id) AS head FROM embeddings GROUP BY label),
s AS (SELECT label, vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * head[i]::DOUBLE)), 5) AS similarity FROM embeddings JOIN h USING (label))
SELECT label, vec_id, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 3""",
    "a17_a18_derivations": """WITH i AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN NULL ELSE floor(l_quantity / 4)::BIGINT END AS x FROM lineitem),
t AS (SELECT l_orderkey, CASE WHEN count(x) = count(*) THEN sum(x)::BIGINT END AS total FROM i GROUP BY l_orderkey)
SELECT l_orderkey, total, CASE WHEN total <= 4 THEN 'MINIMAL' WHEN total <= 9 THEN 'MILD' WHEN total <= 14 THEN 'MODERATE' WHEN total <= 19 THEN 'MODERATELY_SEVERE' WHEN total <= 27 THEN 'SEVERE' END AS phq9,
CASE WHEN total <= 4 THEN 'MINIMAL' WHEN total <= 9 THEN 'MILD' WHEN total <= 14 THEN 'MODERATE' WHEN total <= 21 THEN 'SEVERE' END AS gad7 FROM t""",
    "a17_a18_derivations_whole": """WITH i AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN NULL ELSE floor(l_quantity / 4)::BIGINT END AS x FROM lineitem),
t AS (SELECT l_orderkey, CASE WHEN count(x) = count(*) THEN sum(x)::BIGINT END AS total FROM i GROUP BY l_orderkey)
SELECT l_orderkey, total, CASE WHEN total <= 4 THEN 'MINIMAL' WHEN total <= 9 THEN 'MILD' WHEN total <= 14 THEN 'MODERATE' WHEN total <= 19 THEN 'MODERATELY_SEVERE' WHEN total <= 27 THEN 'SEVERE' END AS phq9,
CASE WHEN total <= 4 THEN 'MINIMAL' WHEN total <= 9 THEN 'MILD' WHEN total <= 14 THEN 'MODERATE' WHEN total <= 21 THEN 'SEVERE' END AS gad7 FROM t""",
    "j08_best_tab_whole": r"""WITH w AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages),
b AS (SELECT w.url, page_id AS tab, CASE WHEN w.url = p.url THEN 0 WHEN w.url = regexp_replace(p.url, '#.*$', '') THEN 1 ELSE 2 END AS rank FROM w JOIN pages p ON w.url = regexp_replace(p.url, '[?#].*$', ''))
SELECT url, tab, rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, tab) AS r FROM b) WHERE r = 1""",
    "j02_first_result": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1",
    "j25_last_report": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "j04_override": "SELECT p_partkey, CASE WHEN p_partkey % 14 = 0 THEN 'own' ELSE p_brand END AS p_brand, p_size FROM part",
    "j05_volatile_options": """SELECT l_suppkey FROM lineitem GROUP BY l_suppkey
HAVING list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber <= 3 AND l_returnflag IS NOT NULL))) IS DISTINCT FROM list_sort(list_distinct(list(l_linestatus) FILTER (l_linenumber > 3 AND l_linestatus IS NOT NULL)))""",
    "j06_rematch": """WITH o AS (SELECT s_nationkey AS form, s_name AS key, s_suppkey % 4 AS kind, s_suppkey % 3 AS label FROM supplier),
n AS (SELECT form, CASE WHEN kind % 2 = 0 THEN 'new ' || key ELSE key END AS key, kind, CASE WHEN label = 2 THEN 9 ELSE label END AS label FROM o),
same AS (SELECT o.form, o.key AS old_key, n.key AS new_key FROM o JOIN n ON o.form = n.form AND o.kind = n.kind AND o.key = n.key),
ol AS (SELECT *, row_number() OVER (PARTITION BY form, kind, label ORDER BY key) AS r FROM o WHERE (form, key) NOT IN (SELECT form, old_key FROM same)),
nl AS (SELECT *, row_number() OVER (PARTITION BY form, kind, label ORDER BY key) AS r FROM n WHERE (form, key) NOT IN (SELECT form, new_key FROM same))
SELECT form, old_key, new_key, 'same' AS status FROM same
UNION ALL SELECT coalesce(ol.form, nl.form), ol.key, nl.key, CASE WHEN ol.key IS NULL THEN 'added' WHEN nl.key IS NULL THEN 'removed' ELSE 'moved' END
FROM ol FULL JOIN nl ON ol.form = nl.form AND ol.kind = nl.kind AND ol.label = nl.label AND ol.r = nl.r""",
    "j07_chart_forms": r"""WITH u AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT CASE WHEN regexp_matches(host, '^.*\.example\.com$') AND regexp_matches(path, '^/en/.*$') THEN 'shop' WHEN regexp_matches(host, '^.*\.example\.org$') AND regexp_matches(path, '^/.*/1.*$') THEN 'wiki'
WHEN regexp_matches(host, '^.*\.example\.net$') THEN 'any_net' END AS form, count(*) AS n FROM u GROUP BY ALL""",
    "j08_best_tab": r"""WITH w AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages),
b AS (SELECT w.url, page_id AS tab, CASE WHEN w.url = p.url THEN 0 WHEN w.url = regexp_replace(p.url, '#.*$', '') THEN 1 ELSE 2 END AS rank FROM w JOIN pages p ON w.url = regexp_replace(p.url, '[?#].*$', ''))
SELECT url, tab, rank FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, tab) AS r FROM b) WHERE r = 1""",
    "j14_fill_outcomes": """WITH r AS (SELECT o_orderstatus AS i, CASE WHEN o_orderkey % 5 = 0 THEN 'F' END AS p, CASE WHEN o_orderkey % 10 = 0 THEN 'F' END AS d,
CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS b, o_orderkey % 13 = 0 AS c, o_orderkey % 17 <> 0 AS f FROM orders)
SELECT CASE WHEN NOT f THEN 'not_found' WHEN c THEN CASE WHEN i IS NOT DISTINCT FROM b THEN 'computed_verified' ELSE 'computed_mismatch' END
WHEN p IS NOT NULL AND p <> '' AND p IS DISTINCT FROM d AND p IS DISTINCT FROM i THEN 'conflict_skipped' WHEN b IS NOT DISTINCT FROM i THEN 'ok' ELSE 'reverted' END AS outcome, count(*) AS n FROM r GROUP BY ALL""",
    "j20_precedence": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS mode, CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'proposal' END AS origin
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
    "j22_resolver": "SELECT CASE WHEN c_acctbal < 0 THEN 'chosen' WHEN c_custkey % 4 > 0 THEN 'default' ELSE 'missing' END AS status, count(*) AS n FROM customer GROUP BY ALL",
    "p01_plan": """WITH p AS (SELECT p_size % 10 = 0 AS hidden, ['narrative', 'clinician_only', 'derived', NULL][p_partkey % 4 + 1] AS mode, p_size = 7 AS computed, p_size > 25 AS derive FROM part)
SELECT CASE WHEN computed OR hidden OR mode IS NULL THEN 'omit' WHEN mode = 'clinician_only' THEN 'clinician_only' WHEN mode = 'derived' THEN CASE WHEN derive THEN 'derived' ELSE 'omit' END ELSE 'request' END AS plan, count(*) AS n FROM p GROUP BY ALL""",
    "p21_p22_pii": f"WITH h AS (SELECT source, {_PII_OK} AS h FROM documents) SELECT source, count(*) FILTER (h > 0) AS flagged, sum(h)::BIGINT AS hits FROM h GROUP BY source",
    "g09_split": f"SELECT doc_id, CASE WHEN {_DRAW.format('doc_id::VARCHAR')} < 150 THEN 'val' ELSE 'train' END AS split FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "g08_epoch": f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row FROM lineitem),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('epoch-1|' || row)) AS k FROM r WHERE l_linenumber > 1 AND {_DRAW.format("'epoch-1|' || l_orderkey")} < 400)
SELECT * FROM r WHERE NOT l_linenumber > 1 UNION ALL SELECT l_orderkey, l_linenumber, row FROM v WHERE k = 1""",
    "a26_export_counts": "SELECT lang, source, count(*) AS n, round(sum(n_chars / 900.0), 3) AS minutes FROM documents GROUP BY lang, source",
    "a27_agreement": f"WITH {_A} SELECT lang, round(avg(CASE WHEN want IS NOT DISTINCT FROM got THEN 1.0 ELSE 0 END), 3) AS agreement, count(*) AS n FROM a GROUP BY lang",
    "a30_unreferenced": "SELECT count(*) AS n, coalesce(sum(p_size), 0)::BIGINT AS bytes_freed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
    "o11_batches": "SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 15)::BIGINT AS batch FROM orders",
    "f15_generalize_path": r"""WITH p AS (SELECT string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS s FROM pages)
SELECT array_to_string(list_transform(s, lambda p: CASE WHEN regexp_matches(p, '^\d+$') OR regexp_matches(p, '^[0-9a-fA-F-]{16,}$') OR (regexp_matches(p, '\d') AND length(p) >= 12) THEN '*' ELSE p END), '/') AS path, count(*) AS n FROM p GROUP BY ALL""",
    "f07_f04_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, true AS is_iso FROM orders",
    "f05_f06_clock": "WITH s AS (SELECT o_orderkey, o_orderkey % 10000 AS s FROM orders) SELECT o_orderkey, lpad((s // 60)::VARCHAR, greatest(2, length((s // 60)::VARCHAR))::INT, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock, s::DOUBLE AS seconds FROM s",
    "u05_except": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "a32_fingerprint": "SELECT item_id, substring(sha256(item_id::VARCHAR || chr(10) || text), 1, 12) AS fingerprint FROM benchmark",
}
