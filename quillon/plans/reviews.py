"""Queries of the review functions and operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import review as R
from quillon.operators import review
from quillon.storage import read_table


def _pick(names: list[str], column: str, step: int = 1):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(F.col(column) / step) % len(names) + 1).cast("int"))


STATUSES = ["filled", "derived", "rejected", "clinician_only", "filled"]
OUTCOMES = ["ok", "conflict_skipped", "computed_mismatch", "failed"]


def p19_p28_review(spark, sf):
    o = read_table(spark, sf, "orders")
    edited = F.col("o_orderkey") % 11 == 0
    status = R.review_status(_pick(STATUSES, "o_orderkey"), _pick(OUTCOMES, "o_custkey"), edited, F.col("o_custkey") % 3 == 0)
    kind = F.when(F.col("o_custkey") % 7 == 0, "hidden").otherwise("text")
    blank = R.required_blank(status, F.col("o_custkey") % 2 == 0, kind, F.col("o_custkey") % 5 == 0, edited)
    return o.groupBy(status.alias("review"), blank.alias("required_blank")).agg(F.count("*").alias("n"))


def j13_review_rows(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    reports = read_table(spark, sf, "lineitem").filter("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("outcome"))
    fields = read_table(spark, sf, "customer").filter("c_custkey % 4 > 0").select("c_custkey", F.col("c_mktsegment").alias("kind"))
    return review.review_rows(o, reports, fields, ["o_orderkey"], "c_custkey").groupBy("outcome", "kind").agg(F.count("*").alias("n"))


def j09_only_one(spark, sf):
    return review.only_one(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


def p30_resumable(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", F.lit("yes")).alias("confirmed"), F.when(F.col("o_orderkey") % 5 > 0, _pick(["armed", "review"], "o_orderkey")).alias("stage"))
    keys = read_table(spark, sf, "customer").filter("c_acctbal > 0")
    return review.unconfirmed(o, keys, "c_custkey", "confirmed", "stage").select("o_orderkey", "stage")


def a04_a06_gates(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, "must_leave_blank").otherwise("must_fill").alias("bucket"), ((F.col("l_linenumber") == 1) | (F.col("l_quantity") > 3)).alias("pass"),
        (F.col("l_tax") > 0.07).alias("risk"), F.col("l_quantity").cast("bigint").alias("ms"), F.lit(None).cast("boolean").alias("cache_miss"),
    )
    return review.gates(rows, 0.9)


def f12_missing_words(spark, sf):
    words = read_table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    out = review.missing_share(words.filter("role = 'user'"), words.filter("role = 'assistant'"), ["conv_id"], "word")
    return out.select("conv_id", F.round("missing", 6).alias("missing"))


def f17_detokenize(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", R.detokenize(F.regexp_replace("text", r"([,.?!])", " $1 ")).alias("text"))


def f29_short_name(spark, sf):
    p = read_table(spark, sf, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("REYES, "), "p_name")).when(F.col("p_size") % 3 == 1, F.col("p_name"))
    return p.select("p_partkey", R.short_name(name, F.col("p_brand")).alias("name"))


def p15_first_label(spark, sf):
    p = read_table(spark, sf, "part")
    label = R.first_label([("label_for", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))), ("aria_label", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("")), ("placeholder", F.when(F.col("p_size") % 5 > 0, F.col("p_name")))])
    return p.select("p_partkey", label["text"].alias("text"), label["source"].alias("source"))


def p04_p09_gated(spark, sf):
    p = read_table(spark, sf, "part")
    gated = R.is_gated(_pick(["discrete", "narrative"], "p_partkey"), _pick(["select", "text", "checkbox_group"], "p_size"), F.col("p_partkey") % 5 == 0)
    return p.groupBy(gated.alias("gated"), R.is_placeholder(F.concat(F.lit("9-"), F.col("p_size").cast("string"))).alias("placeholder")).agg(F.count("*").alias("n"))


def o04_call_sources(spark, sf):
    c = read_table(spark, sf, "customer")
    order = review.call_source_order(F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING", F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return review.numbered(c, ["c_nationkey"], order).select("c_custkey", "place")


def w06_stamp(spark, sf):
    out = review.stamp(read_table(spark, sf, "conversations"), ["conv_id"], "turn", "text", 150.0)
    return out.select("conv_id", "turn", F.round("start", 4).alias("start"))


def u04_o07_sets(spark, sf):
    p = read_table(spark, sf, "part").select(F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"), "p_size")
    b = F.when(F.col("p_size") % 4 == 0, F.col("a")).when(F.col("p_size") % 4 == 1, F.slice("a", 1, 1)).when(F.col("p_size") % 4 == 2, F.concat("a", "b")).otherwise(F.col("b"))
    return p.groupBy(R.set_relation(F.col("a"), b).alias("relation"), F.array_join(R.in_option_order(b, F.col("a")), ",").alias("chosen")).agg(F.count("*").alias("n"))


def a31_window_features(spark, sf):
    f = R.window_features(F.col("embedding"))
    return read_table(spark, sf, "embeddings").select("vec_id", (F.round(f["mean"], 4) + 0.0).alias("mean"), F.round(f["max"], 4).alias("max"), F.round(f["top_mean"], 4).alias("top_mean"))


def r40_two_teachers(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("answer"))
    other = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).alias("answer")).filter("o_orderkey % 7 > 0")
    return review.two_teachers(o, other, ["o_orderkey"], "answer").groupBy("agree", "label").agg(F.count("*").alias("n"))


def r32_questions(spark, sf):
    p = read_table(spark, sf, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("key"), F.split("p_type", " ").alias("options"), (F.col("p_size") % 2 == 0).alias("multi"))
    return review.questions(p, "key", "options", "multi").groupBy("letters").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("ids"))


def r02_content_words(spark, sf):
    """Words that items of the benchmark share; ASCII letters and blanks only, so that all normalisers agree."""
    b = read_table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z ]", " ").alias("text"))
    return b.select("item_id", F.explode(R.content_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    p19_p28_review, j13_review_rows, j09_only_one, p30_resumable, a04_a06_gates, f12_missing_words, f17_detokenize, f29_short_name, p15_first_label,
    p04_p09_gated, o04_call_sources, w06_stamp, u04_o07_sets, a31_window_features, r40_two_teachers, r32_questions, r02_content_words,
)}

ORACLE_SQL = {
    "p19_p28_review": """WITH o AS (SELECT *, ['filled', 'derived', 'rejected', 'clinician_only', 'filled'][o_orderkey % 5 + 1] AS s, ['ok', 'conflict_skipped', 'computed_mismatch', 'failed'][o_custkey % 4 + 1] AS x, o_orderkey % 11 = 0 AS e FROM orders),
r AS (SELECT *, CASE WHEN e THEN 'edited' WHEN s = 'clinician_only' THEN 'needs_judgement' WHEN s = 'rejected' THEN 'insufficient_evidence'
WHEN s = 'derived' THEN CASE WHEN x = 'computed_mismatch' THEN 'write_failed' ELSE 'calculated' END WHEN x = 'ok' THEN 'filled'
WHEN x = 'conflict_skipped' THEN CASE WHEN o_custkey % 3 = 0 THEN 'proposed_change' ELSE 'conflict_skipped' END ELSE 'write_failed' END AS review FROM o)
SELECT review, o_custkey % 2 = 0 AND o_custkey % 7 <> 0 AND o_custkey % 5 <> 0 AND NOT e AND review IN ('insufficient_evidence', 'needs_judgement', 'write_failed') AS required_blank, count(*) AS n FROM r GROUP BY ALL""",
    "j13_review_rows": """SELECT outcome, kind, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS outcome FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT c_custkey, c_mktsegment AS kind FROM customer WHERE c_custkey % 4 > 0) ON c_custkey = o_custkey GROUP BY ALL""",
    "j09_only_one": "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1",
    "p30_resumable": "SELECT o_orderkey, 'review' AS stage FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 > 0 AND o_orderkey % 2 = 1 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "a04_a06_gates": """SELECT true AS blank_gate, count(*) FILTER (l_tax > 0.07 AND l_linenumber <> 1 AND l_quantity <= 3) = 0 AS risk_gate,
coalesce(avg((l_quantity > 3)::INT) FILTER (l_linenumber <> 1) >= 0.9, false) AS accuracy_gate, false AS cache_gate, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS total_ms FROM lineitem""",
    "f12_missing_words": """WITH w AS (SELECT conv_id, role, unnest(string_split(text, ' ')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) FILTER (role = 'user') AS r, count(*) FILTER (role = 'assistant') AS h FROM w WHERE word <> '' GROUP BY ALL)
SELECT conv_id, round(sum(greatest(r - h, 0)) / sum(r), 6) AS missing FROM c WHERE r > 0 GROUP BY conv_id""",
    "f17_detokenize": r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([,.?!])', ' \1 ', 'g'), '\s+([,.?!;:])', '\1', 'g'), '\s+''', '''', 'g'), '\s+', ' ', 'g')) AS text FROM conversations""",
    "f29_short_name": """WITH p AS (SELECT p_partkey, p_brand, p_size % 3 AS k, string_split(p_name, ' ') AS w, p_name FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN w[1] || ' R.' WHEN 1 THEN CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[-1][1] || '.' ELSE p_name END ELSE p_brand END AS name FROM p""",
    "p15_first_label": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 5 > 0 THEN p_name END AS text,
CASE WHEN p_size % 2 = 0 THEN 'label_for' WHEN p_size % 3 = 0 THEN 'aria_label' WHEN p_size % 5 > 0 THEN 'placeholder' END AS source FROM part""",
    "p04_p09_gated": "SELECT p_partkey % 2 = 0 AND p_size % 3 <> 1 AND p_partkey % 5 <> 0 AS gated, p_size IN (9, 99) AS placeholder, count(*) AS n FROM part GROUP BY ALL",
    "o04_call_sources": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 5000 DESC, c_mktsegment = 'BUILDING' DESC, c_custkey % 3 = 0 DESC, lower(c_name), c_name)::INT AS place FROM customer",
    "w06_stamp": r"""SELECT conv_id, turn, round(coalesce(sum(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.4, 4)::DOUBLE AS start FROM conversations""",
    "u04_o07_sets": """WITH p AS (SELECT string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS n, p_size % 4 AS k FROM part), q AS (SELECT a, CASE k WHEN 0 THEN a WHEN 1 THEN a[1:1] WHEN 2 THEN a || n ELSE n END AS b FROM p),
r AS (SELECT a, b, len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 AS more, len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 AS less FROM q)
SELECT CASE WHEN NOT more AND NOT less THEN 'equal' WHEN NOT more THEN 'subset' WHEN NOT less THEN 'superset' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'apart' END AS relation,
array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS chosen, count(*) AS n FROM r GROUP BY ALL""",
    "a31_window_features": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 4) + 0.0 AS mean, round(list_max(v), 4) AS max, round(list_avg(list_reverse_sort(v)[1:3]), 4) AS top_mean FROM e""",
    "r40_two_teachers": """WITH t AS (SELECT CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS a, CASE WHEN o_orderkey % 7 > 0 AND o_custkey % 4 > 0 THEN o_orderstatus END AS b FROM orders)
SELECT a IS NOT DISTINCT FROM b AS agree, CASE WHEN a IS NOT DISTINCT FROM b THEN a END AS label, count(*) AS n FROM t GROUP BY ALL""",
    "r32_questions": """WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS o, p_size % 2 = 0 AS m FROM part), q AS (SELECT p_partkey || '' AS id, substring('ABCDEFGHIJ', 1, len(o)) || 'Z' AS letters FROM p WHERE NOT m
UNION ALL SELECT p_partkey || ':' || unnest(o), 'AB' FROM p WHERE m) SELECT letters, count(*) AS n, count(DISTINCT id) AS ids FROM q GROUP BY letters""",
    "r02_content_words": """WITH b AS (SELECT item_id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS word FROM benchmark)
SELECT word, count(DISTINCT item_id) AS n FROM b WHERE length(word) >= 4 GROUP BY word""",
}
