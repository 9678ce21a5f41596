"""Queries of the value functions and store operators over customers, parts, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import values as V
from quillon.operators import store
from quillon.storage import read_table

KEY = b"quillon example key"
PREFIXES = [("PROMO BRUSHED", "promo brushed"), ("PROMO", "promo"), ("STANDARD", "standard"), ("S", "other s")]


def f18_frequency_band(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_quantity").cast("double").alias("n"))
    period = F.element_at(F.array(*[F.lit(x) for x in ("day", "week", "month", "year")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    bands = F.create_map(F.lit("a_rare"), F.array(F.lit(0.0), F.lit(4.0)), F.lit("b_some"), F.array(F.lit(4.0), F.lit(60.0)), F.lit("c_often"), F.array(F.lit(100.0), F.lit(1000.0)))
    return rows.groupBy(period.alias("period"), V.frequency_band(F.col("n"), period, bands).alias("band")).agg(F.count("*").alias("n"))


def f26_label_match(spark, sf):
    rows = read_table(spark, sf, "part").select("p_partkey", F.split("p_type", " ").alias("v"), "p_size")
    accepted = F.array(F.reverse("v"), F.array(F.lit("x")))
    value = F.when(F.col("p_size") % 2 == 0, F.col("v")).when(F.col("p_size") % 3 == 0, F.array(F.lit("x")))
    return rows.groupBy(V.label_match(value, accepted).alias("good")).agg(F.count("*").alias("n"))


def f34_weekday(spark, sf):
    return read_table(spark, sf, "orders").groupBy(V.weekday(F.col("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


def f40_meter(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.round(V.meter(F.abs("value") / 1000), 6).alias("level"))


def p05_p07_labels(spark, sf):
    rows = read_table(spark, sf, "benchmark").select("item_id", "text")
    return rows.select("item_id", V.is_questionnaire(F.lit("radio_group"), F.col("text")).alias("questionnaire"), V.says_something(F.col("text")).alias("speaks"), V.is_attestation(F.col("text")).alias("attests"))


def p05_p07_labels_whole(spark, sf):
    rows = read_table(spark, sf, "benchmark").select("item_id", "text")
    return rows.select("item_id", V.is_questionnaire(F.lit("radio_group"), F.col("text")).alias("questionnaire"), V.says_something(F.col("text")).alias("speaks"))


def p08_normalise(spark, sf):
    rows = read_table(spark, sf, "part")
    mode = F.element_at(F.array(*[F.lit(x) for x in ("narrative", "discrete", "other", "derived")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("p_size") > 20, "textarea").otherwise("select")
    return rows.groupBy(V.clean_mode(mode, kind).alias("mode"), V.clamp_chars((F.col("p_size") - 25) * 200).alias("max_chars")).agg(F.count("*").alias("n"))


def j26_rekey(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    renames = c.filter("key % 5 = 0").select(F.col("key").alias("old_key"), (F.col("key") + 1_000_000).alias("new_key"))
    keys = c.filter("key % 5 <> 0 and key % 7 <> 0").select("key").unionByName(renames.filter("old_key % 2 = 0").select(F.col("new_key").alias("key")))
    return store.rekey(c, renames, keys, "key")


def j27_recover(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("text"))
    return store.recover(o.select("key"), o.filter("key % 3 = 0"), o.filter("key % 2 = 0").withColumn("text", F.lower("text")), "key", "text")


def j28_prefix(spark, sf):
    return read_table(spark, sf, "part").groupBy(store.first_prefix(F.col("p_type"), PREFIXES).alias("kind")).agg(F.count("*").alias("n"))


def k11_upsert(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(5000)).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return store.upsert(s, new, "s_suppkey")


def a33_verify_blobs(spark, sf):
    b = read_table(spark, sf, "benchmark").select("item_id", "text")
    wanted = b.select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    blobs = b.filter("item_id % 5 <> 0").select(F.sha2("text", 256).alias("sha256"), F.when(F.col("item_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return store.verify_blobs(wanted, blobs).groupBy("status").agg(F.count("*").alias("n"))


def a34_r20_preflight(spark, sf):
    p = read_table(spark, sf, "part")
    files = p.select("p_brand", F.col("p_partkey").cast("string").alias("sha256"), F.col("p_size").cast("bigint").alias("size"))
    have = files.filter("cast(sha256 as int) % 3 > 0").select("sha256", F.when(F.col("size") > 45, F.col("size") - 5).otherwise(F.col("size")).alias("size"))
    return store.bytes_missing(files, have, "p_brand").join(store.complete(files, have, "p_brand"), "p_brand")


def a24_groups(spark, sf):
    c = read_table(spark, sf, "customer").withColumn("active", F.col("c_acctbal") < 0)
    return store.group_processes(c, "c_nationkey", "active", "c_mktsegment").select("c_nationkey", "active", "n", F.array_join("names", ",").alias("names"))


def t22_chunks(spark, sf):
    e = read_table(spark, sf, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    e = e.select("user_id", (F.col("start") / 3600).alias("start"), (F.col("start") / 3600 + 0.5).alias("end"), "event_id")
    out = store.second_chunks(e, ["user_id"], "start", "end", 6.0)
    return out.groupBy("user_id", "piece").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("n"))


def j24_clip(spark, sf):
    e = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + 10).alias("end"))
    return store.clip(e, 15.0, 40.0).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


def k09_seal(spark, sf):
    """Seals each customer's name for its key; opening works for that key only."""
    c = read_table(spark, sf, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("name"))
    key, aad = F.lit(b"0123456789abcdef"), F.concat(F.col("c_custkey").cast("string"), F.lit("/name"))
    box = V.seal(F.col("name"), key, aad)
    opened = V.unseal(box, key, F.when(F.col("c_custkey") % 4 == 0, F.concat(aad, F.lit("x"))).otherwise(aad))
    return c.select("c_custkey", opened.cast("string").alias("name"))


def g10_middle_cut(spark, sf):
    rows = read_table(spark, sf, "benchmark").select("item_id", V.middle_cut(F.split("text", " "), 11).alias("t"))
    return rows.select("item_id", F.array_join("t", " ").alias("text"))


QUERIES = {f.__name__: f for f in (
    f18_frequency_band, f26_label_match, f34_weekday, f40_meter, p05_p07_labels, p05_p07_labels_whole, p08_normalise, j24_clip, j26_rekey, j27_recover, j28_prefix,
    k09_seal, k11_upsert, a24_groups, a33_verify_blobs, a34_r20_preflight, t22_chunks, g10_middle_cut,
)}

ORACLE_SQL = {
    "f18_frequency_band": """WITH p AS (SELECT floor(l_quantity) AS n, ['day', 'week', 'month', 'year'][l_linenumber % 4 + 1] AS period FROM lineitem),
m AS (SELECT period, CASE period WHEN 'day' THEN n * 30.4 WHEN 'week' THEN n * 4.345 WHEN 'month' THEN n ELSE n / 12 END AS m FROM p)
SELECT period, CASE WHEN m BETWEEN 0 AND 4 THEN 'a_rare' WHEN m BETWEEN 4 AND 60 THEN 'b_some' WHEN m BETWEEN 100 AND 1000 THEN 'c_often' END AS band, count(*) AS n FROM m GROUP BY ALL""",
    "f26_label_match": "SELECT p_size % 2 = 0 OR p_size % 3 = 0 AS good, count(*) AS n FROM part GROUP BY ALL",
    "f34_weekday": "SELECT dayname(o_orderdate) AS day, count(*) AS n FROM orders GROUP BY ALL",
    "f40_meter": "SELECT event_id, round(greatest(0, least(1, (20 * log10(greatest(abs(value) / 1000, 1e-9)) + 60) / 60)), 6) AS level FROM events",
    "p05_p07_labels": r"SELECT item_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 5 AS questionnaire, regexp_matches(text, '[\p{L}\p{N}]') AS speaks, regexp_matches(lower(text), 'attest|signature|sign here|i certify|e-sign|esign|electronically sign') AS attests FROM benchmark",
    "p05_p07_labels_whole": r"SELECT item_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 5 AS questionnaire, regexp_matches(text, '[\p{L}\p{N}]') AS speaks FROM benchmark",
    "p08_normalise": """WITH p AS (SELECT ['narrative', 'discrete', 'other', 'derived'][p_partkey % 4 + 1] AS m, p_size > 20 AS t, least(greatest((p_size - 25) * 200, 1), 4000) AS max_chars FROM part)
SELECT CASE WHEN m = 'other' THEN 'discrete' WHEN m = 'narrative' AND NOT t THEN 'discrete' ELSE m END AS mode, max_chars, count(*) AS n FROM p GROUP BY ALL""",
    "j24_clip": """SELECT l_linenumber, count(*) AS n, round(sum(least(l_quantity + 10, 40) - greatest(l_quantity, 15)), 4) AS seconds FROM lineitem WHERE l_quantity < 40 AND l_quantity + 10 > 15 GROUP BY ALL""",
    "j26_rekey": """SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS key, c_name FROM customer
WHERE CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 ELSE c_custkey % 7 <> 0 END""",
    "j27_recover": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END AS text,
CASE WHEN o_orderkey % 3 = 0 THEN 'final' WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'none' END AS source FROM orders""",
    "j28_prefix": """SELECT CASE WHEN starts_with(p_type, 'PROMO BRUSHED') THEN 'promo brushed' WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN starts_with(p_type, 'S') THEN 'other s' END AS kind, count(*) AS n FROM part GROUP BY ALL""",
    "k09_seal": "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name FROM customer",
    "k11_upsert": """WITH n AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 5000 END AS s_suppkey, 'new' AS s_name, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) UNION ALL SELECT * FROM n""",
    "a24_groups": "SELECT c_nationkey, bool_or(c_acctbal < 0) AS active, count(*) AS n, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS names FROM customer GROUP BY c_nationkey",
    "a33_verify_blobs": "SELECT CASE WHEN item_id % 5 = 0 THEN 'missing' WHEN item_id % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS status, count(*) AS n FROM benchmark GROUP BY ALL",
    "a34_r20_preflight": """WITH h AS (SELECT p_brand, p_size AS size, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_size > 45 THEN p_size - 5 ELSE p_size END END AS have FROM part)
SELECT p_brand, sum(size)::BIGINT AS total, sum(greatest(size - coalesce(have, 0), 0))::BIGINT AS missing, bool_and(coalesce(size = have, false)) AS complete FROM h GROUP BY p_brand""",
    "t22_chunks": """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 / 3600 AS s FROM events),
b AS (SELECT *, CASE WHEN s - (lag(s) OVER w + 0.5) > 6 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
p AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s)::BIGINT AS piece FROM b), c AS (SELECT *, floor(s - min(s) OVER (PARTITION BY user_id, piece)) AS chunk FROM p)
SELECT user_id, piece, count(DISTINCT chunk) AS chunks, count(*) AS n FROM c GROUP BY ALL""",
    "g10_middle_cut": """WITH t AS (SELECT item_id, string_split(text, ' ') AS t FROM benchmark)
SELECT item_id, array_to_string(CASE WHEN len(t) <= 11 THEN t ELSE list_concat(t[1:5], t[len(t) - 5:len(t)]) END, ' ') AS text FROM t""",
}
