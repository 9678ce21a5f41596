"""Queries of the timeline and text operators over ``conversations`` (session conv_id, order turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import scoring, timeline
from quillon.storage import read_table

S, O = ["conv_id"], ["turn"]


def _turns(spark, sf):
    return read_table(spark, sf, "conversations")


def w01_j16_turn_context(spark, sf):
    rows = timeline.preceding(_turns(spark, sf), S, O, F.col("role") == "assistant", F.length("text"), "prev_len")
    rows = rows.withColumn("prev_len", F.when(F.col("role") != "system", F.col("prev_len")))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count("prev_len").alias("has_prev"), F.sum("prev_len").cast("bigint").alias("sum_prev_len"))


def w01_numbering(spark, sf):
    rows = timeline.number_segments(_turns(spark, sf), S, [F.col("turn"), F.when(F.col("role") == "assistant", 0).otherwise(1)])
    return rows.select("conv_id", "turn", "seq", "segment_id")


def w02_segment_ends(spark, sf):
    rows = _turns(spark, sf).withColumn("start", F.col("turn") * 10.0)
    return timeline.segment_ends(rows, S, O, "start", "text").select("conv_id", "turn", F.round("end", 6).alias("end"))


def w04_context(spark, sf):
    rows = timeline.context_windows(_turns(spark, sf), S, O, "role")
    return rows.select("conv_id", "turn", "context")


def w05_running_clock(spark, sf):
    rows = timeline.running_clock(_turns(spark, sf), S, O, "text", 150.0, 0.6)
    return rows.select("conv_id", "turn", F.round("start", 4).alias("start"))


def w09_islands(spark, sf):
    rows = timeline.islands(_turns(spark, sf), S, O, ["role"])
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


def f01_normalize(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.length(T.normalize(F.col("text"))).alias("n"), F.md5(T.normalize(F.col("text"))).alias("digest"))


def p11_p12_short_answers(spark, sf):
    rows = _turns(spark, sf).select("conv_id", "turn", T.is_negated_short_answer(F.col("text")).alias("negated"), T.is_bare_affirmation(F.col("text")).alias("affirmed"))
    return rows


def p11_p12_sentences(spark, sf):
    """Every sentence of every turn, judged as a short answer."""
    rows = _turns(spark, sf).select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.!?]+")).alias("sentence", "t"))
    return rows.select("conv_id", "turn", "sentence", T.is_negated_short_answer(F.col("t")).alias("negated"), T.is_bare_affirmation(F.col("t")).alias("affirmed"))


def a20_text_by_role(spark, sf):
    rows = _turns(spark, sf).groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda r: r["text"]), " ")
    return rows.select("conv_id", "role", F.md5(joined).alias("digest"), F.length(joined).cast("bigint").alias("n"))


def a22_main_speaker(spark, sf):
    rows = _turns(spark, sf).withColumn("talk_time", F.length("text").cast("bigint"))
    return scoring.main_speaker(rows, S, "role", "talk_time")


def a10_role_summary(spark, sf):
    rows = _turns(spark, sf).select("role", F.when(F.length("text") > 400, "ok").when(F.length("text") < 100, "blank").otherwise("unsafe").alias("outcome"), (F.col("turn") % 2 == 0).alias("risk"))
    out = scoring.summary(rows, "role")
    return out.select(F.coalesce("role", F.lit("all")).alias("role"), "checks", "ok", "unsafe", "unsafe_risk", "safe_blank", F.round("accuracy", 6).alias("accuracy"))


def f13_redact(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.md5(T.redact(F.col("text"))).alias("digest"))


def f13_redact_whole(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.length(T.redact(F.col("text"))).alias("n"), F.md5(T.redact(F.col("text"))).alias("digest"))


def w03_backwards(spark, sf):
    rows = _turns(spark, sf).withColumn("start", (F.col("turn") * 7 % 5).cast("double"))
    return timeline.backwards(rows, S, O, "start").select("conv_id", "turn", "start")


def u01_u06_timeline_union(spark, sf):
    turns = _turns(spark, sf)
    said = turns.select("conv_id", (F.col("turn") * 10.0).alias("start"), F.lit("segment").alias("kind"), "role")
    gaps = turns.filter(F.length("text") < 100).select("conv_id", (F.col("turn") * 10.0 + 5).alias("start"), F.lit("gap").alias("kind"))
    return timeline.number_segments(said.unionByName(gaps, allowMissingColumns=True), S, ["start", "kind"]).select("conv_id", "seq", "start", "kind", "role")


def t15_rising_edges(spark, sf):
    rows = _turns(spark, sf).withColumn("long", F.length("text") > 300)
    return timeline.rising_edges(rows, S, O, "long").select("conv_id", "turn")


def t23_silence(spark, sf):
    rows = _turns(spark, sf).withColumn("silent", F.length("text") < 300)
    return timeline.silence_so_far(rows, S, O, "silent").select("conv_id", "turn", F.round("silence", 4).alias("silence"))


def t14_chain(spark, sf):
    """Chains every conversation, breaks each fifth one at its second entry, and finds the breaks again."""
    rows = _turns(spark, sf).select("conv_id", "turn", "role")
    chained = timeline.append_chain(rows, S, ["turn"], ["turn", "role"])
    torn = (F.col("conv_id") % 5 == 0) & (F.col("seq") == 2)
    return timeline.broken_chains(chained.withColumn("role", F.when(torn, "x").otherwise(F.col("role"))), S, ["turn", "role"])


QUERIES = {f.__name__: f for f in (
    w01_j16_turn_context, w01_numbering, w02_segment_ends, w03_backwards, w04_context, w05_running_clock, w09_islands, f01_normalize,
    p11_p12_short_answers, p11_p12_sentences, f13_redact, f13_redact_whole, a20_text_by_role, a22_main_speaker, a10_role_summary, u01_u06_timeline_union, t14_chain,
    t15_rising_edges, t23_silence,
)}

_PLAIN = r"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '[''‘’ʼ`´]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = "len(list_filter(string_split(text, ' '), lambda w: w <> ''))"
_FILLERS = "|".join(T.FILLERS)

ORACLE_SQL = {
    "w01_j16_turn_context": """
WITH p AS (SELECT role, CASE WHEN role <> 'system' THEN last_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prev_len FROM conversations)
SELECT role, count(*) AS n, count(prev_len) AS has_prev, sum(prev_len)::BIGINT AS sum_prev_len FROM p GROUP BY role""",
    "w01_numbering": """
SELECT conv_id, turn, seq, 's' || CASE WHEN length(seq::VARCHAR) >= 4 THEN seq::VARCHAR ELSE lpad(seq::VARCHAR, 4, '0') END AS segment_id
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) AS seq FROM conversations)""",
    "w02_segment_ends": f"""
SELECT conv_id, turn, round(coalesce(greatest(turn * 10.0, lead(turn * 10.0) OVER w), turn * 10.0 + greatest(1.0, {_WORDS} * 0.4))::DOUBLE, 6) AS "end"
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""".replace("coalesce(greatest(turn * 10.0, lead(turn * 10.0) OVER w), ", "coalesce(CASE WHEN lead(turn) OVER w IS NOT NULL THEN greatest(turn * 10.0, lead(turn * 10.0) OVER w) END, "),
    "w03_backwards": """
SELECT conv_id, turn, start FROM (SELECT conv_id, turn, (turn * 7 % 5)::DOUBLE AS start, lag((turn * 7 % 5)::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE start < b""",
    "w04_context": """
SELECT conv_id, turn, concat_ws(chr(10), lag(role) OVER w, role, lead(role) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "w05_running_clock": f"""
SELECT conv_id, turn, round(coalesce(sum({_WORDS} / 150.0 * 60 + 0.6) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 4) AS start FROM conversations""",
    "w09_islands": """
WITH f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 0 ELSE 1 END AS s FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM f)
SELECT conv_id, island, min(turn) AS first_turn, count(*) AS n FROM i GROUP BY ALL""",
    "f01_normalize": f"SELECT conv_id, turn, length({_PLAIN.format('text')}) AS n, md5({_PLAIN.format('text')}) AS digest FROM conversations",
    "p11_p12_short_answers": f"""
WITH n AS (SELECT conv_id, turn, {_PLAIN.format("text")} AS t FROM conversations),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n)
SELECT conv_id, turn, len(w) BETWEEN 1 AND 5 AND regexp_matches(t, '^(?:(?:{_FILLERS}) )*(?:{"|".join(T.NEGATIONS)})(?: |$)') AS negated,
  len(w) BETWEEN 1 AND 4 AND regexp_matches(t, '^(?:(?:{_FILLERS}) )*(?:{"|".join(T.AFFIRMATIONS)})(?: |$)')
  AND len(list_filter(w, lambda x: x NOT IN ({", ".join(repr(x) for x in T.AFFIRMATION_WORDS)}))) = 0 AS affirmed FROM w""",
    "f13_redact": r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '\p{L}', 'x', 'g'), '\p{N}', '#', 'g')) AS digest FROM conversations",
    "p11_p12_sentences": f"""
WITH s AS (SELECT conv_id, turn, generate_subscripts(s, 1)::INT - 1 AS sentence, unnest(s) AS x FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '[.!?]+') AS s FROM conversations)),
n AS (SELECT conv_id, turn, sentence, {_PLAIN.format("x")} AS t FROM s),
w AS (SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n)
SELECT conv_id, turn, sentence, len(w) BETWEEN 1 AND 5 AND regexp_matches(t, '^(?:(?:{_FILLERS}) )*(?:{"|".join(T.NEGATIONS)})(?: |$)') AS negated,
  len(w) BETWEEN 1 AND 4 AND regexp_matches(t, '^(?:(?:{_FILLERS}) )*(?:{"|".join(T.AFFIRMATIONS)})(?: |$)')
  AND len(list_filter(w, lambda x: x NOT IN ({", ".join(repr(x) for x in T.AFFIRMATION_WORDS)}))) = 0 AS affirmed FROM w""",
    "f13_redact_whole": r"""
WITH r AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\p{L}', 'x', 'g'), '\p{N}', '#', 'g') AS t FROM conversations)
SELECT conv_id, turn, length(t) AS n, md5(t) AS digest FROM r""",
    "a20_text_by_role": """
SELECT conv_id, role, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, length(string_agg(text, ' ' ORDER BY turn))::BIGINT AS n FROM conversations GROUP BY conv_id, role""",
    "a22_main_speaker": """
SELECT conv_id, role, talk FROM (SELECT conv_id, role, sum(length(text))::BIGINT AS talk, row_number() OVER (PARTITION BY conv_id ORDER BY sum(length(text)) DESC, role) AS r
FROM conversations GROUP BY conv_id, role) WHERE r = 1""",
    "a10_role_summary": """
WITH o AS (SELECT role, CASE WHEN length(text) > 400 THEN 'ok' WHEN length(text) < 100 THEN 'blank' ELSE 'unsafe' END AS o, turn % 2 = 0 AS risk FROM conversations)
SELECT coalesce(role, 'all') AS role, count(*) AS checks, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'unsafe') AS unsafe, count(*) FILTER (o = 'unsafe' AND risk) AS unsafe_risk,
count(*) FILTER (o = 'blank') AS safe_blank, round(count(*) FILTER (o = 'ok') / count(*), 6) AS accuracy FROM o GROUP BY ROLLUP (role)""",
    "u01_u06_timeline_union": """
WITH u AS (SELECT conv_id, (turn * 10.0)::DOUBLE AS start, 'segment' AS kind, role FROM conversations
UNION ALL SELECT conv_id, (turn * 10.0 + 5)::DOUBLE, 'gap', NULL FROM conversations WHERE length(text) < 100)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start, kind) AS seq, start, kind, role FROM u""",
    "t14_chain": "SELECT conv_id, 2::BIGINT AS first_broken FROM conversations GROUP BY conv_id HAVING conv_id % 5 = 0 AND count(*) >= 2",
    "t15_rising_edges": """
SELECT conv_id, turn FROM (SELECT conv_id, turn, length(text) > 300 AS f, coalesce(lag(length(text) > 300) OVER (PARTITION BY conv_id ORDER BY turn), false) AS b FROM conversations) WHERE f AND NOT b""",
    "t23_silence": """
WITH s AS (SELECT *, length(text) < 300 AS silent, sum(CASE WHEN length(text) < 300 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn, round(sum(CASE WHEN silent THEN 0.05 ELSE 0 END) OVER (PARTITION BY conv_id, k ORDER BY turn)::DOUBLE, 4) AS silence FROM s""",
}
