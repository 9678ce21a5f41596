"""Queries of the interval, as-of and streaming-shaped operators over ``events`` (key user_id, time ts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import forms, scoring, timeline
from quillon.storage import read_table


def _events(spark, sf):
    rows = read_table(spark, sf, "events")
    return rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def _spans(spark, sf):
    rows = _events(spark, sf)
    return rows.select("event_id", "user_id", "event_type", F.col("at").alias("start"), (F.col("at") + 600 + F.col("event_id") % 1200).alias("end"))


def w08_merge_spans(spark, sf):
    return timeline.merge_spans(_spans(spark, sf), ["user_id"], "start", "end")


def j11_missed(spark, sf):
    """Purchases without a view of the same user within half an hour before or after."""
    s = _spans(spark, sf)
    out = timeline.overlapping(s.filter("event_type = 'purchase'"), s.filter("event_type = 'view'"), ["user_id"], 7200.0, 1800.0, "left_anti")
    return out.select("event_id", "user_id")


def j12_overlapped(spark, sf):
    s = _spans(spark, sf)
    out = timeline.overlapping(s.filter("event_type = 'purchase'"), s.filter("event_type = 'view'"), ["user_id"], 7200.0, 1800.0, "left_semi")
    return out.select("event_id", "user_id")


def j15_as_of(spark, sf):
    e = _events(spark, sf)
    left = e.filter("event_type = 'purchase'").select("user_id", "at", "event_id")
    right = e.filter("event_type = 'view'").groupBy("user_id", "at").agg(F.max("event_id").alias("seen"))
    return timeline.as_of(left, right, ["user_id"], "at", ["seen"]).select("event_id", "seen")


def a05_cache_check(spark, sf):
    rows = _events(spark, sf).withColumn("prefill", F.floor(F.col("value")).cast("bigint"))
    out = scoring.cache_check(rows, ["user_id"], ["at", "event_id"], "prefill", 2)
    return out.select("user_id", "requests", "first_prefill", "total", "misses", F.round("rest_ratio", 6).alias("rest_ratio"), "pass")


def a23_erle(spark, sf):
    rows = _events(spark, sf).select("event_type", (F.col("value") + 1).alias("e_in"), (F.col("value") / 10 + 1).alias("e_out"))
    return scoring.erle(rows, ["event_type"], "e_in", "e_out").select("event_type", "frames", F.round("erle", 6).alias("erle"))


def a28_weighted_mean(spark, sf):
    rows = _events(spark, sf).withColumn("n", F.length("props"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("confidence"))


def a02_histogram(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1).alias("low"))


def t18_gapless(spark, sf):
    pieces = timeline.merge_spans(_spans(spark, sf), ["user_id"], "start", "end")
    out = timeline.gapless(pieces, ["user_id"], 86400.0)
    return out.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))


def t16_t17_retention(spark, sf):
    rows = _events(spark, sf).withColumn("retention", F.element_at(F.array(F.lit("none"), F.lit("until_confirm"), F.lit("days:7"), F.lit("days:400")), (F.col("event_id") % 4 + 1).cast("int")))
    now = F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")
    confirmed, purge_after = F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 6 == 0, F.col("ts") + F.expr("interval 30 days"))
    stage = F.when(F.col("event_id") % 5 == 0, "armed").otherwise("reviewing")
    reason = forms.purge_reason(F.col("ts"), confirmed, purge_after, stage, now, 90)
    due = reason.isNull() & forms.audio_due(F.col("ts"), confirmed, F.col("retention"), now)
    return rows.groupBy("retention", reason.alias("reason"), due.alias("audio_due")).agg(F.count("*").alias("n"))


def o10_latest_type(spark, sf):
    """The type each user has most, the least name of equals."""
    n = _events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("event_type"))


def p18_transitions(spark, sf):
    legal = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "click")]
    out = forms.illegal_transitions(_events(spark, sf), legal, ["user_id"], ["at", "event_id"], "event_type")
    return out.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (w08_merge_spans, j11_missed, j12_overlapped, j15_as_of, a05_cache_check, a23_erle, a28_weighted_mean, a02_histogram, t18_gapless, t16_t17_retention, o10_latest_type, p18_transitions)}

_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS tm FROM events), s AS (SELECT event_id, user_id, event_type, tm AS start, tm + 600 + event_id % 1200 AS \"end\" FROM e)"
_MERGED = f"""{_E}, m AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m),
spans AS (SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n_spans FROM g GROUP BY user_id, k)"""
_NEAR = "EXISTS (SELECT 1 FROM s r WHERE r.event_type = 'view' AND r.user_id = l.user_id AND r.start <= l.\"end\" + 1800 AND r.\"end\" >= l.start - 1800)"

ORACLE_SQL = {
    "w08_merge_spans": f'WITH {_MERGED} SELECT user_id, start, "end", n_spans FROM spans',
    "j11_missed": f"WITH {_E} SELECT event_id, user_id FROM s l WHERE event_type = 'purchase' AND NOT {_NEAR}",
    "j12_overlapped": f"WITH {_E} SELECT event_id, user_id FROM s l WHERE event_type = 'purchase' AND {_NEAR}",
    "j15_as_of": f"""WITH {_E}, r AS (SELECT user_id, tm, max(event_id) AS seen FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, r.seen FROM (SELECT * FROM e WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.tm >= r.tm""",
    "a05_cache_check": """WITH p AS (SELECT user_id, floor(value)::BIGINT AS p, row_number() OVER w AS rn, first_value(floor(value)::BIGINT) OVER w AS f FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS requests, min(f) AS first_prefill, sum(p)::BIGINT AS total, count(*) FILTER (rn > 2 AND p > 0.5 * f) AS misses,
CASE WHEN count(*) > 1 AND min(f) > 0 THEN round((sum(p) - min(f)) / (min(f) * (count(*) - 1)), 6) END AS rest_ratio, count(*) FILTER (rn > 2 AND p > 0.5 * f) = 0 AS pass FROM p GROUP BY user_id""",
    "a23_erle": "SELECT event_type, count(*) AS frames, CASE WHEN count(*) > 50 THEN round(10 * log10(sum(value + 1) / sum(value / 10 + 1)), 6) END AS erle FROM events GROUP BY event_type",
    "a28_weighted_mean": "SELECT user_id, round(sum(value * length(props)) / sum(length(props)), 6) AS confidence FROM events GROUP BY user_id",
    "a02_histogram": "SELECT event_type, count(*) AS n, count(*) FILTER (value < 1) AS low FROM events GROUP BY event_type",
    "t18_gapless": f"""WITH {_MERGED}, g2 AS (SELECT user_id, "end", lead(start) OVER (PARTITION BY user_id ORDER BY start) AS following FROM spans)
SELECT user_id, 'sound' AS kind, count(*) AS n, round(sum("end" - start), 3) AS seconds FROM spans GROUP BY user_id
UNION ALL SELECT user_id, 'silence', sum(ceil((following - "end") / 86400.0))::BIGINT, round(sum(following - "end"), 3) FROM g2 WHERE following > "end" GROUP BY user_id""",
    "t16_t17_retention": """WITH r AS (SELECT *, ['none', 'until_confirm', 'days:7', 'days:400'][event_id % 4 + 1] AS retention, TIMESTAMP '2024-06-30' AS now FROM events),
p AS (SELECT *, CASE WHEN event_id % 6 = 0 AND ts + INTERVAL 30 DAY <= now THEN 'retention' WHEN event_id % 5 = 0 AND event_id % 3 <> 0 AND ts < now - INTERVAL 1 HOUR THEN 'never_started'
WHEN event_id % 3 <> 0 AND ts + INTERVAL 90 DAY <= now THEN 'unreviewed' END AS reason FROM r)
SELECT retention, reason, reason IS NULL AND CASE WHEN retention = 'until_confirm' THEN event_id % 3 = 0
WHEN retention LIKE 'days:%' THEN ts::DATE + split_part(retention, ':', 2)::INT <= now::DATE ELSE false END AS audio_due, count(*) AS n FROM p GROUP BY ALL""",
    "o10_latest_type": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1",
    "p18_transitions": """SELECT from_state, to_state, count(*) AS n FROM (SELECT event_type AS to_state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('click', 'click')) GROUP BY ALL""",
}
