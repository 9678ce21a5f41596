"""Operators over timed, speaker-labelled segments. ``session`` columns are lists of column names."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from quillon.functions.text import segment_id, word_error_rate


def number_segments(df: DataFrame, session: list[str], order: list) -> DataFrame:
    """``seq`` and ``segment_id`` in merged time order."""
    seq = F.row_number().over(Window.partitionBy(*session).orderBy(*order))
    return df.withColumn("seq", seq.cast("bigint")).withColumn("segment_id", segment_id(F.col("seq")))


def segment_ends(df: DataFrame, session: list[str], order: list, start: str, text: str) -> DataFrame:
    """A segment ends where the next starts; the last is estimated from its words."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    following = F.lead(start).over(Window.partitionBy(*session).orderBy(*order))
    estimated = F.col(start) + F.greatest(F.lit(1.0), words * 0.4)
    return df.withColumn("end", F.when(following.isNull(), estimated).otherwise(F.greatest(F.col(start), following)))


def backwards(df: DataFrame, session: list[str], order: list, start: str) -> DataFrame:
    """The rows whose start lies before the start of the row before."""
    before = F.lag(start).over(Window.partitionBy(*session).orderBy(*order))
    return df.withColumn("__before", before).filter(F.col(start) < F.col("__before")).drop("__before")


def context_windows(df: DataFrame, session: list[str], order: list, text: str, reach: int = 1) -> DataFrame:
    """Each line with its neighbours."""
    lines = F.collect_list(text).over(Window.partitionBy(*session).orderBy(*order).rowsBetween(-reach, reach))
    return df.withColumn("context", F.array_join(lines, "\n"))


def preceding(df: DataFrame, session: list[str], order: list, when: Column, value: Column, name: str) -> DataFrame:
    """``value`` of the nearest row before for which ``when`` holds."""
    before = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(when, value), ignorenulls=True).over(before))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its keys with right.at <= left.at. Both sides are put in
    one order and filled forward, so each key is sorted once and no range of pairs is made."""
    right_side = right.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.struct(*values).alias("__value"))
    names = [c for c in left.columns if c not in keys]
    left_side = left.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"))
    both = left_side.unionByName(right_side, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__found", F.last("__value", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in names], *[F.col(f"__found.{v}").alias(v) for v in values])


def to_session_time(points: DataFrame, pieces: DataFrame, keys: list[str], t: str) -> DataFrame:
    """J15 for stream times: pieces (keys, stream, session, length); past a piece's length time stands still."""
    right = pieces.withColumnRenamed("stream", t)
    right = right.withColumn("__stream", F.col(t))
    out = as_of(points, right, keys, t, ["__stream", "session", "length"])
    mapped = F.col("session") + F.least(F.col(t) - F.col("__stream"), F.col("length"))
    return out.withColumn("session_time", F.coalesce(mapped, F.col(t))).drop("__stream", "session", "length")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 1.0) -> DataFrame:
    """Spans that touch (at most ``gap`` apart) become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    marked = marked.withColumn("__span", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__span").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("__span")


def islands(df: DataFrame, keys: list[str], order: list, same: list[str]) -> DataFrame:
    """``island`` numbers stretches of neighbouring rows with equal ``same`` columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    df = df.withColumn("__new", F.when(first | changed, 1).otherwise(0))
    return df.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def running_clock(df: DataFrame, keys: list[str], order: list, text: str, wpm: float, gap: float, given: str | None = None) -> DataFrame:
    """Start times from word counts; a given start sets the clock anew."""
    w = Window.partitionBy(*keys).orderBy(*order)
    words = F.size(F.filter(F.split(text, " "), lambda x: x != ""))
    df = df.withColumn("__length", words / wpm * 60 + gap)
    given_col = F.col(given) if given else F.lit(None).cast("double")
    df = df.withColumn("__island", F.count(given_col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "__island").orderBy(*order)
    base = F.coalesce(F.first(given_col).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    before = F.coalesce(F.sum("__length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("start", base + before).drop("__length", "__island")


def _with_buckets(df: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    first, last = F.floor(low / width), F.floor(high / width)
    return df.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def _with_row_ids(df: DataFrame) -> DataFrame:
    """``__id`` from the row's own values, which stay the same if a task runs again; equal rows share it, and their fate."""
    return df.withColumn("__id", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float, slack: float = 0.0, how: str = "left_semi", extra: Column | None = None) -> DataFrame:
    """Left rows (start, end) with (left_semi) or without (left_anti) a right row of their keys that
    overlaps within ``slack``. Time is cut into buckets, so the join is by equal keys; each left row meets
    the rows of its own buckets only. ``extra`` may refer to ``l`` and ``r``."""
    left = _with_row_ids(left)
    l_side = _with_buckets(left, F.col("start") - slack, F.col("end") + slack, width).alias("l")
    r_side = _with_buckets(right, F.col("start"), F.col("end"), width).alias("r")
    on = F.col("l.__bucket") == F.col("r.__bucket")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    on = on & (F.col("r.start") <= F.col("l.end") + slack) & (F.col("r.end") >= F.col("l.start") - slack)
    if extra is not None:
        on = on & extra
    hits = l_side.join(r_side, on, "left_semi").select("__id").distinct()
    return left.join(hits, "__id", how).drop("__id")


def without_bleed(segments: DataFrame, keys: list[str], worker: str, client: str, width: float = 60.0) -> DataFrame:
    """Drops worker segments that overlap a client segment for half their length and say nearly the same."""
    s = _with_row_ids(segments)
    w = _with_buckets(s.filter(F.col("speaker") == worker), F.col("start"), F.col("end"), width).alias("w")
    c = _with_buckets(s.filter(F.col("speaker") == client), F.col("start"), F.col("end"), width).alias("c")
    on = F.col("w.__bucket") == F.col("c.__bucket")
    for k in keys:
        on = on & (F.col(f"w.{k}") == F.col(f"c.{k}"))
    shared = F.least(F.col("w.end"), F.col("c.end")) - F.greatest(F.col("w.start"), F.col("c.start"))
    long_enough = shared / F.greatest(F.col("w.end") - F.col("w.start"), F.lit(0.01)) >= 0.5
    pairs = w.join(c, on & long_enough).select(F.col("w.__id").alias("__id"), F.col("c.__id").alias("__c"), F.col("c.text").alias("reference"), F.col("w.text").alias("hypothesis"))
    echoed = pairs.dropDuplicates(["__id", "__c"]).withColumn("wer", word_error_rate("reference", "hypothesis")).filter("wer <= 0.25")
    return s.join(echoed.select("__id").distinct(), "__id", "left_anti").drop("__id")


def gapless(df: DataFrame, keys: list[str], longest: float = 1.0) -> DataFrame:
    """(start, end) pieces plus the silences between them, none longer than ``longest``."""
    w = Window.partitionBy(*keys).orderBy("start")
    rows = df.select(*keys, "start", "end").withColumn("following", F.lead("start").over(w))
    gaps = rows.filter("following > end").withColumn("n", F.ceil((F.col("following") - F.col("end")) / longest).cast("int"))
    gaps = gaps.select(*keys, "end", "following", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("__k"))
    silence = gaps.select(*keys, (F.col("end") + F.col("__k") * longest).alias("start"), F.least(F.col("end") + (F.col("__k") + 1) * longest, F.col("following")).alias("end"), F.lit("silence").alias("kind"))
    return df.select(*keys, "start", "end", F.lit("sound").alias("kind")).unionByName(silence)


def rising_edges(df: DataFrame, keys: list[str], order: list, flag: str) -> DataFrame:
    """Rows where ``flag`` becomes true."""
    before = F.lag(flag).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__before", F.coalesce(before, F.lit(False))).filter(F.col(flag) & ~F.col("__before")).drop("__before")


def silence_so_far(df: DataFrame, keys: list[str], order: list, silent: str, step: float = 0.05) -> DataFrame:
    """Seconds of silence up to each row; any sound sets them to 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__sounds", F.sum(F.when(F.col(silent), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(*keys, "__sounds").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("silence", F.sum(F.when(F.col(silent), step).otherwise(0.0)).over(inside)).drop("__sounds")


def chain_digest(*columns: str) -> Column:
    """Digest of an entry and the digest before it."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def append_chain(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Adds seq, prev and hash. Keys are dealt to partitions, sorted, and read row by row: of a key, only the last
    digest is kept."""
    entry = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    names = list(dict.fromkeys([*keys, *order, *fields]))
    rows = df.select(*names, entry.alias("__entry")).repartition(*keys).sortWithinPartitions(*keys, *order, "__entry")
    schema = StructType([f for f in rows.schema.fields if f.name != "__entry"]).add("seq", LongType()).add("prev", StringType()).add("hash", StringType())

    def run(batches):
        last, seq, digest = None, 0, ""
        for batch in batches:
            columns = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            numbers, before, after = [], [], []
            for key, text in zip(columns, batch.column("__entry").to_pylist(), strict=True):
                if key != last:
                    last, seq, digest = key, 0, ""
                seq += 1
                before.append(digest)
                digest = hashlib.sha256(f"{text}|{digest}".encode()).hexdigest()
                numbers.append(seq)
                after.append(digest)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(numbers, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*names, "seq", "prev", "hash"])

    return rows.mapInArrow(run, schema)


def broken_chains(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For each key the first seq that doesn't follow from the row before; keys in order aren't listed."""
    w = Window.partitionBy(*keys).orderBy("seq")
    entry = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    wrong = (F.col("seq") != F.row_number().over(w)) | (F.col("prev") != F.coalesce(F.lag("hash").over(w), F.lit(""))) | (F.col("hash") != F.sha2(F.concat_ws("|", entry, F.col("prev")), 256))
    return df.withColumn("__wrong", wrong).filter("__wrong").groupBy(*keys).agg(F.min("seq").alias("first_broken"))
