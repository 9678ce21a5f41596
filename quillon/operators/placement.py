"""Placing audio on a session's timeline, and the map between a stream's time and the session's.

Times are whole milliseconds, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: shorter stretches of silence aren't reported as gaps (milliseconds).
LEAST_GAP = 50


def place(pieces: DataFrame, keys: list[str], order: list[str], wanted: str, length: str) -> DataFrame:
    """Each piece begins where it is ``wanted``, but never before zero or the end of the piece before it. Adds
    ``start``, ``end``, and ``gap_from`` where more than LEAST_GAP lies between the piece before and this one.

    start = max(wanted, end of the piece before) unrolls to the running maximum of wanted less the lengths before, plus
    the lengths before: one window, no loop. A null length counts as nothing, a null ``wanted`` as the end before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = F.coalesce(F.col(length), F.lit(0))
    before = F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("__before", before).withColumn("__free", F.greatest(F.coalesce(F.col(wanted), F.lit(0)), F.lit(0)) - F.col("__before"))
    rows = rows.withColumn("start", F.max("__free").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")).withColumn("end", F.col("start") + own)
    last = F.lag("end").over(w)
    return rows.withColumn("gap_from", F.when(F.col("start") - last > LEAST_GAP, last)).drop("__before", "__free")


def piece_map(utterances: DataFrame, keys: list[str], order: list[str], start: str, length: str) -> DataFrame:
    """Where each utterance is in the stream of all of them, one after the other: keys, stream_from, stream_to,
    session_from. Utterances without a length are left out."""
    before = F.sum(length).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = utterances.filter(F.col(length) > 0).withColumn("stream_from", F.coalesce(before, F.lit(0)))
    return rows.select(*keys, "stream_from", (F.col("stream_from") + F.col(length)).alias("stream_to"), F.col(start).alias("session_from"))


def to_session_spans(spans: DataFrame, pieces: DataFrame, keys: list[str], bin_length: int = 60_000) -> DataFrame:
    """Spans (keys, span, start, end in stream time) to session time: one span for each piece that it touches, in
    stream order: keys, span, part (from 0), session_start, session_end. What lies behind the last piece is lost.

    Spans meet pieces in bins of stream time, so that a long session isn't compared with itself."""
    binned = lambda df, low, high: df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / bin_length), F.floor((F.col(high) - 1) / bin_length))))
    s = binned(spans.filter("end > start"), "start", "end")
    p = binned(pieces, "stream_from", "stream_to")
    low, high = F.greatest("start", "stream_from"), F.least("end", "stream_to")
    hits = s.join(p, [*keys, "__bin"]).withColumn("__low", low).withColumn("__high", high)
    hits = hits.filter((F.col("__low") < F.col("__high")) & (F.floor(F.col("__low") / bin_length) == F.col("__bin")))
    shift = F.col("session_from") - F.col("stream_from")
    part = F.row_number().over(Window.partitionBy(*keys, "span").orderBy("__low")) - 1
    return hits.select(*keys, "span", part.alias("part"), (F.col("__low") + shift).alias("session_start"), (F.col("__high") + shift).alias("session_end"))
