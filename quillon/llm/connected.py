"""Connected components by large-star and small-star rounds over edge tables.

A round is one plan and one table; the table of the round before is removed. Null ends link nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node (larger ones, or the smaller ones and itself) to its least neighbour."""
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("x")).select("n", F.least("n", "x").alias("x"))
    joined = both.join(least, "n")
    if large:
        out = joined.filter("m > n").select(F.col("m").alias("v"), F.col("x").alias("u"))
    else:
        out = joined.select(F.col("m").alias("v"), F.col("x").alias("u")).unionByName(least.select(F.col("n").alias("v"), F.col("x").alias("u")))
    return out.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (u, v) of any order to (node, component), component being the least node that can be
    reached; nodes without links aren't listed. Both columns are long. Only sums reach the driver."""
    now = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now, seen = materialize(now, "cc"), None
    for _ in range(most_rounds):
        before, now = now, materialize(_star(_star(now, True), False).distinct(), "cc")
        release(before)
        # the edge set is stable once two rounds have the same count and checksum
        print_ = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if print_ == seen:
            break
        seen = print_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
