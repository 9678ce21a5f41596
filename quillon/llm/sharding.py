"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group. Groups, largest first, enter the bin with the tightest remaining capacity that still
holds them; bins are kept in a balanced tree by remaining capacity. Groups of one size are interchangeable, so what is
packed is the histogram of their sizes: runs of equal sizes go to bins, and each group takes its place by its rank among
the groups of its size. Every group is packed with its own size. There are at most sqrt(2 * bytes) different sizes,
however many groups; sizes that many groups have are split by a hash, so that ranks aren't counted in one task.

``capacity=`` opens bins of a fixed capacity as needed and so minimises their number; groups are dealt to
parts of about ``PART_BINS`` bins by their hash, each of which is packed by a task of its own. ``shards=``
fits a fixed number of bins: capacities are tried from an even share upward, in steps that double, until
best-fit-decreasing needs no more bins than that, which makes the bins' sizes nearly equal. A group larger than an even
share gets a bin of its own and the others share the rest. Only a sum reaches the driver.

Size of a row: UTF-8 bytes of the text plus 1; a null text counts no bytes and is in one group with empty
texts. Null ids stay null. Repeated rows are rows of their own in the same group. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.storage import materialize, read_table, release

#: Bins that are packed together, and groups of one size whose ranks are counted together, about.
PART_BINS, RANKED = 64, 20_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, take and best fit in logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # node: [key, priority, left, right]

    @staticmethod
    def _split(node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = CapacityTree._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = CapacityTree._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    @staticmethod
    def _merge(low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], CapacityTree._merge(low[3], high)]
        return [high[0], high[1], CapacityTree._merge(low, high[2]), high[3]]

    def insert(self, capacity: int, bin_no: int) -> None:
        key = (capacity, bin_no)
        priority = hashlib.blake2b(repr(key).encode(), digest_size=8).digest()
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, priority, None, None]), high)

    def take_best_fit(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest (capacity, bin) with capacity >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, rest)
        return key


def pack_fixed(cells: list[tuple[int, int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int, int]] | None:
    """Best-fit-decreasing of cells (size, salt, count). Returns runs (size, salt, first, last, bin), ranks
    from 0; None once more than ``most`` bins are needed. A size above ``capacity`` gets a bin alone."""
    tree, runs, opened = CapacityTree(), [], 0
    for size, salt, count in sorted(cells, key=lambda c: (-c[0], c[1])):
        done = 0
        while done < count:
            found = tree.take_best_fit(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            left, bin_no = found
            # the tightest bin stays the tightest until the next of the same size no longer fits
            n = min(count - done, left // size)
            runs.append((size, salt, done, done + n - 1, bin_no))
            tree.insert(left - n * size, bin_no)
            done += n
    return runs


def pack_into(cells: list[tuple[int, int, int]], bins: int) -> list[tuple[int, int, int, int, int]]:
    """As ``pack_fixed``, into at most ``bins`` bins of nearly equal sizes."""
    left = sorted(cells, key=lambda c: (-c[0], c[1]))
    runs, used = [], 0
    total = sum(s * n for s, _, n in left)
    while left and bins - used > 1 and left[0][0] * (bins - used) > total:
        size, salt, count = left[0]
        n_before = sum(r[3] - r[2] + 1 for r in runs if r[:2] == (size, salt))
        runs.append((size, salt, n_before, n_before, used))
        left[0:1] = [(size, salt, count - 1)] if count > 1 else []
        used, total = used + 1, total - size
    if not left:
        return runs
    skip = {}
    for size, salt, _, last, _ in runs:
        skip[size, salt] = last + 1
    rest, step = bins - used, 1
    capacity = max(left[0][0], -(-total // rest))
    while (found := pack_fixed(left, capacity, rest)) is None:
        capacity, step = capacity + step, 2 * step
    for size, salt, first, last, bin_no in found:
        n = skip.get((size, salt), 0)
        runs.append((size, salt, first + n, last + n, bin_no + used))
    return runs


def assign(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot (from 0 in each shard, no gaps).
    Give either the number of ``shards`` or the ``capacity`` of each in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("h"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("group_size")), "shard-groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    bins = shards or -(-total // capacity) or 1
    parts = 1 if shards else -(-bins // PART_BINS)
    part = F.pmod(F.xxhash64("h"), F.lit(parts)).cast("bigint")
    groups = groups.withColumn("part", part)
    # a size that many groups have gets several salts, whose ranks are counted apart
    often = groups.groupBy("part", "group_size").agg(F.count("*").alias("n")).select("part", "group_size", (F.expr(f"n div {RANKED}") + 1).alias("salts"))
    groups = groups.join(often, ["part", "group_size"]).withColumn("salt", F.pmod(F.xxhash64("h", F.lit("salt")), F.col("salts")))
    rank = F.row_number().over(Window.partitionBy("part", "group_size", "salt").orderBy("h")) - 1
    groups = materialize(groups.select("h", "part", "group_size", "salt", rank.alias("rank")), "shard-ranks")

    def pack(table):
        cells = list(zip(*(table.column(c).to_pylist() for c in ("group_size", "salt", "n")), strict=True))
        runs = list(zip(*(pack_into(cells, shards) if shards else pack_fixed(cells, capacity)), strict=True))
        names = ("group_size", "salt", "first", "last", "bin")
        return pa.Table.from_pydict({"part": pa.array([table.column("part")[0].as_py()] * len(runs[0]), pa.int64())} | {c: pa.array(x, pa.int64()) for c, x in zip(names, runs, strict=True)})

    cells = groups.groupBy("part", "group_size", "salt").agg(F.count("*").alias("n"))
    packed = materialize(cells.groupBy("part").applyInArrow(pack, "part bigint, group_size bigint, salt bigint, first bigint, last bigint, bin bigint"), "shard-runs")
    # one row for each part: the bins of the parts before it
    used = packed.groupBy("part").agg((F.max("bin") + 1).alias("n"))
    used = used.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    bin_of = packed.join(used, "part").select("part", "group_size", "salt", "first", "last", (F.col("before") + F.col("bin")).cast("int").alias("shard"))
    in_bins = groups.join(bin_of, ["part", "group_size", "salt"]).filter(F.col("rank").between(F.col("first"), F.col("last")))
    placed = materialize(rows.join(in_bins.select("h", "shard"), "h"), "shard-placed")
    release(groups, packed, rows)
    # slots: a running number inside small blocks of a shard, from the sum of the blocks before
    blocks = max(64, placed.count() // 100_000)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    sums = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("shard", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h"))
    numbered = placed.withColumn("inside", inside).join(sums, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))


def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = assign(docs, shards=16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
