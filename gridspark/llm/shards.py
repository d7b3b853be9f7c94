"""Shards of near-equal bytes: the minimax contiguous partition of ordered groups.

Groups (rows of equal text) stay whole and keep their order, that of their least doc_id. The least
capacity with which filling shards greedily needs no more than ``shards`` of them is found by
binary search; the cuts of that filling are the shards.

The running totals of the groups are a distributed table. The driver sees a bounded summary of it:
group ends at block granularity. A search over the summary tells a capacity that certainly works
from one that certainly fails; the few blocks in which they differ are opened by one further
aggregation, until the answer is exact and the cuts are group ends. Each level opens a block
256 times finer, so the number of jobs grows with the logarithm of the bytes.

Cases: a null text has no bytes, size 1, and is in the group of the empty text; a null id comes
first; repeated rows are rows of their own; groups larger than an even share make the capacity;
shards beyond the last group stay empty; an empty table gives an empty table; other input columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.order import bounds, bucket
from .storage import discard, materialize

BLOCKS, FINER, ROWS_EACH = 4096, 256, 2000


class _Ends:
    """Known group ends in order, and how many groups end after the one before up to each."""

    def __init__(self, total: int, groups: int) -> None:
        self.end, self.count = [0, total], [0, groups]

    def refine(self, rows: list[tuple[int, int]]) -> None:
        """``rows``: (last end, groups) of finer blocks, covering whole blocks."""
        known = dict(zip(self.end, self.count, strict=True)) | dict(rows)
        self.end = sorted(known)
        self.count = [known[e] for e in self.end]

    def open_at(self, target: int) -> int | None:
        """Index of the block that hides the greatest end at or under ``target``; None where that end is known."""
        i = bisect_right(self.end, target)
        return i if i < len(self.end) and self.count[i] > 1 and target > self.end[i - 1] else None

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], set[int]]:
        """Ends of the shards, and the blocks that hide where they truly are. ``hopeful``: as if groups ended
        wherever a block could hide one; else at known ends only."""
        at, cuts, hidden = 0, [], set()
        for _ in range(shards):
            target = at + capacity
            if (i := self.open_at(target)) is not None:
                hidden.add(i)
            at = min(target, self.end[i] - 1) if hopeful and i is not None else self.end[bisect_right(self.end, target) - 1]
            cuts.append(at)
        return cuts, hidden


def _least(works, low: int, high: int) -> int:
    """The least capacity in (low, high] for which ``works``; it does for high."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if works(mid) else (mid, high)
    return high


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """The ends (running totals) at which to cut. ``groups``: long ``size`` and its running total ``end``, distinct."""
    total, largest, n = groups.agg(F.max("end"), F.max("size"), F.count(F.lit(1))).first()
    if not n:
        return []
    ends, finer = _Ends(total, n), BLOCKS
    floor = max(-(-total // shards), largest)
    while True:
        works = lambda c, hopeful: ends.fill(c, shards, hopeful)[0][-1] >= total
        high = _least(lambda c: works(c, False), floor - 1, total)
        low = _least(lambda c: works(c, True), floor - 1, high)
        cuts, hidden = ends.fill(high, shards, False)
        if low < high:
            hidden |= ends.fill(low, shards, True)[1] | ends.fill(low, shards, False)[1] | ends.fill((low + high) // 2, shards, False)[1]
        if not hidden:
            return [c for c in dict.fromkeys(cuts) if c < total]
        ranges = [(ends.end[i - 1], ends.end[i]) for i in sorted(hidden)]
        inside = key = None
        for k, (a, b) in enumerate(ranges):
            here = (F.col("end") > a) & (F.col("end") <= b)
            step = max(1, -(-(b - a) // finer))
            part = F.lit(k * BLOCKS) + F.floor((F.col("end") - a - 1) / step)
            inside = here if inside is None else inside | here
            key = F.when(here, part) if key is None else key.when(here, part)
        rows = groups.filter(inside).groupBy(key.alias("k")).agg(F.max("end"), F.count(F.lit(1))).collect()
        ends.refine([(r[1], r[2]) for r in rows])
        finer = FINER


def running_totals(groups: DataFrame, key: str, tie: str, size: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """``groups`` with ``end``: the sum of ``size`` up to and with each row in the order of (key, tie)."""
    cuts = bounds(groups, key, rows_each)
    rows = groups.withColumn("_b", bucket(key, cuts))
    # One row a bucket; Spark sends it to all tasks if the table that it is written to is small enough for that.
    before = rows.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_o", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).select("_b", "_o")
    before = materialize(before, "before")
    inside = F.sum(size).over(Window.partitionBy("_b").orderBy(F.col(key).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", inside).join(before, "_b").withColumn("end", F.col("end") + F.col("_o")).drop("_b", "_o")


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_each: int = ROWS_EACH) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; slots count from 0 in each shard by doc_id."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("digest"),
        ),
        "sizes",
    )
    grouped = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))
    groups = materialize(running_totals(materialize(grouped, "groups"), "first", "digest", "size", rows_each), "totals")
    cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("end") > c).cast("int")
    placed = rows.join(groups.select("digest", shard.alias("shard")), "digest").withColumn("_b", bucket("doc_id", bounds(rows, "doc_id", rows_each)))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "digest", "shard", "_b"), "placed")
    # One row a shard and bucket, joined as Spark sees fit.
    before = placed.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).select("shard", "_b", "_o")
    before = materialize(before, "slots")
    slot = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(F.col("doc_id").asc_nulls_first(), "digest")) - 1
    out = placed.withColumn("slot", slot).join(before, ["shard", "_b"])
    discard(rows)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("slot") + F.col("_o")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
