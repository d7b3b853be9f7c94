"""Order over a whole table without one task that holds it.

:func:`ranked` orders by any keys: range partitions of whole keys, each sorted, and one row a partition that says how
many rows come before it.

:func:`bounds` and :func:`bucket` deal a table by one integer column, for operators that need to know the borders. Quantiles cut the key's range into at most CUTS parts, and equal steps cut each of these into at most STEPS
buckets where the table is large, so a million buckets share its rows, and what is known of buckets stays small
at any input size. Rows of one key are in one bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.iterate import cut

#: Most quantiles of a table, and most buckets between two of them.
CUTS, STEPS = 16_384, 64
FANOUT = 128


@dataclass(frozen=True)
class Cuts:
    """Ascending distinct values; a part of the range is between two of them, below the first or from the last on."""

    values: list[int] = field(default_factory=list)
    steps: int = 1


def bounds(df: DataFrame, key: str, rows_each: int, most: int = CUTS) -> Cuts:
    """What cuts the integer column ``key`` into buckets of about ``rows_each`` rows."""
    wanted = df.count() // rows_each + 1
    parts = min(most, wanted)
    if parts < 2:
        return Cuts()
    at = [i / parts for i in range(1, parts)]
    if wanted > parts:  # the ends too, so that every row has a step between two values
        at = [0.0, *at, 1.0]
    found = df.select(F.percentile_approx(key, at, max(10_000, 8 * parts))).first()[0]
    return Cuts(sorted(set(found or [])), min(STEPS, -(-wanted // parts)))


def bucket(key: str, cuts: Cuts) -> Column:
    """The number of the bucket of ``key`` (null: the first), ascending with it."""
    values, x = cuts.values, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    if not values:
        return F.lit(0)
    literal = lambda vs: F.split(F.lit(",".join(map(str, vs))), ",").cast("array<bigint>")  # noqa: E731  # one literal, folded by the optimizer
    fine = literal(values)
    if len(values) <= FANOUT:
        part = F.size(F.filter(fine, lambda c: c <= x))
    else:  # found in two steps
        block = F.size(F.filter(literal(values[::FANOUT]), lambda c: c <= x))
        inside = F.filter(F.slice(fine, (block - 1) * FANOUT + 1, FANOUT), lambda c: c <= x)
        part = F.when(block == 0, 0).otherwise((block - 1) * FANOUT + F.size(inside))
    if cuts.steps == 1:
        return part
    low, high = F.get(fine, part - 1).cast("double"), F.get(fine, part).cast("double")
    step = F.floor((x.cast("double") - low) / (high - low) * cuts.steps).cast("int")
    return part * cuts.steps + F.coalesce(F.greatest(F.lit(0), F.least(step, F.lit(cuts.steps - 1))), F.lit(0))


def numbered(df: DataFrame, name: str = "rank") -> DataFrame:
    """``df``, whose partitions follow each other and are in order inside, with the row number from 1 over all of them.

    It is computed once, into a checkpoint. What comes before each partition is one row a partition.
    """
    at = cut(df.withColumn("_at", F.monotonically_increasing_id()))  # the partition's number above 33 bits of the row's
    rows = at.withColumn("_part", F.shiftright("_at", 33))
    size = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within + 1).drop("_part", "_at", "_before")


def in_order(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """``df`` in partitions that follow each other in the order of ``keys`` and are sorted inside.

    Keys are columns of any types, leading texts too, by name (ascending, null first) or as ``F.col("x").desc()``. Spark
    samples whole keys for the borders. Rows equal in all keys stay in the order in which they were read, and
    as their places are part of the key, however many there are they are spread over partitions.
    """
    order = [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in keys]
    read = df.withColumn("_read", F.monotonically_increasing_id())
    return read.repartitionByRange(*order, F.col("_read")).sortWithinPartitions(*order, "_read").drop("_read")


def ranked(df: DataFrame, keys: list[str | Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank``: the row number from 1 in the order of ``keys`` (see :func:`in_order`), within each group of columns
    ``by``. Groups are ranked as parts of one order over the whole table, so a large one takes many tasks."""
    by = by or []
    rows = numbered(in_order(df, [*by, *keys]))
    if not by:
        return rows
    first = rows.groupBy(*by).agg(F.min("rank").alias("_first")).select(*[F.col(b).alias(f"_{b}") for b in by], "_first")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return rows.join(first, same).withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first", *[f"_{b}" for b in by])
