"""Exact order statistics of groups of any size, without a buffer of a large group's values anywhere.

Groups are counted first. Those of at most FITS rows are aggregated, as a buffer holds them. In the others a rank is narrowed by counted histograms. The first counts rows by sign and power of two. Of the bucket that holds the
rank its count, least and greatest value are known; the next histogram cuts what lies between these two into WIDTH equal
steps. As the values of a bucket are within a factor of two, a few passes leave one value, or at most FITS rows, which
are sorted. A pass reads two columns and shuffles counts, at most WIDTH a rank and task.

Values are doubles; NULL is left out, NaN is the greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.iterate import cut

#: Steps of a histogram, rows that one task sorts, and ranks that are sent to all tasks.
WIDTH, FITS, FEW = 4096, 1 << 15, 100_000


def _magnitude(x: Column) -> Column:
    """The sign and power of two of ``x``, ascending with it."""
    size = F.floor(F.log2(F.abs(x))) + 1100
    return (
        F.when(F.isnan(x), 9000).when(x == float("inf"), 8000).when(x == float("-inf"), -8000).when(x == 0, 0)
        .when(x > 0, size).otherwise(-size).cast("int")
    )


def _counted(rows: DataFrame, key: list[str], step: Column) -> DataFrame:
    """For each key and step its rows, least and greatest value, and the rows in the steps before."""
    found = rows.groupBy(*key, step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("step")) - F.col("n")
    return found.withColumn("before", before)


def _holding(counted: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
    """``ranks`` (group, nth, rank, on...) with the step that holds each: rank within it, n, low, high."""
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    met = ranks.join(counted, on).filter(inside)
    return cut(met.select("group", "nth", (F.col("rank") - F.col("before")).alias("rank"), "n", "low", "high"))


def _within(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (group, x) with the spans (group, low, high) that they lie in; spans are counted before they are sent to all."""
    spans = cut(spans)
    sent = F.broadcast(spans) if spans.count() <= FEW else spans
    return rows.join(sent, "group").filter("x >= low and x <= high")


def at_ranks(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(group, nth, value) for ``ranks`` (group, nth, rank from 0) among ``rows`` (group, x), x not NULL."""
    open_ = _holding(_counted(rows, ["group"], _magnitude(F.col("x"))), ranks, ["group"])
    found = None
    while True:
        # NaN equals NaN here.
        one, many = F.col("low") == F.col("high"), F.col("n") > FITS
        settled = open_.filter(one).select("group", "nth", F.col("low").alias("value"))
        found = settled if found is None else found.unionAll(settled)
        few = open_.filter(~one & ~many)
        lists = _within(rows, few.select("group", "low", "high").distinct()).groupBy("group", "low", "high").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        found = found.unionAll(few.join(lists, ["group", "low", "high"]).select("group", "nth", F.get("xs", F.col("rank").cast("int")).alias("value")))
        wide = open_.filter(~one & many)
        if wide.isEmpty():
            return found
        spans = _within(rows, wide.select("group", "low", "high").distinct()).withColumnsRenamed({"low": "from", "high": "to"})
        step = F.least(F.floor((F.col("x") - F.col("from")) / (F.col("to") - F.col("from")) * WIDTH), F.lit(WIDTH - 1))
        ranks = wide.select("group", "nth", "rank", F.col("low").alias("from"), F.col("high").alias("to"))
        open_ = _holding(_counted(spans, ["group", "from", "to"], step), ranks, ["group", "from", "to"])


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``wanted`` (name: share from 0 to 1), interpolated between the two nearest ranks; groups
    whose values are all NULL have NULL."""
    if any(not 0 <= q <= 1 for q in wanted.values()):
        raise ValueError("a quantile is between 0 and 1")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    data = rows.select(group.alias("group"), F.col(value).cast("double").alias("x"))
    sizes = cut(data.groupBy("group").agg(F.count("x").alias("total")))
    x = data.filter("x is not null")
    small, large = sizes.agg(F.count_if(F.col("total") <= FITS), F.count_if(F.col("total") > FITS)).first()
    if large == 0:
        return _aggregated(x, sizes, by, wanted)
    if small:
        some = sizes.filter(F.col("total") > FITS)
        split = F.broadcast(some.select("group")) if large <= FEW else some.select("group")
        parts = _aggregated(x.join(split, "group", "left_anti"), sizes.filter(F.col("total") <= FITS), by, wanted)
        return parts.unionByName(_selected(x.join(split, "group", "left_semi"), some, by, wanted))
    return _selected(x, sizes, by, wanted)


def _aggregated(x: DataFrame, sizes: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    found = x.groupBy("group").agg(*[F.percentile("x", q).alias(name) for name, q in wanted.items()])
    return sizes.join(found, "group", "left").select(*[F.col("group").getField(b).alias(b) for b in by], *wanted)


def _selected(x: DataFrame, sizes: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    ends = []
    for k, q in enumerate(wanted.values()):
        place = F.lit(q) * (F.col("total") - 1)
        ends += [F.struct(F.lit(2 * k).alias("nth"), F.floor(place).alias("rank")), F.struct(F.lit(2 * k + 1).alias("nth"), F.ceil(place).alias("rank"))]
    ranks = sizes.filter("total > 0").select("group", F.explode(F.array(*ends)).alias("at")).select("group", "at.*")
    got = at_ranks(x, ranks).groupBy("group").agg(*[F.max(F.when(F.col("nth") == k, F.col("value"))).alias(f"v{k}") for k in range(2 * len(wanted))])
    out = sizes.join(got, "group", "left")
    columns = []
    for k, (name, q) in enumerate(wanted.items()):
        place = F.lit(q) * (F.col("total") - 1)
        low, high = F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}")
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place))).alias(name))
    return out.select(*[F.col("group").getField(b).alias(b) for b in by], *columns)
