"""Timing statistics, runs of a log, speed-up, and small numeric helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.quantiles import quantiles
from gridspark.plans.iterate import cut


def summary(rows: DataFrame, by: list[str], value: str, population: bool = True) -> DataFrame:
    """n, mean, std, median, p95 (interpolated) and max of each group, whatever its size."""
    std = F.stddev_pop(value) if population else F.stddev_samp(value)
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), std.alias("std"), F.max(value).alias("max"))
    return with_quantiles(sums, rows, by, value, {"median": 0.5, "p95": 0.95}).select(*by, "n", "mean", "std", "median", "p95", "max")


def with_quantiles(table: DataFrame, rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``table``, which has a row for each group ``by`` of ``rows``, with the exact quantiles of ``value``."""
    found = quantiles(rows, by, value, wanted)
    if not by:
        return table.crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({b: f"_{b}" for b in by})
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return table.join(found, same).drop(*[f"_{b}" for b in by])


def speedup(timings: DataFrame) -> DataFrame:
    """(variant, threads, mean_sec, speedup, efficiency) against the same variant's mean at one thread; variants
    without one are left out."""
    means = timings.groupBy("variant", "threads").agg(F.avg("time_sec").alias("mean_sec"))
    base = means.filter("threads = 1").select("variant", F.col("mean_sec").alias("base"))
    sp = F.col("base") / F.col("mean_sec")
    return means.join(base, "variant").select("variant", "threads", "mean_sec", sp.alias("speedup"), (sp / F.col("threads")).alias("efficiency"))


def islands(log: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``log`` (seq, nthreads, ...) with ``run``, numbering the stretches of equal ``nthreads`` from 1.

    Lines are taken in chunks by ``seq``; the line before each chunk, and the runs that begin before it, come
    from a table with one row a chunk.
    """
    rows = log.withColumn("_c", F.floor(F.col("seq") / chunk))
    ends = rows.groupBy("_c").agg(F.max_by("nthreads", "seq").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.orderBy("_c")))
    inside = Window.partitionBy("_c").orderBy("seq")
    rows = rows.join(ends.select("_c", "_before"), "_c")
    turn = F.coalesce(F.coalesce(F.lag("nthreads").over(inside), F.col("_before")) != F.col("nthreads"), F.lit(True)).cast("long")
    rows = rows.withColumn("_t", turn)
    counts = rows.groupBy("_c").agg(F.sum("_t").alias("_n"))
    counts = counts.withColumn("_o", F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")).select("_c", "_o")
    return rows.withColumn("_r", F.sum("_t").over(inside)).join(counts, "_c").select(*log.columns, (F.col("_r") + F.col("_o")).alias("run"))


def drop_first(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Without the first line of each run of more than one; runs are numbered within the columns ``by``."""
    key = [*(by or []), "run"]
    heads = runs.groupBy(*key).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return runs.join(heads, key).filter("seq > _first or _n = 1").drop("_first", "_n")


def run_stats(runs: DataFrame, optional: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Lines, mean and median of each run; ``optional`` maps columns to the names of their means, which leave out NaN."""
    key = [*(by or []), "run", "nthreads"]
    runs = cut(runs.select(*key, "total_s", *(optional or {})))  # read three times, and costly where runs have just been numbered
    more = [mean_skipping_nan(c).alias(name) for c, name in (optional or {}).items()]
    sums = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("total_s").alias("mean_total"), *more)
    names = [*key, "n", "mean_total", "median_total", *(optional or {}).values()]
    return with_quantiles(sums, runs, key, "total_s", {"median_total": 0.5}).select(names)


def span_totals(edges: DataFrame, key: list[str], by: str) -> DataFrame:
    """(``by``, n_spans, seconds) of events (``key``, edge, at in ns): a span is a ``start`` and a ``finish`` of one key."""
    at = lambda edge: F.max(F.when(F.col("edge") == edge, F.col("at")))
    spans = edges.groupBy(*key).agg(at("start").alias("a"), at("finish").alias("b")).filter("a is not null and b is not null")
    return spans.groupBy(by).agg(F.count(F.lit(1)).alias("n_spans"), (F.sum(F.col("b") - F.col("a")) / 1e9).alias("seconds"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def monotonic(medians: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row ``monotonic``: no median of (nthreads, median) is over that of fewer threads by more than the
    tolerance; one row or none is monotonic. There is a row for each thread count, a few dozen."""
    w = Window.orderBy("nthreads", "median")
    pairs = medians.select("nthreads", "median", F.lead("nthreads").over(w).alias("t2"), F.lead("median").over(w).alias("m2"))
    ok = (F.col("t2") == F.col("nthreads")) | (F.col("m2") <= F.col("median") * (1 + tolerance))
    return pairs.filter("t2 is not null").agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("monotonic"))


def mean_skipping_nan(x: str) -> Column:
    """Mean of what is neither NULL nor NaN; NaN without any."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), F.col(x))), F.lit(float("nan")))


def weak_size(size: Column, threads: Column, scale: str, override: int | None = None) -> Column:
    """A grid side for weak scaling: ``override`` if it is given, else the size by a factor, halves rounded to even."""
    if override is not None:
        if override < 1:
            raise ValueError("a side is at least 1")
        return F.lit(override).cast("long")
    factor = {"sqrt": F.sqrt(threads), "linear": threads.cast("double")}.get(scale)
    return F.greatest(F.lit(1), F.rint(size * (factor if factor is not None else F.lit(float(scale)))).cast("long"))


def close(a: Column, b: Column, tol: float = 1e-3) -> Column:
    return F.abs(a - b) < tol * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


#: A linear congruential generator.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31


def lcg(n: Column, seed: Column) -> Column:
    """array<double>: the first n numbers in [0, 1) of the generator, by one fold."""
    step = lambda acc, _: F.concat(acc, F.array(F.pmod(F.element_at(acc, -1) * LCG_A + LCG_C, F.lit(LCG_M))))
    states = F.aggregate(F.sequence(F.lit(1), n), F.array(seed.cast("long")), step)
    return F.transform(F.slice(states, 2, n), lambda s: s.bitwiseAND(F.lit(0xFFFFFF)) / float(1 << 24))
