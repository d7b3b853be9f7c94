"""pass@k and the tables of a study of sampled solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIVE = "__native_reference__"


def binomial(n: Column, k: Column) -> Column:
    """n over k as a double; 0 outside 0 <= k <= n."""
    k = F.least(k, n - k).cast("int")
    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(terms, F.lit(1.0), lambda p, i: p * (n - k + i) / i))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k samples drawn from n with c right ones is right. Guards in this order: k <= 0 is 1, fewer
    than k samples or more right ones than samples is NaN, fewer than k wrong ones is 1."""
    if k <= 0:
        return F.lit(1.0)
    miss = F.lit(1.0)
    for j in range(k):
        miss = miss * ((n - c - j) / (n - j))
    nan = F.lit(float("nan"))
    return F.when(n < k, nan).when(c > n, nan).when(n - c < k, 1.0).otherwise(1.0 - miss)


def choose(rows: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Rows of the one ``wanted`` value, all of them if it is None; an error that names the choices if no row has it."""
    if wanted is None:
        return rows
    found = rows.filter(F.col(column) == wanted)
    if found.isEmpty():
        choices = rows.select(column).distinct().orderBy(column).limit(50)  # for the message alone
        raise ValueError(f"no {column} named {wanted!r}; choices: {', '.join(str(r[0]) for r in choices.collect())}")
    return found


def choose_any(rows: DataFrame, column: str, wanted: list[str] | None, known: DataFrame | None = None) -> DataFrame:
    """Rows of all ``wanted`` values, all rows if it is None. Every wanted value must be one of ``known`` (a table with that
    column; the rows themselves if it is None), whether rows have it or not; the error names those that are not, and the choices."""
    if wanted is None:
        return rows
    names = rows.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{column} string")
    there = (rows if known is None else known).select(F.col(column).cast("string").alias(column)).distinct()
    odd = [r[0] for r in names.join(there, column, "left_anti").orderBy(column).collect()]  # of the caller's own list
    if odd:
        choices = there.orderBy(column).limit(50)  # for the message alone
        raise ValueError(f"no {column} named {', '.join(map(repr, odd))}; choices: {', '.join(str(r[0]) for r in choices.collect())}")
    return rows.filter(F.col(column).cast("string").isin(list(dict.fromkeys(wanted))))


def must_match(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which must have each of their keys; the error names the first that it lacks."""
    met = rows.join(table.withColumn("_there", F.lit(True)), on, "left")
    lost = F.raise_error(F.concat(F.lit(f"unknown {on} "), F.coalesce(F.col(on).cast("string"), F.lit("NULL"))))
    return met.filter(F.coalesce("_there", lost.cast("boolean"))).drop("_there")


def pass_table(samples: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    counts = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.sum(F.col("passed").cast("long")).alias("n_correct"))
    return counts.select(*by, "n_total", "n_correct", *[pass_at_k(F.col("n_total"), F.col("n_correct"), k).alias(f"pass_at_{k}") for k in ks])


def mean_runtime(samples: DataFrame, by: list[str], passed_only: bool = True) -> DataFrame:
    rows = samples.filter("passed") if passed_only else samples
    return rows.groupBy(*by).agg(F.avg("elapsed_sec").alias("mean_elapsed_sec"), F.count(F.lit(1)).alias("n_passed"))


def native_summary(rows: DataFrame) -> DataFrame:
    """One reference result for each (task, framework): the values agree in a group."""
    return rows.groupBy("task", "framework").agg(F.min("reference_passed").alias("reference_passed"), F.min("reference_elapsed_sec").alias("reference_elapsed_sec"))


def ratio(value: Column, base: Column) -> Column:
    """value / base where base is positive and finite, else NULL."""
    return F.when((base > 0) & (base < float("inf")), value / base)


def runtime_vs_native(runtime: DataFrame, summary: DataFrame) -> DataFrame:
    joined = runtime.join(summary, ["task", "framework"], "left")
    return joined.select("task", "framework", "mean_elapsed_sec", "n_passed", "reference_passed", "reference_elapsed_sec", ratio(F.col("mean_elapsed_sec"), F.col("reference_elapsed_sec")).alias("mean_over_native"))


def with_native(samples: DataFrame, summary: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """The pass table by (task, model), and a row a task for the reference: all or none of max(ks) samples right."""
    most = max(ks)
    oracle = summary.groupBy("task").agg(F.min(F.coalesce("reference_passed", F.lit(False))).alias("ok"))
    rows = oracle.select("task", F.lit(NATIVE).alias("model"), F.lit(most).cast("long").alias("n_total"), F.when(F.col("ok"), most).otherwise(0).cast("long").alias("n_correct"))
    rows = rows.select("*", *[pass_at_k(F.col("n_total"), F.col("n_correct"), k).alias(f"pass_at_{k}") for k in ks])
    return pass_table(samples, ["task", "model"], ks).unionByName(rows, allowMissingColumns=True)


VERDICTS = ("values", "shape_and_type", "correctness", "shape_only", "scalar_expected", "scalar_finite", "correctness_block")


def verdict(check: Column, has_block: Column, ok: dict[str, Column]) -> Column:
    """Which rule decides a test case, and its outcome: the first that its kind of check matches."""
    kind = F.when((check == "correctness") & has_block, "correctness_block").otherwise(check)
    out = F.when(kind == VERDICTS[0], ok[VERDICTS[0]])
    for v in VERDICTS[1:]:
        out = out.when(kind == v, ok[v])
    return out.otherwise(F.lit(False))
