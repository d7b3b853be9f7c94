"""Logs that grow while they are read: totals, and the runs of each log, brought up to date from the new files alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.functions import stats
from gridspark.sources.files import timing_lines
from gridspark.streaming import commits

TOTALS = "nthreads long, n long, mean_total_s double, max_total_s double, mean_dp_s double, mean_dp_frac double"
LINES = "log string, seq long, nthreads long, total_s double, dp_s double, dp_frac double, run long"
#: What is kept of each log between batches: its last line, and the run that this is in.
OPEN = "seq long, nthreads long, run long"


def timings(spark: SparkSession, path: str, marker: str = "timings", files_each: int = 1000) -> DataFrame:
    """A stream of the timing lines (value, nthreads, total_s, dp_s, dp_frac) of the files in ``path``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(path)
    return timing_lines(lines.withColumn("line", F.col("value")), marker)


def totals(rows: DataFrame) -> DataFrame:
    """(nthreads, n, mean_total_s, max_total_s, mean_dp_s, mean_dp_frac); a running state of one row a thread count. Means leave
    out NaN, and are NaN where there is nothing else."""
    nan = F.lit(float("nan"))
    mean = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), nan).alias(f"mean_{c}")
    return rows.groupBy("nthreads").agg(F.count(F.lit(1)).alias("n"), F.avg("total_s").alias("mean_total_s"), F.max("total_s").alias("max_total_s"), mean("dp_s"), mean("dp_frac"))


def update_summary(spark: SparkSession, log: str, out: str, checkpoint: str, marker: str = "timings") -> DataFrame:
    """Read what has come to ``log`` since the last run with this ``checkpoint``, and bring the totals at ``out`` up to date: each
    batch commits them whole, and the last committed ones count."""
    stream = totals(timings(spark, log, marker)).writeStream.outputMode("complete")
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commits.writer(out)).start().awaitTermination()
    return commits.latest(spark, out, TOTALS)


def _numbered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new lines of one log with their runs; goes on from the last line of the batch before."""
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    last, nthreads, run = state.get if state.exists else (None, None, 0)
    if last is not None and int(rows["seq"].iloc[0]) <= last:
        raise ValueError(f"line {rows['seq'].iloc[0]} of log {key[0]} came after line {last}")
    before = rows["nthreads"].shift(1)
    before.iloc[0] = float("nan") if nthreads is None else nthreads
    rows["run"] = run + (rows["nthreads"] != before).cumsum()
    state.update((int(rows["seq"].iloc[-1]), int(rows["nthreads"].iloc[-1]), int(rows["run"].iloc[-1])))
    yield rows


def numbered_runs(lines: DataFrame) -> DataFrame:
    """A stream of lines (log, seq, nthreads, total_s, dp_s, dp_frac) with ``run``: within each log, the number from 1 of the
    stretch of equal ``nthreads``. The state is three numbers a log; what a task holds is one log's lines of one batch, which the
    stream's files at a time bound. A log's lines come in the order of ``seq``, batch by batch; one that comes late is an error."""
    typed = lines.select("log", "seq", "nthreads", "total_s", "dp_s", "dp_frac")
    return typed.groupBy("log").applyInPandasWithState(_numbered, LINES, OPEN, "append", GroupStateTimeout.NoTimeout)


def update_runs(spark: SparkSession, log: str, out: str, checkpoint: str, marker: str = "timings", files_each: int = 1000) -> DataFrame:
    """Read what has come to ``log`` since the last run with this ``checkpoint``; all lines so far, in LINES. ``log`` and ``seq`` are
    fields of the lines."""
    found = timings(spark, log, marker, files_each)
    lines = found.withColumns({"log": F.coalesce(F.get_json_object("line", "$.data.log"), F.lit("")), "seq": F.get_json_object("line", "$.data.seq").cast("long")})
    stream = numbered_runs(lines).writeStream.outputMode("append")
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commits.writer(out)).start().awaitTermination()
    return commits.committed(spark, out, LINES)


def run_table(lines: DataFrame) -> DataFrame:
    """Statistics of each run of each log, without the first line of runs of more than one."""
    return stats.run_stats(stats.drop_first(lines, by=["log"]), {"dp_s": "mean_dp", "dp_frac": "mean_frac"}, by=["log"])
