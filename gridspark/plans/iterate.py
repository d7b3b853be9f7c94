"""Driver loops over DataFrames with their lineage cut at intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from gridspark.sources.scratch import scratch, shared_root


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the folder of :func:`shared_root`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of :func:`shared_root` and read back. Its size is then that of its files. A checkpoint keeps the
    estimate of the plan that made it; where every step joins the last ones these are multiplied, and the number of their
    digits grows exponentially with the steps."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def states(df: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, every: int = 4) -> Iterator[tuple[int, DataFrame]]:
    """(0, df), (1, step(df)), ... up to ``steps``; each ``every``-th state is checkpointed."""
    if steps < 0:
        raise ValueError("steps must not be negative")
    yield 0, df
    for i in range(1, steps + 1):
        df = step(df)
        if i % every == 0 and i < steps:
            df = cut(df)
        yield i, df


def last(df: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, every: int = 4) -> DataFrame:
    for _, df in states(df, step, steps, every):  # noqa: B020
        pass
    return df
