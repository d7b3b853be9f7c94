"""Matrices as entries (i, j, v) and as tiles (ti, tj, data)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.iterate import written

TILE = "ti int, tj int, data array<double>"


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A x B over entries, for sparse or narrow matrices: products are summed before the shuffle."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def transpose_add(a: DataFrame) -> DataFrame:
    """A + A' for a square A: one grouping, no join."""
    return a.select("i", "j", "v").unionByName(transpose(a)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def to_tiles(a: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """Dense tiles of ``size`` x ``size`` in row order; those at the far edges may be smaller, absent entries are 0."""
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        data = np.zeros((min(size, rows - ti * size), min(size, cols - tj * size)))
        data[pdf["i"].to_numpy() - ti * size, pdf["j"].to_numpy() - tj * size] = pdf["v"].to_numpy()
        return pd.DataFrame({"ti": [ti], "tj": [tj], "data": [data.ravel()]})

    keyed = a.select(F.floor(F.col("i") / size).cast("int").alias("ti"), F.floor(F.col("j") / size).cast("int").alias("tj"), "i", "j", "v")
    return keyed.groupBy("ti", "tj").applyInPandas(fill, TILE)


def from_tiles(tiles: DataFrame, cols: int, size: int) -> DataFrame:
    wide = F.least(F.lit(size), F.lit(cols) - F.col("tj") * size)
    flat = tiles.select("ti", "tj", wide.alias("w"), F.posexplode("data").alias("p", "v"))
    return flat.select((F.col("ti") * size + F.floor(F.col("p") / F.col("w"))).cast("long").alias("i"), (F.col("tj") * size + F.col("p") % F.col("w")).cast("int").alias("j"), "v")


#: Result tiles that a task adds up before it sends them on, and tasks whose sums of one tile are added at once.
HELD_TILES, FAN = 256, 32


def multiply_tiles(a: DataFrame, b: DataFrame, inner: int, size: int, fan: int = FAN) -> DataFrame:
    """A x B over tiles: tiles meet on the inner index and are multiplied there; each task adds up its products of a result
    tile. The sums of ``fan`` tasks are added, then those of ``fan`` such groups, and so on, so that what a task holds of a result
    tile does not grow with the number of tasks."""
    if fan < 2:
        raise ValueError("sums of at least two tasks are added at once")
    right = b.select(F.col("ti").alias("k"), F.col("tj").alias("jj"), F.col("data").alias("other"))
    pairs = a.withColumnRenamed("tj", "k").join(right, "k")

    def sent(sums: dict) -> pd.DataFrame:
        part = TaskContext.get().partitionId()
        return pd.DataFrame([(ti, tj, z.ravel(), part) for (ti, tj), z in sums.items()], columns=["ti", "tj", "data", "part"])

    def products(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for ti, tj, k, x, y in zip(pdf["ti"], pdf["jj"], pdf["k"], pdf["data"], pdf["other"], strict=True):
                wide = min(size, inner - int(k) * size)
                z = np.asarray(x).reshape(-1, wide) @ np.asarray(y).reshape(wide, -1)
                at = (int(ti), int(tj))
                sums[at] = sums[at] + z if at in sums else z
                if len(sums) > HELD_TILES:
                    yield sent(sums)
                    sums = {}
        if sums:
            yield sent(sums)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.array(pdf["data"].iloc[0], float)
        for more in pdf["data"].iloc[1:]:
            total += more
        return pd.DataFrame({"ti": pdf["ti"][:1], "tj": pdf["tj"][:1], "data": [total], "part": pdf["part"][:1]})

    tiles, parts = pairs.mapInPandas(products, f"{TILE}, part int"), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = -(-parts // fan)
        group = F.floor(F.col("part") / fan).cast("int") if parts > 1 else F.lit(0)  # the last level takes all that is left
        tiles = tiles.withColumn("part", group).groupBy("ti", "tj", "part").applyInPandas(add, f"{TILE}, part int")
        if parts <= 1:
            return tiles.drop("part")


def placed(tiles: DataFrame, owners: int) -> DataFrame:
    """``tiles`` with ``place``, their owner's number from 0, each in the partition of that number: later steps by place find
    a place's tiles together and need no exchange."""
    place = (tile_owner(F.col("ti"), F.col("tj"), owners) - 1).cast("int")
    return tiles.withColumn("place", place).repartitionById(owners, "place")


def spd_ones(spark: SparkSession, n: int) -> DataFrame:
    """All ones, and n on the diagonal."""
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(n * n).select(i.cast("long").alias("i"), j.cast("int").alias("j"), F.when(i == j, float(n)).otherwise(1.0).alias("v"))


def diagonal_boost(a: DataFrame, delta: float, n: int | None = None) -> DataFrame:
    """``delta`` added on the diagonal; of a sparse n x n matrix, also where it has no entry."""
    if n is None:
        return a.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + delta).otherwise(F.col("v")))
    diagonal = a.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").cast("int").alias("j"), F.lit(delta).alias("v"))
    return a.select("i", "j", "v").unionByName(diagonal).groupBy("i", "j").agg(F.sum("v").alias("v"))


def tile_owner(ti: Column, tj: Column, owners: int) -> Column:
    """Block-cyclic placement of a tile (from 0) on 1, 2, 3 or 4 owners, numbered from 1."""
    if owners == 1:
        return F.lit(1)
    if owners == 4:
        return ti % 2 + 2 * (tj % 2) + 1
    return 1 + (ti + tj) % owners


def cholesky_tiles(a: DataFrame, n: int, size: int) -> DataFrame:
    """Lower tiles L with L L' = A: per step one tile is factorised, its column solved, the rest updated.
    A step joins the tiles that are left with the solved column twice, by row and by column, and is written."""
    nb = -(-n // size)
    rest = written(a.filter("ti >= tj"))
    out = None
    edge = lambda t: min(size, n - t * size)
    for k in range(nb):
        column = rest.filter(F.col("tj") == k)
        head = column.filter(F.col("ti") == k).select(F.col("data").alias("head"))

        def solve(pdf: pd.DataFrame, k: int = k) -> pd.DataFrame:
            rows = []
            for ti, data, top in zip(pdf["ti"], pdf["data"], pdf["head"], strict=True):
                factor = np.linalg.cholesky(np.asarray(top).reshape(edge(k), edge(k)))
                x = factor if ti == k else np.linalg.solve(factor, np.asarray(data).reshape(edge(int(ti)), edge(k)).T).T
                rows.append((int(ti), k, np.ascontiguousarray(x).ravel()))
            return pd.DataFrame(rows, columns=["ti", "tj", "data"])

        def solved(batches, f=solve):
            for pdf in batches:
                yield f(pdf)

        done = written(column.crossJoin(F.broadcast(head)).mapInPandas(solved, TILE))  # the head is one tile
        out = done if out is None else out.unionByName(done)
        if k + 1 < nb:
            rest = written(_update(rest.filter(F.col("tj") > k), done, k, edge))
    return out


def _update(rest: DataFrame, column: DataFrame, k: int, edge) -> DataFrame:
    left = column.select("ti", F.col("data").alias("x"))
    right = column.select(F.col("ti").alias("tj"), F.col("data").alias("y"))
    pairs = rest.join(left, "ti").join(right, "tj").select("ti", "tj", "data", "x", "y")

    def each(batches):
        for pdf in batches:
            rows = []
            for ti, tj, data, x, y in zip(pdf["ti"], pdf["tj"], pdf["data"], pdf["x"], pdf["y"], strict=True):
                z = np.asarray(x).reshape(-1, edge(k)) @ np.asarray(y).reshape(-1, edge(k)).T
                rows.append((ti, tj, (np.asarray(data).reshape(z.shape) - z).ravel()))
            yield pd.DataFrame(rows, columns=["ti", "tj", "data"])

    return pairs.mapInPandas(each, TILE)


def closeness(a: DataFrame, b: DataFrame, rtol: float) -> DataFrame:
    """One row: the Frobenius distance of two matrices of entries, the larger norm, and whether the first is within
    ``rtol`` of the second."""
    both = a.select("i", "j", F.col("v").alias("p")).join(b.select("i", "j", F.col("v").alias("q")), ["i", "j"], "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    norms = both.agg(F.sqrt(F.sum((p - q) * (p - q))).alias("distance"), F.greatest(F.sqrt(F.sum(p * p)), F.sqrt(F.sum(q * q))).alias("norm"))
    return norms.withColumn("close", F.col("distance") <= rtol * F.col("norm"))
