"""Seeded grids, plates, images, particles and matrices.

Each value is a hash of the seed and the cell's key, so that it does not depend on how the cells are dealt to
tasks, and a task that runs again gives the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import stencil as st
from gridspark.operators.linalg import tile_owner


def uniform(seed: int, *keys: Column) -> Column:
    """Numbers in [0, 1) with 52 random bits, one for each value of ``keys``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """The cells (y, x) of a grid."""
    if rows <= 0 or cols <= 0:
        raise ValueError("rows and cols must be positive")
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("y"), (F.col("id") % cols).cast("int").alias("x"))


def random_world(spark: SparkSession, rows: int, cols: int, density: float = 0.25, seed: int = 1) -> DataFrame:
    """Life cells (y, x, a), each alive with chance ``density``."""
    if not 0.0 <= density <= 1.0:
        raise ValueError("density must be in [0, 1]")
    return grid(spark, rows, cols).withColumn("a", (uniform(seed, F.col("y"), F.col("x")) < density).cast("int"))


def ambient_plate(spark: SparkSession, rows: int, cols: int, ambient: float = 0.0) -> DataFrame:
    """Heat cells (y, x, v) of one temperature."""
    return grid(spark, rows, cols).withColumn("v", F.lit(ambient).cast("float"))


def with_hotspots(plate: DataFrame, rows: int, cols: int, temperature: float = 1.0, radius: int = 8) -> DataFrame:
    """A disc in the upper left third, a smaller and cooler one in the lower right, then a Gaussian added at the centre."""
    third = lambda n, k: -(-k * n // 3) - 1
    plate = st.disc(plate, third(rows, 1), third(cols, 1), radius, temperature)
    plate = st.disc(plate, third(rows, 2), third(cols, 2), max(2, radius // 2), 0.75 * temperature)
    return st.gaussian(plate, st.centre(rows), st.centre(cols), max(3.0, 1.5 * radius), 0.5 * temperature)


def random_image(spark: SparkSession, rows: int, cols: int, seed: int = 42) -> DataFrame:
    """Image cells (y, x, v) in [0, 1), single precision."""
    return grid(spark, rows, cols).withColumn("v", uniform(seed, F.col("y"), F.col("x")).cast("float"))


def _particles(spark: SparkSession, n: int, place) -> DataFrame:
    if n < 0:
        raise ValueError("the number of particles must not be negative")
    zero = [F.lit(0.0).alias(f"v{a}") for a in "xyz"]
    return spark.range(n).select("id", *[place(k).alias(a) for k, a in enumerate("xyz")], *zero, F.lit(1.0).alias("mass"))


def random_particles(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Particles at rest with mass 1 in the unit cube."""
    return _particles(spark, n, lambda k: uniform(seed, F.col("id"), F.lit(k)))


def zero_particles(spark: SparkSession, n: int) -> DataFrame:
    return _particles(spark, n, lambda k: F.lit(0.0))


def matrix_tiles(spark: SparkSession, n: int, size: int, kind: str = "random", owners: int = 1, seed: int = 3) -> DataFrame:
    """An n x n matrix as tiles (ti, tj, owner, data) of ``size``: ``random``, ``zeros``, ``ones`` or ``spd`` (ones, and n on the
    diagonal), each tile with the number of its owner in block-cyclic placement. Edge tiles may be smaller, not for ``spd``."""
    if n <= 0 or size <= 0:
        raise ValueError("n and size must be positive")
    if kind not in ("random", "zeros", "ones", "spd"):
        raise ValueError("kind is one of random, zeros, ones, spd")
    if kind == "spd" and n % size:
        raise ValueError("size must divide n")
    blocks = -(-n // size)
    tiles = spark.range(blocks * blocks).select(F.floor(F.col("id") / blocks).cast("int").alias("ti"), (F.col("id") % blocks).cast("int").alias("tj"))
    edge = lambda t: F.least(F.lit(size), F.lit(n) - t * size)
    wide = edge(F.col("tj"))

    def cell(p: Column) -> Column:
        i, j = F.col("ti") * size + F.floor(p / wide).cast("int"), F.col("tj") * size + p % wide
        if kind == "random":
            return uniform(seed, i, j)
        return F.when(i == j, float(n)).otherwise(1.0) if kind == "spd" else F.lit(0.0 if kind == "zeros" else 1.0)

    data = F.transform(F.sequence(F.lit(0), edge(F.col("ti")) * wide - 1), cell)
    return tiles.select("ti", "tj", tile_owner(F.col("ti"), F.col("tj"), owners).cast("int").alias("owner"), data.alias("data"))
