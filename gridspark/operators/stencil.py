"""Neighbourhood operators over cells (y, x, value) of a height x width grid.

A step sends each cell's value to the places it is a neighbour of and groups there, with partial sums
before the shuffle; no row or column of the grid has to fit a task. Under ``wrap`` a neighbour counts as
often as the offsets reach it, also where height or width is under 3. :func:`tiled_run` is the form for
many steps: tiles with a halo as deep as the steps of a round, one shuffle a round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.plans.iterate import cut, last

MOORE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def boundary_of(value: object) -> str:
    """'wrap' or 'pad' from any spelling."""
    name = str(value).strip().lower().removeprefix(":")
    if name not in ("wrap", "pad"):
        raise ValueError(f"boundary must be wrap or pad, not {value!r}")
    return name


def alpha_of(alpha: float) -> float:
    """A diffusion number, after rounding to single precision: 0 < alpha <= 0.25."""
    a = float(np.float32(alpha))
    if not 0 < a <= 0.25:
        raise ValueError("alpha must be in (0, 0.25]")
    return a


def stencil(grid: DataFrame, height: int, width: int, offsets: list[tuple[int, int]], boundary: str, value: str, pad, result: Callable[[Column, dict[tuple[int, int], Column]], Column]) -> DataFrame:
    """``grid`` with ``value`` replaced by ``result(own value, {(dy, dx): neighbour's value})``; outside a padded
    grid every neighbour has the value ``pad``."""
    wrap = boundary_of(boundary) == "wrap"
    kind = grid.schema[value].dataType.simpleString()
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate([(0, 0), *offsets])])
    sent = grid.select("y", "x", F.col(value).alias("v"), F.explode(moves).alias("m"))
    # The cell at (y, x) is the (dy, dx) neighbour of the one at (y - dy, x - dx).
    ty, tx = F.col("y") - F.col("m.dy"), F.col("x") - F.col("m.dx")
    if wrap:
        ty, tx = F.pmod(ty, F.lit(height)), F.pmod(tx, F.lit(width))
    sent = sent.select(ty.cast("int").alias("y"), tx.cast("int").alias("x"), F.col("m.k").alias("k"), "v")
    if not wrap:
        sent = sent.filter(f"y between 0 and {height - 1} and x between 0 and {width - 1}")
    got = sent.groupBy("y", "x").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n{k}") for k in range(len(offsets) + 1)])
    near = {o: F.coalesce(F.col(f"n{k}"), F.lit(pad).cast(kind)) for k, o in enumerate(offsets, 1)}
    return got.select("y", "x", result(F.col("n0"), near).cast(kind).alias(value))


def survives(alive: Column, n: Column) -> Column:
    return F.when(((alive == 1) & n.isin(2, 3)) | ((alive == 0) & (n == 3)), 1).otherwise(0)


def life_step(world: DataFrame, height: int, width: int, boundary: str = "wrap", pad_value: int = 0) -> DataFrame:
    """One generation. Only counts are needed, so the neighbours are summed before the shuffle."""
    wrap = boundary_of(boundary) == "wrap"
    if not wrap and pad_value:
        return stencil(world, height, width, MOORE, boundary, "a", pad_value, lambda a, n: survives(a, sum(n.values(), F.lit(0))))
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [(0, 0), *MOORE]])
    sent = world.select("y", "x", "a", F.explode(moves).alias("m"))
    here = (F.col("m.dy") == 0) & (F.col("m.dx") == 0)
    ty, tx = F.col("y") + F.col("m.dy"), F.col("x") + F.col("m.dx")
    if wrap:
        ty, tx = F.pmod(ty, F.lit(height)), F.pmod(tx, F.lit(width))
    sent = sent.select(ty.cast("int").alias("y"), tx.cast("int").alias("x"), F.when(here, F.col("a")).alias("own"), F.when(here, 0).otherwise(F.col("a")).alias("n"))
    if not wrap:
        sent = sent.filter(f"y between 0 and {height - 1} and x between 0 and {width - 1}")
    return sent.groupBy("y", "x").agg(F.max("own").alias("own"), F.sum("n").alias("n")).select("y", "x", survives(F.col("own"), F.col("n")).alias("a"))


def life(world: DataFrame, height: int, width: int, steps: int = 1, boundary: str = "wrap", pad_value: int = 0) -> DataFrame:
    return last(world, lambda w: life_step(w, height, width, boundary, pad_value), steps)


def heat_step(plate: DataFrame, height: int, width: int, alpha: float = 0.2, boundary: str = "pad", pad_value: float = 0.0) -> DataFrame:
    """Explicit Euler in single precision: c + a * (((n + s) + w) + e - 4 c), operands in this order."""
    a, four = F.lit(alpha_of(alpha)).cast("float"), F.lit(4.0).cast("float")
    rule = lambda c, n: c + a * (((n[-1, 0] + n[1, 0]) + n[0, -1]) + n[0, 1] - four * c)
    return stencil(plate, height, width, CROSS, boundary, "v", pad_value, rule)


def heat(plate: DataFrame, height: int, width: int, steps: int = 200, alpha: float = 0.2, boundary: str = "pad", pad_value: float = 0.0) -> DataFrame:
    return last(plate, lambda p: heat_step(p, height, width, alpha, boundary, pad_value), steps)


def heat_history(plate: DataFrame, height: int, width: int, steps: int = 400, snapshot_every: int = 1, alpha: float = 0.2, boundary: str = "pad", pad_value: float = 0.0) -> DataFrame:
    """(step, y, x, v) of step 0, every ``snapshot_every``-th and the last one."""
    if snapshot_every < 1:
        raise ValueError("snapshot_every must be positive")
    out, now = plate.select(F.lit(0).alias("step"), "y", "x", "v"), plate
    for i in range(1, steps + 1):
        now = heat_step(now, height, width, alpha, boundary, pad_value)
        if i % snapshot_every == 0 or i == steps:
            now = cut(now)
            out = out.unionByName(now.select(F.lit(i).alias("step"), "y", "x", "v"))
    return out


def jacobi_step(grid: DataFrame, height: int, width: int) -> DataFrame:
    """(c + n + s + w + e) / 5 on a torus."""
    return stencil(grid, height, width, CROSS, "wrap", "v", 0.0, lambda c, n: (c + n[-1, 0] + n[1, 0] + n[0, -1] + n[0, 1]) / 5)


def disc(plate: DataFrame, row: int, col: int, radius: int, temperature: float) -> DataFrame:
    """Cells within ``radius`` of (row, col) get the temperature."""
    d = (F.col("y") - row) * (F.col("y") - row) + (F.col("x") - col) * (F.col("x") - col)
    return plate.withColumn("v", F.when(d <= radius * radius, F.lit(temperature).cast("float")).otherwise(F.col("v")))


def gaussian(plate: DataFrame, row: int, col: int, sigma: float, amplitude: float) -> DataFrame:
    """A bell of the given height is added."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    d = (F.col("y") - row) * (F.col("y") - row) + (F.col("x") - col) * (F.col("x") - col)
    return plate.withColumn("v", (F.col("v") + F.lit(amplitude) * F.exp(-d / (2 * sigma * sigma))).cast("float"))


def centre(n: int) -> int:
    """Row or column of the middle, from 0."""
    return -(-n // 2) - 1


#: Cells of the patterns, from 0, relative to their anchor.
GLIDER = [(0, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def overlay(world: DataFrame, height: int, width: int, row: int, col: int, cells: list[tuple[int, int]]) -> DataFrame:
    """The cells at (row, col) + each offset come alive."""
    at = [(row + dy, col + dx) for dy, dx in cells]
    if not all(0 <= y < height and 0 <= x < width for y, x in at):
        raise ValueError("the pattern does not fit the grid")
    hit = None
    for y, x in at:
        here = (F.col("y") == y) & (F.col("x") == x)
        hit = here if hit is None else hit | here
    return world.withColumn("a", F.when(hit, 1).otherwise(F.col("a")))


def blinker(horizontal: bool = True) -> list[tuple[int, int]]:
    return [(0, -1), (0, 0), (0, 1)] if horizontal else [(-1, 0), (0, 0), (1, 0)]


def tiles(grid: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """``grid`` with the tile (ty, tx) of each cell; tiles at the far edges may be smaller."""
    return grid.withColumn("ty", F.floor(F.col("y") / tile_h).cast("int")).withColumn("tx", F.floor(F.col("x") / tile_w).cast("int"))


def tiled_run(grid: DataFrame, height: int, width: int, value: str, step: Callable[[np.ndarray], np.ndarray], steps: int, boundary: str = "wrap", pad=0, tile: int = 128, round_steps: int = 8) -> DataFrame:
    """``steps`` of a radius-1 rule. ``step`` maps an array to the new values of all but its border cells.

    Each round sends every tile the cells around it, ``round_steps`` deep, in one shuffle of little more than the
    grid; the tile then takes that many steps alone, its valid part shrinking by one cell a step.
    """
    wrap = boundary_of(boundary) == "wrap"
    kind = grid.schema[value].dataType.simpleString()
    deep = max(1, min(round_steps, tile))
    done = 0
    while done < steps:
        k = min(deep, steps - done)
        grid = _round(grid, height, width, value, kind, step, k, wrap, pad, tile)
        done += k
        if done < steps:
            grid = cut(grid)
    return grid


def _round(grid, height, width, value, kind, step, k, wrap, pad, tile) -> DataFrame:
    def reach(c: str, size: int) -> Column:
        """(tile, place in the plane of that tile) of every tile whose halo holds the coordinate."""
        far = -(-k // size)
        shifts = range(-far, far + 1) if wrap else [0]
        planes = F.array(*[F.col(c) + s * size for s in shifts])
        spots = F.transform(planes, lambda p: F.transform(F.sequence(F.floor((p - k) / tile).cast("int"), F.floor((p + k) / tile).cast("int")), lambda t: F.struct(t.alias("t"), p.cast("int").alias("p"))))
        return F.filter(F.flatten(spots), lambda s: (s["t"] >= 0) & (s["t"] * tile < size) & (s["p"] < F.least((s["t"] + 1) * tile, F.lit(size)) + k))

    sent = grid.select(F.explode(reach("y", height)).alias("r"), "x", F.col(value).alias("v")).select(F.col("r.t").alias("ty"), F.col("r.p").alias("py"), "x", "v")
    sent = sent.select("ty", "py", F.explode(reach("x", width)).alias("r"), "v").select("ty", F.col("r.t").alias("tx"), "py", F.col("r.p").alias("px"), "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["ty"].iloc[0]) * tile, int(pdf["tx"].iloc[0]) * tile
        h, w = min(tile, height - y0), min(tile, width - x0)
        cells = np.full((h + 2 * k, w + 2 * k), pad, dtype=pdf["v"].to_numpy().dtype)
        cells[pdf["py"].to_numpy() - y0 + k, pdf["px"].to_numpy() - x0 + k] = pdf["v"].to_numpy()
        for s in range(1, k + 1):
            cells = step(cells)
            if not wrap:  # what lies outside of the grid keeps the pad value
                ys, xs = np.arange(cells.shape[0]) + y0 - (k - s), np.arange(cells.shape[1]) + x0 - (k - s)
                cells[(ys < 0) | (ys >= height)] = pad
                cells[:, (xs < 0) | (xs >= width)] = pad
        y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), value: cells.ravel()})

    return sent.groupBy("ty", "tx").applyInPandas(lambda pdf: run(pdf), f"y int, x int, {value} {kind}")


def life_rule(c: np.ndarray) -> np.ndarray:
    n = sum(c[1 + dy : c.shape[0] - 1 + dy, 1 + dx : c.shape[1] - 1 + dx] for dy, dx in MOORE)
    own = c[1:-1, 1:-1]
    return (((own == 1) & ((n == 2) | (n == 3))) | ((own == 0) & (n == 3))).astype(c.dtype)


def heat_rule(alpha: float) -> Callable[[np.ndarray], np.ndarray]:
    a, four = np.float32(alpha_of(alpha)), np.float32(4)

    def rule(c: np.ndarray) -> np.ndarray:
        own = c[1:-1, 1:-1]
        return own + a * (((c[:-2, 1:-1] + c[2:, 1:-1]) + c[1:-1, :-2]) + c[1:-1, 2:] - four * own)

    return rule
