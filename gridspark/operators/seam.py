"""Content-aware image resizing: gradient energy, row-recurrent dynamic programming, back-tracking, removal.

The recurrence runs in bands of rows: within a band, blocks of columns with a margin twice as wide as the band is
high are independent, so a band costs one shuffle and no task holds more than band x (block + 4 band) cells. The energy
of an image of several bands is written once, by band, so that each band reads its own files and no more.
All schedules of the recurrence that an engine may choose give this one result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.stencil import CROSS, stencil
from gridspark.plans.iterate import cut
from gridspark.sources.scratch import scratch

BAND, BLOCK = 512, 2048


def energy(image: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, v): |right - left| + |below - above|, the image's own cell standing in beyond an edge."""
    def rule(c, n):
        at = lambda o: F.coalesce(n[o], c)
        return F.abs(at((0, 1)) - at((0, -1))) + F.abs(at((1, 0)) - at((-1, 0)))

    return stencil(image, height, width, CROSS, "pad", "v", None, rule)


def _recur(e: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Costs and back-pointers of a block; ``before`` is the row above it, or None at the top of the image."""
    m, b = e.copy(), np.zeros(e.shape, np.int8)
    for y in range(len(e)):
        above = m[y - 1] if y else before
        if above is None:
            continue
        far = np.full(1, np.inf)
        left, right = np.concatenate([far, above[:-1]]), np.concatenate([above[1:], far])
        b[y] = np.where((left <= above) & (left <= right), -1, np.where(above <= right, 0, 1))
        m[y] = e[y] + np.minimum(np.minimum(left, above), right)
    return m, b


def _climb(b: np.ndarray, x: np.ndarray, left: int) -> np.ndarray:
    """Where the paths from columns ``x`` of the last row of a block come from in the row above the block."""
    for y in range(len(b) - 1, -1, -1):
        x = x + b[y, x - left]
    return x


def _by_band(e: DataFrame, height: int, band: int) -> DataFrame:
    """``e`` with its ``band``, as a table that a filter by band prunes."""
    banded = e.select("y", "x", F.col("v").cast("double").alias("v"), F.floor(F.col("y") / band).cast("int").alias("band"))
    if height <= band:
        return banded
    at = scratch(e.sparkSession, "energy")
    banded.write.partitionBy("band").parquet(at)
    return e.sparkSession.read.schema(banded.schema).parquet(at)


def cumulative_energy(e: DataFrame, height: int, width: int, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """(y, x, m, b, up): least cost of a path from the top and where it comes from (-1, 0, 1); ties go left, then up.
    ``up``, in the last row of each band, is the path's column in the row above the band."""
    out, above = None, None
    e = _by_band(e, height, band)
    for y0 in range(0, height, band):
        rows = min(band, height - y0)
        now = e.filter(F.col("band") == y0 // band).select("y", "x", "v")
        if above is not None:
            now = now.unionByName(above)
        # A path climbs at most a column a row: with twice the rows as a margin its cells' costs and pointers are all right.
        reach = 2 * rows
        spots = F.sequence(F.greatest(F.lit(0), F.floor((F.col("x") - reach) / block)).cast("int"), F.least(F.lit((width - 1) // block), F.floor((F.col("x") + reach) / block)).cast("int"))
        sent = now.withColumn("block", F.explode(spots))

        def run(pdf: pd.DataFrame, y0: int = y0, rows: int = rows) -> pd.DataFrame:
            k = int(pdf["block"].iloc[0])
            lo, hi = max(0, k * block - 2 * rows), min(width, (k + 1) * block + 2 * rows)
            cells = np.zeros((rows + 1, hi - lo))
            cells[pdf["y"].to_numpy() - y0 + 1, pdf["x"].to_numpy() - lo] = pdf["v"].to_numpy()
            m, b = _recur(cells[1:], cells[0] if y0 else None)
            a, z = k * block, min(width, (k + 1) * block)
            y, x = np.mgrid[y0 : y0 + rows, a:z]
            up = np.full(x.shape, -1, np.int32)
            up[-1] = _climb(b, np.arange(a, z), lo)
            return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "m": m[:, a - lo : z - lo].ravel(), "b": b[:, a - lo : z - lo].ravel().astype(np.int32), "up": up.ravel()})

        done = _apply(sent, run)
        if y0 + rows < height:
            done = cut(done)
            above = done.filter(F.col("y") == y0 + rows - 1).select("y", "x", F.col("m").alias("v"))
        out = done if out is None else out.unionByName(done)
    return out


def _apply(sent: DataFrame, run) -> DataFrame:
    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf)

    return sent.groupBy("block").applyInPandas(each, "y int, x int, m double, b int, up int")


def seam(costs: DataFrame, height: int, band: int = BAND) -> DataFrame:
    """(y, s): the column of the cheapest path in each row, the left one of equals at the bottom; ``band`` as it was for the
    costs. The bands' climbs are composed by doubling, and each band follows its own part of the path."""
    last = (height - 1) // band
    end = costs.filter(F.col("y") == height - 1).agg(F.min(F.struct("m", "x")).alias("s")).select(F.lit(last).alias("band"), F.col("s.x").alias("x"))
    climb = costs.withColumn("band", F.floor(F.col("y") / band).cast("int")).filter((F.col("y") == F.least((F.col("band") + 1) * band, F.lit(height)) - 1) & (F.col("band") > 0)).select("band", "x", "up")
    known, span = end, 1
    while span <= last:
        known = cut(known.unionByName(known.join(climb, ["band", "x"]).select((F.col("band") - span).alias("band"), F.col("up").alias("x"))))
        if 2 * span <= last:
            further = climb.select((F.col("band") + span).alias("band"), F.col("x").alias("up"), F.col("up").alias("far"))
            climb = cut(climb.join(further, ["band", "up"]).select("band", "x", F.col("far").alias("up")))
        span *= 2
    near = costs.withColumn("band", F.floor(F.col("y") / band).cast("int")).join(known.select("band", F.col("x").alias("e")), "band").filter(F.abs(F.col("x") - F.col("e")) <= band).select("band", "y", "x", "b", "e")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0, x = int(pdf["y"].min()), int(pdf["x"].min()), int(pdf["e"].iloc[0])
        b = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), np.int64)
        b[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["b"].to_numpy()
        path = []
        for row in b[::-1]:
            path.append(x)
            x += int(row[x - x0])
        return pd.DataFrame({"y": np.arange(y0, y0 + len(b)), "s": path[::-1]})

    return near.groupBy("band").applyInPandas(lambda pdf: follow(pdf), "y int, s int")


def remove(image: DataFrame, path: DataFrame) -> DataFrame:
    """``image`` without the cell (y, s) of each row; what lies right of it moves left."""
    joined = image.join(path, "y").filter("x <> s")
    return joined.withColumn("x", (F.col("x") - (F.col("x") > F.col("s")).cast("int")).cast("int")).drop("s")


def carve(image: DataFrame, height: int, width: int, k: int = 1, band: int = BAND, block: int = BLOCK) -> DataFrame:
    """``k`` cheapest seams removed, one after the other."""
    if not 0 <= k < width:
        raise ValueError("k must be less than the width")
    for _ in range(k):
        costs = cut(cumulative_energy(energy(image, height, width), height, width, band, block))
        image = cut(remove(image, seam(costs, height, band)))
        width -= 1
    return image
