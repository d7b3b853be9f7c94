"""Gravity among particles (id, x, y, z, vx, vy, vz, mass): direct sums, Morton order, a median-split tree.

Direct sums are taken over blocks: every two blocks of particles meet once, as rows with arrays, tile by tile, and what each
pulls of the other is summed in the same pass. Trees are in tree.py; those of all segments are built and
walked together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import tree as trees
from gridspark.operators.order import ranked
from gridspark.operators.tree import AXES, EPS2, LEAF
from gridspark.plans.iterate import cut


def spread(v: Column) -> Column:
    """Two zero bits after each of 21 bits."""
    v = v.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Z-order code of a point of the unit cube; coordinates outside are clamped."""
    top = (1 << 21) - 1
    cell = lambda c: F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * float(1 << 21)).cast("long"), F.lit(top))
    return spread(cell(x)).bitwiseOR(F.shiftleft(spread(cell(y)), 1)).bitwiseOR(F.shiftleft(spread(cell(z)), 2))


def segments(particles: DataFrame, parts: int) -> DataFrame:
    """``particles`` with ``code`` and ``seg`` (from 1): contiguous Morton ranges, the first ones a particle larger."""
    coded = cut(particles.withColumn("code", morton(F.col("x"), F.col("y"), F.col("z"))))
    n = coded.count()
    base, more = n // parts, n % parts
    r = F.col("rank") - 1
    seg = F.when(r < more * (base + 1), F.floor(r / (base + 1))).otherwise(more + F.floor((r - more * (base + 1)) / max(base, 1)))
    return ranked(coded, ["code", "id"]).withColumn("seg", (seg + 1).cast("int")).drop("rank")


#: Most particles of a block, blocks of a small table and least particles of these, most tasks.
BLOCK, FEW, SMALL, TASKS = 16_384, 8, 512, 2_000


def block_pairs(particles: DataFrame, block: int | None = None) -> DataFrame:
    """(part, pair, block, id, x, y, z, mass), the last five arrays: every two blocks, once, and every block with itself. A pair is
    one or two rows in the partition ``part``; pairs are dealt out evenly, however small the blocks are as bytes. Equal ids share
    a block; rows without id meet nothing."""
    particles = particles.filter("id is not null")
    n = particles.count()
    blocks = max(1, -(-n // block)) if block else max(1, -(-n // BLOCK), min(FEW, -(-n // SMALL)))
    pairs = blocks * (blocks + 1) // 2
    each = particles.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", *AXES, "mass")).alias("src"))
    met = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    high, low = F.greatest("block", F.col("other").cast("long")), F.least("block", F.col("other").cast("long"))
    met = met.select((F.floor(high * (high + 1) / 2) + low).alias("pair"), "block", *[F.col(f"src.{c}").alias(c) for c in ("id", *AXES, "mass")])
    tasks = min(pairs, TASKS)
    return met.withColumn("part", (F.col("pair") % tasks).cast("int")).repartitionById(tasks, "part")


def _both(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, (3, n) places, masses) of the blocks of a pair; a block with itself, or with an empty one, is one row."""
    rows = [(np.asarray(r.id), np.stack([np.asarray(getattr(r, a), float) for a in AXES]), np.asarray(r.mass, float)) for r in pdf.sort_values("block").itertuples()]
    return [rows[0], rows[-1]]


def accelerations(particles: DataFrame, eps2: float = EPS2, g: float = 1.0, block: int | None = None) -> DataFrame:
    """(id, ax, ay, az): the sum over all others of g m r / d**3 with d**2 at least eps2. Two blocks meet once, for both sides."""
    def pull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (ids, at, mass), (oid, oat, omass) = _both(pdf)
        one = len(pdf) == 1
        if one and not _alone(key[1]):
            return pd.DataFrame({"id": ids[:0], **{f"a{a}": at[0][:0] for a in AXES}})
        mine, theirs = np.zeros_like(at), np.zeros_like(oat)
        for i, j, d, d2, spare in trees.tiles(at, oat, eps2):
            np.multiply(np.sqrt(d2, out=spare), d2, out=spare)
            np.divide(g, spare, out=spare)
            if one:
                spare[ids[i][:, None] == oid[j][None, :]] = 0.0
            d *= spare
            mine[:, i] += d @ omass[j]
            if not one:
                theirs[:, j] -= mass[i] @ d
        sides = [(ids, mine)] if one else [(ids, mine), (oid, theirs)]
        return pd.concat([pd.DataFrame({"id": k, **{f"a{a}": v[n] for n, a in enumerate(AXES)}}) for k, v in sides])

    parts = block_pairs(particles, block).groupBy("part", "pair").applyInPandas(pull, "id long, ax double, ay double, az double")
    return parts.groupBy("id").agg(*[F.sum(f"a{a}").alias(f"a{a}") for a in AXES])


def potential(particles: DataFrame, eps2: float = EPS2, g: float = 1.0, block: int | None = None) -> DataFrame:
    """One row ``potential``: the sum over pairs of -g m m' / d."""
    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (ids, at, mass), (oid, oat, omass) = _both(pdf)
        one, total = len(pdf) == 1, 0.0
        if one and not _alone(key[1]):
            return pd.DataFrame({"potential": [total]})
        for i, j, _, d2, spare in trees.tiles(at, oat, eps2):
            np.divide(-g, np.sqrt(d2, out=spare), out=spare)
            if one:
                spare[ids[i][:, None] >= oid[j][None, :]] = 0.0
            total += float(mass[i] @ (spare @ omass[j]))
        return pd.DataFrame({"potential": [total]})

    return block_pairs(particles, block).groupBy("part", "pair").applyInPandas(sums, "potential double").agg(F.sum("potential").alias("potential"))


def _alone(pair: int) -> bool:
    """Whether ``pair`` is that of a block with itself: such numbers are h * (h + 3) / 2."""
    h = (math.isqrt(8 * int(pair) + 9) - 3) // 2
    return h * (h + 3) // 2 == pair


def kinetic(particles: DataFrame) -> DataFrame:
    """One row: kinetic energy and total momentum."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return particles.agg(F.sum(0.5 * F.col("mass") * v2).alias("kinetic"), *[F.sum(F.col("mass") * F.col(f"v{a}")).alias(f"p{a}") for a in AXES])


def centres(particles: DataFrame, by: list[str]) -> DataFrame:
    """Mass and centre of mass of each group."""
    m = F.sum("mass")
    return particles.groupBy(*by).agg(m.alias("mass"), *[(F.sum(F.col("mass") * F.col(a)) / m).alias(f"c{a}") for a in AXES])


def tree(particles: DataFrame, leaf: int = LEAF, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a median-split tree, or of one for each value of ``by``, which both tables then have.

    nodes: node, depth, n, mass, cx, cy, cz, gx, gy, gz, size, is_leaf. members: the particles with the leaf they are in.
    """
    built = trees.build(particles, leaf, by)
    return built.nodes(), built.members()


def tree_accelerations(particles: DataFrame, theta: float, eps2: float = EPS2, g: float = 1.0, leaf: int = LEAF, by: str | None = None) -> DataFrame:
    """(id, ax, ay, az) by Barnes-Hut; see :func:`gridspark.operators.tree.accelerations`."""
    return trees.accelerations(particles, theta, eps2, g, leaf, by)


def step(particles: DataFrame, acc: DataFrame, dt: float = 0.01) -> DataFrame:
    """Semi-implicit Euler from the accelerations of the old positions."""
    v = {a: F.col(f"v{a}") + F.col(f"a{a}") * dt for a in AXES}
    return particles.join(acc, "id").select("id", *[(F.col(a) + v[a] * dt).alias(a) for a in AXES], *[v[a].alias(f"v{a}") for a in AXES], "mass")


def segment_accelerations(particles: DataFrame, parts: int, theta: float, eps2: float = EPS2, g: float = 1.0) -> DataFrame:
    """The distributed scheme: a tree in each Morton segment, all in one pass, and every other segment as one body."""
    seg = cut(segments(particles, parts))
    heads = centres(seg, ["seg"]).filter("mass > 0")  # one row a segment
    r = {a: F.col(f"c{a}") - F.col(a) for a in AXES}
    d2 = F.greatest(r["x"] * r["x"] + r["y"] * r["y"] + r["z"] * r["z"], F.lit(eps2))
    others = heads.select(F.col("seg").alias("other"), F.col("mass").alias("om"), "cx", "cy", "cz")
    far = seg.select("id", *AXES, "seg").join(F.broadcast(others), F.col("seg") != F.col("other"))
    total = far.groupBy("id").agg(*[F.sum(g * F.col("om") / d2 / F.sqrt(d2) * r[a]).alias(f"a{a}") for a in AXES])
    total = total.unionByName(tree_accelerations(seg.drop("code"), theta, eps2, g, by="seg"))
    return total.groupBy("id").agg(*[F.sum(f"a{a}").alias(f"a{a}") for a in AXES])


def relative_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, error): |a - t| / (|t| + 1e-12)."""
    t = truth.select("id", *[F.col(f"a{a}").alias(f"t{a}") for a in AXES])
    norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    return found.join(t, "id").select("id", (norm([F.col(f"a{a}") - F.col(f"t{a}") for a in AXES]) / (norm([F.col(f"t{a}") for a in AXES]) + 1e-12)).alias("error"))
