"""Trees, forces and seams against plain Python on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import linalg, nbody, seam, tree

EPS2 = nbody.EPS2


def particles(spark, n, seed):
    r = random.Random(seed)
    rows = [(k, round(r.random(), 3), round(r.random(), 2), round(r.random() ** 2, 3), 0.0, 0.0, 0.0, 1.0 + k % 3) for k in range(n)]  # with ties
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, mass double")


def build(ids, p, leaf, node=1, depth=0, low=(0.0, 0.0, 0.0), size=1.0):
    """node -> (depth, ids, mass, centre of mass, centre of box, size, is leaf)."""
    mass = sum(p[i][7] for i in ids)
    com = tuple(sum(p[i][7] * p[i][1 + a] for i in ids) / mass for a in range(3))
    out = {node: (depth, ids, mass, com, tuple(x + size / 2 for x in low), size, len(ids) <= leaf)}
    if len(ids) > leaf:
        extent = [max(p[i][1 + a] for i in ids) - min(p[i][1 + a] for i in ids) for a in range(3)]
        axis = extent.index(max(extent))
        order = sorted(ids, key=lambda i: p[i][1 + axis])  # stable
        cut = (len(ids) + 1) // 2
        moved = tuple(x + (size / 2 if a == axis else 0) for a, x in enumerate(low))
        out |= build(order[:cut], p, leaf, 2 * node, depth + 1, low, size / 2) | build(order[cut:], p, leaf, 2 * node + 1, depth + 1, moved, size / 2)
    return out


def pull(a, b, mass):
    d = [v - u for u, v in zip(a, b, strict=True)]
    d2 = max(sum(x * x for x in d), EPS2)
    return [mass * x / d2 / math.sqrt(d2) for x in d]


def force(i, p, nodes, theta, node=1):
    _, ids, mass, com, box, size, is_leaf = nodes[node]
    at = p[i][1:4]
    if is_leaf:
        parts = [pull(at, p[j][1:4], p[j][7]) for j in ids if j != i]
    else:
        reach = max(math.sqrt(max(sum((c - x) ** 2 for c, x in zip(com, at, strict=True)), EPS2)) - math.dist(com, box), math.sqrt(EPS2))
        if i not in ids and size / reach <= theta:
            parts = [pull(at, com, mass)]
        else:
            parts = [force(i, p, nodes, theta, 2 * node), force(i, p, nodes, theta, 2 * node + 1)]
    return [sum(x[a] for x in parts) for a in range(3)]


def test_tree(spark):
    rows, df = particles(spark, 150, 1)
    want = build([r[0] for r in rows], rows, 16)
    nodes, members = nbody.tree(df)
    got = {r.node: r for r in nodes.collect()}
    assert got.keys() == want.keys()
    for k, (depth, ids, mass, com, box, size, is_leaf) in want.items():
        r = got[k]
        assert (r.depth, r.n, r.is_leaf, r.size) == (depth, len(ids), is_leaf, size) and math.isclose(r.mass, mass)
        assert np.allclose([r.cx, r.cy, r.cz], com) and np.allclose([r.gx, r.gy, r.gz], box)
    home = {r.id: r.node for r in members.collect()}
    assert home == {i: k for k, n in want.items() if n[6] for i in n[1]}


@pytest.mark.parametrize("theta", [0.0, 0.7])
def test_tree_forces(spark, theta):
    rows, df = particles(spark, 120, 2)
    nodes = build([r[0] for r in rows], rows, 16)
    got = {r.id: (r.ax, r.ay, r.az) for r in nbody.tree_accelerations(df, theta).collect()}
    want = {r[0]: force(r[0], rows, nodes, theta) for r in rows}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9) for i in want)
    if theta:  # some nodes did act as one body
        exact = {r[0]: force(r[0], rows, nodes, 0.0) for r in rows}
        assert any(not np.allclose(exact[i], want[i], rtol=1e-9) for i in want)


@pytest.mark.parametrize("task,bucket", [(40, 20), (16, 16), (70, 1)])
def test_trees_over_many_tasks(spark, task, bucket):
    """The top levels split over the cluster, with subtrees of few particles, and many buckets that open some of them."""
    rows, df = particles(spark, 300, 5)
    rows = [(*r[:7], 0.0 if r[1] > 0.9 else r[7]) for r in rows]  # some that pull nothing
    df = spark.createDataFrame(rows, df.schema)
    want = build([r[0] for r in rows], rows, 16)
    got = tree.build(df, 16, None, task, bucket)
    nodes = {r.node: r for r in got.nodes().collect()}
    assert nodes.keys() == want.keys() and got.top.count() > 2
    assert all((nodes[k].depth, nodes[k].n, nodes[k].is_leaf, nodes[k].size) == (w[0], len(w[1]), w[6], w[5]) and np.allclose([nodes[k].gx, nodes[k].gy, nodes[k].gz], w[4]) for k, w in want.items())
    assert {r.id: r.node for r in got.members().collect()} == {i: k for k, n in want.items() if n[6] for i in n[1]}
    acc = {r.id: (r.ax, r.ay, r.az) for r in tree.accelerations(df, 0.6, task=task, bucket=bucket).collect()}
    truth = {r[0]: force(r[0], rows, want, 0.6) for r in rows}
    assert acc.keys() == truth.keys() and all(np.allclose(acc[i], truth[i], rtol=1e-9) for i in truth)


def test_ids_over_two_to_the_53(spark):
    rows, df = particles(spark, 40, 6)
    far = df.withColumn("id", F.col("id") + (1 << 60))
    near = {r.id: (r.ax, r.ay, r.az) for r in tree.accelerations(df, 0.5).collect()}
    assert {r.id - (1 << 60): (r.ax, r.ay, r.az) for r in tree.accelerations(far, 0.5).collect()} == near
    assert tree.accelerations(df.limit(0), 0.5).count() == 0


def test_jobs_of_a_tree(spark):
    """Few passes, whatever the depth of the tree."""
    _, df = particles(spark, 500, 7)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for group, most, run in (("tree", 15, lambda: nbody.tree(df)[0].count()), ("walk", 20, lambda: nbody.tree_accelerations(df, 0.5).count())):
        sc.setJobGroup(group, group)
        run()
        jobs = len(tracker.getJobIdsForGroup(group))
        assert jobs <= most, jobs
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_segment_forces_and_errors(spark):
    rows, df = particles(spark, 90, 3)
    seg = {r.id: r.seg for r in nbody.segments(df, 3).collect()}
    want = {}
    for k in (1, 2, 3):
        ids = [i for i in sorted(seg) if seg[i] == k]
        nodes = build(ids, rows, 16)
        for i in ids:
            parts = [force(i, rows, nodes, 0.5)]
            for other in {1, 2, 3} - {k}:
                theirs = [j for j in seg if seg[j] == other]
                mass = sum(rows[j][7] for j in theirs)
                com = [sum(rows[j][7] * rows[j][1 + a] for j in theirs) / mass for a in range(3)]
                parts.append(pull(rows[i][1:4], com, mass))
            want[i] = [sum(x[a] for x in parts) for a in range(3)]
    got = nbody.segment_accelerations(df, 3, 0.5)
    found = {r.id: (r.ax, r.ay, r.az) for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[i], want[i], rtol=1e-9) for i in want)
    truth = {r[0]: [sum(pull(r[1:4], q[1:4], q[7])[a] for q in rows if q[0] != r[0]) for a in range(3)] for r in rows}
    direct = nbody.accelerations(df, block=40)
    assert all(np.allclose((r.ax, r.ay, r.az), truth[r.id], rtol=1e-9) for r in direct.collect())
    errors = {r.id: r.error for r in nbody.relative_errors(got, direct).collect()}
    assert all(math.isclose(errors[i], math.dist(want[i], truth[i]) / (math.hypot(*truth[i]) + 1e-12), rel_tol=1e-6, abs_tol=1e-12) for i in want)
    potential = sum(-a[7] * b[7] / math.sqrt(max(sum((x - y) ** 2 for x, y in zip(a[1:4], b[1:4], strict=True)), EPS2)) for k, a in enumerate(rows) for b in rows[:k])
    assert math.isclose(nbody.potential(df, block=40).first().potential, potential, rel_tol=1e-9)


def carved(image, k):
    for _ in range(k):
        h, w = image.shape
        wide = np.pad(image, 1, mode="edge")
        e = np.abs(wide[1:-1, 2:] - wide[1:-1, :-2]) + np.abs(wide[2:, 1:-1] - wide[:-2, 1:-1])
        m = e.astype(float)
        for y in range(1, h):
            far = np.pad(m[y - 1], 1, constant_values=np.inf)
            m[y] += np.minimum(np.minimum(far[:-2], far[1:-1]), far[2:])
        x = int(m[-1].argmin())
        path = [x]
        for y in range(h - 1, 0, -1):
            x = min((c for c in (x - 1, x, x + 1) if 0 <= c < w), key=lambda c: (m[y - 1, c], c != x - 1, c))  # left, then up, then right
            path.append(x)
        image = np.array([np.delete(row, s) for row, s in zip(image, path[::-1], strict=True)])
    return image


@pytest.mark.parametrize("band,block", [(4, 8), (16, 5), (64, 100)])
def test_seams_over_bands_and_blocks(spark, band, block):
    r = np.random.default_rng(band)
    image = r.integers(0, 6, (45, 30))  # with many ties
    df = spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "y int, x int, v long")
    got = np.zeros((45, 28), int)
    for c in seam.carve(df, 45, 30, 2, band, block).collect():
        got[c.y, c.x] = c.v
    assert (got == carved(image, 2)).all()


def test_bands_read_their_own_energy(spark):
    image = spark.range(600).selectExpr("cast(id div 10 as int) y", "cast(id % 10 as int) x", "id * 7919 % 31 as v")
    e = seam._by_band(seam.energy(image, 60, 10), 60, 16)
    plan = e.filter("band = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and e.filter("band = 2").agg(F.min("y"), F.max("y")).first() == (32, 47)


def test_tiles_at_their_place(spark):
    entries = spark.range(64 * 32).selectExpr("id div 32 as i", "cast(id % 32 as int) as j", "cast(id as double) as v")
    tiles = linalg.placed(linalg.to_tiles(entries, 64, 32, 8), 4)
    got = tiles.select("ti", "tj", "place", F.spark_partition_id().alias("p")).collect()
    assert len(got) == 32 and all(r.p == r.place == r.ti % 2 + 2 * (r.tj % 2) for r in got)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(tiles.groupBy("place").count()) == exchanges(tiles) and len(tiles.groupBy("place").count().collect()) == 4


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_products_of_tiles(spark, fan):
    with pytest.raises(ValueError):
        linalg.multiply_tiles(None, None, 1, 1, fan=1)
    r = np.random.default_rng(4)
    a, b = r.normal(size=(7, 11)), r.normal(size=(11, 5))
    entries = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j int, v double")
    tiles = linalg.multiply_tiles(linalg.to_tiles(entries(a), 7, 11, 3), linalg.to_tiles(entries(b), 11, 5, 3), 11, 3, fan)
    got = np.zeros((7, 5))
    for c in linalg.from_tiles(tiles, 5, 3).collect():
        got[c.i, c.j] = c.v
    assert np.allclose(got, a @ b)
    assert np.allclose(linalg.multiply(entries(a), entries(b)).agg(F.sum("v")).first()[0], (a @ b).sum())


def test_cholesky_of_many_steps(spark):
    """The estimated size of the plan must not grow with the number of steps."""
    r = np.random.default_rng(9)
    m = r.normal(size=(13, 13))
    a = m @ m.T + 13 * np.eye(13)
    tiles = linalg.to_tiles(spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], "i long, j int, v double"), 13, 13, 2)
    out = linalg.cholesky_tiles(tiles, 13, 2)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**60
    got = np.zeros((13, 13))
    for c in linalg.from_tiles(out, 13, 2).collect():
        got[c.i, c.j] = c.v
    assert np.allclose(got, np.linalg.cholesky(a))


def scattered(spark, n, seed):
    r = np.random.default_rng(seed)
    at, mass = r.random((n, 3)), r.integers(1, 5, n).astype(float)
    rows = [(k, *map(float, p), 0.0, 0.0, 0.0, float(m)) for k, (p, m) in enumerate(zip(at, mass, strict=True))]
    d = at[None] - at[:, None]
    d2 = np.maximum((d**2).sum(axis=2), EPS2)
    np.fill_diagonal(d2, np.inf)
    return spark.createDataFrame(rows, "id long, x double, y double, z double, vx double, vy double, vz double, mass double"), at, mass, d, d2


def test_direct_sums_are_dealt_to_many_tasks(spark):
    """However few bytes the blocks have; every pair of blocks is met once."""
    df, _, mass, d, d2 = scattered(spark, 1500, 11)
    met = nbody.block_pairs(df).select("part", "pair", "block", F.spark_partition_id().alias("p")).collect()
    assert {r.pair for r in met} == set(range(6)) and len(met) == 9 and all(r.part == r.p for r in met) and len({r.p for r in met}) == 6
    want = ((mass[None] / d2 / np.sqrt(d2))[..., None] * d).sum(axis=1)
    got = nbody.accelerations(df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast("long")))).collect()
    assert len(got) == 1500 and all(np.allclose((r.ax, r.ay, r.az), want[r.id], rtol=1e-9) for r in got)
    assert nbody.accelerations(df.limit(0)).count() == 0


def test_step_over_many_blocks(spark):
    df, at, mass, d, d2 = scattered(spark, 1200, 12)
    pull = ((mass[None] / d2 / np.sqrt(d2))[..., None] * d).sum(axis=1)
    got = {r.id: r for r in nbody.step(df, nbody.accelerations(df), 0.01).collect()}
    assert all(np.allclose([got[k].vx, got[k].vy, got[k].vz], pull[k] * 0.01) and np.allclose([got[k].x, got[k].y, got[k].z], at[k] + pull[k] * 1e-4) for k in range(1200))
    stages = nbody.accelerations(df, block=150).rdd.toDebugString().decode()
    assert nbody.block_pairs(df, 150).rdd.getNumPartitions() == 36 and "Cartesian" not in stages


def test_potential_over_many_blocks(spark):
    """Each pair counts once, within a block and across two, in as many tasks as there are pairs of blocks."""
    df, _, mass, _, d2 = scattered(spark, 1300, 13)
    want = -(mass[None] * mass[:, None] / np.sqrt(d2)).sum() / 2
    for block in (None, 100, 5000):
        assert math.isclose(nbody.potential(df, block=block).first().potential, want, rel_tol=1e-11)
    assert nbody.block_pairs(df, 100).rdd.getNumPartitions() == 91 and nbody.potential(df.limit(0)).first().potential is None


@pytest.mark.parametrize("theta", [0.0, 0.6])
def test_subtrees_meet_chunks_of_particles(spark, theta, monkeypatch):
    """What a task holds is a subtree and a chunk of particles, also where each particle gets to every leaf."""
    rows, df = particles(spark, 300, 15)
    nodes = build([r[0] for r in rows], rows, 16)
    monkeypatch.setattr(tree, "PARTS", 3)
    got = {r.id: (r.ax, r.ay, r.az) for r in tree.accelerations(df, theta, task=80, bucket=20, chunk=60).collect()}
    want = {r[0]: force(r[0], rows, nodes, theta) for r in rows}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9) for i in want)
    plan = tree.accelerations(df, theta, task=80, bucket=20, chunk=60)._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "chunk" in plan
