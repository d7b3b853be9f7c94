"""Queries over matrices and particles, each with the same query in DuckDB SQL where it can be said."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspark.functions import stats as ss
from gridspark.operators import linalg as la
from gridspark.operators import nbody as nb
from gridspark.plans.iterate import cut
from gridspark.sources import fixtures as fx

QUERIES, ORACLES = {}, {}
SIZE, DIM = 16, 64


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


MATRIX, PARTICLES = fx.SQL["matrix"], fx.SQL["particles"]
_GRAM = f"WITH a AS ({MATRIX}) SELECT p.j::BIGINT AS i, q.j AS j, round(sum(p.v * q.v), 4) AS v FROM a p JOIN a q ON p.i = q.i GROUP BY 1, 2"


@query("gemm_coo", _GRAM)
def gemm_coo(spark, sf):
    a = fx.matrix(spark, sf)
    got = la.multiply(la.transpose(a), a)
    return got.select(F.col("i").cast("long").alias("i"), "j", F.round("v", 4).alias("v"))


@query("gemm_tiled", _GRAM)
def gemm_tiled(spark, sf):
    a = fx.matrix(spark, sf)
    n = fx.table(spark, sf, "embeddings").count()
    left = la.to_tiles(la.transpose(a), DIM, n, 64)
    right = la.to_tiles(a, n, DIM, 64)
    got = la.from_tiles(la.multiply_tiles(left, right, n, 64), DIM, 64)
    return got.select("i", "j", F.round("v", 4).alias("v"))


@query("tiles_placed", f"""SELECT (CASE WHEN ti % 2 = 0 THEN 0 ELSE 1 END + 2 * (tj % 2))::INT AS place, (CASE WHEN ti % 2 = 0 THEN 0 ELSE 1 END + 2 * (tj % 2))::INT AS partition, count(DISTINCT (ti, tj)) AS tiles, round(sum(v), 4) AS total
FROM (SELECT i // 16 AS ti, j // 16 AS tj, v FROM ({MATRIX})) GROUP BY 1, 2""")
def tiles_placed(spark, sf):
    """The whole table as tiles, each in the partition of its owner; their sums are taken there, without a further exchange."""
    a = fx.matrix(spark, sf)
    tiles = la.placed(la.to_tiles(a, fx.table(spark, sf, "embeddings").count(), DIM, 16), 4)
    sums = tiles.select("place", F.spark_partition_id().alias("partition"), F.aggregate("data", F.lit(0.0), lambda t, x: t + x).alias("v"))
    return sums.groupBy("place").agg(F.max("partition").alias("partition"), F.count(F.lit(1)).alias("tiles"), F.round(F.sum("v"), 4).alias("total"))


@query("gemm_sampled_check", f"""WITH a AS ({MATRIX}), spots AS (SELECT t, 97 * t % {DIM} AS i, 53 * t % {DIM} AS j FROM (SELECT unnest(range(0, 8)) AS t))
SELECT t, round(sum(p.v * q.v), 4) AS v FROM spots s JOIN a p ON p.j = s.i JOIN a q ON q.j = s.j AND q.i = p.i GROUP BY t""")
def gemm_sampled_check(spark, sf):
    a = fx.matrix(spark, sf)
    at = spark.range(8).select(F.col("id").alias("t"), (F.col("id") * 97 % DIM).alias("i"), (F.col("id") * 53 % DIM).cast("int").alias("j"))
    got = la.multiply(la.transpose(a), a)
    return got.join(F.broadcast(at), ["i", "j"]).select("t", F.round("v", 4).alias("v"))  # eight rows


#: The whole table as a sparse square matrix, n x n with entries in its first columns.
_SQUARE = f"WITH a AS ({MATRIX})"


@query("transpose_add", f"{_SQUARE} SELECT i, j::INT AS j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, v FROM a) GROUP BY 1, 2")
def transpose_add(spark, sf):
    return la.transpose_add(fx.matrix(spark, sf)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.round("v", 6).alias("v"))


@query("normalize_sum", f"{_SQUARE} SELECT round(sum(v / greatest(m, 1e-6)), 4) AS total FROM a, (SELECT max(v) AS m FROM a)")
def normalize_sum(spark, sf):
    a = fx.matrix(spark, sf)
    top = a.agg(F.greatest(F.max("v"), F.lit(1e-6)).alias("m"))
    return a.crossJoin(F.broadcast(top)).agg(F.round(F.sum(F.col("v") / F.col("m")), 4).alias("total"))  # one row


@query("scale_sum", f"{_SQUARE} SELECT round(sum(v * 2), 4) AS total FROM a")
def scale_sum(spark, sf):
    return fx.matrix(spark, sf).agg(F.round(F.sum(F.col("v") * 2), 4).alias("total"))


@query("independent_sums", f"SELECT (i % 4)::BIGINT AS array_id, round(sum(v), 4) AS total FROM ({MATRIX}) GROUP BY 1")
def independent_sums(spark, sf):
    return fx.matrix(spark, sf).groupBy((F.col("i") % 4).alias("array_id")).agg(F.round(F.sum("v"), 4).alias("total"))


#: The side of a matrix that grows with the tables, all ones but for its side on the diagonal.
_SIDE = "n AS (SELECT 20 + floor(sqrt(count(*)))::BIGINT AS n FROM part)"
_SPD = f"WITH {_SIDE} SELECT i, j::INT AS j, CASE WHEN i = j THEN n ELSE 1.0 END::DOUBLE AS v FROM n, LATERAL (SELECT unnest(range(0, n)) AS i), LATERAL (SELECT unnest(range(0, n)) AS j)"
#: Column by column: s is the sum of squares of a row's entries so far, equal for all rows below the diagonal.
_CHOL = f"""WITH RECURSIVE {_SIDE}, c AS (
  SELECT n, 0 AS j, 0.0::DOUBLE AS s, sqrt(n::DOUBLE) AS d, 1.0 / sqrt(n::DOUBLE) AS o FROM n
  UNION ALL SELECT n, j + 1, s + o * o, sqrt(n - (s + o * o)), (1 - (s + o * o)) / sqrt(n - (s + o * o)) FROM c WHERE j < n - 1)
SELECT i::BIGINT AS i, j::INT AS j, round(CASE WHEN i = j THEN d ELSE o END, 6) AS v FROM c, LATERAL (SELECT unnest(range(0, n)) AS i) WHERE i >= j"""


def _side(spark, sf) -> int:
    return 20 + math.isqrt(fx.table(spark, sf, "part").count())


@query("spd_matrix", _SPD)
def spd_matrix(spark, sf):
    return la.spd_ones(spark, _side(spark, sf))


@query("diagonal_boost", f"{_SQUARE} SELECT i, j::INT AS j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT DISTINCT i, i, 64.0::DOUBLE FROM a) GROUP BY 1, 2")
def diagonal_boost(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    return la.diagonal_boost(fx.matrix(spark, sf), 64.0, n).select("i", "j", F.round("v", 6).alias("v"))


@query("cholesky_closed_form", _CHOL)
def cholesky_closed_form(spark, sf):
    """The factor of ones + (n - 1) I from its recurrence, folded in the engine."""
    n = _side(spark, sf)
    first = F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<struct<d: double, o: double>>)").alias("out"))

    def column(acc, _):
        d = F.sqrt(n - acc["s"])
        o = (1 - acc["s"]) / d
        return F.struct((acc["s"] + o * o).alias("s"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), o.alias("o")))).alias("out"))

    cols = spark.range(1).select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, column, lambda a: a["out"])).alias("j", "c"))
    grid = cols.select("j", "c", F.explode(F.sequence(F.col("j"), F.lit(n - 1))).alias("i"))
    return grid.select(F.col("i").cast("long").alias("i"), "j", F.round(F.when(F.col("i") == F.col("j"), F.col("c.d")).otherwise(F.col("c.o")), 6).alias("v"))


@query("cholesky_tiled", _CHOL)
def cholesky_tiled(spark, sf):
    n = _side(spark, sf)
    tiles = la.cholesky_tiles(la.to_tiles(la.spd_ones(spark, n), n, n, 2 * SIZE), n, 2 * SIZE)
    return la.from_tiles(tiles, n, 2 * SIZE).filter("i >= j").select("i", "j", F.round("v", 6).alias("v"))


_SPD_DATA = f"WITH a AS ({MATRIX}), n AS (SELECT count(*)::DOUBLE AS n FROM embeddings) SELECT p.j::BIGINT AS i, q.j::INT AS j, round(sum(p.v * q.v) / max(n) + CASE WHEN p.j = q.j THEN 1.0 ELSE 0 END, 6) AS v FROM a p JOIN a q ON p.i = q.i, n GROUP BY p.j, q.j"


def _spd(spark, sf):
    """The covariance of the embeddings about zero, plus the unit matrix."""
    a, n = fx.matrix(spark, sf), fx.table(spark, sf, "embeddings").count()
    gram = la.multiply(la.transpose(a), a).select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), (F.col("v") / n).alias("v"))
    return la.diagonal_boost(gram, 1.0)


@query("spd_from_data", _SPD_DATA)
def spd_from_data(spark, sf):
    return _spd(spark, sf).withColumn("v", F.round("v", 6))


@query("cholesky_from_data", _SPD_DATA)
def cholesky_from_data(spark, sf):
    """The factor of a matrix made of the whole table, multiplied by its transpose: the matrix again."""
    factor = la.from_tiles(la.cholesky_tiles(la.to_tiles(_spd(spark, sf), DIM, DIM, SIZE), DIM, SIZE), DIM, SIZE).filter("i >= j")
    got = la.multiply(factor, la.transpose(factor))
    return got.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.round("v", 6).alias("v"))


@query("frob_close", f"""{_SQUARE}, t AS (SELECT coalesce(p.v, 0) AS p, coalesce(q.v, 0) AS q FROM a p FULL JOIN (SELECT j AS i, i AS j, v FROM a) q ON p.i = q.i AND p.j = q.j)
SELECT round(sqrt(sum(pow(p - q, 2))), 4) AS distance, round(greatest(sqrt(sum(p * p)), sqrt(sum(q * q))), 4) AS norm, sqrt(sum(pow(p - q, 2))) <= 1e-3 * greatest(sqrt(sum(p * p)), sqrt(sum(q * q))) AS close FROM t""")
def frob_close(spark, sf):
    a = fx.matrix(spark, sf)
    t = la.transpose(a).select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), "v")
    return la.closeness(a, t, 1e-3).select(F.round("distance", 4).alias("distance"), F.round("norm", 4).alias("norm"), "close")


# --- particles ------------------------------------------------------------------------------------------


def _spread_sql(v: str) -> str:
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = f"(({v}) | (({v}) << {shift})) & {mask}" if shift > 8 else f"(({v}) | (({v}) * {1 << shift})) & {mask}"
    return v


def _cell_sql(c: str) -> str:
    return f"least(floor(greatest(0.0, least(1.0, {c})) * 2097152)::BIGINT, 2097151)"


def _code_sql() -> str:
    """Bit by bit: bit b of axis k becomes bit 3b + k."""
    return "SELECT id, list_sum(list_transform(range(0, 21), lambda b: (((cx >> b) & 1) << (3 * b)) + (((cy >> b) & 1) << (3 * b + 1)) + (((cz >> b) & 1) << (3 * b + 2))))::BIGINT AS code, x, y, z, mass FROM (SELECT *, " + ", ".join(f"{_cell_sql(a)} AS c{a}" for a in "xyz") + f" FROM ({PARTICLES}))"


@query("morton_codes", f"SELECT id, code FROM ({_code_sql()})")
def morton_codes(spark, sf):
    return fx.particles(spark, sf).select("id", nb.morton(F.col("x"), F.col("y"), F.col("z")).alias("code"))


@query("morton_ntile", f"SELECT id, code, ntile(7) OVER (ORDER BY code, id)::INT AS seg FROM ({_code_sql()})")
def morton_ntile(spark, sf):
    return nb.segments(fx.particles(spark, sf), 7).select("id", "code", "seg")


@query("com_by_segment", f"SELECT seg, round(sum(mass), 6) AS mass, round(sum(mass * x) / sum(mass), 6) AS cx, round(sum(mass * y) / sum(mass), 6) AS cy, round(sum(mass * z) / sum(mass), 6) AS cz FROM (SELECT *, ntile(7) OVER (ORDER BY code, id)::INT AS seg FROM ({_code_sql()})) GROUP BY seg")
def com_by_segment(spark, sf):
    got = nb.centres(nb.segments(fx.particles(spark, sf), 7), ["seg"])
    return got.select("seg", *[F.round(c, 6).alias(c) for c in ("mass", "cx", "cy", "cz")])


_D2 = f"greatest((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z), {nb.EPS2}::DOUBLE)"
_ACC = f"SELECT a.id, " + ", ".join(f"sum(b.mass / {_D2} * (b.{k} - a.{k}) / sqrt({_D2})) AS a{k}" for k in "xyz") + f" FROM ({PARTICLES}) a JOIN ({PARTICLES}) b ON a.id <> b.id GROUP BY a.id"  # noqa: F541
_ROUND = "SELECT id, round(ax, 4) AS ax, round(ay, 4) AS ay, round(az, 4) AS az FROM ({})"


@query("direct_sum", _ROUND.format(_ACC))
def direct_sum(spark, sf):
    return nb.accelerations(fx.particles(spark, sf)).select("id", *[F.round(c, 4).alias(c) for c in ("ax", "ay", "az")])


@query("bh_force_exact", _ROUND.format(_ACC))
def bh_force_exact(spark, sf):
    """An opening angle of 0 opens every node: the tree walk must give the direct sum."""
    return nb.tree_accelerations(fx.particles(spark, sf), 0.0).select("id", *[F.round(c, 4).alias(c) for c in ("ax", "ay", "az")])


def _tree_sql(source: str) -> str:
    """Recursive tables of the median-split trees of ``source`` (seg, id, x, y, z, mass): t has each particle once a level, nodes
    and home follow from it."""
    moved = ", ".join(f"l{a} + CASE WHEN axis = {k} AND up = 1 THEN size / 2 ELSE 0 END" for k, a in enumerate("xyz"))
    return f"""t AS (
  SELECT seg, id, x, y, z, mass, 1::BIGINT AS node, 0 AS depth, id::BIGINT AS prev, 0.0::DOUBLE AS lx, 0.0::DOUBLE AS ly, 0.0::DOUBLE AS lz, 1.0::DOUBLE AS size FROM ({source})
  UNION ALL
  SELECT seg, id, x, y, z, mass, node * 2 + up, depth + 1, r, {moved}, size / 2 FROM (
    SELECT *, (r > (n + 1) // 2)::INT AS up FROM (
      SELECT *, row_number() OVER (PARTITION BY seg, node ORDER BY CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END, prev) AS r FROM (
        SELECT *, CASE WHEN ex >= ey AND ex >= ez THEN 0 WHEN ey >= ez THEN 1 ELSE 2 END AS axis FROM (
          SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS ex, max(y) OVER w - min(y) OVER w AS ey, max(z) OVER w - min(z) OVER w AS ez
          FROM t WINDOW w AS (PARTITION BY seg, node)) WHERE n > {nb.LEAF})))
), nodes AS (
  SELECT seg, node, depth, count(*) AS n, sum(mass) AS mass, {", ".join(f"sum(mass * {a}) / sum(mass) AS c{a}" for a in "xyz")}, {", ".join(f"l{a} + size / 2 AS g{a}" for a in "xyz")}, size, count(*) <= {nb.LEAF} AS is_leaf
  FROM t GROUP BY seg, node, depth, lx, ly, lz, size
), home AS (SELECT t.seg, t.id, t.x, t.y, t.z, t.mass, t.node FROM t JOIN nodes ON nodes.seg = t.seg AND nodes.node = t.node WHERE is_leaf)"""


def _walk_sql(theta: float) -> str:
    """f: (id, ax, ay, az) parts from those trees; w has the nodes that each particle gets to."""
    d2 = f"greatest((cx - w.x) * (cx - w.x) + (cy - w.y) * (cy - w.y) + (cz - w.z) * (cz - w.z), {nb.EPS2}::DOUBLE)"
    e2 = f"greatest((h.x - w.x) * (h.x - w.x) + (h.y - w.y) * (h.y - w.y) + (h.z - w.z) * (h.z - w.z), {nb.EPS2}::DOUBLE)"
    far = f"""NOT is_leaf AND NOT exists(SELECT 1 FROM t WHERE t.seg = w.seg AND t.id = w.id AND t.node = w.node)
      AND size / greatest(sqrt({d2}) - sqrt((cx - gx) * (cx - gx) + (cy - gy) * (cy - gy) + (cz - gz) * (cz - gz)), {nb.EPS2 ** 0.5}::DOUBLE) <= {theta}"""
    return f"""w AS (
  SELECT seg, id, x, y, z, 1::BIGINT AS node FROM home
  UNION ALL
  SELECT w.seg, w.id, w.x, w.y, w.z, 2 * w.node + side FROM w JOIN nodes n ON n.seg = w.seg AND n.node = w.node, (SELECT unnest([0, 1]) AS side) WHERE NOT is_leaf AND NOT ({far})
), f AS (
  SELECT w.id, {", ".join(f"n.mass / {d2} / sqrt({d2}) * (c{a} - w.{a}) AS a{a}" for a in "xyz")} FROM w JOIN nodes n ON n.seg = w.seg AND n.node = w.node WHERE {far}
  UNION ALL
  SELECT w.id, {", ".join(f"h.mass / {e2} / sqrt({e2}) * (h.{a} - w.{a})" for a in "xyz")} FROM w JOIN nodes n ON n.seg = w.seg AND n.node = w.node AND is_leaf JOIN home h ON h.seg = w.seg AND h.node = w.node WHERE h.id <> w.id
)"""


_ONE_TREE = _tree_sql(f"SELECT 0 AS seg, * FROM ({PARTICLES})")
_SUMS = "SELECT id, sum(ax) AS ax, sum(ay) AS ay, sum(az) AS az FROM {} GROUP BY id"
_PLACES = {"mass": 6, **{f"{k}{a}": 6 for k in "cg" for a in "xyz"}}


def _forces(df):
    return df.select("id", *[F.round(c, 4).alias(c) for c in ("ax", "ay", "az")])


@query("bh_force", f"WITH RECURSIVE {_ONE_TREE}, {_walk_sql(0.5)} " + _ROUND.format(_SUMS.format("f")))
def bh_force(spark, sf):
    return _forces(nb.tree_accelerations(fx.particles(spark, sf), 0.5))


_SEGMENTS = f"SELECT ntile(2) OVER (ORDER BY code, id)::INT AS seg, * FROM ({_code_sql()})"
_S2 = f"greatest((cx - p.x) * (cx - p.x) + (cy - p.y) * (cy - p.y) + (cz - p.z) * (cz - p.z), {nb.EPS2}::DOUBLE)"


@query("bh_segment_force", f"""WITH RECURSIVE p AS ({_SEGMENTS}), {_tree_sql("SELECT * FROM p")}, {_walk_sql(0.5)}, s AS (SELECT seg, sum(mass) AS mass, {", ".join(f"sum(mass * {a}) / sum(mass) AS c{a}" for a in "xyz")} FROM p GROUP BY seg),
both_ AS (SELECT * FROM f UNION ALL SELECT p.id, {", ".join(f"s.mass / {_S2} / sqrt({_S2}) * (c{a} - p.{a})" for a in "xyz")} FROM p JOIN s ON s.seg <> p.seg) """ + _ROUND.format(_SUMS.format("both_")))
def bh_segment_force(spark, sf):
    return _forces(nb.segment_accelerations(fx.particles(spark, sf), 2, 0.5))


@query("bh_tree", f"WITH RECURSIVE {_ONE_TREE} SELECT node, depth, n, {', '.join(f'round({c}, {k}) AS {c}' for c, k in _PLACES.items())}, size, is_leaf FROM nodes")
def bh_tree(spark, sf):
    return nb.tree(fx.particles(spark, sf))[0].withColumns({c: F.round(c, k) for c, k in _PLACES.items()})


_DT = 0.0001
_STEP = "SELECT p.id, " + ", ".join(f"round(p.{k} + (p.v{k} + a.a{k} * {_DT}) * {_DT}, 6) AS {k}, round(p.v{k} + a.a{k} * {_DT}, 4) AS v{k}" for k in "xyz") + f" FROM ({PARTICLES}) p JOIN ({_ACC}) a ON a.id = p.id"


@query("nbody_step", _STEP)
def nbody_step(spark, sf):
    p = fx.particles(spark, sf)
    got = nb.step(p, nb.accelerations(p), _DT)
    return got.select("id", *[F.round(k, 6).alias(k) for k in "xyz"], *[F.round(f"v{k}", 4).alias(f"v{k}") for k in "xyz"])


@query("potential_energy", f"SELECT round(sum(-a.mass * b.mass / sqrt({_D2})), 2) AS potential FROM ({PARTICLES}) a JOIN ({PARTICLES}) b ON a.id < b.id")
def potential_energy(spark, sf):
    return nb.potential(fx.particles(spark, sf)).select(F.round("potential", 2).alias("potential"))


@query("kinetic_momentum", "SELECT round(sum(0.5 * mass * (x * x + y * y + z * z)), 4) AS kinetic, round(sum(mass * x), 4) AS px, round(sum(mass * y), 4) AS py, round(sum(mass * z), 4) AS pz FROM (" + PARTICLES + ")")
def kinetic_momentum(spark, sf):
    """The positions stand for velocities, which the fixture has as zero."""
    p = fx.particles(spark, sf).select("id", "mass", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    return nb.kinetic(p).select(*[F.round(c, 4).alias(c) for c in ("kinetic", "px", "py", "pz")])


_ERROR = f"sqrt({' + '.join(f'pow(b.a{k} - e.a{k}, 2)' for k in 'xyz')}) / (sqrt({' + '.join(f'pow(e.a{k}, 2)' for k in 'xyz')}) + 1e-12)"


@query("rel_error_summary", f"""WITH RECURSIVE {_ONE_TREE}, {_walk_sql(0.5)}, b AS ({_SUMS.format("f")}), e AS ({_ACC}), r AS (SELECT {_ERROR} AS error FROM b JOIN e ON e.id = b.id)
SELECT round(avg(error), 9) AS mean, round(median(error), 9) AS median, round(quantile_cont(error, 0.95), 9) AS p95, round(max(error), 9) AS max FROM r""")
def rel_error_summary(spark, sf):
    """Error of the tree walk against direct sums: mean, median, 95th percentile, most."""
    p = cut(fx.particles(spark, sf))
    e = cut(nb.relative_errors(nb.tree_accelerations(p, 0.5), nb.accelerations(p)))
    return ss.summary(e, [], "error").select(*[F.round(c, 9).alias(c) for c in ("mean", "median", "p95", "max")])
