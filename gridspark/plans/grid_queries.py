"""Queries over grids, images and tiles, each with the same query in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import seam as sm
from gridspark.operators import stencil as st
from gridspark.plans.iterate import cut, states
from gridspark.sources import fixtures as fx

W, IW, ALPHA = fx.WIDTH, fx.IMAGE_WIDTH, 0.2
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def height(grid: DataFrame) -> int:
    return grid.agg(F.max("y")).first()[0] + 1


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


WORLD, PLATE, IMAGE = fx.SQL["world"], fx.SQL["plate"], fx.SQL["image"]
_OFF = "(VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx)"


def life_sql(source: str, wrap: bool) -> str:
    at = ("(g.y + dy + h) % h", "(g.x + dx + w) % w") if wrap else ("g.y + dy", "g.x + dx")
    return f"""SELECT g.y, g.x, CASE WHEN a = 1 AND s IN (2, 3) OR a = 0 AND s = 3 THEN 1 ELSE 0 END AS a FROM {source} g JOIN (
      SELECT {at[0]} AS y, {at[1]} AS x, sum(a) AS s FROM {source} g, (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM {source}), {_OFF}
      WHERE dy <> 0 OR dx <> 0 GROUP BY 1, 2) n ON n.y = g.y AND n.x = g.x"""


def chain(first: str, step, steps: int, prefix: str) -> str:
    """WITH-clauses prefix0 .. prefix<steps>, each a step from the one before."""
    return "WITH " + ", ".join([f"{prefix}0 AS ({first})", *[f"{prefix}{i} AS MATERIALIZED ({step(f'{prefix}{i - 1}')})" for i in range(1, steps + 1)]])


_LIFE5 = chain(WORLD, lambda s: life_sql(s, True), 5, "w")


@query("grid_world", WORLD)
def grid_world(spark, sf):
    return fx.world(spark, sf)


@query("life_step_wrap", f"WITH w AS ({WORLD}) {life_sql('w', True)}")
def life_step_wrap(spark, sf):
    w = fx.world(spark, sf)
    return st.life_step(w, height(w), W)


@query("life_step_pad", f"WITH w AS ({WORLD}) {life_sql('w', False)}")
def life_step_pad(spark, sf):
    w = fx.world(spark, sf)
    return st.life_step(w, height(w), W, "pad")


@query("life_run5", f"{_LIFE5} SELECT * FROM w5")
def life_run5(spark, sf):
    """Five steps in the tiled form: one exchange of halos."""
    w = fx.world(spark, sf)
    return st.tiled_run(w, height(w), W, "a", st.life_rule, 5, "wrap")


@query("life_alive_by_step", _LIFE5 + " " + " UNION ALL ".join(f"SELECT {i} AS step, sum(a)::BIGINT AS alive FROM w{i}" for i in range(6)))
def life_alive_by_step(spark, sf):
    w = fx.world(spark, sf)
    parts = [s.agg(F.lit(i).alias("step"), F.sum("a").cast("long").alias("alive")) for i, s in states(w, lambda g: st.life_step(g, height(w), W), 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("glider_overlay", f"SELECT y, x, CASE WHEN (y, x) IN ((2, 3), (3, 4), (4, 2), (4, 3), (4, 4)) THEN 1 ELSE a END AS a FROM ({WORLD})")
def glider_overlay(spark, sf):
    w = fx.world(spark, sf)
    return st.overlay(w, height(w), W, 2, 2, st.GLIDER)


@query("blinker_overlay", f"SELECT y, x, CASE WHEN x = 7 AND y BETWEEN 4 AND 6 THEN 1 ELSE a END AS a FROM ({WORLD})")
def blinker_overlay(spark, sf):
    w = fx.world(spark, sf)
    return st.overlay(w, height(w), W, 5, 7, st.blinker(horizontal=False))


def heat_sql(s: str, wrap: bool) -> str:
    def at(way: str, part: str, order: str, end: str) -> str:
        beyond = f"{end}(v) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if wrap else "0.0::FLOAT"
        return f"coalesce({way}(v) OVER (PARTITION BY {part} ORDER BY {order}), {beyond})"

    n, o = at("lag", "x", "y", "last_value"), at("lead", "x", "y", "first_value")
    w, e = at("lag", "y", "x", "last_value"), at("lead", "y", "x", "first_value")
    return f"SELECT y, x, (v + {ALPHA}::FLOAT * ((({n} + {o}) + {w}) + {e} - 4.0::FLOAT * v))::FLOAT AS v FROM {s}"


_R = "SELECT {} y, x, round(v::DOUBLE, 6) AS v FROM {}"
_HEAT = chain(PLATE, lambda s: heat_sql(s, False), 3, "p")


@query("heat_step_pad", f"WITH p AS ({PLATE}), q AS ({heat_sql('p', False)}) {_R.format('', 'q')}")
def heat_step_pad(spark, sf):
    p = fx.plate(spark, sf)
    return rounded(st.heat_step(p, height(p), W, ALPHA), "v")


@query("heat_step_wrap", f"WITH p AS ({PLATE}), q AS ({heat_sql('p', True)}) {_R.format('', 'q')}")
def heat_step_wrap(spark, sf):
    p = fx.plate(spark, sf)
    return rounded(st.heat_step(p, height(p), W, ALPHA, "wrap"), "v")


@query("heat_run", f"{_HEAT} {_R.format('', 'p3')}")
def heat_run(spark, sf):
    p = fx.plate(spark, sf)
    return rounded(st.tiled_run(p, height(p), W, "v", st.heat_rule(ALPHA), 3, "pad", 0.0), "v")


@query("heat_history", _HEAT + " " + " UNION ALL ".join(_R.format(f"{i} AS step,", f"p{i}") for i in (0, 2, 3)))
def heat_history(spark, sf):
    p = fx.plate(spark, sf)
    return rounded(st.heat_history(p, height(p), W, 3, 2, ALPHA), "v")


@query("heat_checksum", f"{_HEAT} SELECT round(sum(v::DOUBLE), 3) AS total, round(min(v)::DOUBLE, 6) AS low, round(max(v)::DOUBLE, 6) AS high, count(*) AS cells FROM p3")
def heat_checksum(spark, sf):
    p = fx.plate(spark, sf)
    got = st.heat(p, height(p), W, 3, ALPHA)
    return got.agg(F.round(F.sum(F.col("v").cast("double")), 3).alias("total"), F.round(F.min("v").cast("double"), 6).alias("low"), F.round(F.max("v").cast("double"), 6).alias("high"), F.count(F.lit(1)).alias("cells"))


@query("max_abs_difference", f"WITH p AS ({PLATE}), q AS ({heat_sql('p', False)}) SELECT round(max(abs(p.v::DOUBLE - q.v::DOUBLE)), 6) AS max_abs, count(*) FILTER (p.v <> q.v) AS n_differ FROM p JOIN q USING (y, x)")
def max_abs_difference(spark, sf):
    p = fx.plate(spark, sf)
    q = st.heat_step(p, height(p), W, ALPHA).withColumnRenamed("v", "u")
    gap = F.abs(F.col("v").cast("double") - F.col("u").cast("double"))
    return p.join(q, ["y", "x"]).agg(F.round(F.max(gap), 6).alias("max_abs"), F.count_if(F.col("v") != F.col("u")).alias("n_differ"))


@query("hotspot_disc", f"SELECT y, x, round(CASE WHEN (y - h) * (y - h) + (x - 49) * (x - 49) <= 36 THEN 1.0 ELSE v::DOUBLE END, 6) AS v FROM ({PLATE}), (SELECT ceil((max(y) + 1) / 2)::INT - 1 AS h FROM ({PLATE}))")
def hotspot_disc(spark, sf):
    p = fx.plate(spark, sf)
    return rounded(st.disc(p, st.centre(height(p)), st.centre(W), 6, 1.0), "v")


@query("hotspot_gauss", f"SELECT y, x, round((v + 0.5 * exp(-((y - h) * (y - h) + (x - 49) * (x - 49)) / (2.0 * 9.0)))::FLOAT::DOUBLE, 4) AS v FROM ({PLATE}), (SELECT ceil((max(y) + 1) / 2)::INT - 1 AS h FROM ({PLATE}))")
def hotspot_gauss(spark, sf):
    p = fx.plate(spark, sf)
    return st.gaussian(p, st.centre(height(p)), st.centre(W), 3.0, 0.5).withColumn("v", F.round(F.col("v").cast("double"), 4))


@query("jacobi_step", f"""WITH g AS ({IMAGE}), d AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM g)
SELECT ((g.y + o.dy + h) % h)::INT AS y, ((g.x + o.dx + w) % w)::INT AS x, round(sum(v) / 5, 6) AS v
FROM g, d, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx) GROUP BY 1, 2""")
def jacobi_step(spark, sf):
    g = fx.image(spark, sf).withColumn("v", F.col("v").cast("double"))
    return rounded(st.jacobi_step(g, height(g), IW), "v")


@query("tile_partition", f"SELECT y, x, (y // 16)::INT AS ty, (x // 32)::INT AS tx, v FROM ({IMAGE})")
def tile_partition(spark, sf):
    return st.tiles(fx.image(spark, sf), 16, 32).select("y", "x", "ty", "tx", "v")


@query("tile_checksum", f"SELECT (y // 16)::INT AS ty, (x // 32)::INT AS tx, sum(v)::BIGINT AS total, count(*) AS cells, true AS finite FROM ({IMAGE}) GROUP BY 1, 2")
def tile_checksum(spark, sf):
    v = F.col("v").cast("double")
    return st.tiles(fx.image(spark, sf), 16, 32).groupBy("ty", "tx").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("cells"), F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"))


@query("tile_owner", f"SELECT DISTINCT (y // 16)::INT AS ti, (x // 16)::INT AS tj, ((y // 16) % 2 + 2 * ((x // 16) % 2) + 1)::BIGINT AS owner4, (1 + (y // 16 + x // 16) % 3)::BIGINT AS owner3 FROM ({IMAGE})")
def tile_owner(spark, sf):
    from gridspark.operators.linalg import tile_owner as owner

    t = st.tiles(fx.image(spark, sf), 16, 16).select(F.col("ty").alias("ti"), F.col("tx").alias("tj")).distinct()
    return t.select("ti", "tj", owner(F.col("ti"), F.col("tj"), 4).cast("long").alias("owner4"), owner(F.col("ti"), F.col("tj"), 3).cast("long").alias("owner3"))


# --- images ---------------------------------------------------------------------------------------------


def energy_sql(s: str) -> str:
    at = lambda way, part, order: f"coalesce({way}(v) OVER (PARTITION BY {part} ORDER BY {order}), v)"
    return f"SELECT y, x, abs({at('lead', 'y', 'x')} - {at('lag', 'y', 'x')}) + abs({at('lead', 'x', 'y')} - {at('lag', 'x', 'y')}) AS v FROM {s}"


def dp_sql(e: str, name: str) -> str:
    """CTEs <name>r (recursive) with y, x, m, b over the energy table ``e``."""
    lo, hi = "lag(p.m) OVER (ORDER BY p.x)", "lead(p.m) OVER (ORDER BY p.x)"
    big = "1e300::DOUBLE"
    return f"""{name} AS (
      SELECT y, x, v::DOUBLE AS m, 0 AS b FROM {e} WHERE y = 0
      UNION ALL
      SELECT e.y, e.x, e.v + least(q.l, q.m, q.r), CASE WHEN q.l <= q.m AND q.l <= q.r THEN -1 WHEN q.m <= q.r THEN 0 ELSE 1 END FROM (
        SELECT p.y, p.x, p.m, coalesce({lo}, {big}) AS l, coalesce({hi}, {big}) AS r FROM {name} p) q
      JOIN {e} e ON e.y = q.y + 1 AND e.x = q.x)"""


def path_sql(dp: str, name: str) -> str:
    return f"""{name} AS (
      (SELECT y, x FROM {dp} WHERE y = (SELECT max(y) FROM {dp}) ORDER BY m, x LIMIT 1)
      UNION ALL SELECT s.y - 1, s.x + d.b FROM {name} s JOIN {dp} d ON d.y = s.y AND d.x = s.x WHERE s.y > 0)"""


def carve_sql(k: int) -> str:
    parts, source = [f"i0 AS ({IMAGE})"], "i0"
    for n in range(1, k + 1):
        parts += [f"e{n} AS ({energy_sql(source)})", dp_sql(f"e{n}", f"d{n}"), path_sql(f"d{n}", f"s{n}"), f"i{n} AS (SELECT i.y, (i.x - (i.x > s.x)::INT)::INT AS x, v FROM {source} i JOIN s{n} s ON s.y = i.y WHERE i.x <> s.x)"]
        source = f"i{n}"
    return "WITH RECURSIVE " + ", ".join(parts)


_DP = f"WITH RECURSIVE i AS ({IMAGE}), e AS ({energy_sql('i')}), {dp_sql('e', 'd')}"


@query("energy", f"WITH i AS ({IMAGE}) {energy_sql('i')}")
def energy(spark, sf):
    i = fx.image(spark, sf)
    return sm.energy(i, height(i), IW)


def _costs(spark, sf):
    i = fx.image(spark, sf)
    h = height(i)
    return sm.cumulative_energy(sm.energy(i, h, IW), h, IW), h


@query("dp_cumulative", f"{_DP} SELECT y, x, m FROM d")
def dp_cumulative(spark, sf):
    return _costs(spark, sf)[0].select("y", "x", "m")


@query("dp_backptr", f"{_DP} SELECT y, x, b FROM d")
def dp_backptr(spark, sf):
    return _costs(spark, sf)[0].select("y", "x", "b")


@query("seam_path", f"{_DP}, {path_sql('d', 's')} SELECT y::INT AS y, x::INT AS s FROM s")
def seam_path(spark, sf):
    costs, h = _costs(spark, sf)
    return sm.seam(cut(costs), h)


@query("seam_remove", f"{carve_sql(1)} SELECT y, x, v FROM i1")
def seam_remove(spark, sf):
    i = fx.image(spark, sf)
    return sm.carve(i, height(i), IW, 1)


@query("carve_k3", f"{carve_sql(3)} SELECT y, x, v FROM i3")
def carve_k3(spark, sf):
    i = fx.image(spark, sf)
    return sm.carve(i, height(i), IW, 3)


@query("strip_geometry", f"SELECT (x // 16)::INT AS strip, count(DISTINCT x)::BIGINT AS width, count(DISTINCT y // 16)::BIGINT AS tiles, count(*) AS cells FROM ({IMAGE}) GROUP BY 1")
def strip_geometry(spark, sf):
    """Vertical strips of the image: columns, tiles and cells of each."""
    cells = st.tiles(fx.image(spark, sf), 16, 16)
    return cells.groupBy(F.col("tx").alias("strip")).agg(F.count_distinct("x").alias("width"), F.count_distinct("ty").alias("tiles"), F.count(F.lit(1)).alias("cells"))
