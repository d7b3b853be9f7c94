"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether each ``a`` of ``edges`` has one ``b``, and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or up = 1 and top = 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b longs): the smallest id that it reaches.

    Alternating star contraction: every vertex hooks its larger neighbours to the least vertex
    near it, then its smaller neighbours; depth halves each round, and each shuffle carries one
    row an edge. A hub's edges are grouped by partial minima, never gathered. The rounds end when
    every vertex hangs on one without edges to smaller ones, which edges that are so from the start need none for.
    Self-loops count as vertices; nulls are dropped; an empty list gives an empty table.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    given = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now, rounds = given.filter("a > b"), 0
    while not _settled(now):
        if rounds == max_rounds:
            raise RuntimeError("components did not settle")
        # Large star: each vertex's larger neighbours point to the least of it and its neighbours.
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a vertex and its smaller neighbours point to the least of them.
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        nxt = materialize(small.filter("a > b").distinct(), "edges")
        discard(now)  # not what was given, which has the self-loops
        now, rounds = nxt, rounds + 1
    alone = given.filter("a = b").select(F.col("a").alias("id"), F.col("b").alias("m"))
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("m")).union(now.select(F.col("b").alias("id"), F.col("b").alias("m"))).union(alone)
    return ids.groupBy("id").agg(F.min("m").alias("component"))
