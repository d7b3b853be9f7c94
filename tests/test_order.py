"""Ranks over whole tables, with few and with many buckets."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import order


@pytest.mark.parametrize("most,each", [(order.CUTS, 10_000), (order.CUTS, 7), (300, 2), (5, 7)])
def test_buckets(spark, most, each):
    r = random.Random(3)
    keys = [r.choice([r.randint(-50, 50), r.randint(-(2**62), 2**62), 7, None]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    cuts = order.bounds(df, "k", each, most)
    got = sorted((x.k is not None, x.k or 0, x.b) for x in df.select("k", order.bucket("k", cuts).alias("b")).collect())
    assert [b for *_, b in got] == sorted(b for *_, b in got) and len({b for *_, b in got}) <= most * order.STEPS + 1
    if (most, each) == (5, 7):
        assert cuts.steps > 1 and len({b for *_, b in got}) > 30


def test_ranks_by_any_keys(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["", None, "a", "ab", "Ä", "zz"] + [f"Supplier#{r.randint(0, 999):09d}"] * 6), r.choice([None, float(r.randint(-9, 9)), -0.5])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, name string, x double").repartition(5)
    asc = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, (v or "").encode())
    for keys, want in (
        (["name", "x", "id"], sorted(rows, key=lambda t: (text(t[1]), asc(t[2]), t[0]))),
        (["x", F.col("name").desc_nulls_last(), "id"], sorted(sorted(sorted(rows, key=lambda t: t[0]), key=lambda t: text(t[1]), reverse=True), key=lambda t: asc(t[2]))),
    ):
        got = {x["rank"]: x.id for x in order.ranked(df, keys).collect()}
        assert [got[i + 1] for i in range(len(rows))] == [t[0] for t in want]


def test_equal_keys_are_spread_and_keep_their_order(spark):
    df = spark.range(4000).select("id", F.lit("Supplier").alias("name"))
    sizes = [r["count"] for r in order.in_order(df, ["name"]).groupBy(F.spark_partition_id()).count().collect()]
    with_names = [r["count"] for r in order.in_order(df.withColumn("name", F.format_string("Supplier#%09d", "id")), ["name"]).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = [r["count"] for r in order.in_order(df, ["name"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == sum(with_names) == sum(spread) == 4000 and len(spread) == 8 and max(spread) < 1500
    assert all(x["rank"] == x.id + 1 for x in order.ranked(df, ["name"]).collect())


def test_ranks_in_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(k, k % 3, k % 5) for k in range(60)], "id long, g int, k long")
    got = {(x.g, x.rank): x.id for x in order.ranked(df, ["k", "id"], by=["g"]).collect()}
    for g in range(3):
        assert [got[g, i] for i in range(1, 21)] == sorted((k for k in range(60) if k % 3 == g), key=lambda k: (k % 5, k))
    assert order.ranked(df.limit(0), ["k", "id"]).count() == 0
    assert spark.range(3).select(F.col("id").alias("k")).select(order.bucket("k", order.Cuts())).distinct().count() == 1
