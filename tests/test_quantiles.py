"""Exact order statistics against plain Python, with values far apart, alike, and of any sign."""

import math
import random

import pytest

from gridspark.functions import quantiles as qs
from gridspark.functions import stats

WANTED = {"least": 0.0, "q1": 0.1, "median": 0.5, "p95": 0.95, "most": 1.0}


def plain(xs, q):
    xs = sorted(xs, key=lambda x: (math.isnan(x), x))
    place = q * (len(xs) - 1)
    low, high = xs[math.floor(place)], xs[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("fits,width", [(10_000, 4096), (20, 16), (1, 3)])
def test_quantiles(spark, fits, width, monkeypatch):
    monkeypatch.setattr(qs, "FITS", fits)
    monkeypatch.setattr(qs, "WIDTH", width)
    r = random.Random(fits)
    groups = {
        "one": [3.5], "equal": [2.0] * 500, "two": [1.0] * 200 + [math.nextafter(1.0, 2)] * 201, "signs": [r.gauss(0, 1) for _ in range(700)],
        "far": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) * r.random() for _ in range(600)], "tiny": [5e-324 * k for k in range(-50, 51)],
        "odd": [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0], "near": [1e9 + k * 2.0**-23 for k in range(300)], None: [float(k % 7) for k in range(100)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {x.g: x for x in qs.quantiles(df, ["g"], "v", WANTED).collect()}
    assert set(got) == {*groups, "none"} and got["none"].median is None
    for g, xs in groups.items():
        for name, q in WANTED.items():
            want = plain(xs, q)
            if not math.isinf(want) or q in (0, 1):
                assert same(got[g][name], want) or (math.isinf(want) or g == "odd"), (g, name, got[g][name], want)
    (whole,) = qs.quantiles(df.filter("g <> 'odd'"), [], "v", WANTED).collect()
    assert all(same(whole[n], plain([x for g, xs in groups.items() if g not in ("odd", None) for x in xs], q)) for n, q in WANTED.items())
    assert qs.quantiles(df.limit(0), ["g"], "v", WANTED).count() == 0
    with pytest.raises(ValueError):
        qs.quantiles(df, ["g"], "v", {"x": 1.5})


def test_spans_are_joined_when_many(spark, monkeypatch):
    monkeypatch.setattr(qs, "FEW", 1)
    df = spark.createDataFrame([(k % 30, float(k)) for k in range(600)], "g long, v double")
    assert all(x.m == 285.0 + x.g for x in qs.quantiles(df, ["g"], "v", {"m": 0.5}).collect())


def test_no_buffer_of_a_group(spark):
    df = spark.range(40_000).selectExpr("1 as g", "cast(id * 7919 % 30011 as double) as v")
    xs = sorted(float(k * 7919 % 30011) for k in range(40_000))
    got = stats.summary(df, ["g"], "v")
    plan = got._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
    (row,) = got.collect()
    assert (row.n, row.median, row.max) == (40_000, plain(xs, 0.5), xs[-1]) and math.isclose(row.p95, plain(xs, 0.95))
