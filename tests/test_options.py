"""Options from arguments and environments, validated choices, lookups that must match."""

import pytest
from pyspark.sql import functions as F

from gridspark.functions import passk
from gridspark.functions.options import Option, resolved

OPTIONS = [
    Option("size", "int", 5, env="SIZE"), Option("big", "long", None), Option("rate", "double", 0.5, env="RATE"), Option("dry_run", "flag", False, env="DRY"),
    Option("name", "text", "none"), Option("sizes", "ints", [1, 2]), Option("tags", "texts", (), choices=("a", "b", "c")),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, a, e, "kept") for k, (a, e) in enumerate(rows)], "id int, args array<string>, env map<string, string>, size_ string")


def run(spark, args, env=None, unknown="skip"):
    (row,) = resolved(frame(spark, [(args, env)]), OPTIONS, env="env", unknown=unknown).collect()
    return row


def test_types_defaults_and_precedence(spark):
    cases = [
        ([], None, (5, None, 0.5, False, "none", [1, 2], [])),
        (None, {}, (5, None, 0.5, False, "none", [1, 2], [])),
        (["--size=7"], {"SIZE": "9"}, (7, None, 0.5, False, "none", [1, 2], [])),
        ([], {"SIZE": " 9 ", "RATE": "1e-3", "DRY": "Yes"}, (9, None, 0.001, True, "none", [1, 2], [])),
        (["--size", "7", "--size=8", "--dry-run", "--name", "--odd"], {"DRY": "no"}, (8, None, 0.5, True, "--odd", [1, 2], [])),
        (["--dry-run=false", "--big", "9007199254740993", "--name=a=b\n c"], {"DRY": "1"}, (5, 9007199254740993, 0.5, False, "a=b\n c", [1, 2], [])),
        (["--sizes", "3, 4,,5", "--tags=b,a,b", "--name="], None, (5, None, 0.5, False, "", [3, 4, 5], ["b", "a", "b"])),
        (["stray", "--no-such", "x", "--other=1", "--size=2"], None, (2, None, 0.5, False, "none", [1, 2], [])),
    ]
    got = resolved(frame(spark, [(a, e) for a, e, _ in cases]), OPTIONS, env="env").orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [w for *_, w in cases] and got[0].size_ == "kept"
    assert resolved(frame(spark, []), OPTIONS, env="env").count() == 0
    assert resolved(frame(spark, [(["--size=3"], None)]).drop("env"), OPTIONS).first().size == 3


@pytest.mark.parametrize("args,env,unknown,match", [
    (["--size=x"], None, "skip", "size: not a value of type int: x"), (["--size=1.5"], None, "skip", "not a value"), ([], {"RATE": "fast"}, "skip", "rate"),
    (["--dry-run=maybe"], None, "skip", "dry_run"), (["--sizes=1,b"], None, "skip", "sizes"), (["--tags=a,d"], None, "skip", "d is not one of a, b, c"),
    (["--size"], None, "skip", "no value for --size"), (["--no-such=1"], None, "refuse", "unknown argument --no-such"), (["--no-such"], None, "refuse", "unknown argument"), (["stray"], None, "refuse", "unknown argument stray"),
])
def test_errors(spark, args, env, unknown, match):
    with pytest.raises(Exception, match=match):
        run(spark, args, env, unknown)


def test_definitions(spark):
    with pytest.raises(ValueError, match="kind of x"):
        Option("x", "complex")
    with pytest.raises(ValueError, match="skipped or refused"):
        resolved(frame(spark, []), OPTIONS, unknown="warn")


def test_choices(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "variant string, n int")
    assert passk.choose_any(df, "variant", None).count() == 4 and passk.choose_any(df, "variant", []).count() == 0
    assert sorted(r.n for r in passk.choose_any(df, "variant", ["b", "b"]).collect()) == [2, 3]
    with pytest.raises(ValueError, match="no variant named 'c', 'd'; choices: .*a, b"):
        passk.choose_any(df, "variant", ["a", "d", "c"])
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "variant string")
    assert passk.choose_any(df, "variant", ["c", "a"], known).count() == 1
    assert passk.choose_any(df.withColumn("variant", F.col("n")), "variant", ["1", "4"]).count() == 2


def test_must_match(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "task string, n int")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("z", 30)], "task string, level int")
    assert sorted((r.n, r.level) for r in passk.must_match(rows, table, "task").collect()) == [(1, 10), (2, 20), (3, 10)]
    with pytest.raises(Exception, match="unknown task b"):
        passk.must_match(rows, table.filter("task <> 'b'"), "task").collect()
    with pytest.raises(Exception, match="unknown task NULL"):
        passk.must_match(rows.union(spark.createDataFrame([(None, 4)], rows.schema)), table, "task").collect()
