"""Readers, writers and generators: errors, odd lines, and runs that go on from earlier ones."""

import pytest
from pyspark.sql import functions as F

from gridspark.functions import passk, stats, text
from gridspark.operators import stencil
from gridspark.sources import delimited, files, generators, sinks
from gridspark.streaming import logs


def lines(path, *texts):
    path.mkdir(exist_ok=True)
    for k, t in enumerate(texts):
        (path / f"{len(list(path.iterdir()))}-{k}.txt").write_text(t)
    return str(path)


GOOD = '{"task": "t", "model": "m", "sample_id": 1, "passed": true, "elapsed_sec": 2}'


def test_json_lines(spark, tmp_path):
    at = lines(tmp_path / "a", f'{GOOD}\n\n   \n{GOOD[:-1]}, "framework": "tasks", "reference_passed": false}}\n')
    got = sorted((r.framework, r.elapsed_sec, r.reference_passed, r.reference_elapsed_sec) for r in files.read_samples(spark, at).collect())
    assert got == [("arrays", 2.0, None, None), ("tasks", 2.0, False, None)]
    for bad in ("not json", GOOD.replace('"m"', "3.5.1"), GOOD.replace('"sample_id": 1, ', ""), GOOD.replace("true", '"yes"')):
        with pytest.raises(Exception):
            files.read_samples(spark, lines(tmp_path / f"bad{abs(hash(bad))}", bad)).collect()


def test_json_documents(spark, tmp_path):
    at = lines(tmp_path / "d", '[{"id": "a", "n": 1}, {"id": "", "n": 2}, {"n": 3}]', ' {"id": "b", "n": 4}', '\n{"c": {"n": 5}, "": {"n": 6}}')
    assert sorted(tuple(r) for r in files.json_document(spark, at, "n int").collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_csv(spark, tmp_path):
    kind = "name string, size int, sec double"
    at = lines(tmp_path / "c", "name,size,sec\nb,2,0.5\n\na,1,missing\n", "name,size,sec\nc,3,1.5")
    assert sorted(tuple(r) for r in delimited.read_csv(spark, at, kind).collect()) == [("a", 1, None), ("b", 2, 0.5), ("c", 3, 1.5)]
    for bad in ("a,1", "a,1,2,3", "a,one,2"):
        with pytest.raises(Exception):
            delimited.read_csv(spark, lines(tmp_path / f"x{bad}", f"name,size,sec\n{bad}\n"), kind).collect()
    assert delimited.merged_csv(spark, [at, f"{tmp_path}/absent", at], kind).count() == 6 and delimited.merged_csv(spark, [f"{tmp_path}/absent"], kind).count() == 0


ODD = ["", "missing", " pad ", "a,b", 'say "hi"', '"', '""', "two\nlines", "\n\n", "cr\r\nlf\r", "name", "plain", None, 'x","y\n"', "漢字 ü", "\t", "MISSING", "'", "name,text,x"]


@pytest.mark.parametrize("block", ["128m", "97", "31"])
def test_csv_texts_come_back(spark, tmp_path, block):
    rows = [(a, b, float(k)) for k, (a, b) in enumerate((a, b) for a in ODD for b in ODD)] + [("long\n" * 200, "end", None)]
    at = str(tmp_path / "odd")
    df = spark.createDataFrame(rows, "name string, text string, x double")
    delimited.write_csv(df.repartition(2), at)
    delimited.write_csv(df.limit(5), at)
    delimited.write_csv(df.limit(0), at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = delimited.read_csv(spark, at, "name string, text string, x double").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows + rows[:5]))


def test_csv_from_elsewhere(spark, tmp_path):
    kind = "name string, text string, n int"
    at = lines(tmp_path / "w", 'name,text,n\r\n"a ""b""","x\r\ny",1\r\n\r\n c , d,missing\r\n"missing",,"3"\r\n', "name,text,n\n")
    assert sorted(map(repr, map(tuple, delimited.read_csv(spark, at, kind).collect()))) == sorted(map(repr, [('a "b"', "x\r\ny", 1), (" c ", " d", None), ("missing", "", 3)]))
    assert delimited.read_csv(spark, lines(tmp_path / "one", 'n\n1\n"2"\n'), "n int").count() == 2
    for k, bad in enumerate(('"a,b,1', 'a"b,c,1', '"a"b,c,1', '"a",b', '"a","b",1,2', '"a","b","one"', 'a,"b\n",1\n"')):
        with pytest.raises(Exception):
            delimited.read_csv(spark, lines(tmp_path / f"q{k}", f"name,text,n\n{bad}\n"), kind).collect()
    with pytest.raises(ValueError, match="no CSV form of v"):
        delimited.write_csv(spark.createDataFrame([([1],)], "v array<int>"), str(tmp_path / "n"))


def test_markdown(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 2, float("nan")), ("c", None, None)], "name string, n int, x double")
    got = [r.line for r in sinks.markdown_lines(df, ["name"]).orderBy("position").collect()]
    assert got == ["| name | n | x |", "|---|---|---|", "| a | 2 | --- |", "| b | 1 | 2.00 |", "| c |  |  |"]


def test_constant_and_listing(spark, tmp_path):
    at = lines(tmp_path / "s", 'const S = """\n x = 1\n"""\n')
    (row,) = files.constant(files.whole_texts(spark, at), "S").collect()
    assert row.code == "x = 1"
    with pytest.raises(Exception):
        files.constant(files.whole_texts(spark, at), "ABSENT").collect()
    lines(tmp_path / "s", "b", "c")
    assert [r.name for r in files.listing(spark, at, ".txt").collect()] == sorted(p.name for p in (tmp_path / "s").iterdir())


def test_log_that_grows(spark, tmp_path):
    line = lambda n, t, more="": f'{{"message": "timings", "data": {{"nthreads": {n}, "total_s": {t}{more}}}}}\n'
    at, out, state = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "state")
    lines(tmp_path / "log", line(1, 4.0) + "noise\n" + line(2, 3.0, ', "dp_s": 1.5') + '{"message": "timings", "data": {"total_s": 1}}\n')
    first = {r.nthreads: (r.n, r.mean_total_s, r.mean_dp_s) for r in logs.update_summary(spark, at, out, state).collect()}
    assert first[2] == (1, 3.0, 1.5) and first[1][:2] == (1, 4.0) and first[1][2] != first[1][2]
    lines(tmp_path / "log", line(2, 1e0, ', "dp_s": 0.5') + line(4, 2.0))
    second = {r.nthreads: (r.n, r.mean_total_s, r.mean_dp_s) for r in logs.update_summary(spark, at, out, state).collect()}
    assert second[2] == (2, 2.0, 1.0) and second[4][:2] == (1, 2.0) and second[1][:2] == (1, 4.0)


def test_generators(spark):
    world = generators.random_world(spark, 40, 50, 0.25, seed=3)
    rows = {(r.y, r.x): r.a for r in world.collect()}
    assert len(rows) == 2000 and 0.2 < sum(rows.values()) / 2000 < 0.3
    assert rows == {(r.y, r.x): r.a for r in generators.random_world(spark, 40, 50, 0.25, seed=3).repartition(7).collect()}
    assert rows != {(r.y, r.x): r.a for r in generators.random_world(spark, 40, 50, 0.25, seed=4).collect()}
    for bad in ((0, 5, 0.5), (5, -1, 0.5), (5, 5, 1.5)):
        with pytest.raises(ValueError):
            generators.random_world(spark, *bad)
    low, high = generators.random_particles(spark, 500).agg(F.min("x"), F.max("z")).first()
    assert 0 <= low < 0.05 and 0.95 < high < 1
    tiles = {(r.ti, r.tj): list(r.data) for r in generators.matrix_tiles(spark, 8, 4, "spd").collect()}
    assert tiles[0, 0][:2] == [8.0, 1.0] and tiles[0, 1] == [1.0] * 16 and len(tiles) == 4
    assert sorted(len(r.data) for r in generators.matrix_tiles(spark, 5, 3, "ones").collect()) == [4, 6, 6, 9]
    for bad in ((5, 3, "spd"), (5, 3, "odd"), (0, 3, "ones")):
        with pytest.raises(ValueError):
            generators.matrix_tiles(spark, *bad)


def test_choices_and_validators(spark):
    df = spark.createDataFrame([("a",), ("b",)], "task string")
    assert passk.choose(df, "task", "a").count() == 1 and passk.choose(df, "task", None).count() == 2
    with pytest.raises(ValueError, match="choices: a, b"):
        passk.choose(df, "task", "c")
    with pytest.raises(ValueError):
        stencil.boundary_of("torus")
    for alpha in (-0.1, float("nan")):
        with pytest.raises(ValueError):
            stencil.alpha_of(alpha)
    with pytest.raises(Exception):
        df.select(text.int_list(F.lit("4, x"))).collect()
    assert spark.range(1).select(stats.weak_size(F.lit(100), F.lit(4), "sqrt"), stats.weak_size(F.lit(100), F.lit(4), "sqrt", override=7)).first() == (200, 7)
    with pytest.raises(ValueError):
        stats.weak_size(F.lit(1), F.lit(1), "linear", override=0)
