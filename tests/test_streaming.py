"""Runs of logs that grow: however a log is cut, and wherever a run of the stream stops, they are those of the whole log."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridspark.functions import stats
from gridspark.streaming import commits, logs


def whole_log():
    r, rows = random.Random(8), []
    threads = {"a": 1, "b": 2}
    for seq in range(120):
        log = r.choice("ab")
        if r.random() < 0.3:
            threads[log] = r.choice([1, 2, 4])
        rows.append({"log": log, "seq": seq, "nthreads": threads[log], "total_s": r.randint(1, 99) / 4, **({"dp_s": 0.5} if seq % 3 else {})})
    return rows


def put(folder: Path, rows):
    folder.mkdir(exist_ok=True)
    for k in range(2):  # two files a part, lines of both logs in each
        text = "".join(json.dumps({"message": "timings", "data": r}) + "\n" for r in rows if r["seq"] % 2 == k)
        (folder / f"{len(list(folder.iterdir())):03d}.txt").write_text(text + "noise\n")


def expected(rows):
    run, last, out = {}, {}, {}
    for r in rows:
        if last.get(r["log"]) != r["nthreads"]:
            run[r["log"]] = run.get(r["log"], 0) + 1
            last[r["log"]] = r["nthreads"]
        out[r["log"], r["seq"]] = run[r["log"]]
    return out


def found(df):
    rows = df.collect()
    assert len({(r.log, r.seq) for r in rows}) == len(rows)
    return {(r.log, r.seq): r.run for r in rows}


@pytest.mark.parametrize("cuts", [[120], [1, 2, 60, 120], [40, 41, 80, 120]])
def test_runs_go_on(spark, tmp_path, cuts):
    rows, low = whole_log(), 0
    at, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    for high in cuts:
        put(tmp_path / "log", rows[low:high])
        got = logs.update_runs(spark, at, out, state)
        assert found(got) == expected(rows[:high])
        low = high
    again = logs.update_runs(spark, at, out, state)  # nothing has come
    assert found(again) == expected(rows)
    for log in "ab":
        part = again.filter(F.col("log") == log)
        batch = stats.run_stats(stats.drop_first(stats.islands(part.drop("run"), chunk=7)), {"dp_s": "mean_dp"})
        grown = logs.run_table(part).select(batch.columns)
        nan = lambda df: sorted(tuple("nan" if x != x else x for x in r) for r in df.collect())
        assert nan(grown) == nan(batch)


def test_stop_between_write_and_commit(spark, tmp_path, monkeypatch):
    rows = whole_log()
    at, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    put(tmp_path / "log", rows[:50])
    logs.update_runs(spark, at, out, state)
    put(tmp_path / "log", rows[50:])
    mark = commits.mark

    def stop(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(commits, "mark", stop)
    with pytest.raises(Exception, match="stopped"):
        logs.update_runs(spark, at, out, state)
    assert found(commits.committed(spark, out, logs.LINES)) == expected(rows[:50])  # readers see whole batches
    assert len(list((tmp_path / "out" / "data").iterdir())) == 2
    monkeypatch.setattr(commits, "mark", mark)
    assert found(logs.update_runs(spark, at, out, state)) == expected(rows)


def test_batch_that_comes_again_after_its_commit(spark, tmp_path):
    rows = whole_log()
    at, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    put(tmp_path / "log", rows[:50])
    logs.update_runs(spark, at, out, state)
    put(tmp_path / "log", rows[50:])
    logs.update_runs(spark, at, out, state)
    last = max((p for p in (tmp_path / "state" / "commits").iterdir() if not p.name.startswith(".")), key=lambda p: int(p.name))
    last.unlink()  # Spark does not know that it has done this batch
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert found(logs.update_runs(spark, at, out, state)) == expected(rows)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{out}/data/000000000009-left")
    assert found(commits.committed(spark, out, logs.LINES)) == expected(rows)


def test_late_lines(spark, tmp_path):
    rows = whole_log()
    at, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    put(tmp_path / "log", rows[50:])
    logs.update_runs(spark, at, out, state)
    put(tmp_path / "log", rows[:50])
    with pytest.raises(Exception, match="came after"):
        logs.update_runs(spark, at, out, state)
    assert commits.committed(spark, str(tmp_path / "none"), logs.LINES).count() == 0
