"""Queries over generators, readers and writers: what is written is read again. Each has the same query in DuckDB SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import passk as pk
from gridspark.functions import stats as ss
from gridspark.operators import order
from gridspark.operators import stencil as st
from gridspark.sources import delimited, files, generators, sinks
from gridspark.sources import fixtures as fx
from gridspark.sources.scratch import scratch
from gridspark.streaming import logs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# --- generators -------------------------------------------------------------------------------------------

IW = fx.IMAGE_WIDTH
_H = f"(SELECT ceil(count(*) / {IW})::BIGINT AS h FROM part)"


def _rows(spark, sf) -> int:
    """As many rows of IW cells as the image fixture has."""
    return -(-fx.table(spark, sf, "part").count() // IW)


def _uniform_sql(seed: int, *keys: str) -> str:
    return f"('0x' || md5(concat_ws(':', '{seed}', {', '.join(keys)}))[1:13])::BIGINT / {float(1 << 52)}"


_CELLS = f"SELECT y::INT AS y, x::INT AS x, h FROM {_H}, LATERAL (SELECT unnest(range(0, h)) AS y), (SELECT unnest(range(0, {IW})) AS x)"


@query("random_world", f"SELECT y, x, ({_uniform_sql(1, 'y', 'x')} < 0.25)::INT AS a FROM ({_CELLS})")
def random_world(spark, sf):
    return generators.random_world(spark, _rows(spark, sf), IW)


@query("ambient_plate", f"SELECT y, x, 0.5::FLOAT AS v FROM ({_CELLS})")
def ambient_plate(spark, sf):
    return generators.ambient_plate(spark, _rows(spark, sf), IW, 0.5)


@query("random_image", f"SELECT y, x, round(({_uniform_sql(42, 'y', 'x')})::FLOAT::DOUBLE, 6) AS v FROM ({_CELLS})")
def random_image(spark, sf):
    return rounded(generators.random_image(spark, _rows(spark, sf), IW), "v")


@query("random_particles", "SELECT id, " + ", ".join(f"round({_uniform_sql(7, 'id', str(k))}, 9) AS {a}" for k, a in enumerate("xyz")) + ", 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 1.0::DOUBLE AS mass FROM (SELECT unnest(range(0, (SELECT count(*) FROM embeddings))) AS id)")
def random_particles(spark, sf):
    return rounded(generators.random_particles(spark, fx.table(spark, sf, "embeddings").count()), *"xyz", places=9)


@query("zero_particles", "SELECT id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 1.0::DOUBLE AS mass FROM (SELECT unnest(range(0, (SELECT count(*) FROM embeddings))) AS id)")
def zero_particles(spark, sf):
    return generators.zero_particles(spark, fx.table(spark, sf, "embeddings").count())


@query("benchmark_plate", f"""WITH a AS (SELECT y, x, h, 0.25::FLOAT AS v FROM ({_CELLS})),
b AS (SELECT y, x, h, CASE WHEN (y - (ceil(h / 3)::INT - 1)) ** 2 + (x - {-(-IW // 3) - 1}) ** 2 <= 64 THEN 1.0::FLOAT ELSE v END AS v FROM a),
c AS (SELECT y, x, h, CASE WHEN (y - (ceil(2 * h / 3)::INT - 1)) ** 2 + (x - {-(-2 * IW // 3) - 1}) ** 2 <= 16 THEN 0.75::FLOAT ELSE v END AS v FROM b)
SELECT y, x, round((v + 0.5 * exp(-((y - (ceil(h / 2)::INT - 1)) ** 2 + (x - {-(-IW // 2) - 1}) ** 2) / (2.0 * 144.0)))::FLOAT::DOUBLE, 4) AS v FROM c""")
def benchmark_plate(spark, sf):
    h = _rows(spark, sf)
    return rounded(generators.with_hotspots(generators.ambient_plate(spark, h, IW, 0.25), h, IW), "v", places=4)


def _tiles_sql(value: str) -> str:
    n = "(SELECT 20 + floor(sqrt(count(*)))::BIGINT AS n FROM part)"
    return f"""SELECT ti::INT AS ti, tj::INT AS tj, (1 + (ti + tj) % 3)::INT AS owner, round(sum(v), 6) AS total, count(*) AS cells FROM (
      SELECT i // 16 AS ti, j // 16 AS tj, {value} AS v FROM {n}, LATERAL (SELECT unnest(range(0, n)) AS i), LATERAL (SELECT unnest(range(0, n)) AS j)) GROUP BY 1, 2, 3"""


def _tile_sums(spark, sf, kind: str) -> DataFrame:
    tiles = generators.matrix_tiles(spark, 20 + math.isqrt(fx.table(spark, sf, "part").count()), 16, kind, owners=3)
    return tiles.select("ti", "tj", "owner", F.round(F.aggregate("data", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.size("data").cast("long").alias("cells"))


@query("matrix_random", _tiles_sql(_uniform_sql(3, "i", "j")))
def matrix_random(spark, sf):
    return _tile_sums(spark, sf, "random")


@query("matrix_zeros", _tiles_sql("0.0::DOUBLE"))
def matrix_zeros(spark, sf):
    return _tile_sums(spark, sf, "zeros")


# --- files ------------------------------------------------------------------------------------------------

_SAMPLES = fx.SQL["samples"]
#: Every seventh line names no framework; every second one has no reference.
_FRAMEWORK = "CASE WHEN sample_id % 7 = 0 THEN 'arrays' ELSE framework END"


def _evaluated(spark, sf) -> DataFrame:
    some = lambda c, k: F.when(F.col("sample_id") % k != 0, c)
    s = fx.samples(spark, sf)
    return s.select(
        "task", "model", F.col("sample_id").cast("int").alias("sample_id"), "passed", "elapsed_sec", some(F.col("framework"), 7).alias("framework"),
        some(F.col("framework") != "tasks", 2).alias("reference_passed"), some(F.length("task").cast("double"), 2).alias("reference_elapsed_sec"),
        some(F.col("elapsed_sec") / F.length("task"), 2).alias("sample_elapsed_over_reference"),
    )


@query("jsonl_samples", f"""SELECT task, model, sample_id::INT AS sample_id, passed, round(elapsed_sec, 6) AS elapsed_sec, {_FRAMEWORK} AS framework, CASE WHEN sample_id % 2 <> 0 THEN framework <> 'tasks' END AS reference_passed,
CASE WHEN sample_id % 2 <> 0 THEN length(task)::DOUBLE END AS reference_elapsed_sec, CASE WHEN sample_id % 2 <> 0 THEN round(elapsed_sec / length(task), 6) END AS sample_elapsed_over_reference FROM ({_SAMPLES})""")
def jsonl_samples(spark, sf):
    """Written as JSON lines, with blank lines among them, and read again."""
    at = scratch(spark, "samples")
    sinks.write_json_lines(_evaluated(spark, sf), at)
    spark.createDataFrame([("",), ("  ",)], "value string").write.mode("append").text(at)
    return rounded(files.read_samples(spark, at), "elapsed_sec", "sample_elapsed_over_reference")


@query("jsonl_keys", f"SELECT CASE WHEN sample_id % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN sample_id % 2 = 0 THEN 0 ELSE 3 END + 5 AS n_keys, count(*) AS n FROM ({_SAMPLES}) GROUP BY 1")
def jsonl_keys(spark, sf):
    """How many keys the written lines have: optional ones are left out where there is nothing."""
    at = scratch(spark, "samples")
    sinks.write_json_lines(_evaluated(spark, sf), at)
    return spark.read.text(at).groupBy(F.size(F.json_object_keys("value")).alias("n_keys")).agg(F.count(F.lit(1)).alias("n"))


@query("passk_from_files", f"SELECT task, {_FRAMEWORK} AS framework, count(*) AS n_total, sum(passed::BIGINT)::BIGINT AS n_correct, round(sum(passed::BIGINT) / count(*), 6) AS pass_at_1 FROM ({_SAMPLES}) GROUP BY 1, 2")
def passk_from_files(spark, sf):
    at = scratch(spark, "samples")
    sinks.write_json_lines(_evaluated(spark, sf), at)
    return rounded(pk.pass_table(files.read_samples(spark, at), ["task", "framework"], (1,)), "pass_at_1")


_PARTS = "SELECT p_type AS name, p_brand AS brand, count(*)::BIGINT AS n, min(p_size)::INT AS low FROM part GROUP BY ALL"


@query("json_documents", f"SELECT brand || ' ' || name AS id, n, low FROM ({_PARTS})")
def json_documents(spark, sf):
    """Documents of one object each for one brand, an array of objects, or an object that maps keys to objects."""
    at = scratch(spark, "documents")
    rows = fx.table(spark, sf, "part").groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("id"), "p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("low"))
    kind = F.pmod(F.crc32("p_brand"), F.lit(2))
    whole = F.collect_list(F.struct("id", "n", "low"))  # the few types of a brand
    docs = rows.groupBy("p_brand").agg(whole.alias("x"))
    mapped = F.to_json(F.map_from_entries(F.transform("x", lambda r: F.struct(r["id"], F.struct(r["n"].alias("n"), r["low"].alias("low"))))))
    text = F.when(F.size("x") == 1, F.to_json(F.get("x", F.lit(0)))).when(kind == 0, F.to_json("x")).otherwise(mapped)
    docs.select(text.alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(at)
    return files.json_document(spark, at, "n long, low int").select("id", "n", "low")


_SUMMARY = "SELECT l_returnflag AS variant, l_linestatus AS device, l_linenumber::INT AS size, round(avg(l_quantity), 6) AS mean_sec, round(stddev_samp(l_quantity), 6) AS std_sec FROM lineitem GROUP BY ALL"
SUMMARY = "variant string, device string, size int, mean_sec double, std_sec double"


def _summaries(spark, sf) -> DataFrame:
    rows = fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("device"), F.col("l_linenumber").cast("int").alias("size"))
    return rows.agg(F.avg("l_quantity").alias("mean_sec"), F.stddev_samp("l_quantity").alias("std_sec"))


@query("csv_summary", f"SELECT *, row_number() OVER (ORDER BY size, variant, device) AS position FROM ({_SUMMARY})")
def csv_summary(spark, sf):
    """Written in two appends with fixed formats, read with a check of each line's fields, in the order of size."""
    at = scratch(spark, "summary")
    rows = _summaries(spark, sf)
    for device in ("F", "O"):
        delimited.write_csv(rows.filter(F.col("device") == device), at, {"mean_sec": "%.6f", "std_sec": "%.6f"})
    return order.ranked(delimited.read_csv(spark, at, SUMMARY), ["size", "variant", "device"]).withColumnRenamed("rank", "position").withColumn("position", F.col("position").cast("long"))


@query("csv_merged", f"SELECT variant, device, size, mean_sec, std_sec FROM ({_SUMMARY}) UNION ALL SELECT variant, device, size, mean_sec, std_sec FROM ({_SUMMARY}) WHERE variant = 'A'")
def csv_merged(spark, sf):
    """The bag union of three folders of CSV, one of them missing."""
    rows, paths = _summaries(spark, sf), [scratch(spark, "worker") for _ in range(3)]
    delimited.write_csv(rows, paths[0], {"mean_sec": "%.6f", "std_sec": "%.6f"})
    delimited.write_csv(rows.filter("variant = 'A'"), paths[2], {"mean_sec": "%.6f", "std_sec": "%.6f"})
    out = scratch(spark, "merged")
    delimited.write_csv(delimited.merged_csv(spark, paths, SUMMARY), out)
    return delimited.read_csv(spark, out, SUMMARY)


@query("csv_quoted", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_quoted(spark, sf):
    """Whole documents, with their commas, quotes and line breaks, written as CSV and read again."""
    at = scratch(spark, "documents")
    delimited.write_csv(fx.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), at)
    return delimited.read_csv(spark, at, "doc_id long, text string, lang string, source string, n_chars long")


_TURNS = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || role || chr(10) WHEN 2 THEN 'missing' ELSE chr(34) || role || ',' END AS role, CASE WHEN turn % 3 = 0 THEN NULL ELSE text END AS text FROM conversations"


@query("csv_odd_texts", f"SELECT role, count(*) AS n, count(text) AS n_texts, sum(length(text))::BIGINT AS chars, min(text) AS least FROM ({_TURNS}) GROUP BY role")
def csv_odd_texts(spark, sf):
    """Empty texts, outer blanks, the word that stands for NULL as a text, lone quotes, and NULL, from two appended parts."""
    at = scratch(spark, "turns")
    role = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), "role", F.lit("\n"))).when(F.col("turn") % 4 == 2, "missing").otherwise(F.concat(F.lit('"'), "role", F.lit(",")))
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    for part in (0, 1):
        delimited.write_csv(rows.filter(F.col("turn") % 2 == part), at)
    got = delimited.read_csv(spark, at, "conv_id long, turn long, role string, text string")
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_texts"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("least"))


_MD = "SELECT task, model, count(*) AS n, avg(elapsed_sec) FILTER (passed AND task <> 'click') AS mean FROM (" + _SAMPLES + ") GROUP BY 1, 2"


@query("markdown_table", f"""SELECT position, line FROM (
  SELECT 0 AS position, '| task | model | n | mean |' AS line UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL
  SELECT 1 + row_number() OVER (ORDER BY task, model), '| ' || task || ' | ' || model || ' | ' || n || ' | ' || CASE WHEN mean IS NULL THEN '' ELSE printf('%.2f', mean) END || ' |' FROM ({_MD}))""")
def markdown_table(spark, sf):
    """Written as a table file and read again, line by line."""
    at = scratch(spark, "table")
    rows = fx.samples(spark, sf).groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("passed") & (F.col("task") != "click"), F.col("elapsed_sec"))).alias("mean"))
    sinks.write_markdown(rows, at, ["task", "model"])
    lines = spark.read.text(at).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("k"))
    seq = F.when(F.col("line").startswith("| task | model"), 0).when(F.col("line").startswith("|---"), 1)
    heads, body = lines.filter(seq.isNotNull()).select(seq.alias("position"), "line"), lines.filter(seq.isNull())
    ranked = order.ranked(body.withColumn("part", F.regexp_extract("f", r"part-(\d+)", 1).cast("long")), ["part", "k"])
    return heads.select(F.col("position").cast("long").alias("position"), "line").unionByName(ranked.select((F.col("rank") + 1).cast("long").alias("position"), "line"))


_LOG = fx.SQL["log"]
#: Lines of a log in file order; those of even seventh numbers lack the optional keys, every fifth one tells of something else.
_LINES = f"SELECT seq, nthreads, total_s, CASE WHEN seq % 7 % 2 = 0 THEN NULL ELSE total_s / 4 END AS dp_s FROM ({_LOG}) WHERE seq % 5 <> 0"


def _log_lines(spark, sf) -> DataFrame:
    data = F.struct("seq", "nthreads", "total_s", F.when(F.col("seq") % 7 % 2 != 0, F.col("total_s") / 4).alias("dp_s"), F.when(F.col("seq") % 7 % 2 != 0, F.lit(0.25)).alias("dp_frac"))
    message = F.when(F.col("seq") % 5 != 0, "strip_timings").otherwise("started")
    return fx.log(spark, sf).select("seq", F.to_json(F.struct(message.alias("message"), data.alias("data"))).alias("value"))


@query("log_scan", f"SELECT seq, nthreads, round(total_s, 6) AS total_s, round(dp_s, 6) AS dp_s, CASE WHEN dp_s IS NULL THEN NULL ELSE 0.25::DOUBLE END AS dp_frac FROM ({_LINES})")
def log_scan(spark, sf):
    """NaN is shown as NULL."""
    at = scratch(spark, "log")
    _log_lines(spark, sf).select("value").write.text(at)
    lines = spark.read.text(at).withColumn("seq", F.get_json_object("value", "$.data.seq").cast("long"))
    got = files.timing_lines(lines, "strip_timings")
    return got.select("seq", "nthreads", F.round("total_s", 6).alias("total_s"), F.round(F.nanvl("dp_s", F.lit(None)), 6).alias("dp_s"), F.nanvl("dp_frac", F.lit(None)).alias("dp_frac"))


_RUNS = f"""SELECT *, sum(t) OVER (ORDER BY seq) AS run FROM (SELECT *, coalesce((lag(nthreads) OVER (ORDER BY seq) <> nthreads)::INT, 1) AS t FROM ({_LINES}))"""


@query("log_run_stats", f"SELECT run::BIGINT AS run, nthreads, count(*) AS n, round(avg(total_s), 6) AS mean_total, round(median(total_s), 6) AS median_total, round(avg(dp_s), 6) AS mean_dp, CASE WHEN avg(dp_s) IS NULL THEN NULL ELSE 0.25::DOUBLE END AS mean_frac FROM ({_RUNS}) GROUP BY run, nthreads")
def log_run_stats(spark, sf):
    got = ss.run_stats(ss.islands(files.timing_lines(_log_lines(spark, sf), "strip_timings"), chunk=20_000), optional={"dp_s": "mean_dp", "dp_frac": "mean_frac"})
    none = lambda c: F.round(F.nanvl(c, F.lit(None)), 6).alias(c)
    return got.select("run", "nthreads", "n", F.round("mean_total", 6).alias("mean_total"), F.round("median_total", 6).alias("median_total"), none("mean_dp"), none("mean_frac"))


@query("log_tail", f"SELECT nthreads, count(*) AS n, round(avg(total_s), 6) AS mean_total_s, round(max(total_s), 6) AS max_total_s, round(avg(dp_s), 6) AS mean_dp_s, round(avg(CASE WHEN dp_s IS NULL THEN NULL ELSE 0.25 END), 6) AS mean_dp_frac FROM ({_LINES}) GROUP BY 1")
def log_tail(spark, sf):
    """The log comes in two parts; the summary is brought up to date after each."""
    at, out, state = (scratch(spark, name) for name in ("log", "summary", "state"))
    lines = _log_lines(spark, sf)
    got = None
    for half in (0, 1):
        lines.filter(F.col("seq") % 2 == half).select("value").write.mode("append").text(at)
        got = logs.update_summary(spark, at, out, state, "strip_timings")
    return rounded(got, "mean_total_s", "max_total_s", "mean_dp_s", "mean_dp_frac")


_LOGS = f"SELECT 'w' || (seq % 3) AS log, seq, nthreads, total_s, dp_s FROM ({_LINES})"
_LOG_RUNS = f"SELECT *, sum(t) OVER (PARTITION BY log ORDER BY seq)::BIGINT AS run FROM (SELECT *, coalesce((lag(nthreads) OVER (PARTITION BY log ORDER BY seq) <> nthreads)::INT, 1) AS t FROM ({_LOGS}))"


def _grown_runs(spark, sf) -> DataFrame:
    """The lines of three logs with their runs; the logs grow three times, at places that cut runs."""
    at, out, state = (scratch(spark, name) for name in ("log", "runs", "state"))
    data = lambda: F.from_json(F.get_json_object("value", "$.data"), "seq long, nthreads long, total_s double, dp_s double, dp_frac double")
    lines = _log_lines(spark, sf).withColumn("data", data()).withColumn("log", F.concat(F.lit("w"), (F.col("seq") % 3).cast("string")))
    lines = lines.select("seq", F.to_json(F.struct(F.get_json_object("value", "$.message").alias("message"), F.struct("log", "data.*").alias("data"))).alias("value"))
    most, got = fx.table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0, None
    cuts = [-1, most // 5, most // 2 + 1, most]
    for low, high in zip(cuts, cuts[1:], strict=False):
        lines.filter(F.col("seq").between(low + 1, high)).select("value").write.mode("append").text(at)
        got = logs.update_runs(spark, at, out, state, "strip_timings")
    return got


@query("log_runs_grown", f"SELECT log, seq, nthreads, round(total_s, 6) AS total_s, run FROM ({_LOG_RUNS})")
def log_runs_grown(spark, sf):
    return _grown_runs(spark, sf).select("log", "seq", "nthreads", F.round("total_s", 6).alias("total_s"), "run")


@query("log_run_table", f"""SELECT log, run, nthreads, count(*) AS n, round(avg(total_s), 6) AS mean_total, round(median(total_s), 6) AS median_total, round(avg(dp_s), 6) AS mean_dp FROM (
  SELECT * FROM ({_LOG_RUNS}) QUALIFY row_number() OVER (PARTITION BY log, run ORDER BY seq) > 1 OR count(*) OVER (PARTITION BY log, run) = 1) GROUP BY ALL""")
def log_run_table(spark, sf):
    got = logs.run_table(_grown_runs(spark, sf))
    return got.select("log", "run", "nthreads", "n", F.round("mean_total", 6).alias("mean_total"), F.round("median_total", 6).alias("median_total"), F.round(F.nanvl("mean_dp", F.lit(None)), 6).alias("mean_dp"))


@query("constant_extraction", "SELECT 'task_' || (item_id % 50) || '/' || item_id AS name, trim(text, chr(10) || chr(9) || ' ') AS code FROM benchmark")
def constant_extraction(spark, sf):
    """Source texts that hold their solution as a constant between triple quotes."""
    items = fx.table(spark, sf, "benchmark")
    name = F.concat(F.lit("task_"), (F.col("item_id") % 50).cast("string"), F.lit("/"), F.col("item_id").cast("string"))
    source = F.concat(F.lit('module Task\nconst LIMIT = 3\nconst SOLUTION = """\n'), "text", F.lit('\n"""\nconst OTHER = """x"""\nend\n'))
    return files.constant(items.select(name.alias("path"), source.alias("value")), "SOLUTION").select(F.col("path").alias("name"), "code")


_LISTED = ("documents", "embeddings", "events")


@query("directory_listing", "SELECT row_number() OVER (ORDER BY name) AS position, name, n FROM (" + " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, count(*) AS n FROM {t}" for t in _LISTED) + ")")
def directory_listing(spark, sf):
    """The tables whose names begin with d or e, in order, with their rows; a table is a file, or a folder of parts. Each listed
    path is read, so the listing must have found them all."""
    found = files.listing(spark, sf, ".parquet").filter(F.regexp_extract("path", r"/([^/]+\.parquet)(/[^/]+)?$", 1).rlike("^[de]"))
    paths = found.groupBy(F.regexp_extract("path", r"/([^/]+\.parquet)(/[^/]+)?$", 1).alias("name")).agg(F.collect_list("path").alias("paths")).collect()  # a dozen names
    count = lambda r: spark.read.parquet(*r.paths).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r.name).alias("name"), "n")
    tables = reduce(DataFrame.unionAll, map(count, paths))
    return order.ranked(tables, ["name"]).select(F.col("rank").alias("position"), "name", "n")


# --- ordered results, filters, frames ----------------------------------------------------------------------


def positioned(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` with ``position`` from 1 in the order of ``keys``."""
    return order.ranked(df, list(keys)).withColumnRenamed("rank", "position")


@query("sort_composite", "SELECT s_suppkey, s_name, s_nationkey, row_number() OVER (ORDER BY s_nationkey, s_name, s_suppkey) AS position FROM supplier")
def sort_composite(spark, sf):
    return positioned(fx.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey", "s_name", "s_suppkey")


@query("sort_text_numeric", f"SELECT variant, threads, row_number() OVER (ORDER BY variant, threads) AS position FROM (SELECT DISTINCT variant, threads FROM ({fx.SQL['timings']}))")
def sort_text_numeric(spark, sf):
    """Variants by name, then threads as numbers: 2 before 16."""
    return positioned(fx.timings(spark, sf).select("variant", "threads").distinct(), "variant", "threads")


@query("sort_by_name", "SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_name DESC, s_suppkey) AS position FROM supplier")
def sort_by_name(spark, sf):
    """Names that all begin alike, the last first."""
    return positioned(fx.table(spark, sf, "supplier").select("s_name", "s_suppkey"), F.col("s_name").desc(), "s_suppkey")


@query("sort_by_url", "SELECT url, page_id, row_number() OVER (ORDER BY url, page_id) AS position FROM pages")
def sort_by_url(spark, sf):
    return positioned(fx.table(spark, sf, "pages").select("url", "page_id"), "url", "page_id")


@query("sort_mixed", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS position FROM orders")
def sort_mixed(spark, sf):
    """A text that a fifth of all orders share, then prices from the highest."""
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return positioned(rows, "o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "position")


@query("rank_in_groups", "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer")
def rank_in_groups(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return order.ranked(rows, [F.col("c_acctbal").desc(), "c_custkey"], by=["c_mktsegment"]).select("c_custkey", "c_mktsegment", F.col("rank").alias("position"))


@query("distinct_axis", "SELECT p_size, row_number() OVER (ORDER BY p_size) AS position FROM (SELECT DISTINCT p_size FROM part)")
def distinct_axis(spark, sf):
    return positioned(fx.table(spark, sf, "part").select("p_size").distinct(), "p_size")


@query("task_choice", f"SELECT sample_id, model, passed FROM ({_SAMPLES}) WHERE task = 'purchase'")
def task_choice(spark, sf):
    return pk.choose(fx.samples(spark, sf), "task", "purchase").select("sample_id", "model", "passed")


@query("integer_clamp", "SELECT p_partkey, greatest(10, least(40, p_size))::INT AS size FROM part")
def integer_clamp(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", ss.clamp(F.col("p_size"), F.lit(10), F.lit(40)).alias("size"))


def _frames_sql() -> str:
    from gridspark.plans.grid_queries import _HEAT

    return _HEAT + " SELECT round(min(v)::DOUBLE, 6) AS low, round(max(v)::DOUBLE, 6) AS high, count(DISTINCT step) AS frames FROM (" + " UNION ALL ".join(f"SELECT {i} AS step, v FROM p{i}" for i in (0, 2, 3)) + ")"


@query("frame_limits", _frames_sql())
def frame_limits(spark, sf):
    """The least and greatest value over all kept frames of a run."""
    p = fx.plate(spark, sf)
    frames = st.heat_history(p, p.agg(F.max("y")).first()[0] + 1, fx.WIDTH, 3, 2, 0.2)
    return rounded(frames.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("step").alias("frames")), "low", "high")


_SPANS = "SELECT event_id // 2 AS span, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'finish' END AS edge, event_type, epoch_us(ts) * 1000 AS ns FROM events"


@query("span_pairs", f"""SELECT category, count(*) AS n_spans, round(sum(b - a) / 1e9, 6) AS seconds FROM (
  SELECT span, max(event_type) FILTER (edge = 'start') AS category, max(ns) FILTER (edge = 'start') AS a, max(ns) FILTER (edge = 'finish') AS b FROM ({_SPANS}) GROUP BY span) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def span_pairs(spark, sf):
    """Starts and finishes that name one span; a start without a finish counts for nothing."""
    rows = fx.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 2).alias("span"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("finish").alias("edge"), "event_type", (F.unix_micros(F.to_timestamp("ts")) * 1000).alias("at")
    )
    starts = rows.filter("edge = 'start'").select("span", F.col("event_type").alias("category"))
    return ss.span_totals(rows.join(starts, "span"), ["category", "span"], "category").select("category", "n_spans", F.round("seconds", 6).alias("seconds"))
