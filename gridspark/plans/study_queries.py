"""Queries over samples, timings, logs and texts, each with the same query in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import passk as pk
from gridspark.functions import stats as ss
from gridspark.functions import text as tx
from gridspark.functions.options import Option, resolved
from gridspark.functions.quantiles import quantiles
from gridspark.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


SAMPLES, NATIVE, TIMINGS, LOG, RESPONSES = (fx.SQL[k] for k in ("samples", "native", "timings", "log", "responses"))
FENCE = "`" * 3


def _pass_sql(n: str, c: str, k: int) -> str:
    miss = " * ".join(f"(({n} - {c} - {j})::DOUBLE / ({n} - {j}))" for j in range(k))
    return f"round(CASE WHEN {n} < {k} OR {c} > {n} THEN 'NaN'::DOUBLE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - {miss} END, 6) AS pass_at_{k}"


def _table_sql(by: str) -> str:
    return f"SELECT {by}, n_total, n_correct, {_pass_sql('n_total', 'n_correct', 1)}, {_pass_sql('n_total', 'n_correct', 5)} FROM (SELECT {by}, count(*) AS n_total, sum(passed::BIGINT)::BIGINT AS n_correct FROM ({SAMPLES}) GROUP BY ALL)"


PASSES = ("pass_at_1", "pass_at_5")

# --- samples --------------------------------------------------------------------------------------------


@query("passk_by_task_model", _table_sql("task, model"))
def passk_by_task_model(spark, sf):
    return rounded(pk.pass_table(fx.samples(spark, sf), ["task", "model"]), *PASSES)


@query("passk_by_framework", _table_sql("task, model, framework"))
def passk_by_framework(spark, sf):
    return rounded(pk.pass_table(fx.samples(spark, sf), ["task", "model", "framework"]), *PASSES)


@query("passk_with_native", f"""{_table_sql('task, model')} UNION ALL
SELECT task, '{pk.NATIVE}' AS model, 5 AS n_total, CASE WHEN ok THEN 5 ELSE 0 END AS n_correct, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS pass_at_1, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS pass_at_5
FROM (SELECT task, bool_and(reference_passed) AS ok FROM ({NATIVE}) GROUP BY task)""")
def passk_with_native(spark, sf):
    s = fx.samples(spark, sf)
    return rounded(pk.with_native(s, pk.native_summary(fx.native(s))), *PASSES)


_RUNTIME = f"SELECT task, framework, avg(elapsed_sec) AS mean_elapsed_sec, count(*) AS n_passed FROM ({SAMPLES}) WHERE passed GROUP BY ALL"


@query("runtime_by_framework", f"SELECT * REPLACE (round(mean_elapsed_sec, 6) AS mean_elapsed_sec) FROM ({_RUNTIME})")
def runtime_by_framework(spark, sf):
    return rounded(pk.mean_runtime(fx.samples(spark, sf), ["task", "framework"]), "mean_elapsed_sec")


@query("native_summary", NATIVE)
def native_summary(spark, sf):
    return pk.native_summary(fx.native(fx.samples(spark, sf)))


@query("runtime_vs_native", f"""SELECT r.task, r.framework, round(mean_elapsed_sec, 6) AS mean_elapsed_sec, n_passed, reference_passed, reference_elapsed_sec,
  round(CASE WHEN reference_elapsed_sec > 0 THEN mean_elapsed_sec / reference_elapsed_sec END, 6) AS mean_over_native
FROM ({_RUNTIME}) r LEFT JOIN ({NATIVE}) n ON n.task = r.task AND n.framework = r.framework""")
def runtime_vs_native(spark, sf):
    s = fx.samples(spark, sf)
    got = pk.runtime_vs_native(pk.mean_runtime(s, ["task", "framework"]), pk.native_summary(fx.native(s)))
    return rounded(got, "mean_elapsed_sec", "mean_over_native")


@query("ratio_nullsafe", f"SELECT sample_id, round(CASE WHEN reference_elapsed_sec > 0 THEN elapsed_sec / reference_elapsed_sec END, 6) AS ratio FROM ({SAMPLES}) s LEFT JOIN ({NATIVE}) n ON n.task = s.task AND n.framework = s.framework")
def ratio_nullsafe(spark, sf):
    s = fx.samples(spark, sf)
    ref = pk.native_summary(fx.native(s))  # a row for each task and framework
    got = s.join(ref, ["task", "framework"], "left")
    return rounded(got.select("sample_id", pk.ratio(F.col("elapsed_sec"), F.col("reference_elapsed_sec")).alias("ratio")), "ratio")


@query("samples_cross", f"SELECT DISTINCT task, framework, s::BIGINT AS sample_id FROM ({SAMPLES}), (SELECT unnest(range(0, 5)) AS s)")
def samples_cross(spark, sf):
    """Every pair of task and framework with each of five sample ids: an explode, so no join at all."""
    pairs = fx.samples(spark, sf).select("task", "framework").distinct()
    return pairs.withColumn("sample_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))


@query("task_lookup", """SELECT e.task, e.framework, t.level, upper(e.framework) AS runtime_name FROM (SELECT DISTINCT event_type AS task, (['arrays', 'kernels', 'tasks'])[(event_id % 3) + 1] AS framework FROM events) e
JOIN (SELECT ['click', 'view', 'purchase', 'error', 'signup'][(n_nationkey % 5)::INT + 1] AS task, count(*) AS level FROM nation GROUP BY 1) t ON t.task = e.task WHERE e.framework <> 'tasks'""")
def task_lookup(spark, sf):
    """A manifest made of one table against tasks made of another, which must all be there, and runtime contexts, which need not."""
    manifest = fx.samples(spark, sf).select("task", "framework").distinct()
    names = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "error", "signup")])
    tasks = fx.table(spark, sf, "nation").groupBy(F.get(names, (F.col("n_nationkey") % 5).cast("int")).alias("task")).agg(F.count(F.lit(1)).alias("level"))
    contexts = manifest.filter("framework <> 'tasks'").select("framework", F.upper("framework").alias("runtime_name")).distinct()
    return pk.must_match(manifest, tasks, "task").join(contexts, "framework").select("task", "framework", "level", "runtime_name")


@query("choose_many", f"SELECT task, framework, count(*) AS n FROM ({SAMPLES}) WHERE framework IN ('arrays', 'tasks') GROUP BY 1, 2")
def choose_many(spark, sf):
    """Rows of a validated list of variants."""
    s = fx.samples(spark, sf)
    return pk.choose_any(s, "framework", ["tasks", "arrays", "tasks"]).groupBy("task", "framework").agg(F.count(F.lit(1)).alias("n"))


RUN_OPTIONS = [
    Option("size", "int", 512, env="RUN_SIZE"), Option("sizes", "ints", [1, 2]), Option("scale", "double", 1.5, env="RUN_SCALE"), Option("check", "flag", False),
    Option("variant", "text", "serial", env="RUN_VARIANT", choices=("serial", "tiled", "click", "view")),
]


@query("run_options", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN k WHEN event_id % 3 = 0 THEN k + 1000 ELSE 512 END AS size, CASE WHEN event_id % 4 = 1 THEN list_sum([k, k + 1]) ELSE 3 END::BIGINT AS sizes,
  CASE WHEN event_id % 5 = 0 THEN k / 4 ELSE 1.5 END AS scale, event_id % 7 = 0 AS check, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'serial' END AS variant
FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""")
def run_options(spark, sf):
    """Each event's properties as the command line and the environment of a run."""
    e = fx.table(spark, sf, "events")
    k, id_ = F.get_json_object("props", "$.k"), F.col("event_id")
    some = lambda when, *xs: F.when(when, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    args = F.concat(
        some(id_ % 2 == 0, F.lit("--size"), F.lit("7"), F.concat(F.lit("--size="), k)), some(id_ % 4 == 1, F.concat(F.lit("--sizes="), k, F.lit(", "), (k.cast("int") + 1).cast("string"))),
        some(id_ % 7 == 0, F.lit("--check")), F.array(F.lit("--no-such"), F.lit("x"), F.lit("stray")), some(F.col("event_type").isin("click", "view"), F.concat(F.lit("--variant="), "event_type")),
    )
    env = F.map_filter(F.create_map(F.lit("RUN_SIZE"), F.when(id_ % 3 == 0, (k.cast("int") + 1000).cast("string")), F.lit("RUN_SCALE"), F.when(id_ % 5 == 0, (k.cast("int") / 4).cast("string"))), lambda _, v: v.isNotNull())
    got = resolved(e.select("event_id", args.alias("args"), env.alias("env")), RUN_OPTIONS, env="env")
    return got.withColumn("sizes", F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x))


@query("anti_unknown", f"SELECT DISTINCT task FROM ({SAMPLES}) EXCEPT SELECT * FROM (VALUES ('click'), ('view'))")
def anti_unknown(spark, sf):
    known = spark.createDataFrame([("click",), ("view",)], "task string")
    return fx.samples(spark, sf).select("task").subtract(known)


@query("distinct_values", f"SELECT 'task' AS kind, task AS value FROM ({SAMPLES}) UNION SELECT 'model', model FROM ({SAMPLES}) UNION SELECT 'framework', framework FROM ({SAMPLES})")
def distinct_values(spark, sf):
    kinds = ("task", "model", "framework")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]))
    return fx.samples(spark, sf).select(pairs.alias("p")).select("p.*").distinct()


_ASKED = "SELECT n_nationkey AS id, unnest(['Strong', ' both ', n_name, 'weak', 'WEAK']) AS x, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM nation"


@query("distinct_scenarios", f"""SELECT id, scenario, row_number() OVER (PARTITION BY id ORDER BY first) - 1 AS place FROM (SELECT id, scenario, min(10 * i + j) AS first FROM (
  SELECT id, i, unnest(CASE WHEN lower(trim(x)) = 'both' THEN ['strong', 'weak'] ELSE [lower(trim(x))] END) AS scenario, unnest([1, 2]) AS j FROM ({_ASKED})) WHERE scenario IS NOT NULL GROUP BY ALL)""")
def distinct_scenarios(spark, sf):
    """'both' stands for strong and weak; the first of equal names stays, in order."""
    asked = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat_ws(",", F.lit("Strong"), F.lit(" both "), "n_name", F.lit("weak"), F.lit("WEAK")).alias("names"))
    names = F.transform(F.split("names", ","), lambda x: F.lower(F.trim(x)))
    wide = F.flatten(F.transform(names, lambda x: F.when(x == "both", F.array(F.lit("strong"), F.lit("weak"))).otherwise(F.array(x))))
    return asked.select("id", F.posexplode(F.array_distinct(wide)).alias("place", "scenario")).select("id", "scenario", F.col("place").cast("long").alias("place"))


@query("union_missing", f"""SELECT task, framework, mean_elapsed_sec, n_passed, reference_passed FROM (
  SELECT task, framework, round(mean_elapsed_sec, 6) AS mean_elapsed_sec, n_passed, NULL::BOOLEAN AS reference_passed FROM ({_RUNTIME})
  UNION ALL SELECT task, framework, NULL, NULL, reference_passed FROM ({NATIVE}))""")
def union_missing(spark, sf):
    s = fx.samples(spark, sf)
    a = rounded(pk.mean_runtime(s, ["task", "framework"]), "mean_elapsed_sec")
    return a.unionByName(pk.native_summary(fx.native(s)).drop("reference_elapsed_sec"), allowMissingColumns=True)


_ALL_PASSED = f"SELECT task, bool_and(passed) AS all_passed, bool_or(passed) AS any_passed FROM ({SAMPLES}) GROUP BY task"


@query("all_passed", _ALL_PASSED)
def all_passed(spark, sf):
    return fx.samples(spark, sf).groupBy("task").agg(F.bool_and("passed").alias("all_passed"), F.bool_or("passed").alias("any_passed"))


_KINDS = ["values", "shape_and_type", "correctness", "shape_only", "scalar_expected", "scalar_finite", "other"]


@query("verdict_ladder", f"""SELECT sample_id, CASE WHEN c = 'values' THEN v < 100 WHEN c = 'shape_and_type' THEN v < 80 WHEN c = 'correctness' AND NOT b THEN v < 60
  WHEN c = 'shape_only' THEN v < 40 WHEN c = 'scalar_expected' THEN abs(v - 20) <= 1e-3 + 1e-3 * 20 WHEN c = 'scalar_finite' THEN true WHEN c = 'correctness' THEN v < 20 ELSE false END AS passed
FROM (SELECT sample_id, elapsed_sec AS v, (sample_id % 2) = 1 AS b, ({_KINDS!r})[(sample_id % 7) + 1] AS c FROM ({SAMPLES}))""")
def verdict_ladder(spark, sf):
    v = F.col("elapsed_sec")
    check = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("sample_id") % 7).cast("int"))
    ok = {
        "values": v < 100, "shape_and_type": v < 80, "correctness": v < 60, "shape_only": v < 40,
        "scalar_expected": F.abs(v - 20) <= 1e-3 + 1e-3 * 20, "scalar_finite": ~F.isnan(v), "correctness_block": v < 20,
    }
    return fx.samples(spark, sf).select("sample_id", pk.verdict(check, F.col("sample_id") % 2 == 1, ok).alias("passed"))


# --- timings and logs -----------------------------------------------------------------------------------


@query("timing_stats", f"""SELECT variant, threads, count(*) AS n, round(avg(time_sec), 6) AS mean, round(stddev_pop(time_sec), 6) AS std, round(stddev_samp(time_sec), 6) AS sample_std,
  median(time_sec) AS median, round(quantile_cont(time_sec, 0.95), 6) AS p95, max(time_sec) AS max FROM ({TIMINGS}) GROUP BY variant, threads""")
def timing_stats(spark, sf):
    t = fx.timings(spark, sf)
    both = ss.summary(t, ["variant", "threads"], "time_sec").join(
        t.groupBy("variant", "threads").agg(F.stddev_samp("time_sec").alias("sample_std")), ["variant", "threads"]
    )
    return rounded(both, "mean", "std", "sample_std", "p95")


_PRICES = {"low": 0.01, "median": 0.5, "p95": 0.95, "p999": 0.999}
_PRICES_SQL = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {k}" for k, q in _PRICES.items())


@query("price_quantiles", f"SELECT {_PRICES_SQL} FROM lineitem")
def price_quantiles(spark, sf):
    """Of all lines as one group."""
    return rounded(quantiles(fx.table(spark, sf, "lineitem"), [], "l_extendedprice", _PRICES), *_PRICES)


@query("price_quantiles_by_flag", f"SELECT l_returnflag, l_linestatus, {_PRICES_SQL} FROM lineitem GROUP BY ALL")
def price_quantiles_by_flag(spark, sf):
    return rounded(quantiles(fx.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", _PRICES), *_PRICES)


@query("speedup_efficiency", f"""WITH m AS (SELECT variant, threads, avg(time_sec) AS s FROM ({TIMINGS}) GROUP BY ALL)
SELECT m.variant, m.threads, round(m.s, 6) AS mean_sec, round(b.s / m.s, 6) AS speedup, round(b.s / m.s / m.threads, 6) AS efficiency FROM m JOIN m b ON b.variant = m.variant AND b.threads = 1""")
def speedup_efficiency(spark, sf):
    return rounded(ss.speedup(fx.timings(spark, sf)), "mean_sec", "speedup", "efficiency")


_ISLANDS = f"""SELECT seq, nthreads, total_s, sum(turn) OVER (ORDER BY seq)::BIGINT AS run FROM (
  SELECT *, CASE WHEN lag(nthreads) OVER (ORDER BY seq) = nthreads THEN 0 ELSE 1 END AS turn FROM ({LOG}))"""


@query("islands", _ISLANDS)
def islands(spark, sf):
    return ss.islands(fx.log(spark, sf))


@query("drop_first", f"SELECT seq, nthreads, total_s, run FROM ({_ISLANDS}) QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq) > 1 OR count(*) OVER (PARTITION BY run) = 1")
def drop_first(spark, sf):
    return ss.drop_first(ss.islands(fx.log(spark, sf))).select("seq", "nthreads", "total_s", "run")


@query("run_stats", f"SELECT run, nthreads, count(*) AS n, round(avg(total_s), 6) AS mean_total, round(median(total_s), 6) AS median_total FROM ({_ISLANDS}) GROUP BY ALL")
def run_stats(spark, sf):
    return rounded(ss.run_stats(ss.islands(fx.log(spark, sf))), "mean_total", "median_total")


@query("monotonic", f"""SELECT bool_and(m2 <= m * 1.05) AS monotonic FROM (
  SELECT m, lead(m) OVER (ORDER BY nthreads) AS m2 FROM (SELECT nthreads, median(total_s) AS m FROM ({LOG}) GROUP BY nthreads)) WHERE m2 IS NOT NULL""")
def monotonic(spark, sf):
    return ss.monotonic(quantiles(fx.log(spark, sf), ["nthreads"], "total_s", {"median": 0.5}), 0.05)


@query("mean_skipping_nan", f"SELECT task, round(avg(elapsed_sec) FILTER (sample_id % 5 <> 0), 6) AS mean FROM ({SAMPLES}) GROUP BY task")
def mean_skipping_nan(spark, sf):
    x = F.when(F.col("sample_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("elapsed_sec"))
    return fx.samples(spark, sf).withColumn("x", x).groupBy("task").agg(F.round(ss.mean_skipping_nan("x"), 6).alias("mean"))


@query("span_summary", "SELECT event_type AS category, round(sum(value), 2) AS total_s, count(*) AS n, count(DISTINCT user_id % 4) AS workers FROM events GROUP BY 1")
def span_summary(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("category")).agg(F.round(F.sum("value"), 2).alias("total_s"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("user_id") % 4).alias("workers"))


@query("top40_funcs", "SELECT 'f' || user_id AS name, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, name LIMIT 40")
def top40_funcs(spark, sf):
    named = fx.table(spark, sf, "events").groupBy(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return named.orderBy(F.desc("n"), "name").limit(40)


@query("throughput", f"SELECT variant, round(2 * 512.0 ^ 3 / median(time_sec) / 1e12, 9) AS tflops, round(1048576 / (avg(time_sec) * 1e6), 6) AS mcells, round(CASE WHEN sum(time_sec) > 0 THEN max(time_sec) / sum(time_sec) ELSE 0 END, 9) AS fraction FROM ({TIMINGS}) GROUP BY variant")
def throughput(spark, sf):
    rows = fx.timings(spark, sf)
    sums = rows.groupBy("variant").agg(F.avg("time_sec").alias("a"), F.sum("time_sec").alias("s"), F.max("time_sec").alias("x"))
    t = ss.with_quantiles(sums, rows, ["variant"], "time_sec", {"m": 0.5})
    fraction = F.when(F.col("s") > 0, F.col("x") / F.col("s")).otherwise(0.0)
    return t.select("variant", F.round(2 * 512.0**3 / F.col("m") / 1e12, 9).alias("tflops"), F.round(1048576 / (F.col("a") * 1e6), 6).alias("mcells"), F.round(fraction, 9).alias("fraction"))


@query("csv_format", f"SELECT variant || ',' || threads || ',' || printf('%.9f', avg(time_sec)) || ',' || printf('%.4f', max(time_sec)) AS line FROM ({TIMINGS}) GROUP BY variant, threads")
def csv_format(spark, sf):
    t = fx.timings(spark, sf).groupBy("variant", "threads").agg(F.avg("time_sec").alias("mean"), F.max("time_sec").alias("most"))
    return t.select(F.format_string("%s,%d,%.9f,%.4f", "variant", "threads", "mean", "most").alias("line"))


@query("weak_dims", "SELECT DISTINCT p_size AS threads, greatest(1, round_even(512 * sqrt(p_size), 0))::BIGINT AS root, greatest(1, round_even(512.0 * p_size, 0))::BIGINT AS linear, greatest(1, round_even(5 * 0.5, 0))::BIGINT AS half FROM part")
def weak_dims(spark, sf):
    t = fx.table(spark, sf, "part").select(F.col("p_size").alias("threads")).distinct()
    size = lambda s, how: ss.weak_size(F.lit(s), F.col("threads"), how)
    return t.select("threads", size(512, "sqrt").alias("root"), size(512, "linear").alias("linear"), size(5, "0.5").alias("half"))


@query("fault_aggregate", "SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_orderkey % 5 = 3 THEN 0 ELSE l_quantity END), 4) AS total FROM lineitem GROUP BY 1")
def fault_aggregate(spark, sf):
    """Shares of a sum, some of which are not a number, or infinite, and count as nothing."""
    key = F.col("l_orderkey") % 10
    share = F.when(key == 3, F.lit(float("nan"))).when(key == 8, F.lit(float("-inf"))).otherwise(F.col("l_quantity").cast("double"))
    rows = fx.table(spark, sf, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(ss.finite_or_zero(share)), 4).alias("total"))


@query("lcg_stream", f"""WITH RECURSIVE g AS (SELECT s_suppkey AS id, 0 AS k, (s_suppkey % 1000)::BIGINT AS s FROM supplier UNION ALL SELECT id, k + 1, ({ss.LCG_A}::BIGINT * s + {ss.LCG_C}) % {ss.LCG_M} FROM g WHERE k < 20)
SELECT id, k - 1 AS k, round((s & 16777215) / 16777216.0, 9) AS value FROM g WHERE k > 0""")
def lcg_stream(spark, sf):
    """Twenty numbers for each supplier, whose key is the seed."""
    s = fx.table(spark, sf, "supplier")
    got = s.select(F.col("s_suppkey").alias("id"), F.posexplode(ss.lcg(F.lit(20), F.col("s_suppkey") % 1000)).alias("k", "value"))
    return got.select("id", "k", F.round("value", 9).alias("value"))


@query("close_check", f"SELECT sample_id, abs(elapsed_sec - 20) < 1e-2 * greatest(abs(elapsed_sec), 20, 1) AS close FROM ({SAMPLES})")
def close_check(spark, sf):
    return fx.samples(spark, sf).select("sample_id", ss.close(F.col("elapsed_sec"), F.lit(20.0), 1e-2).alias("close"))


@query("integer_division", "SELECT event_id, ((event_id + 6) // 7)::BIGINT AS up, (event_id // 7)::BIGINT AS down, (event_id % 7)::BIGINT AS rest, ((event_id + 6) % 7 + 1)::BIGINT AS rest1 FROM events")
def integer_division(spark, sf):
    n = F.col("event_id")
    return fx.table(spark, sf, "events").select("event_id", F.ceil(n / 7).alias("up"), F.floor(n / 7).alias("down"), F.pmod(n, F.lit(7)).alias("rest"), (F.pmod(n - 1, F.lit(7)) + 1).alias("rest1"))


@query("timestamp_format", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS dashed FROM events")
def timestamp_format(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss").alias("dashed"))


# --- texts ----------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BLOCK = f"regexp_extract(response, '(?s){FENCE}(?:julia)?\\s*\\n(.*?){FENCE}', 1)"


@query("code_fence", f"SELECT conv_id, turn, {_STRIP.format(f'CASE WHEN (conv_id + turn) % 3 = 0 THEN {_BLOCK} ELSE response END')} AS code FROM ({RESPONSES})")
def code_fence(spark, sf):
    return fx.responses(spark, sf).select("conv_id", "turn", tx.code_block(F.col("response")).alias("code"))


@query("module_name", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'M' || conv_id END AS name FROM conversations")
def module_name(spark, sf):
    c = fx.table(spark, sf, "conversations")
    head = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("module M"), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise("# no name\n")
    return c.select("conv_id", "turn", tx.module_name(F.concat(head, "text")).alias("name"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"


@query("last_line", f"SELECT conv_id, turn, coalesce(({_LINES})[-1], '') AS line FROM conversations")
def last_line(spark, sf):
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", tx.last_line(F.col("text")).alias("line"))


@query("pass_fail", "SELECT conv_id, turn, turn % 2 = 0 AND conv_id % 3 <> 0 AS passed FROM conversations")
def pass_fail(spark, sf):
    end = F.when(F.col("turn") % 2 == 0, F.lit("\nPASS \n\n")).otherwise("\nFAIL\n")
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", tx.pass_fail(F.concat("text", end), F.col("conv_id") % 3 != 0).alias("passed"))


@query("template_fill", f"SELECT sample_id, 'Run ' || task || ' on ' || framework || ' as ' || model || '; ' || task AS prompt FROM ({SAMPLES})")
def template_fill(spark, sf):
    text = tx.fill(F.lit("Run {{TASK}} on {{RUNTIME}} as {{MODEL}}; {{TASK}}"), {"TASK": F.col("task"), "RUNTIME": F.col("framework"), "MODEL": F.col("model")})
    return fx.samples(spark, sf).select("sample_id", text.alias("prompt"))


_HTML = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_PLAIN = _STRIP.format(rf"regexp_replace({_HTML}, '\s+', ' ', 'g')")


@query("strip_html", f"SELECT page_id, {_PLAIN} AS plain FROM pages")
def strip_html(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("plain"))


@query("excerpt_1200", f"SELECT page_id, CASE WHEN plain = '' THEN 'No documentation excerpt available.' ELSE substring(plain, 1, 1200) END AS excerpt FROM (SELECT page_id, {_PLAIN} AS plain FROM pages)")
def excerpt_1200(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tx.excerpt(tx.strip_html(F.col("html"))).alias("excerpt"))


def snippets_of(index: DataFrame, snippets: DataFrame, top_k: int) -> DataFrame:
    """(framework, task, place, path, title, source_url, excerpt): of the index's paths (``common``, then ``own``) those
    that exist, in order, the first ``top_k``; all with ``top_k`` <= 0."""
    paths = index.select("framework", "task", F.posexplode(F.concat("common", "own")).alias("at", "path"))
    found = paths.join(snippets, "path")
    place = F.row_number().over(Window.partitionBy("framework", "task").orderBy("at"))
    found = found.withColumn("place", place).drop("at")
    return found.filter(F.col("place") <= top_k) if top_k > 0 else found


def _index(spark, sf) -> tuple[DataFrame, DataFrame]:
    pairs = fx.samples(spark, sf).select("task", "framework").distinct()
    number = lambda x: F.array(*x).cast("array<long>")
    index = pairs.select("framework", "task", number([F.lit(0), F.lit(-5), F.lit(1)]).alias("common"), number([F.length("task"), F.lit(9)]).alias("own"))
    pages = fx.table(spark, sf, "pages")
    text = F.when(F.col("page_id") % 2 == 0, tx.excerpt(tx.strip_html(F.col("html")), 40)).otherwise(" ")
    return index, pages.select(F.col("page_id").alias("path"), F.col("url").alias("title"), F.col("url").alias("source_url"), text.alias("excerpt"))


_TOPK = f"""SELECT t.framework, t.task, row_number() OVER (PARTITION BY t.framework, t.task ORDER BY pos)::INT AS place, path, url, CASE WHEN path % 2 = 0 THEN substring({_PLAIN}, 1, 40) ELSE ' ' END AS excerpt
  FROM (SELECT framework, task, unnest([0, -5, 1, length(task), 9]) AS path, unnest(range(0, 5)) AS pos FROM (SELECT DISTINCT task, framework FROM ({SAMPLES}))) t JOIN pages p ON p.page_id = t.path QUALIFY place <= 3"""


@query("docs_topk", f"SELECT framework, task, place, path::BIGINT AS path FROM ({_TOPK})")
def docs_topk(spark, sf):
    return snippets_of(*_index(spark, sf), 3).select("framework", "task", "place", "path")


@query("render_docs", f"SELECT framework, task, string_agg('[' || place || '] ' || url || chr(10) || 'Source: ' || url || chr(10) || excerpt, chr(10) ORDER BY place) AS block FROM ({_TOPK}) WHERE excerpt <> ' ' GROUP BY ALL")
def render_docs(spark, sf):
    top = snippets_of(*_index(spark, sf), 3)
    # At most three rows a group.
    all_ = top.groupBy("framework", "task").agg(F.array_sort(F.collect_list(F.struct("place", "title", "source_url", "excerpt"))).alias("s"))
    return all_.select("framework", "task", tx.render_docs(F.col("s")).alias("block"))


@query("prompt_assembly", f"SELECT sample_id, 'Solve ' || task || CASE WHEN sample_id % 3 > 0 THEN chr(10) || chr(10) || framework ELSE '' END || CASE WHEN sample_id % 2 > 0 THEN chr(10) || chr(10) || 'Think step by step.' ELSE '' END AS prompt FROM ({SAMPLES})")
def prompt_assembly(spark, sf):
    n = F.col("sample_id")
    docs, suffix = F.when(n % 3 > 0, F.col("framework")).otherwise(""), F.when(n % 2 > 0, F.lit("Think step by step."))
    return fx.samples(spark, sf).select("sample_id", tx.prompt(F.concat(F.lit("Solve "), "task"), docs, suffix).alias("prompt"))


@query("md_cells", f"""SELECT '| ' || variant || ' | ' || printf('%.2f', m) || ' | ' || CASE WHEN threads = 1 THEN '' ELSE '---' END || ' |' AS line FROM (SELECT variant, threads, avg(time_sec) AS m FROM ({TIMINGS}) GROUP BY ALL)""")
def md_cells(spark, sf):
    t = fx.timings(spark, sf).groupBy("variant", "threads").agg(F.avg("time_sec").alias("m"))
    odd = F.when(F.col("threads") > 1, F.lit(float("inf")))
    return t.select(tx.markdown_row([F.col("variant"), tx.markdown_cell(F.col("m")), tx.markdown_cell(odd)]).alias("line"))


@query("json_encode", f"SELECT sample_id, '{{\"model\":\"' || model || '\",\"note\":null,\"passed\":' || passed || ',\"sample_id\":' || sample_id || ',\"task\":\"' || task || '\"}}' AS line FROM ({SAMPLES})")
def json_encode(spark, sf):
    s = fx.samples(spark, sf)
    pairs = {c: F.col(c) for c in ("task", "model", "sample_id", "passed")} | {"note": F.lit(None).cast("string")}
    return s.select("sample_id", tx.sorted_json(pairs).alias("line"))


@query("json_decode", "SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, coalesce(props->>'$.framework', 'arrays') AS framework FROM events")
def json_decode(spark, sf):
    read = F.from_json("props", "k long, framework string", {"mode": "FAILFAST"})  # a malformed row is an error
    return fx.table(spark, sf, "events").select("event_id", read.alias("r")).select("event_id", F.coalesce("r.k", F.lit(-1)).alias("k"), F.coalesce("r.framework", F.lit("arrays")).alias("framework"))


@query("size_list_parse", "SELECT conv_id, turn, [conv_id + 1, turn + 2, 64]::INT[] AS sizes FROM conversations")
def size_list_parse(spark, sf):
    c = fx.table(spark, sf, "conversations")
    text = F.concat((F.col("conv_id") + 1).cast("string"), F.lit(", "), (F.col("turn") + 2).cast("string"), F.lit("  64,"))
    return c.select("conv_id", "turn", tx.int_list(text).alias("sizes"))


@query("normalise_option", "SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) AS option, replace('org/' || event_type, '/', '_') AS path FROM events")
def normalise_option(spark, sf):
    e = F.col("event_type")
    return fx.table(spark, sf, "events").select("event_id", F.lower(F.trim(F.concat(F.lit("  "), F.upper(e), F.lit(" ")))).alias("option"), F.replace(F.concat(F.lit("org/"), e), F.lit("/"), F.lit("_")).alias("path"))


@query("binomial_table", "SELECT DISTINCT p_size AS n, k::INT AS k, round(coalesce(list_product(list_transform(range(1, k + 1), lambda i: (p_size - k + i)::DOUBLE / i)), 1.0), 2) AS ways FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest(range(0, 4)) AS k) WHERE k <= p_size")
def binomial_table(spark, sf):
    """Ways to choose up to three of each number of things that parts come in."""
    n = fx.table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct()
    k = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).filter("k <= n")
    return k.select("n", "k", F.round(pk.binomial(F.col("n"), F.col("k")), 2).alias("ways"))
