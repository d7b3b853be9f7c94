"""Deterministic inputs over the driver's tables: grids, particles, matrices, samples, timings, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, IMAGE_WIDTH = 100, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(key: str, width: int) -> list:
    return [F.floor(F.col(key) / width).cast("int").alias("y"), (F.col(key) % width).cast("int").alias("x")]


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life cells (y, x, a)."""
    return table(spark, sf_dir, "events").select(*_cell("event_id", WIDTH), (F.col("event_type") == "click").cast("int").alias("a"))


def plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat cells (y, x, v FLOAT)."""
    return table(spark, sf_dir, "events").select(*_cell("event_id", WIDTH), F.col("value").cast("float").alias("v"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image cells (y, x, v) with small integers, so that sums are exact."""
    return table(spark, sf_dir, "part").select(*_cell("p_partkey", IMAGE_WIDTH), F.col("p_size").cast("long").alias("v"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda k: (F.get("embedding", F.lit(k)).cast("double") + 0.5)
    zero = F.lit(0.0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"),
        zero.alias("vx"), zero.alias("vy"), zero.alias("vz"), (1.0 + F.col("label")).cast("double").alias("mass"),
    )


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (i, j, v) of the embeddings as a matrix."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode(F.transform("embedding", lambda v: v.cast("double"))).alias("j", "v"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated samples: task, model, framework, sample_id, passed, elapsed_sec."""
    frameworks = F.array(F.lit("arrays"), F.lit("kernels"), F.lit("tasks"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.get(frameworks, (F.col("event_id") % 3).cast("int")).alias("framework"), F.col("event_id").alias("sample_id"),
        (F.col("value") < 20).alias("passed"), F.col("value").alias("elapsed_sec"),
    )


def native(samples_: DataFrame) -> DataFrame:
    """Reference runs by (task, framework); the pair (click, arrays) has none."""
    pairs = samples_.select("task", "framework").distinct().filter("not (task = 'click' and framework = 'arrays')")
    return pairs.select("task", "framework", (F.col("framework") != "tasks").alias("reference_passed"), F.length("task").cast("double").alias("reference_elapsed_sec"))


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("variant"), F.expr("shiftleft(1L, l_linenumber - 1)").alias("threads"), F.col("l_quantity").alias("time_sec")
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines in file order: seq, nthreads, total_s."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (1 + F.floor(F.col("event_id") / 7) % 4).cast("long").alias("nthreads"), F.col("value").alias("total_s"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies: every third text stands in a fenced block."""
    fence = F.lit("`" * 3)
    fenced = F.concat(fence, F.lit("julia\n"), F.col("text"), F.lit("\n"), fence)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, fenced).otherwise(F.col("text")).alias("response"))


#: The same inputs for DuckDB.
SQL = {
    "world": f"SELECT (event_id // {WIDTH})::INT AS y, (event_id % {WIDTH})::INT AS x, (event_type = 'click')::INT AS a FROM events",
    "plate": f"SELECT (event_id // {WIDTH})::INT AS y, (event_id % {WIDTH})::INT AS x, value::FLOAT AS v FROM events",
    "image": f"SELECT (p_partkey // {IMAGE_WIDTH})::INT AS y, (p_partkey % {IMAGE_WIDTH})::INT AS x, p_size::BIGINT AS v FROM part",
    "particles": "SELECT vec_id AS id, embedding[1]::DOUBLE + 0.5 AS x, embedding[2]::DOUBLE + 0.5 AS y, embedding[3]::DOUBLE + 0.5 AS z, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, (1.0 + label)::DOUBLE AS mass FROM embeddings",
    "matrix": "SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INT AS j, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "samples": "SELECT event_type AS task, 'm' || (user_id % 3) AS model, (['arrays', 'kernels', 'tasks'])[(event_id % 3) + 1] AS framework, event_id AS sample_id, value < 20 AS passed, value AS elapsed_sec FROM events",
    "timings": "SELECT l_returnflag AS variant, (1::BIGINT << (l_linenumber - 1)) AS threads, l_quantity AS time_sec FROM lineitem",
    "log": "SELECT event_id AS seq, 1 + (event_id // 7) % 4 AS nthreads, value AS total_s FROM events",
    "responses": "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN '```julia' || chr(10) || text || chr(10) || '```' ELSE text END AS response FROM conversations",
}
SQL["native"] = f"SELECT DISTINCT task, framework, framework <> 'tasks' AS reference_passed, length(task)::DOUBLE AS reference_elapsed_sec FROM ({SQL['samples']}) WHERE NOT (task = 'click' AND framework = 'arrays')"
