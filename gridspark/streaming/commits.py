"""Batches of a stream, each written once.

A batch's rows go to a folder of their own; then one small file, named by the batch, says which folder counts. That
file is made whole or not at all, and never twice. A stream that stops before it leaves a folder that no one reads, and
writes the batch again; one that stops after it finds the file when it comes again, and adds nothing. Readers see the
batches whose files are there, whatever is being written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def mark(spark: SparkSession, path: str, folder: str) -> None:
    """A file that names the folder; an error if there is one already."""
    fs, target = _path(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(folder.encode()))
    finally:
        out.close()


def writer(out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: commits each batch below ``out``."""
    def put(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, f"{out}/commits/{batch_id:012d}"
        if exists(spark, done):
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state goes on with the batch all the same
            return
        folder = f"{batch_id:012d}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{out}/data/{folder}")
        mark(spark, done, folder)

    return put


def committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of all committed batches."""
    if not exists(spark, f"{out}/commits"):
        return spark.createDataFrame([], schema)
    folders = spark.read.text(f"{out}/commits").select(F.col("value").alias("_folder"))  # a row a batch
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/data")
    return rows.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(folders), "_folder", "left_semi").drop("_folder")


def latest(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of the last committed batch."""
    last = spark.read.text(f"{out}/commits").agg(F.max("value")).first()[0] if exists(spark, f"{out}/commits") else None
    return spark.read.schema(schema).parquet(f"{out}/data/{last}") if last else spark.createDataFrame([], schema)
