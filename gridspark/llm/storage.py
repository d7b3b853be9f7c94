"""Tables that cut lineage: Parquet in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset and all runs in one process (tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from the files,
    whichever executors are lost. The caller passes the result to :func:`discard` when done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridspark/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(schema).parquet(path)
    back._gridspark_path = path
    _written.append(back)
    return back


#: What :func:`materialize` has written and :func:`discard` has not deleted.
_written: list[DataFrame] = []


def mark() -> int:
    """A point in time for :func:`release`."""
    return len(_written)


def release(since: int, *kept: DataFrame) -> None:
    """Discard all tables written since :func:`mark` gave ``since`` but ``kept``. What is computed from them must be
    written by then."""
    discard(*[df for df in _written[since:] if all(df is not k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_gridspark_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            _written[:] = [x for x in _written if x is not df]


#: Most keys that are sent to every executor; with more, both sides are shuffled.
BROADCAST_KEYS = 100_000


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (distinct longs); a wide ``df`` stays where it is if the keys,
    counted first, are few."""
    keys = materialize(keys, "keys")  # as a table of its own the sorted join can be split at keys that many rows hold
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")
