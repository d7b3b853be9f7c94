"""Readers of study files: JSON lines, JSON documents, logs, whole texts, listings; those of CSV are in delimited.py.

Paths go to Spark's readers alone, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Evaluated samples; those after ``framework`` may be missing in a line.
REQUIRED = "task string, model string, sample_id int, passed boolean, elapsed_sec double"
OPTIONAL = "framework string, reference_passed boolean, reference_elapsed_sec double, sample_elapsed_over_reference double"


def json_lines(spark: SparkSession, path: str | list[str], required: str, optional: str = "", defaults: dict[str, object] | None = None) -> DataFrame:
    """One object a line; blank lines are skipped. A line that is no object, a field of another type or a required field
    that is missing is an error; optional fields are NULL, or their default, where they are missing."""
    kinds = lambda ddl: T._parse_datatype_string(ddl).fields if ddl else []
    needed = kinds(required)
    return decoded(spark.read.text(path), T.StructType([*needed, *kinds(optional)]), [f.name for f in needed], defaults)


def decoded(lines: DataFrame, schema: T.StructType, required: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """The same for a table of lines (value)."""
    rows = lines.filter(F.trim("value") != "").select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))

    def column(name: str) -> Column:
        got = F.col(f"r.{name}")
        if name in required:
            got = F.coalesce(got, F.raise_error(F.concat(F.lit(f"no {name} in: "), F.substring("value", 1, 200))).cast(schema[name].dataType))
        elif name in (defaults or {}):
            got = F.coalesce(got, F.lit(defaults[name]))
        return got.alias(name)

    return rows.select([column(f.name) for f in schema.fields])


def read_samples(spark: SparkSession, path: str | list[str], framework: str = "arrays") -> DataFrame:
    """Evaluated samples of a study; ``framework`` stands in where a line names none."""
    return json_lines(spark, path, REQUIRED, OPTIONAL, {"framework": framework})


def json_document(spark: SparkSession, path: str, fields: str, key: str = "id") -> DataFrame:
    """Whole-file JSON as rows (``key``, fields...): an array of objects, one object with ``key`` among its fields, or an
    object that maps keys to objects. Rows without a key, or with an empty one, are skipped."""
    whole = spark.read.text(path, wholetext=True)
    item = T._parse_datatype_string(f"{key} string, {fields}")
    inner = T._parse_datatype_string(fields)
    strict = {"mode": "FAILFAST"}
    text = F.regexp_replace("value", r"^\s+", "")
    array = text.startswith("[")
    single = F.get_json_object("value", f"$.{key}").isNotNull()
    listed = whole.filter(array).select(F.explode(F.from_json("value", T.ArrayType(item), strict)).alias("r")).select("r.*")
    one = whole.filter(~array & single).select(F.from_json("value", item, strict).alias("r")).select("r.*")
    mapped = whole.filter(~array & ~single).select(F.explode(F.from_json("value", T.MapType(T.StringType(), inner), strict)).alias(key, "r")).select(key, "r.*")
    return listed.unionByName(one).unionByName(mapped).filter(F.coalesce(F.col(key), F.lit("")) != "")


def timing_lines(lines: DataFrame, marker: str = "timings") -> DataFrame:
    """(nthreads, total_s, dp_s, dp_frac and other columns of ``lines``) of the lines (value) that name ``marker`` and have
    the first two; dp_s and dp_frac are NaN where they are missing."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"

    def found(key: str) -> Column:
        got = F.regexp_extract("value", rf'"{key}":\s*{number}', 1)
        return F.when(got != "", got.cast("double"))

    nan = F.lit(float("nan"))
    rows = lines.filter(F.contains("value", F.lit(marker))).withColumns({"nthreads": found("nthreads").cast("long"), "total_s": found("total_s")})
    rows = rows.filter("nthreads is not null and total_s is not null")
    return rows.withColumns({"dp_s": F.coalesce(found("dp_s"), nan), "dp_frac": F.coalesce(found("dp_frac"), nan)}).drop("value")


def constant(texts: DataFrame, name: str) -> DataFrame:
    """``texts`` (path, value: a whole source file) with ``code``: the triple-quoted constant ``name``, stripped; an error
    where there is none."""
    got = F.regexp_extract_all("value", F.lit(rf'(?s)const\s+{name}\s*=\s*"""(.*?)"""'), F.lit(1))
    absent = F.raise_error(F.concat(F.lit(f"no constant {name} in "), F.col("path")))
    return texts.select("path", F.regexp_replace(F.coalesce(F.get(got, F.lit(0)), absent.cast("string")), r"^\s+|\s+$", "").alias("code"))


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, name, length) of the files under ``path``, by name, whose names end in ``suffix``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.filter(F.col("name").endswith(suffix)).orderBy("name", "path")
