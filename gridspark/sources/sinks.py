"""Writers of study files: JSON lines and Markdown tables; that of CSV is in delimited.py. Each writes a folder of part files, in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.text import markdown_cell


def write_json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    """One object a row; fields that are NULL are left out."""
    df.write.mode("append" if append else "overwrite").json(path, ignoreNullFields=True)


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(position, line) of a Markdown table: head, rule, then the rows in the order of ``order``, which must tell rows apart."""
    def cell(f: T.StructField) -> Column:
        kind = f.dataType
        return markdown_cell(F.col(f.name)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.coalesce(F.col(f.name).cast("string"), F.lit(""))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |"))
    rows = df.select(F.struct(F.lit(2).alias("part"), *order).alias("position"), line.alias("line"))
    blank = lambda k: F.struct(F.lit(k).alias("part"), *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order])
    heads = [(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "|".join(["---"] * len(df.columns)) + "|")]
    top = reduce(DataFrame.unionAll, [df.sparkSession.range(1).select(blank(k).alias("position"), F.lit(x).alias("line")) for k, x in heads])
    return top.unionAll(rows)


def write_markdown(df: DataFrame, path: str, order: list[str]) -> None:
    """The lines as text; the parts, in the order of their names, are the table."""
    markdown_lines(df, order).orderBy("position").select("line").write.mode("overwrite").text(path)
