"""CSV that keeps every text: commas, quotes, line breaks, outer spaces, the empty text and NULL come back as written.

A field is plain, without comma, quote or line break, or stands between quotes, with quotes inside doubled. NULL is the
plain word ``missing``; the same word between quotes is a text. Files are read in blocks, in parallel, though a
quoted field may go on over lines and over the border of a block. A line alone does not tell whether it begins
inside a quoted field; the number of quotes before it does. So blocks are read twice: once to count their
quotes, of which one row a block remains, and once, each with the knowledge how it begins, for the records. A record
that a border cuts is put together from its pieces, at most two of each block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.plans.iterate import cut

MISSING = "missing"
#: What must stand between quotes besides the empty text and MISSING.
QUOTED = r'[",\r\n]|^\s|\s$'
FIELD = re.compile(r'"([^"]*(?:""[^"]*)*)"|([^",]*)')


def _written(names: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' if n in ("", MISSING) or re.search(QUOTED, n) else n for n in names)


def formatted(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Columns as text by printf formats; others as they are."""
    return df.select([F.format_string(formats[c], F.col(f"`{c}`")).alias(c) if c in formats else F.col(f"`{c}`") for c in df.columns])


def _line(df: DataFrame) -> Column:
    """A row as one record."""
    def field(k: int, name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        quote = (text == "") | (text == MISSING) | text.rlike(QUOTED)
        if k == 0:  # else a row of the names would be taken for the header
            quote = quote | (text == name)
        return F.coalesce(F.when(quote, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(MISSING))

    return F.concat_ws(",", *[field(k, c) for k, c in enumerate(df.columns)])


def _headed(header: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = lambda schema: pa.RecordBatch.from_arrays([pa.array([header], pa.string())], schema=schema)
        first, schema = True, pa.schema([("value", pa.string())])
        for batch in batches:
            schema = batch.schema
            if first and batch.num_rows:
                yield head(schema)
                first = False
            yield batch
        if first and TaskContext.get().partitionId() == 0:
            yield head(schema)

    return run


def write_csv(df: DataFrame, path: str, formats: dict[str, str] | None = None, append: bool = True) -> None:
    """Rows as CSV, each part with the header; more rows are appended as further parts."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise ValueError(f"no CSV form of {', '.join(nested)}")
    lines = formatted(df, formats or {})
    lines.select(_line(lines).alias("value")).mapInArrow(_headed(_written(df.columns)), "value string").write.mode("append" if append else "overwrite").option("lineSep", "\n").text(path)


def fields(record: str) -> list[str | None]:
    """The fields of one record."""
    if '"' not in record:
        return [None if x == MISSING else x for x in record.split(",")]
    out, at = [], 0
    while True:
        m = FIELD.match(record, at)
        out.append(m[1].replace('""', '"') if m[1] is not None else None if m[2] == MISSING else m[2])
        at = m.end()
        if at == len(record):
            return out
        if record[at] != ",":
            raise ValueError(f"a quote within a plain field or text after a quoted one: {record[:200]}")
        at += 1


def _parsed(record: str, names: list[str]) -> list[str | None] | None:
    """Its fields; None for a header or a blank line."""
    record = record.removesuffix("\r")
    if record.strip() == "" or record == _written(names):
        return None
    got = fields(record)
    if len(got) != len(names):
        raise ValueError(f"not {len(names)} fields: {record[:200]}")
    return got


CELLS = "cells array<string>, file long, block long, nth int, piece string"


def _reader(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (value, file, block, inside), block by block in their order, to records, and to pieces of those that a border cuts:
    nth 0 is what goes on from an earlier block, 1 what a later one continues."""
    kinds = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, open_, before, rows = None, [], False, False, []

        def left_over() -> None:
            if held:
                rows.append((None, *at, 0 if before else 1, "\n".join(held)))

        for batch in batches:
            for value, *key, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    left_over()
                    at, held, open_, before = key, [], inside, inside
                held.append(value)
                open_ ^= value.count('"') % 2 == 1
                if open_:
                    continue
                record, held = "\n".join(held), []
                if before:
                    rows.append((None, *key, 0, record))
                    before = False
                elif (cells := _parsed(record, names)) is not None:
                    rows.append((cells, *key, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in CELLS.split(", ")])
                rows = []
        left_over()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in CELLS.split(", ")])

    return run


def _whole(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for r in batch.column(0).to_pylist() if (c := _parsed(r, names)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["cells"])

    return run


def _plain_cells(lines: DataFrame, names: list[str]) -> DataFrame:
    """Records of files without any quote."""
    rows = lines.select(F.regexp_replace("value", "\r$", "").alias("line")).filter((F.trim("line") != "") & (F.col("line") != _written(names)))
    wrong = F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.substring("line", 1, 200)))
    cells = F.split("line", ",", -1)
    checked = rows.select(F.when(F.size(cells) == len(names), cells).otherwise(wrong.cast("array<string>")).alias("cells"))
    return checked.select(F.transform("cells", lambda c: F.when(c != MISSING, c)).alias("cells"))


def _quoted_cells(lines: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """Records of files with quotes; ``blocks`` (file, block, odd) has one row a block."""
    order = Window.partitionBy("file").orderBy("block")
    begun = (F.sum(F.col("odd").cast("int")).over(order) - F.col("odd").cast("int")) % 2 == 1
    known = cut(blocks.select("file", "block", begun.alias("inside"), (begun != F.col("odd")).alias("opens")))
    # One row a block of the input; a block without one means that the input was cut otherwise the second time.
    told = lines.join(F.broadcast(known), ["file", "block"], "left")
    lost = F.raise_error(F.lit("the files were split in another way when read again")).cast("boolean")
    told = told.select("value", "file", "block", F.coalesce("inside", lost).alias("inside"), "opens")
    whole = told.drop("opens").mapInArrow(_reader(names), CELLS).filter("cells is not null").select("cells")
    if known.filter("inside").isEmpty():
        return whole
    pieces = told.filter("inside or opens").drop("opens").mapInArrow(_reader(names), CELLS).filter("piece is not null")
    nth = F.sum(F.col("nth")).over(Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0))
    record = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "nth", "piece"))), lambda p: p["piece"]), "\n")
    joined = pieces.withColumn("record", nth).groupBy("file", "record").agg(record.alias("text")).select("text")
    return whole.unionAll(joined.mapInArrow(_whole(names), "cells array<string>"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header in each file. Blank lines are skipped; a record with another number of fields, one that breaks the
    grammar, a quote that is never closed or a field that is no value of its type is an error."""
    kinds = T._parse_datatype_string(schema).fields
    names = [f.name for f in kinds]
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = cut(lines.groupBy("file", "block").agg((F.sum(quotes) > 0).alias("any"), (F.sum(quotes) % 2 == 1).alias("odd")))
    some, unclosed = blocks.groupBy("file").agg(F.max("any").alias("any"), (F.sum(F.col("odd").cast("int")) % 2 == 1).alias("bad")).agg(F.max("any"), F.max("bad")).first()
    if unclosed:
        raise ValueError(f"a quote is not closed in {path}")
    cells = _quoted_cells(lines, blocks, names) if some else _plain_cells(lines, names)
    return cells.select([F.get("cells", F.lit(k)).cast(f.dataType).alias(f.name) for k, f in enumerate(kinds)])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def merged_csv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The rows of all those CSV files that exist, as a bag: equal rows stay, headers go."""
    there = [p for p in paths if exists(spark, p)]
    return reduce(DataFrame.unionAll, [read_csv(spark, p, schema) for p in there]) if there else spark.createDataFrame([], schema)
