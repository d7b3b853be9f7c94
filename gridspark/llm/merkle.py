"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

A paragraph is a line. A section ends after a paragraph whose digest begins with 0 or 1, so that an
insertion moves no section border but those beside it. Leaves are runs of at most LEAF characters
that end at a full stop; a parent's digest is the SHA-256 of its children's. The fingerprint is

    root|paragraph.leaf leaf ...,paragraph...;paragraph...

with 64 hexadecimal digits of the root and eight of each paragraph and leaf; ``;`` ends a section.
Equal roots mean equal texts; :func:`differing` names the sections and paragraphs that differ, and
:func:`likeness` is the share of distinct leaves that two fingerprints have in common.

Everything is built from Spark SQL expressions. Cases: a null text is the empty text, with one
empty paragraph; likeness of two texts without leaves is 1 and of one such with another is 0. Rows that
share an id, repeated ones too, follow each other in the order of their texts, and rows without id come last;
a table of one row is its own next; a very long text is one row; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.order import bounds, bucket

from .storage import materialize

LEAF = 160
LEAVES = r"[^.]{1,%d}\.?|\." % LEAF


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column) -> Column:
    sha = lambda c: F.sha2(c, 256)
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), sha)
    paragraph = lambda ls: F.struct(sha(F.array_join(ls, "")).alias("d"), F.array_join(F.transform(ls, lambda x: F.substring(x, 1, 8)), "").alias("l"))
    mark = lambda p: F.when(F.substring(p["d"], 1, 1).isin("0", "1"), ";").otherwise(",")

    def tree(ps: Column) -> Column:
        digests = F.array_join(F.transform(ps, lambda p: F.concat(p["d"], mark(p))), "")
        sections = F.split(F.rtrim(digests, F.lit(";,")), ";")
        root = sha(F.array_join(F.transform(sections, lambda s: sha(F.rtrim(s, F.lit(",")))), ","))
        body = F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p["d"], 1, 8), F.lit("."), p["l"], mark(p))), "")
        return F.concat(root, F.lit("|"), F.rtrim(body, F.lit(";,")))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(F.transform(lines, lambda p: let(leaves(p), paragraph)), tree)


def leaves_of(print_: Column) -> Column:
    """The distinct leaf digests of a fingerprint."""
    paragraphs = F.split(F.substring(print_, 66, 1 << 30), "[,;]")
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, 10, 1 << 30), F.lit("[0-9a-f]{8}"), F.lit(0)))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: common leaves by all leaves of the two."""
    by = lambda x, y: let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))
    shared = let(leaves_of(a), lambda x: let(leaves_of(b), lambda y: by(x, y)))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(F.round(shared, 6))


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0) of the paragraphs of ``a`` that no paragraph of ``b`` equals."""
    sections = lambda f: F.transform(F.split(F.substring(f, 66, 1 << 30), ";"), lambda s: F.split(s, ","))
    place = lambda known: F.flatten(F.transform(sections(a), lambda s, i: F.filter(F.transform(s, lambda p, j: F.when(~F.array_contains(known, p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())))
    return let(F.flatten(sections(b)), place)


def with_next(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each row with the next by descending doc_id, the first after the last.

    Rows meet in buckets of neighbouring ids; the first row of the bucket that follows joins each as a guest.
    Equal ids are in the order of their texts, and a null id comes last.
    """
    cuts = bounds(docs, "doc_id", rows_each)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket("doc_id", cuts)).withColumn("print", fingerprint(F.col("text")))
    # One row a bucket, written, so that Spark knows its size when it chooses the join.
    first = docs.withColumn("bucket", bucket("doc_id", cuts)).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.col("bucket").desc())
    host = first.withColumn("host", F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy())))
    host = materialize(host, "hosts")
    guests = docs.join(host, docs.doc_id.eqNullSafe(F.col("top"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("host").alias("bucket"))
    guests = guests.withColumn("print", fingerprint(F.col("text")))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    near = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    both = both.withColumn("next_text", F.lead("text").over(near)).withColumn("next_print", F.lead("print").over(near))
    return both.filter("guest = 0").drop("guest", "bucket")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its characters replaced by as many
    of the next text's first ones."""
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "print", "next_print",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
    )
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_print")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
