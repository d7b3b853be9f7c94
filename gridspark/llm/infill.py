"""Fill-in-middle documents: a text is cut at two unit borders, and its middle goes to the end.

A unit is a word with the white space before it, or white space that ends the text. The work is relational: the unit
lengths of each document become rows, a window sums them in order, cut requests meet the sums by unit ordinal, an
aggregate brings both offsets of a document together, and the text is cut there by substring.

Only numbers take part in that: the texts are read a second time and joined with their offsets, so a text is
shuffled once, and not at all where its form is plain. All of it is Spark SQL expressions.

Cases: a null text is the empty text; an empty text has no units and is plain, as is one that holds a sentinel; a null
id is drawn like the empty text; rows equal in id and text have one result, and each row gets it; rows that share an id and
differ in text are cut apart; a very long text is one row, its units many; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Units, matched left to right.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draw(doc_id: Column, nth: int, seed: int = 42) -> Column:
    """The ``nth`` 32-bit draw (from 1) of a document: eight digits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def form_of(doc_id: Column, text: Column, rate: int = 50, spm: int = 80, seed: int = 42) -> Column:
    """plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle): ``rate`` percent of the documents are cut, and of
    these ``spm`` percent begin with the suffix."""
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (draw(doc_id, 3, seed) % 100 >= rate)
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < spm, "spm").otherwise("psm")


def offsets(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(key, check, n, first, second): units of each text and the characters before its two cuts, for rows (doc_id, text, key, check)."""
    # The ordinal 0 stands for the cut before the first unit.
    sizes = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.length))
    texts = rows.select("key", "check", sizes.alias("sizes")).dropDuplicates(["key", "check"])
    units = texts.select("key", "check", F.posexplode("sizes").alias("unit", "chars"))
    ends = units.select("key", "check", "unit", F.sum("chars").over(Window.partitionBy("key", "check").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    counts = rows.select("doc_id", "key", "check", F.regexp_count("text", F.lit(UNIT)).alias("n")).dropDuplicates(["key", "check"])
    cut = [(draw(F.col("doc_id"), i, seed) % (F.col("n") + 1)) for i in (1, 2)]
    requests = counts.select("key", "check", "n", F.posexplode(F.array(F.least(*cut), F.greatest(*cut))).alias("nth", "cut"))
    # Both sides are dealt by document. With the ordinal as a further key of the join Spark would deal every unit once
    # more; as a difference it is a condition on the pairs of one document, of which each unit has two.
    met = ends.join(requests, (ends.key == requests.key) & (ends.check == requests.check) & (F.col("unit") - F.col("cut") == 0)).select(ends.key, ends.check, "n", "nth", "end")
    return met.groupBy("key", "check").agg(
        F.max("n").cast("long").alias("n"), F.max(F.when(F.col("nth") == 0, F.col("end"))).alias("first"), F.max(F.when(F.col("nth") == 1, F.col("end"))).alias("second")
    )


def arrange(text: Column, form: Column, first: Column, second: Column) -> Column:
    """The text in its form: cut after ``first`` and ``second`` characters."""
    prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`arrange` was given, from its output and form alone."""
    second, third = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    a, b = F.position(second, output), F.position(third, output)
    one, two, three = F.substring(output, F.lit(4), a - 4), F.substring(output, a + 3, b - a - 3), F.substring(output, b + 3, F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row: its units, its form, the characters of
    prefix and middle (null where plain) and the text to train on."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("form", form_of(F.col("doc_id"), F.col("text"), rate, spm, seed))
    plain = rows.filter("form = 'plain'").select(
        "doc_id", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), "form", F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output")
    )
    cut = rows.filter("form <> 'plain'").withColumn("key", F.xxhash64("doc_id", "text")).withColumn("check", F.hash("text", "doc_id"))
    # A table of its own: it is narrow, and its join with the texts can be split at rows that repeat.
    found = materialize(offsets(cut, seed), "offsets")
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    moved = cut.join(found, ["key", "check"]).select(
        "doc_id", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), arrange(F.col("text"), F.col("form"), first, second).alias("output")
    )
    return plain.unionByName(moved)
