"""Repeated lines, paragraphs or wrapped lines: each unit's first occurrence stays, later ones go.

Units are the lines of a text (``line``), its paragraphs (``paragraph``: runs of lines up to a blank
one), or its lines wrapped at sentence ends (``sentence``), which also meet where two texts break the
same passage into other lines. A unit is normalised (lower case, runs of white space to one space, ends
trimmed) and stands as a 96-bit digest; digests are grouped over all documents, and the occurrence with
the least (doc_id, text hash, place) stays. Of the others, those go that stand in a run of at least
``min_words`` words of such repeated units: a short line that many texts hold by chance is no passage.
With ``min_words`` 1 every repeated unit goes. Blank units are none, and break no run.

The first occurrence of each digest comes from partial minima, so a line that a third of all rows
hold costs one row a task; the join back is one that adaptive execution can split.

Repeated units that stay, as their run has too few words, are reported with their offsets too.

Cases: rows without id are left out; a null text has no units and stays null; rows that share an id and
differ in text are documents of their own; rows equal in id and text are one document, and each keeps
what that keeps; a very long text is one row throughout; an empty table gives an empty table; other
input columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Lines are wrapped at a space after one of these.
STOPS = (". ", "! ", "? ")
UNITS = ("line", "paragraph", "sentence")
MIN_WORDS = 30
#: Bytes of a digest: enough for 10**12 units to have no two alike by chance but for one in 10**5 corpora.
DIGEST = 12
#: A line break before a blank line; the same pattern in Java and in Python.
BLANK = r"\n(?=[ \t\r]*\n)"


def _split(text: Column, unit: str) -> Column:
    """The units of a text, which one character parts from each other."""
    if unit == "sentence":
        for stop in STOPS:
            text = F.replace(text, F.lit(stop), F.lit(stop[0] + "\n"))
    return F.split(text, BLANK if unit == "paragraph" else "\n", -1)


def _splitter(unit: str) -> Callable[[str], list[str]]:
    """The same in Python."""
    if unit == "paragraph":
        return re.compile(BLANK).split

    def split(text: str) -> list[str]:
        if unit == "sentence":
            for stop in STOPS:
                text = text.replace(stop, stop[0] + "\n")
        return text.split("\n")

    return split


def repeated_units(docs: DataFrame, unit: str) -> DataFrame:
    """(doc_id, rid, gone array<struct<nth, at, words>>): units that occurred before, of rows with columns doc_id, rid and
    text. ``nth`` numbers a text's units that are not blank, ``at`` all of them."""
    body = lambda u: F.trim(F.regexp_replace(F.lower(u), r"\s+", " "))
    each = F.transform(_split(F.col("text"), unit), lambda u, i: F.struct(i.alias("at"), body(u).alias("body")))
    flat = docs.filter("text is not null").select("doc_id", "rid", F.posexplode(F.filter(each, lambda u: u["body"] != "")).alias("nth", "u"))
    flat = materialize(flat.select("doc_id", "rid", "nth", "u.at", F.size(F.split("u.body", " ")).alias("words"), F.substring(F.unhex(F.md5("u.body")), 1, DIGEST).alias("digest")), "units")
    first = flat.groupBy("digest").agg(F.min(F.struct("doc_id", "rid", "nth")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    first = materialize(first, "firsts")  # as a table of its own the sorted join can be split at digests that many rows hold
    gone = flat.join(first, "digest").filter(F.struct("doc_id", "rid", "nth") != F.col("first"))
    return gone.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("nth", "at", "words")).alias("gone"))


def _drop(units: list[dict], min_words: int) -> set[int]:
    """Which of the repeated units stand in runs of enough words."""
    units = sorted((u["nth"], u["at"], u["words"]) for u in units)
    out, i = set(), 0
    while i < len(units):
        j = i + 1
        while j < len(units) and units[j][0] == units[j - 1][0] + 1:
            j += 1
        if sum(u[2] for u in units[i:j]) >= min_words:
            out.update(u[1] for u in units[i:j])
        i = j
    return out


def _cut(unit: str, min_words: int):
    split = _splitter(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            clean, count, spans, spared = [], [], [], []
            for text, units in zip(texts, gone, strict=True):
                parts = split(text) if text is not None else []
                drop, at, removed, kept = _drop(units or [], min_words), 0, [], []
                again, left = {u["at"] for u in units or []}, []
                for i, part in enumerate(parts):
                    if i in drop:
                        removed.append({"start": at, "end": at + len(part)})
                    else:  # with the character that parts it from what is before
                        if i in again:
                            left.append({"start": at, "end": at + len(part)})
                        kept.append(text[max(at - 1, 0) : at + len(part)] if kept else part)
                    at += len(part) + 1
                clean.append("".join(kept) if text is not None else None)
                count.append(len(parts))
                spans.append(removed)
                spared.append(left)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clean, pa.string()), pa.array(count, pa.int32()), pa.array([len(x) for x in spans], pa.int32()), pa.array(spans, kind), pa.array(spared, kind)],
                ["doc_id", "text", "n_units", "n_removed", "removed", "spared"],
            )

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """(doc_id, text, n_units, n_removed, removed, spared array<struct<start, end>>) for every row with an id: the text without its
    repeated units, where these were in the original, in characters, and where those are that stay in too short a run."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("rid"), F.col(text_col).alias("text")).filter("doc_id is not null")
    joined = rows.join(repeated_units(rows, unit), ["doc_id", "rid"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_cut(unit, min_words), "doc_id long, text string, n_units int, n_removed int, removed array<struct<start: long, end: long>>, spared array<struct<start: long, end: long>>")
