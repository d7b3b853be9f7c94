"""Passages that repeat across documents: a sparse suffix array over minimiser positions.

A suffix is retained where a text's minimisers begin: every window of ``min_words`` words is owned by the
leftmost least hash of its GRAM-word grams, so equal windows have owners with equal grams. Suffixes whose
first gram occurs once are dropped; the others are sorted by that gram, document and position, and each is
compared with those before it that begin alike. A row carries what the extension to the left and to the
right needs: the hashes of all windows that its position owns, so two suffixes whose match reaches
``min_words`` words, however far to the left or right, share one. Nearest neighbours in the order of the
words alone would not do: where a passage ends in a phrase that many texts hold, its copies stand far apart.
The earliest occurrence of a window (least doc_id, then text hash and position) keeps its words and all
others lose them. Windows that overlap join into whole passages.

Texts with equal words are one class: only the first of them is indexed, and a copy of at least
``min_words`` words is a repeat from end to end.

The sort key ends in document and position, so that range partitioning splits a gram that a third of all
rows hold. The first and last gram of every partition may go on in another one: the windows that are new
there meet in a further round, sorted by their own hash, and the last round has one partition.

Cases: rows without id are left out; null and blank texts have no words; rows that share an id and differ
in text are documents of their own, rows equal in both are one document; texts under ``min_words`` words
never lose any; a very long text is indexed whole; an empty table gives an empty one. Output columns are
doc_id and those named below; other input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, materialize, semi_join
from .text import BASE, Words, mix64, windows

MIN_WORDS, GRAM = 50, 16
#: Rows that are compared at once, and windows of one gram that a partition holds before it hands them over.
PIECE, HELD = 8192, 1 << 20


def minimisers(grams: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``window`` consecutive ``grams`` of one text start, and the indices of the leftmost least ones of them."""
    n, text = len(grams), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    best, at, span = grams.copy(), np.arange(n), 1
    while span < window:  # the least of so many values doubles up to that of a window
        step = min(span, window - span)
        other = np.concatenate([best[step:], np.full(min(step, n), np.iinfo(np.uint64).max, np.uint64)])[:n]
        where = np.concatenate([at[step:], np.zeros(min(step, n), np.int64)])[:n]
        take = other < best
        best, at = np.where(take, other, best), np.where(take, where, at)
        span += step
    start = np.flatnonzero(np.arange(n) + window <= begin[1:][text])
    return start, at[start]


def _index(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, rids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for i, j, first, _, _, hashes in words.batches(texts):
                grams, begin = windows(hashes, first, GRAM)
                kept = np.unique(minimisers(grams, begin, min_words - GRAM + 1)[1])
                text = np.searchsorted(begin, kept, side="right") - 1
                at = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                anchors = pa.StructArray.from_arrays([pa.array(grams[kept].view(np.int64)), pa.array((kept - begin[text]).astype(np.int32))], ["h", "pos"])
                prints = [hashlib.blake2b(hashes[first[t] : first[t + 1]].tobytes(), digest_size=16).digest() for t in range(j - i)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), rids.slice(i, j - i), pa.array(prints, pa.binary()), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at), anchors)], ["doc_id", "rid", "fp", "n_words", "anchors"])

    return run


def _windows(min_words: int):
    """(h, doc_id, rid, pos, keys): the gram of each retained suffix, where the first window that it owns starts, and
    the hashes of its windows, one for each word from there on."""
    parts = [*range(0, min_words - GRAM, GRAM), min_words - GRAM]  # grams that cover a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            ids, rids, texts, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j, first, _, _, hashes in words.batches(texts):
                grams, begin = windows(hashes, first, GRAM)
                start, owner = minimisers(grams, begin, min_words - GRAM + 1)
                wanted = np.zeros(len(grams), bool)
                for t in range(i, j):
                    wanted[begin[t - i] + np.array(places[t], np.int64)] = True
                start, owner = start[wanted[owner]], owner[wanted[owner]]
                if not len(start):
                    continue
                key = np.zeros(len(start), np.uint64)
                for o in parts:
                    key = key * np.uint64(BASE) + grams[start + o]
                row = np.flatnonzero(np.diff(owner, prepend=-1))
                text = np.searchsorted(begin, owner[row], side="right") - 1
                yield _rows(NAMES[:5], grams[owner[row]].view(np.int64), ids[i + text], rids[i + text], start[row] - begin[text], mix64(key), np.append(row, len(key)))

    return run


def _rows(names: list[str], h: np.ndarray, doc: np.ndarray, rid: np.ndarray, pos: np.ndarray, key: np.ndarray, bounds: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    """Row i has key[bounds[i]:bounds[i + 1]], eight bytes each."""
    keys = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(key).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc, pa.int64()), pa.array(rid, pa.int64()), pa.array(pos.astype(np.int32)), keys, *more], names)


class _Sweep:
    """One pass over windows (h, doc, rid, pos, key), sorted by the first four, equal keys having equal h. ``lost`` has
    (doc, rid, from, to) of those that occurred before; ``outer`` the first (key, doc, rid, pos) in groups of h that may
    go on elsewhere."""

    def __init__(self, min_words: int, held: int = HELD) -> None:
        self.min_words, self.most, self.lost, self.outer = min_words, held, [], []
        self.h, self.edge, self.held = None, True, _NONE  # the open group, and its first occurrences by key

    def add(self, row: np.ndarray, h: np.ndarray, doc: np.ndarray, rid: np.ndarray, pos: np.ndarray, key: np.ndarray) -> None:
        """Windows of whole rows; ``row`` tells them apart."""
        new = np.zeros(len(key), bool)
        new[np.unique(key, return_index=True)[1]] = True
        if len(self.held[0]):
            new &= self.held[0][np.minimum(np.searchsorted(self.held[0], key), len(self.held[0]) - 1)] != key
        gone = np.flatnonzero(~new)
        if len(gone):  # consecutive windows of a row are one span
            cut = np.flatnonzero((np.diff(gone) != 1) | (np.diff(row[gone]) != 0)) + 1
            a, b = gone[np.append(0, cut)], gone[np.append(cut, len(gone)) - 1]
            self.lost.append((doc[a], rid[a], pos[a], pos[b] + self.min_words))
        if self.h is None:
            self.h = h[0]
        if self.h != h[-1]:
            self._hold(new & (h == self.h), key, doc, rid, pos)
            if self.edge:
                self.outer.append(self.held)
            self.h, self.edge, self.held = h[-1], False, _NONE
        self._hold(new & (h == self.h), key, doc, rid, pos)
        if len(self.held[0]) > self.most:  # the rest of the group goes to the next round too, which compares all of it
            self.outer.append(self.held)
            self.edge, self.held = True, _NONE

    def end(self) -> None:
        self.outer.append(self.held)

    def _hold(self, rows: np.ndarray, *columns: np.ndarray) -> None:
        if rows.any():
            held = [np.concatenate([x, y[rows]]) for x, y in zip(self.held, columns, strict=True)]
            order = np.argsort(held[0], kind="stable")
            self.held = tuple(x[order] for x in held)


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(min_words: int, held: int = HELD):
    """Sorted windows to (doc_id, rid, a, b) of lost words, and (a null) to what another partition may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(min_words, held)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                keys = part.column(4).to_pylist()
                size = np.array([len(k) // 8 for k in keys])
                row = np.repeat(np.arange(len(size)), size)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                h, doc, rid, pos = (part.column(c).to_numpy().astype(np.int64)[row] for c in range(4))
                sweep.add(row, h, doc, rid, pos + nth, np.frombuffer(b"".join(keys), np.uint64))
            yield from _found(sweep)
        sweep.end()
        yield from _found(sweep)

    return run


NAMES = ["h", "doc_id", "rid", "pos", "keys", "a", "b"]


def _found(sweep: _Sweep) -> Iterator[pa.RecordBatch]:
    """What the sweep has ready, and takes it from there."""
    if sweep.lost:
        doc, rid, a, b = (np.concatenate(x) for x in zip(*sweep.lost, strict=True))
        n = len(doc)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(doc), pa.array(rid), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], NAMES)
    for key, doc, rid, pos in sweep.outer:
        n = len(key)
        yield _rows(NAMES, key.view(np.int64), doc, rid, pos, key, np.arange(n + 1), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()))
    sweep.lost, sweep.outer = [], []


SUFFIX = "h long, doc_id long, rid long, pos int, keys binary"


def _compared(rows: DataFrame, partitions: int, min_words: int, name: str) -> DataFrame:
    keys = NAMES[:4]
    ordered = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.mapInArrow(_compare(min_words), f"{SUFFIX}, a int, b int"), name)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, rid, n_words, spans array<struct<a, b>>) of documents (doc_id, rid, text), told apart by the first two:
    words a..b-1 repeat words that an earlier place keeps; spans are apart and in order."""
    if min_words < GRAM:
        raise ValueError(f"min_words is at least {GRAM}")
    spark, id_ = docs.sparkSession, ["doc_id", "rid"]
    index = materialize(docs.mapInArrow(_index(min_words), "doc_id long, rid long, fp binary, n_words long, anchors array<struct<h: long, pos: int>>"), "index")
    heads = index.select(*id_, "fp", "n_words")
    rep = heads.groupBy("fp").agg(F.min(F.struct(*id_)).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp", "rep")
    rep = materialize(rep, "reps")  # as a table of its own the sorted join can be split at a text that many rows hold
    first = F.coalesce("rep", F.struct(*id_))
    heads = materialize(heads.join(rep, "fp", "left").groupBy(*id_).agg(F.min(first).alias("rep"), F.max("n_words").alias("n_words")), "heads")
    own = F.struct(*id_) == F.col("rep")
    anchors = materialize(index.join(heads.filter(own).select(*id_), id_, "left_semi").select(*id_, F.inline("anchors")).dropDuplicates([*id_, "pos"]), "anchors")
    discard(index, rep)
    often = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    places = semi_join(anchors, often, "h").groupBy(*id_).agg(F.collect_set("pos").alias("places"))
    owned = docs.dropDuplicates(id_).join(places, id_).mapInArrow(_windows(min_words), SUFFIX)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = [_compared(owned, partitions, min_words, "compared")]
    discard(anchors)
    parts = 0
    while parts != 1:  # a round of several partitions leaves at most two rows of each, so the last has one
        edges = found[-1].filter("a is null").select(*NAMES[:5])
        parts = max(1, edges.count() // (64 * PIECE))
        found.append(_compared(edges, parts, min_words, "edges"))
    lost = lambda table: table.filter("a is not null").select(*id_, "a", "b")
    marks = lost(found[0])
    for more in found[1:]:
        marks = marks.union(lost(more))
    per = marks.groupBy(*id_).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("raw"))
    copies = heads.filter(~own & (F.col("n_words") >= min_words)).select(*id_, F.array(F.struct(F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b"))).alias("raw"))
    empty = F.expr("cast(array() as array<struct<a: int, b: int>>)")

    def joined(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when((F.size(done) > 0) & (last["b"] >= s["a"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    spans = per.union(copies).select(*id_, F.aggregate("raw", empty, joined).alias("spans"))
    out = materialize(heads.select(*id_, "n_words").join(spans, id_, "left").select(*id_, "n_words", F.coalesce("spans", empty).alias("spans")), "spans")
    discard(heads, *found)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, and the spans as character offsets of the original."""
    words = Words()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        clean, offsets = list(texts), [[] for _ in texts]
        for t in [t for t, s in enumerate(spans) if s]:
            blob = texts[t].encode("utf-8", "replace")
            _, _, _, start, end, _ = next(words.batches([texts[t]]))
            kept, at = [], 0
            for s in spans[t]:
                lo, hi = (int(start[s["a"]]) if s["a"] else 0), (int(end[s["b"] - 1]) if s["b"] < len(end) else len(blob))
                kept.append(blob[at:lo])
                offsets[t].append({"start": len(blob[:lo].decode("utf-8", "replace")), "end": len(blob[:hi].decode("utf-8", "replace"))})
                at = hi
            clean[t] = b"".join([*kept, blob[at:]]).decode("utf-8", "replace").strip()
        gone = pa.array([sum(s["b"] - s["a"] for s in own) for own in spans], pa.int64())
        columns = [batch.column(0), pa.array(clean, pa.string()), pa.array(offsets, kind), batch.column(3), gone, *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "removed", "n_words", "n_removed", "rest"][: len(columns)])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, with_rest: bool = False) -> DataFrame:
    """(doc_id, text, removed, n_words, n_removed): each text without its repeated spans; ``removed`` has
    their character offsets in the original text. ``with_rest`` adds ``rest``, a struct of the row's other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.struct(*others).alias("rest")] if with_rest and others else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"), *rest).filter("doc_id is not null")
    joined = rows.join(repeated_spans(rows.select("doc_id", "rid", "text"), min_words), ["doc_id", "rid"]).select("doc_id", "text", "spans", "n_words", *["rest" for _ in rest])
    schema = T._parse_datatype_string("doc_id long, text string, removed array<struct<start: long, end: long>>, n_words long, n_removed long")
    return joined.mapInArrow(_cut, T.StructType([*schema.fields, *joined.schema.fields[4:]]))
