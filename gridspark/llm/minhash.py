"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on whole shingle sets.

Signature: a permutation ``sigma`` spreads the shingles over 2**32 places, and coordinate k is the
least ``pi(sigma(s) + k)``, so one second permutation, shifted circularly, gives every coordinate.
With 4 rows in each of 32 bands a pair of Jaccard 0.75 shares no band with chance
(1 - 0.75**4)**32 = 5e-6.

Equal sets are one class with its smallest id; only classes are banded. In a bucket each class is
compared with one pivot, not with all others. Of a bucket whose classes are then in several
components, pairs across components are compared too: all of them in buckets of at most SMALL
classes; in larger ones those that the bound of :func:`_probes` leaves, which drops classes with too
many shingles of their own to reach the threshold with anything. So a pair that shares a bucket is
examined, or already connected, or ruled out by that bound.

Cases: rows without id are left out; null or blank texts have no shingles and link with nothing;
texts under five words are one shingle; repeated rows give repeated rows; rows that share an id and differ in
text are linked each by its own text, ids being under 2**62 then; a very long text is one set; a link at
exactly the threshold counts; an empty table gives an empty table; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize, semi_join
from .text import Words, mix64, windows

WORDS, ROWS, BANDS = 5, 4, 32
#: Buckets of so many classes are compared in full: at most SMALL / 2 pairs for each of their rows.
SMALL = 16


def shingle_sets(texts: list[str | None], k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, shingles, begin) for runs of texts from texts[i]: text i+t has shingles[begin[t]:begin[t+1]], with repeats."""
    words = Words()
    for i, _, first, _, _, hashes in words.batches(texts):
        shingles, begin = windows(hashes, first, k)
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            whole = np.full(len(short), 0x51ED270B, np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                whole[has] = mix64(whole[has] + hashes[first[short[has]] + j])
            shingles = np.insert(shingles, begin[short], whole)
            begin = begin + np.concatenate(([0], np.cumsum((count > 0) & (count < k))))
        yield i, shingles, begin


def signatures(shingles: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates) of uint32 minima; texts without shingles get the largest value."""
    out = np.full((len(begin) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(begin))
    if not len(filled):
        return out
    sigma = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
    at = begin[:-1][filled]
    for k in range(coordinates):
        x = sigma + np.uint32(k)  # the circular shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        out[filled, k] = np.minimum.reduceat(x, at)
    return out


def _sign(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, shingles, begin in shingle_sets(texts):
                n = len(begin) - 1
                sets = [np.unique(shingles[begin[t] : begin[t + 1]]) for t in range(n)]
                sig = signatures(shingles, begin, rows * bands).reshape(n, bands, rows).astype(np.uint64)
                key = np.zeros((n, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, n), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(_print, sets), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "fp", "bands"],
                )

    return run


def _print(shingles: np.ndarray) -> bytes:
    """Of a sorted set: equal for equal sets only."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for i, shingles, begin in shingle_sets(texts):
            sets = [np.unique(shingles[begin[t] : begin[t + 1]]) for t in range(len(begin) - 1)]
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, len(sets)), pa.array(map(_print, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], ["doc_id", "fp", "shingles"]
            )


def _named(classes: DataFrame) -> tuple[DataFrame, bool]:
    """``classes`` with ``id``: the least doc_id, or where that has several texts a number of its own for all but one; and
    whether there are such."""
    texts = materialize(classes.groupBy("rep").agg(F.min("fp").alias("own"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("rep", "own"), "shared")
    if texts.isEmpty():
        return classes.withColumn("id", F.col("rep")), False
    apart = F.lit(1 << 62) + F.pmod(F.xxhash64("fp"), F.lit(1 << 62))
    return materialize(classes.join(texts, "rep", "left").withColumn("id", F.when(F.col("own") != F.col("fp"), apart).otherwise(F.col("rep"))).drop("own"), "named"), True


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("total"))
    return materialize(both.filter(F.col("common") * 100 >= F.col("total") * percent).select("a", "b"), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (id, component) brought up to date with further ``links``; itself if there are none."""
    if label is None:
        return materialize(connected_components(links), "component")
    if links.isEmpty():
        return label
    stars = label.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return materialize(connected_components(stars.union(links)), "component")


def _tagged(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of those buckets that hold more than one component, with each row's component."""
    rows = buckets.join(label, "id", "left").withColumn("component", F.coalesce("component", "id")).select("key", "id", "n", "c", "component")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return materialize(rows.join(mixed, "key"), "tagged")


def _own(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, u): how many shingles of each of ``ids`` no other of them has."""
    single = sets.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s"))
    single = single.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("id")).filter("k = 1")
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("u"))


def _probes(large: DataFrame, percent: int) -> DataFrame:
    """(key, class, id, component, u, target): the rows of large buckets, and the size classes of their bucket in
    which a partner from another component is possible.

    A partner of x has n shingles, lacks the u ones that x alone has, and so meets at most n_x - u of x's in a
    union of at least n + u: 100 * (n_x - u) >= percent * (n + u) is needed. The least n of a class decides.
    """
    step = 1.2
    rows = large.withColumn("class", F.floor(F.log("n") / math.log(step)).cast("int"))
    stats = rows.groupBy("key", F.col("class").alias("target")).agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    able = (F.col("n") - F.col("u")) * 100 >= (F.col("least") + F.col("u")) * percent
    return rows.join(stats, "key").filter(able & ((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component")))).select("key", "class", "id", "component", "n", "u", "target")


def _close_pairs(probes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of probes of one bucket, from two components, that can reach the threshold.

    Against the bucket's most central class p: x and y share all of p but what one of them misses, and besides
    at most what the lesser of them has outside of p and not alone.
    """
    central = probes.groupBy("key").agg(F.min(F.struct("u", "id")).alias("p")).select("key", F.col("p.id").alias("p"))
    rows = materialize(probes.join(central, "key"), "probes")
    each = rows.select("id", "p").distinct()
    each = each.join(sets.select(F.col("doc_id").alias("id"), F.col("shingles").alias("sx")), "id").join(sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("sp")), "p")
    each = materialize(each.select("id", "p", F.array_except("sp", "sx").alias("missing"), F.size("sp").alias("np")), "missing")
    x = rows.join(each, ["id", "p"]).withColumn("others", F.greatest(F.lit(0), F.col("n") - F.col("np") + F.size("missing") - F.col("u")))
    y = x.select("key", F.col("class").alias("target"), F.col("target").alias("class"), F.col("id").alias("b"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("missing").alias("my"), F.col("others").alias("oy"))
    most = F.col("np") - F.size(F.array_union("missing", "my")) + F.least("others", "oy")
    able = (F.col("component") < F.col("other")) & (most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    return x.withColumnRenamed("id", "a").join(y, ["key", "class", "target"]).filter(able).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, rows: int = ROWS, bands: int = BANDS, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` that has an id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    signed = materialize(docs.mapInArrow(_sign(rows, bands), "doc_id long, n_shingles long, fp binary, bands array<long>"), "signed")
    full = signed.filter("n_shingles > 0")
    classes, shared = _named(materialize(full.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes"))
    reps = full.select("doc_id", "fp", "bands").join(classes.select(F.col("rep").alias("doc_id"), "fp", "n", "id"), ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"])
    keys = materialize(reps.select("id", "n", F.explode("bands").alias("key")), "keys")
    live = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot")).filter("c > 1")
    buckets = materialize(keys.join(live, "key"), "buckets")
    discard(keys)
    wanted = buckets.select("id").distinct()
    if shared:
        wanted = classes.join(wanted, "id", "left_semi").select(F.col("rep").alias("id")).distinct()
    sets = semi_join(docs, wanted.select(F.col("id").alias("doc_id")), "doc_id").mapInArrow(_sets, "doc_id long, fp binary, shingles array<long>")
    if shared:
        sets = sets.join(classes.select(F.col("rep").alias("doc_id"), "fp", "id"), ["doc_id", "fp"]).select(F.col("id").alias("doc_id"), "shingles")
    sets = materialize(sets.select("doc_id", "shingles").dropDuplicates(["doc_id"]), "sets")

    # Every class with the pivot of each of its buckets.
    links = _verified(_ordered(buckets.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))), sets, percent)
    first = _joined(None, links)
    # Large buckets with several components: each class with the pivot of each size class that it may reach,
    # the one with the fewest shingles of its own.
    tagged = _tagged(buckets, first)
    own = materialize(_own(sets, tagged.filter(F.col("c") > small).select("id").distinct()), "own")
    able = _probes(tagged.filter(F.col("c") > small).join(own, "id", "left").fillna(0, ["u"]), percent)
    central = able.groupBy("key", "class").agg(F.min(F.struct("u", "id", "component")).alias("p"))
    second = able.join(central.select("key", F.col("class").alias("target"), "p"), ["key", "target"]).filter("component <> p.component").select(F.col("id").alias("a"), F.col("p.id").alias("b"))
    label = _joined(first, _verified(_ordered(second), sets, percent))
    # What is still apart, across components: all of small buckets, what is able in large ones.
    tagged = tagged if label is first else _tagged(buckets, label)
    x = tagged.filter(F.col("c") <= small).select("key", F.col("id").alias("a"), "n", "component")
    y = x.select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    near = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    third = x.join(y, "key").filter((F.col("component") < F.col("other")) & near).select("a", "b")
    fourth = _close_pairs(_probes(tagged.filter(F.col("c") > small).join(own, "id", "left").fillna(0, ["u"]), percent), sets, percent)

    component = _joined(label, _verified(_ordered(third.union(fourth)), sets, percent))
    member = classes.join(component, "id", "left").select("fp", "rep", F.coalesce("component", "id").alias("component"))
    if shared:  # a component may begin with a number of no document
        member = member.join(member.groupBy("component").agg(F.min("rep").alias("least")), "component").select("fp", F.col("least").alias("component"))
    member = member.select("fp", "component")
    discard(sets, buckets)
    return (
        signed.select("doc_id", "n_shingles", "fp").join(member, "fp", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
