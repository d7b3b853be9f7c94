"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The words form a trie. Of a node's children the one with the most words below it is heavy, the others are light; a
word has at most log2(words) light edges on its path, since each at least halves the words below. Two words part
at one node, and there at most one of them goes down the heavy edge. So it does to merge the light subtrees, the
smaller ones, into their siblings with one character wrong:

    v a x  (light at v, whose heavy child is h)   replaced: v h x    skipped: v x    inserted: v h a x

A word that ends at v is a light child without a character; it is merged inserted only. Two words are one edit apart
exactly if a merged terminal of one coincides with the other's own, or both are merged replaced at the same
node and coincide. Each word is merged at its light edges alone, not at each of its characters.

Trie nodes are known by hashes of their prefixes, all of which come from one cumulative sum a batch, so a word of a
million letters costs a million rows and no prefix is ever spelled out. A wrong heavy child, as two prefixes with one
hash might give, changes how much is merged and not what coincides: words are compared as they are spelled.

Scale: a node's words are counted by partial sums. The heavy children of nodes with many words, at most
``storage.BROADCAST_KEYS`` of them since a word meets each node once, are sent to the words; the others are joined.

Cases: null texts have no words; a null id counts as the empty text in :func:`misspelt`; words are compared by code
points; words equally frequent go by code-point order; an empty table gives an empty table; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_KEYS, discard, materialize
from .text import BASE, INVERSE, mix64

#: Runs of letters that are words.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of prefixes that are hashed together.
PIECE = 1 << 16
#: Nodes with more words than this, and than all prefixes allow BROADCAST_KEYS nodes to have, are known to all tasks.
MANY = 10_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(doc_id, run): every run of letters of at least ``min_chars``, A-Z made lower case."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.filter(found, lambda r: F.length(r) >= min_chars)).alias("run"))
    return each.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """``run``, or, where the checksum h of ``doc_id:run`` is a multiple of ``one_in``, without its code point h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, node, depth, next) for words (id, word): the hash of each prefix and the code point that follows it,
    0 after the whole word."""
    power = inverse = np.ones(1, np.uint64)
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        i = 0
        while i < len(words):
            j, size = i, 0
            while j < len(words) and (j == i or size < PIECE):
                size += len(words[j]) + 1
                j += 1
            codes = np.frombuffer("\0".join(words[i:j]).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.uint64)
            if len(power) <= len(codes):
                power, inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), b, np.uint64)))) for b in (BASE, INVERSE))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
            lengths = np.array([len(w) + 1 for w in words[i:j]])
            start = np.cumsum(lengths) - lengths
            first = np.repeat(start, lengths)
            depth = np.arange(len(codes)) - first
            node = mix64((total[:-1] - total[first]) * inverse[first] + depth.astype(np.uint64))
            for k in range(0, len(codes), PIECE):
                cut = slice(k, k + PIECE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[i:j], lengths)[cut]), pa.array(node[cut].view(np.int64)), pa.array(depth[cut].astype(np.int32)), pa.array(codes[cut].astype(np.int32))],
                    ["id", "node", "depth", "next"],
                )
            i = j


def light_edges(words: DataFrame) -> DataFrame:
    """(word, depth, heavy) for distinct ``words`` (word): where each word leaves a branching node of the trie by another
    child than the heavy one, whose character is ``heavy``."""
    rows = words.select(F.xxhash64("word").alias("id"), "word").mapInArrow(_prefixes, "id long, node long, depth int, next int")
    rows = materialize(rows, "prefixes")
    edges = rows.groupBy("node", "next").agg(F.count(F.lit(1)).alias("n"))
    # The end of a word, 0, is heavy only where nothing follows it, and there is no light edge then.
    best = F.max(F.when(F.col("next") > 0, F.struct("n", (-F.col("next")).alias("c"))))
    heavy = edges.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("children"), best.alias("best")).filter("children > 1")
    heavy = materialize(heavy.select("node", "n", (-F.col("best.c")).alias("heavy")), "heavy")
    many = max(MANY, rows.count() // BROADCAST_KEYS)  # at most BROADCAST_KEYS nodes have more words
    top = F.broadcast(heavy.filter(F.col("n") > many).select("node", F.col("heavy").alias("known")))
    at = rows.join(top, "node", "left")
    low = at.filter("known is null").drop("known").join(heavy.filter(F.col("n") <= many).select("node", F.col("heavy").alias("known")), "node")
    light = at.filter("known is not null").unionByName(low).filter("next <> known").groupBy("id").agg(F.collect_list(F.struct("depth", F.col("known").alias("heavy"))).alias("at"))
    joined = words.select(F.xxhash64("word").alias("id"), "word").join(light, "id")
    letter = F.decode(F.unhex(F.lpad(F.hex("at.heavy"), 8, "0")), "UTF-32")  # of a code point
    return joined.select("word", F.explode("at").alias("at")).select("word", "at.depth", letter.alias("heavy"))


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(a, b) for all distinct ``words`` (word) that differ by one inserted, deleted or replaced code point; each pair both ways."""
    w, d, h, end = F.col("word"), F.col("depth"), F.col("heavy"), F.length("word")
    head, rest = F.substring(w, F.lit(1), d), F.substring(w, d + 2, end)
    light = materialize(light_edges(words), "light")
    inside = light.filter(d < end)
    replaced = inside.select(F.concat(head, h, rest).alias("key"), "depth", "word")
    skipped = inside.select(F.concat(head, rest).alias("key"), "word")
    inserted = light.select(F.concat(head, h, F.substring(w, d + 1, end)).alias("key"), "word")
    merged = replaced.drop("depth").union(skipped).union(inserted)
    own = merged.join(words.select(F.col("word").alias("b")), F.col("key") == F.col("b")).select(F.col("word").alias("a"), "b")
    # Terminals merged alike differ in the character at that depth, so one key has no more of them than the alphabet has letters.
    alike = replaced.alias("x").join(replaced.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.depth") == F.col("y.depth")) & (F.col("x.word") < F.col("y.word")))
    found = own.unionByName(alike.select(F.col("x.word").alias("a"), F.col("y.word").alias("b")))
    # A skip within a run of one letter, as aab without its second a, is met once at most: the words part at one node.
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) for ``forms`` (word, form), each word once: where following forms ends. The way doubles each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = now.alias("x").join(now.select(F.col("word").alias("w"), F.col("root").alias("r")), F.col("x.root") == F.col("w"), "left")
        nxt = materialize(further.select("x.word", F.coalesce("r", "x.root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        moved = not nxt.filter("moved").isEmpty()
        discard(now)
        now = nxt
        if not moved:
            return now.select("word", "root")
    raise ValueError("forms go round in a circle")


def group_variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``counts`` (word, n), each word once.

    ``n_near`` is the number of words one edit apart; ``form`` the most frequent of these if it is at least ``ratio`` times
    as frequent as the word, else null; ``root`` the end of the chain of forms, the word itself where there is none.
    ``ratio`` must be over 1, so that chains rise.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    pairs = one_edit_pairs(counts.select("word"))
    near = pairs.join(counts.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("word"))).alias("best"))
    known = counts.join(best, F.col("word") == F.col("a"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    risen = -F.col("best.m") >= ratio * F.col("n")
    table = materialize(known.select("word", "n", "n_near", F.when(risen, F.col("best.word")).alias("form"), F.when(risen, -F.col("best.m")).alias("form_n")), "variants")
    ends = roots(table.filter("form is not null").select("word", "form"))
    return table.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def word_counts(found: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the column ``word``: words of at least so many code points that occur so often."""
    counts = found.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") >= min_count), "words")
