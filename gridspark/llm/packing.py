"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt by hash into groups of about GROUP; a group is packed in one task from its ids and
token counts alone. A document longer than the longest sequence is cut into whole ones and a rest.
Pieces go, longest first, into the open bin that they leave the least room in. Where none has room a bin
is opened, and at the end each bin shrinks to the shortest permitted length that holds its contents.

Which length is opened is chosen for all bins of a group together. A rule alone is short-sighted: to open what fits
the piece leaves bins half empty, to open long ones pays for attention, and what is best for this piece depends on
those to come. So a group is packed once by each of several rules, and of these the packing of the least total cost is
kept: ``floor`` rules open no bin under a certain length; the ``trial`` rule fills each permitted length with the
largest pieces that are still to be placed and opens the one of the least cost for each token that it would hold, the
shortest of equals. The rule of least length, plain best fit, is one of them, so that a packing costs never more. Each bin
tells the length at which it was opened.

Cases: rows without id are left out; documents without tokens (null or blank texts) are a piece of length
0, all of a group in one bin if they are alone; repeated rows are packed as often as they occur, 64 of one
kind at most going to one group; a very long text is as many pieces as it needs; of equal sizes the lesser
id goes first; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import words

LENGTHS, GROUP, ALIKE = (512, 1024, 2048, 4096), 4096, 64


def sequence_cost(length: int) -> float:
    """Tokens, attention growing with the square of the length, and a fixed price for each sequence, whose loading and
    step do not depend on its length. Full sequences of 1024 cost the least a token: shorter ones pay for their number, longer
    ones for attention."""
    return length + length * length / 16_384 + 64


class _Left:
    """How many pieces of each size are still to be placed; bit s of ``mask`` is set if there are any of size s > 0."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.mask = sum(1 << s for s in self.count if s)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if size and not self.count[size]:
            self.mask ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that the largest pieces, one after the other as they fit, put into ``room``."""
        mask, start = self.mask, room
        while room and (fits := mask & ((2 << room) - 1)):
            size = fits.bit_length() - 1
            n = min(self.count[size], room // size)
            room -= n * size
            mask &= (1 << size) - 1
        return start - room


def pieces_of(sizes: Sequence[int], longest: int) -> list[tuple[int, int, int]]:
    """(size, item, piece), the longest first."""
    pieces = []
    for item, size in enumerate(sizes):
        whole = max(0, -(-size // longest) - 1)
        pieces += [(longest, item, p) for p in range(whole)]
        pieces.append((size - whole * longest, item, whole))
    return sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))


def pack_by(pieces: list[tuple[int, int, int]], lengths: Sequence[int], cost: Callable[[int], float], floor: int | None) -> tuple[float, list[tuple[int, int, int, int, int, int, int]]]:
    """The total cost of one packing of sorted ``pieces`` into sorted ``lengths``, and (item, piece, start, size, bin,
    capacity, opened) for every piece. Bins are opened at ``floor`` or the next length that takes the piece, and by trial if it is None."""
    longest, left = lengths[-1], _Left([p[0] for p in pieces])
    shortest = lambda held: lengths[bisect_left(lengths, held)]

    def opened(size: int) -> int:
        if floor is not None:
            return shortest(max(size, floor))
        best = None
        for n in lengths[bisect_left(lengths, size) :]:
            held = size + left.fill(n - size)
            price = cost(shortest(held)) / max(1, held)
            if best is None or price < best[0]:
                best = (price, n)
        return best[1]

    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    held: list[int] = []
    begun: list[int] = []
    placed = []
    for size, item, piece in pieces:
        left.take(size)
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, where = open_bins.pop(at)
        else:
            room, where = opened(size), len(held)
            held.append(0)
            begun.append(room)
        insort(open_bins, (room - size, where))
        placed.append((item, piece, piece * longest, size, where))
        held[where] += size
    placed.sort(key=lambda p: p[4])
    ends = [shortest(h) for h in held]
    return sum(cost(n) for n in ends), [(*p, ends[p[4]], begun[p[4]]) for p in placed]


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost) -> list[tuple[int, int, int, int, int, int, int]]:
    """(item, piece, start, size, bin, capacity, opened) for every piece of every item, in the order of bins and of placing: the
    cheapest packing over all rules, the first of equals, by trial and then from the least floor."""
    lengths = sorted(lengths)
    pieces = pieces_of(sizes, lengths[-1])
    return min((pack_by(pieces, lengths, cost, floor) for floor in (None, *lengths)), key=lambda x: x[0])[1]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, lengths: Sequence[int] = LENGTHS, group: int = GROUP) -> DataFrame:
    """(sequence_id, capacity, opened, slot, position, doc_id, piece, piece_start, n_tokens): where every piece lies.

    ``capacity`` is the length of the sequence, ``opened`` the one at which it was opened. ``slot`` numbers a sequence's pieces, ``position`` is a piece's first token in the sequence, ``piece_start`` its
    first token in the document. Tokens are white-space words unless ``tokens_col`` counts them.
    """
    n = F.size(words(F.col(text_col))) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n")).filter("doc_id is not null")
    # Rows alike in id and size are counted first and go to groups by the ALIKE, so that an id of very many rows is no hot group.
    kinds = rows.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("times"))
    groups = max(1, -(-docs.count() // group))
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / ALIKE))
    dealt = kinds.select("doc_id", "n", "times", F.explode(parts).alias("part"))
    dealt = dealt.select("doc_id", "n", F.least(F.col("times") - F.col("part") * ALIKE, F.lit(ALIKE)).alias("times"), F.pmod(F.xxhash64("doc_id", "n", "part"), F.lit(groups)).alias("grp"))
    lengths = tuple(int(x) for x in lengths)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["times"])].sort_values(["doc_id", "n"], ignore_index=True)
        out = pd.DataFrame(pack(pdf["n"].tolist(), lengths), columns=["item", "piece", "piece_start", "n_tokens", "bin", "capacity", "opened"])
        before = out.groupby("bin")["n_tokens"]
        out["position"] = before.cumsum() - out["n_tokens"]
        out["slot"] = out.groupby("bin").cumcount()
        out["doc_id"] = pdf["doc_id"].to_numpy()[out["item"]]
        out["sequence_id"] = out["bin"] * groups + int(pdf["grp"].iloc[0])
        return out[["sequence_id", "capacity", "opened", "slot", "position", "doc_id", "piece", "piece_start", "n_tokens"]]

    schema = "sequence_id long, capacity int, opened int, slot int, position long, doc_id long, piece int, piece_start long, n_tokens long"
    return dealt.groupBy("grp").applyInPandas(lambda pdf: packed(pdf), schema)
