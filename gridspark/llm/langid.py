"""Language of whole texts, from a linear-chain conditional random field over their words.

A word is a run of letters (bytes a-z after lower-casing, or bytes from 0x80). Its emission score
for each language sums the weights of its byte bigrams and trigrams with word boundaries, its
three-byte prefix and suffix, and its entry in a learned lexicon; a learned matrix scores each
step from word to word. Forward-backward over the whole text gives every word's posterior. For speed
all texts of a batch run in step in pieces of CHAIN words; what a piece hands to the next, and back,
is found first from the product of its steps, so the result is that of one long chain.

Training: at most about ``train_docs`` labelled documents a language, lowest id hash first, of each of which
``spans`` spans of ``span_words`` words, at places that the id's hash draws from the whole text; half of
the training chains join spans of two languages, from which the transitions learn to switch. Full-batch
AdaGrad on the exact likelihood gradient, in the driver: its size is fixed by those parameters.
Everything else covers all rows and whole texts.

Cases: rows without id are left out; a null text or one without a letter is ``und`` with score 0;
with no labelled row every text is ``und``; ties go to the first language in order; repeated rows, and rows that
share an id, give a row each; a very long text is read whole; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import Words

BITS, LEXICON_BITS, CHAIN = 18, 16, 64
LEXICON_MIN = 3
UNDETERMINED = "und"
MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (2**BITS, languages); row 0 stays 0
    lexicon: np.ndarray  # (2**LEXICON_BITS,) word hashes by their top bits; 0 is empty
    trans: np.ndarray
    start: np.ndarray


def _slot(code: np.ndarray, template: int) -> np.ndarray:
    x = (code.astype(np.uint32) ^ np.uint32(template << 27)) * MULTIPLIER
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return np.maximum(x >> np.uint32(32 - BITS), 1)


class Features:
    """Feature slots of the words of a byte string, each word's n-grams lying side by side."""

    def __init__(self) -> None:
        self.words = Words(letters_only=True)

    def __call__(self, data: bytes, lexicon: np.ndarray | None):
        """(starts, ends, hashes, grams (2, bytes), bounds of the words' grams, per-word slots (3, words))."""
        raw, start, end = self.words.spans(b" " + data + b"   ")
        hashes = self.words.hash_spans(raw, start, end)
        b = raw.astype(np.uint32)
        two = (b[:-2] << np.uint32(8)) | b[1:-1]
        three = (two << np.uint32(8)) | b[2:]
        grams = np.stack([_slot(two, 1), np.where(b[1:-1] == 32, 0, _slot(three, 2))])
        size = end - start
        own = np.zeros((3, len(start)), np.uint32)
        own[0] = np.where(size >= 3, _slot(three[start], 3), 0)
        own[1] = np.where(size >= 3, _slot(three[np.maximum(end - 3, 0)], 4), 0)
        if lexicon is not None:
            place = (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
            own[2] = np.where(lexicon[place] == hashes, _slot(place, 5), 0)
        return start - 1, end - 1, hashes, grams, np.stack([start - 1, end], 1).ravel(), own


def emissions(model: Model, grams: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(words, languages)."""
    w = model.weights
    if not own.shape[1]:
        return np.zeros((0, w.shape[1]), np.float32)
    byte = w[grams[0]]
    byte += w[grams[1]]
    out = np.add.reduceat(byte, np.minimum(bounds, len(byte) - 1), axis=0)[::2]
    for row in own:
        out += w[row]
    return out


def forward_backward(emit: np.ndarray, size: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray | None = None):
    """emit (T, chains, L) with rows from size[c] on ignored; ``first`` weighs the languages of each chain's first word
    and ``last``, if given, those of its last one. Posteriors (T, chains, L), log-likelihood normalisers (chains,) and
    expected transition counts (L, L), these two without ``last``."""
    steps, chains, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    p = np.exp(emit - top)
    a, move = np.empty_like(p), np.exp(trans).astype(p.dtype)
    scale = np.empty((steps, chains, 1), p.dtype)
    live = (np.arange(steps)[:, None] < size)[:, :, None]
    now = first.astype(p.dtype) * p[0]
    for t in range(steps):
        if t:
            now = (a[t - 1] @ move) * p[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        a[t] = now / scale[t]
    z = (np.where(live, np.log(scale) + top, 0)).sum(axis=(0, 2))
    end = np.ones((chains, k), p.dtype) if last is None else last.astype(p.dtype)
    back = end
    post, pairs = np.empty_like(p), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        post[t] = a[t] * back
        if t:
            ahead = np.where(live[t], p[t] * back / scale[t], 0)
            pairs += (a[t - 1].T @ ahead) * move
            back = np.where(live[t], ahead @ move.T, end)
    if last is not None:
        post /= post.sum(axis=2, keepdims=True)
    return post, z, pairs


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words, sizes, texts and places in their texts of the pieces."""
    count = np.diff(first)
    n = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), n)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[:-1][text] + piece * CHAIN
    return begin, np.minimum(CHAIN, first[1:][text] - begin), text, piece


def _steps(p: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(pieces, k, k), each to a factor: what a piece makes of the weights of its first word's languages, up to its last word."""
    now = np.eye(p.shape[2]) * p[0][:, None, :]
    for t in range(1, len(p)):
        n = int(np.searchsorted(-size, -t, side="left"))  # pieces of more than t words; the longest come first
        x = (now[:n] @ move) * p[t][:n, None, :]
        now[:n] = x / x.max(axis=(1, 2), keepdims=True)
    return now


def _handed(own: np.ndarray, piece: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, k) each: the weights that a piece's first word gets from before, and its last word from behind.
    ``own`` has the pieces' matrices, in the order of texts and places."""
    k = len(first)
    before, behind = np.tile(first, (len(piece), 1)), np.ones((len(piece), k))
    ends = np.flatnonzero(np.append(piece[1:] == 0, True)[: len(piece)])
    left = np.repeat(piece[ends], piece[ends] + 1) - piece  # pieces after each one in its text
    for r in range(1, int(piece.max(initial=0)) + 1):
        at = np.flatnonzero(piece == r)
        x = np.einsum("nk,nkl->nl", before[at - 1], own[at - 1]) @ move
        before[at] = x / x.max(axis=1, keepdims=True)
        at = np.flatnonzero(left == r)
        x = np.einsum("nkl,nl->nk", own[at + 1], behind[at + 1]) @ move.T
        behind[at] = x / x.max(axis=1, keepdims=True)
    return before, behind


def _emissions(model: Model, features: Features, blob: bytes, most: int = 1 << 19):
    """(starts, ends, emissions) of a byte string, a long one in parts cut between words."""
    found, at = [], 0
    while at < len(blob) or not found:
        to = min(len(blob), at + most)
        while to < len(blob) and not features.words.space[blob[to]]:
            to += 1
        start, end, _, grams, bounds, own = features(blob[at:to], model.lexicon)
        found.append((start + at, end + at, emissions(model, grams, bounds, own)))
        at = to
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_posteriors(model: Model, features: Features, blobs: list[bytes]):
    """(starts, ends, first, posteriors): text t has words first[t]:first[t+1]; offsets are into the joined bytes."""
    start, end, emit = _emissions(model, features, b"\n".join(blobs))
    offset = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    first = np.searchsorted(start, offset)
    if not len(emit):
        return start, end, first, emit, offset
    begin, size, text, piece = _chains(first)
    out = np.empty_like(emit)
    order = np.argsort(-size, kind="stable")
    own, several = np.zeros((len(size), *model.trans.shape)), np.diff(first)[text] > CHAIN
    move = np.exp(model.trans)
    scores = lambda index: np.exp(emit[index] - emit[index].max(axis=2, keepdims=True))
    mine = order[several[order]]
    for at in range(0, len(mine), 4096):
        part = mine[at : at + 4096]
        index = np.minimum(begin[part] + np.arange(int(size[part[0]]))[:, None], len(emit) - 1)
        own[part] = _steps(scores(index), size[part], move)
    before, behind = _handed(own, piece, np.exp(model.start), move)
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        index = np.minimum(begin[part] + np.arange(int(size[part[0]]))[:, None], len(emit) - 1)
        post, _, _ = forward_backward(emit[index], size[part], model.trans, before[part], behind[part])
        live = np.arange(len(index))[:, None] < size[part]
        out[index[live]] = post[live]
    return start, end, first, out, offset


def runs(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``most`` bytes."""
    i, held, size = 0, [], 0
    for j, text in enumerate(texts):
        blob = (text or "").encode("utf-8", "replace")
        if held and size + len(blob) > most:
            yield i, held
            i, held, size = j, [], 0
        held.append(blob)
        size += len(blob)
    if held:
        yield i, held


def _spans(langs: list[str], spans: int, span_words: int):
    """``spans`` spans of ``span_words`` words of each sampled text, or all of it if it has no more words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(letters_only=True)
        for batch in batches:
            lang, span = [], []
            for name, text, draw in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                blob = text.encode("utf-8", "replace")
                _, start, end = words.spans(blob)
                if not len(start):
                    continue
                free = len(start) - span_words  # the last place where a span can begin
                places = {0} if free <= 0 else {int(x) for x in np.random.default_rng(draw & 0xFFFFFFFF).integers(0, free + 1, spans)}
                for at in sorted(places):
                    lang.append(langs.index(name))
                    span.append(blob[start[at] : end[min(at + span_words, len(start)) - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(span, pa.binary())], ["lang", "span"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 400, spans: int = 2, span_words: int = 32, rounds: int = 40, seed: int = 7) -> Model | None:
    """A model of the labelled ``docs``; None if there is none. One task learns from at most spans x train_docs x languages spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("doc_id is not null and lang is not null and text is not null")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    known = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a number a language
    langs = sorted(known)
    if not langs:
        return None
    # Of each language about twice the wanted rows, by a threshold of the hash; only these are ranked.
    shares = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, (2 * train_docs + 50) / known[lang]) * (1 << 40))))])
    few = rows.filter(F.pmod(F.col("draw"), F.lit(1 << 40)) < F.element_at(shares, F.col("lang"))).withColumn("rank", F.pmod(F.col("draw"), F.lit(1 << 40)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "draw", "doc_id"))
    sample = few.withColumn("nth", nth).filter(F.col("nth") <= train_docs).select("lang", "text", "draw")
    found = sample.mapInArrow(_spans(langs, spans, span_words), "lang int, span binary")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = sorted((r["lang"], r["span"]) for b in batches for r in b.to_pylist())
        if some:
            m = _train(langs, some, rounds, seed)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((m.langs, m.weights, m.lexicon, m.trans, m.start))], pa.binary())], ["model"])

    # In one task, as the sample is bounded; the driver gets the model alone.
    (model,) = found.repartition(1).mapInArrow(trained, "model binary").collect() or [None]
    return Model(*pickle.loads(bytes(model[0]))) if model else None


def _train(langs: list[str], spans: list[tuple[int, bytes]], rounds: int, seed: int) -> Model:
    rng, k, features = np.random.default_rng(seed), len(langs), Features()
    label, blobs = np.array([s[0] for s in spans]), [s[1] for s in spans]
    offset = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    start, _, hashes, grams, bounds, own = features(b"\n".join(blobs), None)
    first = np.searchsorted(start, offset)
    seen, times = np.unique(hashes, return_counts=True)
    lexicon = np.zeros(1 << LEXICON_BITS, np.uint64)
    lexicon[(seen[times >= LEXICON_MIN] >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)] = seen[times >= LEXICON_MIN]
    place = (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
    own[2] = np.where(lexicon[place] == hashes, _slot(place, 5), 0)

    # Chains: every span alone, and every second one followed by a span drawn at random.
    joined = rng.permutation(len(spans))
    members = [[i, joined[i]] if i % 2 else [i] for i in range(len(spans))]
    size = np.array([sum(first[i + 1] - first[i] for i in m) for m in members])
    index = np.zeros((int(size.max()), len(members)), np.int64)
    for c, m in enumerate(members):
        index[: size[c], c] = np.concatenate([np.arange(first[i], first[i + 1]) for i in m])
    live = np.arange(len(index))[:, None] < size
    gold = np.repeat(label, np.diff(first))
    target = gold[index]
    wanted = np.zeros((k, k))
    np.add.at(wanted, (target[:-1][live[1:]], target[1:][live[1:]]), 1)
    opening = np.bincount(target[0], minlength=k).astype(float)

    inside = np.concatenate([np.arange(a, b) for a, b in bounds.reshape(-1, 2)])
    owner = np.repeat(np.arange(len(start)), np.diff(bounds.reshape(-1, 2), axis=1).ravel())
    slots = np.concatenate([grams[0][inside], grams[1][inside], *own]).astype(np.int64)
    owners = np.concatenate([owner, owner, *[np.arange(len(start))] * 3])
    used, slots = np.unique(slots, return_inverse=True)
    model = Model(langs, np.zeros((1 << BITS, k), np.float32), lexicon, np.zeros((k, k)), np.zeros(k))
    local = np.zeros((len(used), k))
    sums = [np.full(x.shape, 1e-8) for x in (local, model.trans, model.start)]
    for _ in range(rounds):
        model.weights[used] = local
        model.weights[0] = 0
        emit = emissions(model, grams, bounds, own)
        post, _, pairs = forward_backward(emit[index].astype(np.float64), size, model.trans, np.exp(model.start))
        miss = np.zeros((len(start), k))
        for lang in range(k):
            miss[:, lang] = np.bincount(index[live], ((target == lang) - post[:, :, lang])[live], minlength=len(start))
        push = np.stack([np.bincount(slots, miss[owners, lang], minlength=len(used)) for lang in range(k)], 1)
        for x, g, s, rate in ((local, push / len(spans) - 1e-5 * local, sums[0], 0.3), (model.trans, (wanted - pairs) / len(spans), sums[1], 0.2), (model.start, (opening - post[0].sum(0)) / len(spans), sums[2], 0.1)):
            s += g * g
            x += rate * g / np.sqrt(s)
    model.weights[used] = local
    model.weights[0] = 0
    return model


def _text_shares(model: Model, features: Features, blobs: list[bytes]) -> np.ndarray:
    """Expected words of each language, (texts, L)."""
    _, _, first, post, _ = word_posteriors(model, features, blobs)
    total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language with the most expected words, and its share of them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if model is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array([UNDETERMINED] * len(texts)), pa.array([0.0] * len(texts), pa.float64())], ["doc_id", "lang_pred", "score"])
                continue
            names = np.array([*model.langs, UNDETERMINED], dtype=object)
            for i, blobs in runs(texts):
                share = _text_shares(model, features, blobs)
                words = share.sum(axis=1)
                best = share.argmax(axis=1)
                score = np.round(np.minimum(share.max(axis=1) / np.maximum(words, 1e-9), 1), 6)
                for t in np.flatnonzero(words < 0.5):  # no word, so no letter
                    best[t], score[t] = len(names) - 1, 0
                for t, blob in enumerate(blobs):  # bytes from 0x80 can be signs without letters
                    if words[t] >= 0.5 and not _has_letter(blob, texts[i + t]):
                        best[t], score[t] = len(names) - 1, 0
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(blobs)), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _has_letter(blob: bytes, text: str) -> bool:
    return any(97 <= c <= 122 for c in blob[:64].lower()) or any(c.isalpha() for c in text)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, start, end, lang, probability): every word of every text; offsets are UTF-8 bytes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, blobs in runs(batch.column(1).to_pylist()):
                start, end, first, post, offset = word_posteriors(model, features, blobs)
                text = np.repeat(np.arange(len(blobs)), np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i + t] for t in text], batch.column(0).type), pa.array(np.arange(len(text)) - first[:-1][text]),
                        pa.array(start - offset[text]), pa.array(end - offset[text]),
                        pa.array(names[post.argmax(1)].tolist(), pa.string()), pa.array(post.max(1).astype(float)),
                    ],
                    ["doc_id", "word", "start", "end", "lang", "probability"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, word long, start long, end long, lang string, probability double")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out; ``id_col`` is named doc_id."""
    model = fit(docs.filter(~held_out(id_col)), id_col, text_col, lang_col, train_docs)
    out = predict(docs, model, id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
