"""FLAC media columns: encode, decode with checks, and PCM blocks that can be sought by sample.

All frames of a batch go in step: one array operation advances every frame by a residual, a sample or
a byte, so the cost per sample does not depend on how long single streams are. Where a stream's seek
table names all frames they are decoded at once; otherwise each round takes the next frame of every
stream. The decoder knows constant, verbatim, fixed and LPC subframes, wasted bits, both Rice codings
with escapes, any partition order and stereo decorrelation, at up to 24 bits a sample.

The encoder writes mono 8-bit streams. Bytes that are frequent in text become samples near zero, which
is what Rice codes are short for: SAMPLE is a one-to-one table, and :func:`payload` undoes it. Each frame takes
the best of fixed predictors 0 to 2 and a second-order LPC, with Rice parameters by quarter of the frame.

:func:`store` writes streams to the folder that all machines share, reads them back, and writes what it
decodes from them: a row a stream with its PCM blocks and their sample offsets, so that nothing is shuffled.
It goes through the streams in waves; only one wave's streams lie beside the blocks. :func:`seek` reads
samples by offset, :func:`media_features` describes what the stored blocks hold.

Cases: a null medium, and one that is no FLAC stream, give one row with an ``error`` and no block; a
frame whose header CRC-8, CRC-16 or length is wrong ends its stream with an error and keeps the blocks
before it; an MD5 that differs is an error too; what such a stream holds is null in its features. A null
text is the empty text: 64 zero bytes. A row is a stream of its own, so repeated ids and rows,
and null ids, are kept apart; a very long text is as many blocks as it needs; an empty table gives
an empty table; other input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

BLOCK = 1024
#: Bytes by how often they are in text; those not named follow by value, those of UTF-8 sequences first.
FREQUENT = b" etaoinsrhldcumfpgwybvkxjqz.,\n" + bytes([0xC3, *range(0x80, 0xC0)])
_ORDER = [*FREQUENT, *[b for b in range(256) if b not in FREQUENT]]
SAMPLE, _BYTE = np.zeros(256, np.int8), np.array(_ORDER, np.uint8)
SAMPLE[_ORDER] = [(r >> 1) ^ -(r & 1) for r in range(256)]  # 0, -1, 1, -2, ...
#: Frames that are decoded, and encoded, at once; the encoder's arrays then stay in the cache.
LANES, ENCODED = 4096, 96
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values: the format's predictors
LPC_BITS, LPC_SHIFT = 12, 9
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}  # fixed values
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}  # fixed values


def payload(samples: np.ndarray) -> bytes:
    """The bytes that 8-bit samples stand for."""
    x = samples.astype(np.int16)
    return _BYTE[(x << 1) ^ (x >> 15)].tobytes()


def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-8 (0x07) by byte, and CRC-16 (0x8005) by byte and by two bytes."""
    eight, sixteen = np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        eight = ((eight << 1) ^ np.where(eight & 0x80, 0x07, 0)).astype(np.uint16) & 0xFF
        sixteen = ((sixteen << 1) ^ np.where(sixteen & 0x8000, 0x8005, 0)) & 0xFFFF
    pair = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        pair = sixteen[pair >> 8] ^ ((pair << 8) & 0xFFFF)
    return eight.astype(np.int64), sixteen.astype(np.int64), pair.astype(np.int64)


CRC8, CRC16, CRC16_PAIR = _crc_tables()


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:start+size] for each lane; ``data`` has bytes to spare at its end."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(order), np.int64)
    word = np.ndarray((len(data) - 1,), ">u2", data, strides=(1,))
    live = np.searchsorted(-(left >> 1), -np.arange(int(left[0]) >> 1) if len(left) else np.zeros(0), side="left")
    for step, n in enumerate(live.tolist()):
        crc[:n] = CRC16_PAIR[crc[:n] ^ word[at[:n] + 2 * step]]
    odd = np.flatnonzero(left & 1)
    crc[odd] = CRC16[(crc[odd] >> 8) ^ data[at[odd] + left[odd] - 1]] ^ ((crc[odd] << 8) & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """The format's coding of a frame number: UTF-8 for up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


def _header(number: int, n: int) -> bytes:
    code = 10 if n == BLOCK else 7
    out = b"\xff\xf8" + bytes([code << 4 | 4, 0b0000_001_0]) + _utf8(number)
    if code == 7:
        out += (n - 1).to_bytes(2, "big")
    crc = 0
    for b in out:
        crc = int(CRC8[crc ^ b])
    return out + bytes([crc])


_HEADERS: dict[tuple[int, int], bytes] = {}


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each (non-empty) payload."""
    out: list[bytes] = []
    at = 0
    while at < len(payloads):
        frames, to = 0, at
        while to < len(payloads) and (to == at or frames + -(-len(payloads[to]) // BLOCK) <= LANES):
            frames += -(-len(payloads[to]) // BLOCK)
            to += 1
        out += _encode(payloads[at:to])
        at = to
    return out


def _encode(payloads: list[bytes]) -> list[bytes]:
    doc = np.repeat(np.arange(len(payloads)), [-(-len(p) // BLOCK) for p in payloads])
    first = np.searchsorted(doc, np.arange(len(payloads) + 1))
    number = np.arange(len(doc)) - first[doc]
    size = np.minimum(BLOCK, np.array([len(p) for p in payloads])[doc] - number * BLOCK)
    parts = [_frames(payloads, doc[i : i + ENCODED], number[i : i + ENCODED], size[i : i + ENCODED]) for i in range(0, len(doc), ENCODED)]
    frames = [f for p in parts for f in p]
    out = []
    for d, text in enumerate(payloads):
        own = frames[first[d] : first[d + 1]]
        lengths = [len(f) for f in own]
        info = min(BLOCK, len(text)).to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(text)).to_bytes(8, "big")
        info += hashlib.md5(SAMPLE[np.frombuffer(text, np.uint8)].tobytes()).digest()
        offset = np.cumsum([0, *lengths[:-1]])
        points = np.zeros(len(own), np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        points["s"], points["o"], points["n"] = np.arange(len(own)) * BLOCK, offset, size[first[d] : first[d + 1]]
        table = points.tobytes()[: 18 * ((1 << 24) // 18 - 1)]
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


def _residuals(x: np.ndarray, inside: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (frames, BLOCK) of each frame's best predictor, its kind (0-2 fixed, 3 LPC) and the two LPC coefficients."""
    f = x.astype(np.float64)
    lag = [(f[:, j:] * f[:, : BLOCK - j]).sum(axis=1) for j in range(3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        det = lag[0] ** 2 - lag[1] ** 2
        c = np.stack([lag[1] * (lag[0] - lag[2]) / det, (lag[0] * lag[2] - lag[1] ** 2) / det], 1)
    most = (1 << (LPC_BITS - 1)) - 1
    coef = np.clip(np.nan_to_num(np.rint(c * (1 << LPC_SHIFT)), posinf=0, neginf=0), -most, most).astype(np.int32)
    all_ = [x]
    for order in (1, 2):
        r = x.copy()
        for j, w in enumerate(FIXED[order], 1):
            r[:, j:] -= w * x[:, :-j]
        all_.append(r)
    guess = np.zeros_like(x)
    guess[:, 1:] = coef[:, :1] * x[:, :-1]
    guess[:, 2:] += coef[:, 1:] * x[:, :-2]
    all_.append(x - (guess >> LPC_SHIFT))
    for r, order in zip(all_, (0, 1, 2, 2), strict=True):
        r[:, :order] = 0
        r[~inside] = 0
    cost = np.stack([np.abs(r).sum(axis=1) for r in all_], 1)
    kind = cost.argmin(axis=1)
    best = all_[0]
    for k in (1, 2, 3):
        own = kind == k
        best = np.where(own[:, None], all_[k], best) if own.any() else best
    return best, kind, coef


def _frames(payloads: list[bytes], doc: np.ndarray, number: np.ndarray, size: np.ndarray) -> list[bytes]:
    n = len(doc)
    x = np.zeros((n, BLOCK), np.int32)
    for i, (d, k, s) in enumerate(zip(doc.tolist(), number.tolist(), size.tolist(), strict=True)):
        x[i, :s] = SAMPLE[np.frombuffer(payloads[d], np.uint8, s, k * BLOCK)]
    column = np.arange(BLOCK)
    inside = column < size[:, None]
    residual, kind, coef = _residuals(x, inside, size)
    order = np.minimum(kind, 2)
    folded = (residual << 1) ^ (residual >> 31)
    split = np.where(size >= 256, 2, 0)
    rows = np.arange(n)
    borders = np.minimum((size[:, None] * np.arange(5)) >> split[:, None], size[:, None])
    total = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(folded, axis=1, dtype=np.int32)], 1)
    sums = np.diff(total[rows[:, None], borders], axis=1)
    opens = np.maximum(borders[:, :4], np.where(np.arange(4) == 0, order[:, None], 0))
    mean = sums / np.maximum(borders[:, 1:] - opens, 1)
    params = np.clip(np.ceil(np.log2(np.maximum(mean * 0.72, 1e-9))), 0, 14).astype(np.int32)
    # Each sample's parameter; what lies beyond a short frame takes the last one.
    ends = borders.copy()
    ends[:, 4] = BLOCK
    k = np.repeat(params.ravel(), np.diff(ends, axis=1).ravel()).reshape(n, BLOCK)
    coded = inside & (column >= order[:, None])
    bits = np.where(coded, (folded >> k) + 1 + k, 0)
    used = np.arange(4) < (1 << split)[:, None]  # partitions
    bits[np.broadcast_to(rows[:, None], used.shape)[used], opens[used]] += 4

    heads = [_HEADERS.setdefault((k_, s), _header(k_, s)) if (k_, s) in _HEADERS or len(_HEADERS) < 4096 else _header(k_, s) for k_, s in zip(number.tolist(), size.tolist(), strict=True)]
    head = np.array([len(h) for h in heads])
    lead = head * 8 + 8 + 8 * order + np.where(kind == 3, 4 + 5 + 2 * LPC_BITS, 0) + 6
    end = lead[:, None] + np.cumsum(bits, axis=1, dtype=np.int32)
    length = -(-end[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(length + 2)])
    acc = np.zeros(base[-1] + 8)

    def put(at: np.ndarray, width: np.ndarray, value: np.ndarray) -> None:
        """Values of up to 16 bits, ending at the bits ``at``: each is added to the 24 bits from its first byte, where no two overlap."""
        begin = at - width
        acc[:] += np.bincount(begin >> 3, value << (24 - (begin & 7) - width), len(acc))

    def put_rows(at, width, value, own=slice(None)) -> None:
        put((base[:-1] * 8)[own] + at, np.broadcast_to(width, at.shape), value)

    where = np.flatnonzero(coded)
    stop = end + (base[:-1] * 8)[:, None]
    kk = k.ravel()[where]
    put(stop.ravel()[where], kk + 1, (1 << kk) | (folded.ravel()[where] & ((1 << kk) - 1)))
    put((stop - bits)[np.broadcast_to(rows[:, None], used.shape)[used], opens[used]] + 4, np.full(used.sum(), 4), params[used].astype(np.int64))
    at = head * 8 + 8
    put_rows(at, 8, np.where(kind == 3, 0b1_00001, 0b001000 | order) << 1)
    for j in range(2):
        own = np.flatnonzero(order > j)
        put_rows(at[own] + 8 * (j + 1), 8, (x[own, j] & 255).astype(np.int64), own)
    at = at + 8 * order
    own = np.flatnonzero(kind == 3)
    put_rows(at[own] + 4, 4, np.full(len(own), LPC_BITS - 1), own)
    put_rows(at[own] + 9, 5, np.full(len(own), LPC_SHIFT), own)
    for j in range(2):
        put_rows(at[own] + 9 + LPC_BITS * (j + 1), LPC_BITS, (coef[own, j] & ((1 << LPC_BITS) - 1)).astype(np.int64), own)
    put_rows(lead, 6, split)
    whole = acc.astype(np.int64)
    out = whole >> 16
    out[1:] += (whole[:-1] >> 8) & 255
    out[2:] += whole[:-2] & 255
    data = out.astype(np.uint8)
    for i, h in enumerate(heads):
        data[base[i] : base[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(data, base[:-1], length)
    data[base[:-1] + length] = crc >> 8
    data[base[:-1] + length + 1] = crc & 255
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


@dataclass
class Stream:
    """What the metadata of a stream says, and what decoding found."""

    rate: int = 0
    channels: int = 0
    bits: int = 0
    samples: int = 0
    md5: bytes = b""
    at: int = 0
    points: list[tuple[int, int, int]] = field(default_factory=list)
    error: str | None = None
    blocks: list[np.ndarray] = field(default_factory=list)  # (samples, channels)


def _metadata(blob: bytes | None) -> Stream:
    s = Stream()
    if blob is None or blob[:4] != b"fLaC":
        s.error = "no FLAC stream"
        return s
    at, last = 4, False
    while not last:
        if at + 4 > len(blob):
            s.error = "metadata cut short"
            return s
        last, kind, size = blob[at] >> 7, blob[at] & 127, int.from_bytes(blob[at + 1 : at + 4], "big")
        body = blob[at + 4 : at + 4 + size]
        if kind == 0 and size >= 34:
            v = int.from_bytes(body[10:18], "big")
            s.rate, s.channels, s.bits, s.samples, s.md5 = v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            p = np.frombuffer(body[: size // 18 * 18], np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            p = p[p["s"] != np.uint64(2**64 - 1)]
            s.points = list(zip(p["s"].tolist(), p["o"].tolist(), p["n"].tolist(), strict=True))
        at += 4 + size
    s.at = at
    if not s.bits:
        s.error = "no stream info"
    elif s.bits > 24:
        s.error = "over 24 bits a sample"
    return s


class _Bits:
    """One reading position in ``data`` for each lane."""

    def __init__(self, data: np.ndarray, pos: np.ndarray) -> None:
        self.word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.pos = pos

    def peek(self, lanes=slice(None)) -> np.ndarray:
        p = self.pos[lanes]
        return self.word[np.minimum(p >> 3, len(self.word) - 1)].astype(np.uint64) << (p & 7).astype(np.uint64)

    def read(self, width, lanes=slice(None)) -> np.ndarray:
        """The next ``width`` (0 to 32) bits."""
        width = np.broadcast_to(np.asarray(width), self.pos[lanes].shape)
        v = (self.peek(lanes) >> np.uint64(32)) >> (32 - width).astype(np.uint64)
        self.pos[lanes] += width
        return v.astype(np.int64)

    def signed(self, width, lanes=slice(None)) -> np.ndarray:
        v, width = self.read(width, lanes), np.asarray(width)
        return np.where((width > 0) & (v >> np.maximum(width - 1, 0) & 1 == 1), v - (1 << width), v)

    def unary(self, lanes) -> np.ndarray:
        """Zeros before the next one."""
        count, lanes = np.zeros(len(lanes), np.int64), np.asarray(lanes)
        todo = np.arange(len(lanes))
        while len(todo):
            q = 32 - np.frexp((self.peek(lanes[todo]) >> np.uint64(32)).astype(np.float64))[1]
            count[todo] += q
            done = q < 32
            self.pos[lanes[todo]] += np.where(done, q + 1, 32)
            todo = todo[~done & (self.pos[lanes[todo]] < self.word.shape[0] * 8)]
        return count


def _rice(bits: _Bits, lanes: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Residuals (longest, lanes) of the lanes' coded partitions."""
    method, split = bits.read(2, lanes), bits.read(4, lanes)
    count = size - order
    rank = np.argsort(-count, kind="stable")
    lanes, method, split, count, size, order = lanes[rank], method[rank], split[rank], count[rank], size[rank], order[rank]
    longest = int(count[0]) if len(count) else 0
    out = np.zeros((longest, len(lanes)), np.int32)
    pos = bits.pos[lanes]
    width = np.where(method == 1, 5, 4)
    k, raw = np.zeros(len(lanes), np.uint64), np.full(len(lanes), -1)
    opens = np.zeros(len(lanes), np.int64)  # where the next partition begins
    nth = np.zeros(len(lanes), np.int64)
    ends = np.searchsorted(-count, -np.arange(longest), side="left")
    next_open, wide, escapes = 0, False, False
    word = bits.word
    for i, n in enumerate(ends.tolist()):
        if i >= next_open:
            own = np.flatnonzero(opens[:n] == i)
            bits.pos[lanes] = pos
            got = bits.read(width[own], lanes[own])
            escape = got == (1 << width[own]) - 1
            k[own] = np.where(escape, 0, got).astype(np.uint64)
            raw[own] = -1
            if escape.any():
                raw[own[escape]] = bits.read(5, lanes[own[escape]])
            pos = bits.pos[lanes]
            nth[own] += 1
            opens[own] = np.maximum((nth[own] * (size[own] >> split[own])) - order[own], i + 1)
            more = nth[:n] < (1 << split[:n])
            next_open = int(opens[:n][more].min()) if more.any() else longest
            opens[:n][~more] = longest + 1
            wide, escapes = bool((k[:n] > 24).any()), bool((raw[:n] >= 0).any())
        p = pos[:n]
        w = word[np.minimum(p >> 3, len(word) - 1)].astype(np.uint64) << (p & 7).astype(np.uint64)
        q = 32 - np.frexp((w >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        if wide or escapes or (q.size and q.max() >= 32):
            bits.pos[lanes] = pos
            out[i, :n] = _slow(bits, lanes[:n], k[:n], raw[:n])
            pos = bits.pos[lanes]
            continue
        kn = k[:n]
        v = (w << (q + 1).astype(np.uint64)) >> (np.uint64(64) - kn)
        u = ((q.astype(np.uint64) << kn) | v).astype(np.int64)
        out[i, :n] = (u >> 1) ^ -(u & 1)
        pos[:n] = p + q + 1 + kn.astype(np.int64)
    bits.pos[lanes] = pos
    back = np.empty_like(rank)
    back[rank] = np.arange(len(rank))
    return out[:, back]


def _slow(bits: _Bits, lanes: np.ndarray, k: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One residual of each lane by the general rules."""
    out = np.zeros(len(lanes), np.int64)
    own = np.flatnonzero(raw < 0)
    if len(own):
        q = bits.unary(lanes[own])
        v = bits.read(k[own].astype(np.int64), lanes[own])
        u = (q << k[own].astype(np.int64)) | v
        out[own] = (u >> 1) ^ -(u & 1)
    own = np.flatnonzero(raw > 0)
    if len(own):
        out[own] = bits.signed(raw[own], lanes[own])
    return out


def _subframe(bits: _Bits, lanes: np.ndarray, size: np.ndarray, depth: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Samples (longest, lanes) of one channel."""
    x = np.zeros((int(size.max()), len(lanes)), np.int64)
    head = bits.read(8, lanes)
    kind, wasted = head >> 1 & 63, np.zeros(len(lanes), np.int64)
    own = np.flatnonzero(head & 1)
    if len(own):
        wasted[own] = bits.unary(lanes[own]) + 1
    depth = depth - wasted
    bad[lanes[(head >> 7 == 1) | (kind >= 2) & (kind < 8) | (kind > 12) & (kind < 32) | (depth < 1)]] = True
    own = np.flatnonzero(kind == 0)
    if len(own):
        x[:, own] = bits.signed(depth[own], lanes[own])
    own = np.flatnonzero(kind == 1)
    for t in range(int(size[own].max()) if len(own) else 0):
        here = own[size[own] > t]
        x[t, here] = bits.signed(depth[here], lanes[here])
    own = np.flatnonzero((kind >= 8) & (kind <= 12) | (kind >= 32))
    if len(own):
        order = np.where(kind[own] >= 32, kind[own] - 31, kind[own] - 8)
        most = int(order.max())
        for t in range(most):
            here = own[order > t]
            x[t, here] = bits.signed(depth[here], lanes[here])
        coef, shift = np.zeros((most, len(own)), np.int64), np.zeros(len(own), np.int64)
        lpc = np.flatnonzero(kind[own] >= 32)
        if len(lpc):
            precision = bits.read(4, lanes[own[lpc]]) + 1
            shift[lpc] = np.maximum(bits.signed(5, lanes[own[lpc]]), 0)
            for j in range(most):
                here = lpc[order[lpc] > j]
                coef[j, here] = bits.signed(precision[order[lpc] > j], lanes[own[here]])
        for o in range(1, min(most, 4) + 1):
            here = np.flatnonzero(kind[own] == 8 + o)
            for j in range(o):
                coef[j, here] = FIXED[o][j]
        residual = _rice(bits, lanes[own], size[own], order)
        rank = np.argsort(order, kind="stable")
        whole = x[:, own]
        for o in np.unique(order).tolist():
            mine = rank[order[rank] == o]
            y, c, s = np.ascontiguousarray(whole[:, mine]), coef[:o, mine], shift[mine]
            r = residual[:, mine]
            if o == 0:
                y[: len(r)] = r
            for t in range(o, min(len(y), o + len(r)) if o else 0):
                guess = c[0] * y[t - 1]
                for j in range(1, o):
                    guess += c[j] * y[t - 1 - j]
                y[t] = r[t - o] + (guess >> s)
            whole[:, mine] = y
        x[:, own] = whole
    return x << wasted


def _decode_frames(data: np.ndarray, start: np.ndarray, streams: list[Stream]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """The byte after each frame (checksum included), and its samples (None where a check fails)."""
    n = len(start)
    bits = _Bits(data, start * 8)
    lanes, bad = np.arange(n), np.zeros(n, bool)
    sync, codes, form = bits.read(16), bits.read(8), bits.read(8)
    bad |= (sync | 1) != 0xFFF9
    lead = bits.read(8)
    extra = np.zeros(n, np.int64)
    for j, least in enumerate((0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE), 1):
        extra[lead >= least] = j
    bits.pos += 8 * extra
    code = codes >> 4
    size = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)], 0)
    for c, width in ((6, 8), (7, 16)):
        own = np.flatnonzero(code == c)
        if len(own):
            size[own] = bits.read(width, own) + 1
    for c, width in ((12, 8), (13, 16), (14, 16)):
        own = np.flatnonzero((codes & 15) == c)
        if len(own):
            bits.read(width, own)
    head = bits.pos // 8 - start
    crc = np.zeros(n, np.int64)
    for j in range(int(head.max())):
        own = np.flatnonzero(head > j)
        crc[own] = CRC8[crc[own] ^ data[start[own] + j]]
    bad |= bits.read(8) != crc
    bad |= size < 1
    assigned, depth = form >> 4, np.array([SIZES.get(int(f >> 1 & 7), s.bits) for f, s in zip(form, streams, strict=True)])
    channels = np.where(assigned < 8, assigned + 1, 2)
    bad |= assigned > 10
    size, channels = np.where(bad, 1, size), np.where(bad, 0, channels)
    found = []
    for c in range(int(channels.max()) if n else 0):
        own = np.flatnonzero(channels > c)
        side = (assigned[own] == 8) & (c == 1) | (assigned[own] == 9) & (c == 0) | (assigned[own] == 10) & (c == 1)
        x = np.zeros((int(size.max()), n), np.int64)
        got = _subframe(bits, lanes[own], size[own], depth[own] + side, bad)
        x[: len(got), own] = got
        found.append(x)
    if len(found) > 1:
        left, right = found[0], found[1]
        here = assigned == 8
        right[:, here] = left[:, here] - right[:, here]
        here = assigned == 9
        left[:, here] += right[:, here]
        here = assigned == 10
        mid = (left[:, here] << 1) | (right[:, here] & 1)
        left[:, here], right[:, here] = (mid + right[:, here]) >> 1, (mid - right[:, here]) >> 1
    end = np.minimum(-(-bits.pos // 8), len(data) - 10)
    bad |= end <= start
    length = np.where(bad, 0, end - start)
    crc = crc16(data, start, length)
    bad |= (data[end].astype(np.int64) << 8 | data[end + 1]) != crc
    return end + 2, [None if bad[i] else np.stack([f[: size[i], i] for f in found[: channels[i]]], 1) for i in range(n)]


def decode(blobs: list[bytes | None]) -> list[Stream]:
    """Every stream with its blocks of samples, or with the error that ended it."""
    streams = [_metadata(b) for b in blobs]
    live = [i for i, s in enumerate(streams) if not s.error]
    data = np.frombuffer(b"".join([blobs[i] or b"" for i in live]) + bytes(64), np.uint8).copy()
    base = dict(zip(live, np.cumsum([0, *(len(blobs[i]) for i in live)])[:-1].tolist(), strict=True)) if live else {}
    whole = []
    for i in live:
        s, covered = streams[i], 0
        for sample, _, n in s.points:
            covered = covered + n if sample == covered else -1
            if covered < 0:
                break
        if s.samples and covered == s.samples:
            whole.append(i)
    jobs = [(i, base[i] + streams[i].at + o) for i in whole for _, o, _ in streams[i].points]
    for at in range(0, len(jobs), LANES):
        part = jobs[at : at + LANES]
        _take(data, part, streams, base, blobs)
    turn = {i: base[i] + streams[i].at for i in live if i not in set(whole)}
    while turn:
        part = list(turn.items())
        ends = _take(data, part, streams, base, blobs)
        turn = {i: int(e) for (i, _), e in zip(part, ends, strict=True) if not streams[i].error and e < base[i] + len(blobs[i]) and not (streams[i].samples and sum(map(len, streams[i].blocks)) >= streams[i].samples)}
    for i in live:
        s = streams[i]
        got = sum(map(len, s.blocks))
        if not s.error and s.samples and got != s.samples:
            s.error = f"{got} of {s.samples} samples"
        if not s.error and s.md5 != bytes(16) and hashlib.md5(b"".join(pcm(b, s.bits) for b in s.blocks)).digest() != s.md5:
            s.error = "MD5 differs"
    return streams


def _take(data, part, streams, base, blobs) -> np.ndarray:
    ends, found = _decode_frames(data, np.array([a for _, a in part]), [streams[i] for i, _ in part])
    for (i, _), e, x in zip(part, ends.tolist(), found, strict=True):
        if streams[i].error:
            continue
        if x is None or e > base[i] + len(blobs[i]):
            streams[i].error = f"checksum of frame {len(streams[i].blocks)}"
        else:
            streams[i].blocks.append(x)
    return ends


def pcm(block: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples."""
    width = -(-bits // 8)
    if width == 3:
        return block.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    return block.astype(f"<i{width}").tobytes()


BLOCKS = "blocks array<struct<block: int, sample_offset: bigint, samples: int, pcm: binary>>, channels int, bits int, rate int, error string"


def decode_blocks(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """(*keep, blocks array<struct<block, sample_offset, samples, pcm>>, channels, bits, rate, error) for every row: the
    PCM of each frame that passes its checks; ``keep`` are columns that go with a medium."""
    rows = media.select(*keep, F.col(media_col).alias("_media"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    names = [*keep, "blocks", "channels", "bits", "rate", "error"]
    kind = pa.list_(pa.struct([("block", pa.int32()), ("sample_offset", pa.int64()), ("samples", pa.int32()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blobs in _parts(batch.column(len(keep)).to_pylist()):
                streams, blocks = decode(blobs), []
                for s in streams:
                    at = np.cumsum([0, *map(len, s.blocks)]).tolist()
                    blocks.append([{"block": k, "sample_offset": at[k], "samples": len(x), "pcm": pcm(x, s.bits)} for k, x in enumerate(s.blocks)])
                about = [pa.array([getattr(s, name) or None for s in streams], pa.int32()) for name in ("channels", "bits", "rate")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, len(blobs)) for c in range(len(keep))], pa.array(blocks, kind), *about, pa.array([s.error for s in streams], pa.string())], names)

    return rows.mapInArrow(run, f"{kinds}, {BLOCKS}")


def _parts(blobs: list[bytes | None], most: int = 1 << 21) -> Iterator[tuple[int, list[bytes | None]]]:
    i, size = 0, 0
    for j, b in enumerate(blobs):
        if j > i and size + len(b or b"") > most:
            yield i, blobs[i:j]
            i, size = j, 0
        size += len(b or b"")
    if len(blobs) > i:
        yield i, blobs[i:]


def encode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with 0 to a positive multiple of 64, as a FLAC stream."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for i, part in _parts(blobs):
                media = encode([b + bytes(max(64, -(-len(b) // 64) * 64) - len(b)) for b in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array([len(b) for b in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def store(waves: list[DataFrame], keep: list[str], media_col: str = "media") -> list[DataFrame]:
    """For each table of streams, (*keep, media_bytes, media_sha256, blocks, ...) as of :func:`decode_blocks`, of streams that
    were written to the shared folder and read back."""
    done = []
    for media in waves:
        stored = materialize(media.select(*keep, media_col), "media")
        about = stored.select(*keep, media_col, F.octet_length(media_col).cast("long").alias("media_bytes"), F.sha2(media_col, 256).alias("media_sha256"))
        done.append(materialize(decode_blocks(about, [*keep, "media_bytes", "media_sha256"], media_col), "blocks", compression="zstd"))
        discard(stored)
    return done


def seek(blocks: DataFrame, start: Column, n: Column) -> Column:
    """``n`` samples from sample ``start`` on, as interleaved PCM, of each row of a table of blocks: the blocks that hold
    them are found by their offsets. Past the end there are fewer."""
    width = blocks["channels"] * F.ceil(blocks["bits"] / 8).cast("int")
    inside = F.filter(blocks["blocks"], lambda b: (b["sample_offset"] < start + n) & (b["sample_offset"] + b["samples"] > start))

    def part(b: Column) -> Column:
        first = F.greatest(start - b["sample_offset"], F.lit(0)).cast("int")
        last = F.least(start + n - b["sample_offset"], b["samples"].cast("long")).cast("int")
        return F.substring(b["pcm"], first * width + 1, (last - first) * width)

    return F.aggregate(F.transform(inside, part), F.lit(b"").cast("binary"), lambda done, b: F.concat(done, b))


def feature(x: np.ndarray) -> str:
    """Level, peak and zero crossings of 8-bit samples, and the share of energy in first differences."""
    x = x.astype(np.int64)
    energy, step = int((x * x).sum()), np.diff(x)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};mean={x.mean():.4f};rms={(energy / len(x)) ** 0.5:.4f};peak={int(np.abs(x).max())};crossings={crossings};rough={int((step * step).sum()) / max(energy, 1):.4f}"


MEDIA = "doc_id {}, n_bytes long, media_bytes long, media_sha256 string, error string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def media_features(blocks: DataFrame) -> DataFrame:
    """One row a stream of stored mono 8-bit blocks: what its PCM holds, or nulls and the error. The last 64 samples
    are sought by their offset."""
    tail = seek(blocks, F.greatest(F.aggregate("blocks", F.lit(0).cast("long"), lambda m, b: m + b["samples"]) - 64, F.lit(0).cast("long")), F.lit(64))
    rows = blocks.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "error", F.transform("blocks", lambda b: b["pcm"]).alias("pcm"), tail.alias("tail"))
    schema = MEDIA.format(rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for error, parts, last in zip(*[batch.column(c).to_pylist() for c in (4, 5, 6)], strict=True):
                x = np.frombuffer(b"".join(parts), np.int8)
                if error or not len(x):
                    out.append((None, None, None, None))
                    continue
                back = payload(x)
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(payload(np.frombuffer(last, np.int8))), feature(x)))
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(5)], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", waves: int = 2) -> DataFrame:
    """Texts as stored streams, their stored PCM blocks, and the features of these; a hash deals rows to the waves."""
    deal = F.pmod(F.xxhash64(id_col, text_col), F.lit(waves))
    media = [encode_text(docs.filter(deal == wave), id_col, text_col) for wave in range(waves)]
    out = None
    for blocks in store(media, ["doc_id", "n_bytes"]):
        part = media_features(blocks)
        out = part if out is None else out.unionByName(part)
    return out
