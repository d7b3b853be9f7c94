"""Words of whole texts as arrays: one vectorised pass over the UTF-8 bytes of a batch.

A word is a maximal run of bytes other than 0x09-0x0D and 0x20 after A-Z became a-z.
Its hash is a 64-bit polynomial of its bytes, finished with a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to so many bytes; a longer text is cut between words into pieces of this size.
BATCH_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Tokenises batches; keeps the powers of the base between them."""

    def __init__(self, letters_only: bool = False) -> None:
        code = np.arange(256)
        self.lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
        self.space = (code == 32) | ((code >= 9) & (code <= 13))
        if letters_only:  # every ASCII byte but A-Z and a-z ends a word
            self.lower[(code < 128) & ~((self.lower >= 97) & (self.lower <= 122))] = 32
            self.space = self.lower == 32
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and the starts and ends of the words."""
        raw = self.lower[np.frombuffer(data, np.uint8)]
        inside = np.concatenate(([False], ~self.space[raw], [False]))
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        return raw, turn[0::2], turn[1::2]

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of ``data``."""
        raw, start, end = self.spans(data)
        return start, end, self.hash_spans(raw, start, end)

    def hash_spans(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * self.inverse[start])

    def batches(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, first, starts, ends, hashes) for texts[i:j]: text i+t has words first[t]:first[t+1];
        starts and ends are byte offsets in its own UTF-8 form."""
        i, held, size = 0, [], 0
        for j, text in enumerate(texts):
            blob = (text or "").encode("utf-8", "replace")
            if held and size + len(blob) > BATCH_BYTES:
                yield self._batch(i, held)
                i, held, size = j, [], 0
            held.append(blob)
            size += len(blob) + 1
        if held:
            yield self._batch(i, held)

    def _batch(self, i: int, blobs: list[bytes]):
        if len(blobs) == 1 and len(blobs[0]) > 2 * BATCH_BYTES:
            start, end, hashes = self._long(blobs[0])
            return i, i + 1, np.array([0, len(start)]), start, end, hashes
        start, end, hashes = self.hashes(b"\n".join(blobs))
        offset = np.cumsum([0, *(len(b) + 1 for b in blobs)])
        first = np.searchsorted(start, offset)
        shift = np.repeat(offset[:-1], np.diff(first))
        return i, i + len(blobs), first, start - shift, end - shift, hashes

    def _long(self, blob: bytes) -> tuple[np.ndarray, ...]:
        at, parts = 0, []
        while at < len(blob):
            to = min(len(blob), at + BATCH_BYTES)
            while to < len(blob) and not self.space[blob[to]]:
                to += 1
            start, end, hashes = self.hashes(blob[at:to])
            parts.append((start + at, end + at, hashes))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that stay in one text, and the index where each text's begin (n+1 values)."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    mixed = np.zeros(len(at), np.uint64)
    for j in range(k):
        mixed *= np.uint64(BASE)
        mixed += hashes[at + j]
    return mix64(mixed), begin
